"""Rows of the distinct parts of texts that a worker has met: found by their hash, told apart by their bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .shingles import Hasher, eights, equal_words


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type, width: tuple[int, ...] = ()):
        self.room, self.n = np.zeros((1024, *width), kind), 0

    def add(self, more: np.ndarray) -> None:
        to = self.n + len(more)
        if to + 8 > len(self.room):
            room = np.zeros((2 * to + 8, *self.room.shape[1:]), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : to] = more
        self.n = to

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


class PartTable:
    """Equal parts have one row. A part whose hash another one has as well gets a row of its own, outside the index."""

    def __init__(self, hasher: Hasher):
        self.hasher = hasher
        self.empty()

    def empty(self) -> None:
        self.hashes, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.bytes, self.first, self.size = Grown(np.uint8), Grown(np.int64), Grown(np.int64)

    def __len__(self) -> int:
        return self.first.n

    def rows(self, data: np.ndarray, cuts: np.ndarray, learn: Callable[[list[bytes]], None]) -> tuple[np.ndarray, np.ndarray]:
        """(starts, rows) of the parts of a block; `learn` is given those that are new, in the order of their rows."""
        starts, ends, hashes = self.hasher.spans(data, cuts)
        size, raw = ends - starts, eights(data)
        one, lead, group = np.unique(hashes, return_index=True, return_inverse=True)
        same = size == size[lead[group]]
        at = np.flatnonzero(same)
        same[at] = equal_words(raw, starts[at], raw, starts[lead[group[at]]], size[at])
        place = np.searchsorted(self.hashes, one)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == one[known]
        found = np.full(len(one), -1)
        found[known] = self.row[place[known]]
        at = np.flatnonzero(known)
        fits = self.size.values[found[at]] == size[lead[at]]
        mine = at[fits]
        fits[fits] = equal_words(raw, starts[lead[mine]], eights_of(self.bytes), self.first.values[found[mine]], size[lead[mine]])
        found[at[~fits]] = -1
        new = np.flatnonzero(~known)
        if len(new):
            found[new] = self._add([data[starts[i] : ends[i]] for i in lead[new].tolist()], learn)
            self.hashes, self.row = np.insert(self.hashes, place[new], one[new]), np.insert(self.row, place[new], found[new])
        out = found[group]
        odd = np.flatnonzero(~same | (out < 0))
        if len(odd):
            texts = [data[starts[i] : ends[i]].tobytes() for i in odd.tolist()]
            distinct = list(dict.fromkeys(texts))
            rows = dict(zip(distinct, self._add([np.frombuffer(x, np.uint8) for x in distinct], learn).tolist(), strict=True))
            out[odd] = [rows[x] for x in texts]
        return starts, out

    def _add(self, parts: list[np.ndarray], learn: Callable[[list[bytes]], None]) -> np.ndarray:
        before, size = len(self), np.array([len(x) for x in parts], np.int64)
        self.first.add(self.bytes.n + np.cumsum(size) - size)
        self.size.add(size)
        self.bytes.add(np.concatenate(parts))
        learn([x.tobytes() for x in parts])
        return np.arange(before, len(self))


def eights_of(pool: Grown) -> np.ndarray:
    """eights() of a pool, without a copy; its room is always eight bytes longer than what is in it."""
    return np.ndarray(len(pool.room) - 7, "<u8", pool.room, strides=(1,))
