"""Word shingles of texts as sorted 64-bit hashes, for a batch of texts at a time, straight from Arrow buffers.

A word is hashed eight bytes at a time, each step a bijection that looks random of what was before and the new
bytes; all words of a block take a step together, so no Python object is made per word. (A polynomial modulo
2**64 would be quicker still, but whole families of words have equal values under it, whatever its base.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .common import LOWER, SPACES, UPPER

#: Texts are hashed together up to so many bytes; a longer text is cut at white space.
BLOCK = 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one by a library.
LONG_WORD = 256
#: What keeps the first k of eight bytes.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit numbers whose outputs look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place of `data` as a number; beyond the end are zeros."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def equal_words(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether `size` bytes of `x` from `a` are those of `y` from `b`, for many words at once."""
    out = np.ones(len(a), bool)
    row = np.arange(len(a))
    while len(row):
        out[row] = (x[a] ^ y[b]) & _MASKS[np.minimum(size, 8)] == 0
        more = (size > 8) & out[row]
        row, a, b, size = row[more], a[more] + 8, b[more] + 8, size[more] - 8
    return out


class Hasher:
    """Holds the tables of a task. fold: A-Z count as a-z; lead: the white space before a word is part of it, and so is any at the end of a text; block: bytes hashed together, BLOCK at most."""

    def __init__(self, fold: bool = True, lead: bool = False, block: int = BLOCK) -> None:
        self.lead, self.block = lead, block
        self.same = np.arange(256, dtype=np.uint8)
        if fold:
            self.same[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]
        self.fold = fold
        self.space = np.zeros(256, bool)
        self.space[[ord(c) for c in SPACES]] = True

    def edges(self, data: np.ndarray) -> np.ndarray:
        """Where words, or the white space that belongs to one, may start."""
        space = self.space[data]
        left = np.empty(len(data), bool)
        left[0], left[1:] = True, space[1:] & ~space[:-1] if self.lead else space[:-1]
        return left

    def spans(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes) of the words of `data` (bytes), none of which crosses `cuts`, the ends of its texts."""
        starts, ends = self.bounds(data, cuts)
        return starts, ends, self.hashes(data, starts, ends)

    def bounds(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        left = self.edges(data)
        left[cuts[cuts < len(data)]] = True
        if self.lead:
            starts = np.flatnonzero(left)
            ends = np.append(starts[1:], len(data))
        else:
            space = self.space[data]
            starts = np.flatnonzero(~space & left)
            right = np.empty(len(data), bool)
            right[-1], right[:-1] = True, space[1:]
            right[cuts[cuts > 0] - 1] = True
            ends = np.flatnonzero(~space & right) + 1
        return starts, ends

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = mixed(size.astype(np.uint64) * _STEP)
        row, at, left = np.arange(len(starts)), starts, size
        if len(size) and int(size.max()) > LONG_WORD:
            for i in np.flatnonzero(size > LONG_WORD).tolist():
                out[i] = xxhash.xxh3_64_intdigest(self.same[data[starts[i] : ends[i]]].tobytes())
            row = np.flatnonzero(size <= LONG_WORD)
            at, left = starts[row], size[row]
        chunks = eights(self.same[data] if self.fold else data)
        while len(row):
            out[row] = mixed((out[row] + _STEP) ^ (chunks[at] & _MASKS[np.minimum(left, 8)]))
            more = left > 8
            row, at, left = row[more], at[more] + 8, left[more] - 8
        return out

    def blocks(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(data, cuts, more) of blocks of an Arrow column, null as empty. more: 1 if the block's one text goes on in the next."""
        wide = pa.types.is_large_string(column.type)
        column = column.cast(pa.large_binary() if wide else pa.binary()).fill_null(b"")
        if not len(column):
            return
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
        at, block = 0, min(self.block, BLOCK)
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1)
            part = data[offsets[at] : offsets[to]]
            if len(part) > 2 * block:
                pieces = list(self._pieces(part))
                for k, x in enumerate(pieces):
                    yield x, np.array([len(x)]), int(k + 1 < len(pieces))
            else:
                yield part, offsets[at + 1 : to + 1] - offsets[at], 0
            at = to

    def words(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The word hashes of each text of an Arrow column; null as empty."""
        held: list[np.ndarray] = []
        for data, cuts, more in self.blocks(column):
            starts, _, hashes = self.spans(data, cuts)
            parts = np.split(hashes, np.searchsorted(starts, cuts)[:-1])
            if more or held:
                held.append(parts[0])
                if not more:
                    yield np.concatenate(held)
                    held = []
            else:
                yield from parts

    def _pieces(self, text: np.ndarray) -> Iterator[np.ndarray]:
        at, block = 0, min(self.block, BLOCK)
        while at < len(text):
            to = min(len(text), at + block)
            while to < len(text):
                edge = np.flatnonzero(self.edges(text[to - 3 : to + 4096])[4:])
                if len(edge):
                    to += 1 + int(edge[0])
                    break
                to = min(len(text), to + 4093)
            yield text[at:to]
            at = to

    def sets(self, column: pa.Array, k: int) -> Iterator[np.ndarray]:
        """The distinct k-word shingles of each text, sorted. A text of fewer words is one shingle of them all; one without words has none."""
        for w in self.words(column):
            if not len(w):
                yield w
                continue
            j = min(k, len(w))
            h = mixed(w[: len(w) - j + 1] + np.uint64(j))
            for i in range(1, j):
                h = mixed((h + _STEP) ^ w[i : len(w) - j + 1 + i])
            h.sort()
            yield h[np.concatenate(([True], h[1:] != h[:-1]))]


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    """Arrow lists of int64 from uint64 arrays."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
