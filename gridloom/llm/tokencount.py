"""Token counts by rank-synchronous array merging.

The distinct parts of a batch of texts (cut where no piece can lie across) are one ragged
array of symbols. In each round every sequence applies its pair of the lowest rank, leftmost first, all
sequences at once; those without a pair that makes a piece are done, and their symbols counted. Counts of parts
are kept in a table of the worker, so a part is merged once; equal parts are told by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parts import Grown, PartTable
from .pieces import SPACE, PartHasher, PieceModel, prefixed

MAX_TOKENS = 4096
TABLE_PARTS = 3_000_000
#: After so many rounds only long sequences are left; from then on they apply all places of their pair that are sure.
SINGLE_ROUNDS = 12
NONE = np.int64(1 << 30)

_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The worker's own; its table serves all its tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


class TokenCounter:
    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.hasher = PartHasher(self.model)
        self._pairs()
        self.parts, self.counts = PartTable(self.hasher), Grown(np.int64)

    def _pairs(self) -> None:
        """Sorted keys of symbol pairs with the rank and symbol of the piece they make. Symbols: pieces, and characters that are none."""
        normal = self.model.normal
        order = {s: r for r, s in enumerate(sorted({self.model.scores[i] for i in normal.values()}, reverse=True))}
        symbols = dict(normal)
        for p in normal:
            for c in p:
                symbols.setdefault(c, len(self.model.names) + len(symbols))
        found = {}
        self.size = max(symbols.values()) + 2
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    found[a * self.size + b] = (order[self.model.scores[i]], i)
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k][0] for k in self.keys.tolist()], np.int64)
        self.makes = np.array([found[k][1] for k in self.keys.tolist()], np.int64)
        single = sorted((ord(c), i) for c, i in symbols.items() if len(c) == 1)
        self.chars, self.char_symbol = np.array([c for c, _ in single]), np.array([i for _, i in single])
        self.piece = np.zeros(self.size, bool)
        self.piece[list(normal.values())] = True

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, made symbol) of symbol pairs; NONE where they make no piece."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.makes[at]

    def merged_counts(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part; a character outside the model counts its UTF-8 bytes."""
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        out = np.zeros(len(parts), np.int64)
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        known = self.chars[at] == codes
        symbol = np.where(known, self.char_symbol[at], self.size - 1)
        width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        weight = np.where(known & self.piece[symbol], 1, width)
        own = np.repeat(np.arange(len(parts)), sizes)
        rank, makes = self._ranks(symbol, own)
        turn = 0
        while len(symbol):
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), starts)
            live = (best >> 32) < NONE
            lengths = np.diff(np.append(starts, len(symbol)))
            if not live.all():
                done = np.repeat(~live, lengths)
                out += np.bincount(own[done], weights=weight[done], minlength=len(out)).astype(np.int64)
                keep = ~done
                shift = np.cumsum(done)
                where = best[live] & 0xFFFFFFFF
                where = where - shift[where]
                least = best[live] >> 32
                symbol, weight, own, rank, makes = symbol[keep], weight[keep], own[keep], rank[keep], makes[keep]
                lengths = lengths[live]
            else:
                where, least = best & 0xFFFFFFFF, best >> 32
            if not len(symbol):
                break
            turn += 1
            if turn > SINGLE_ROUNDS:
                where = self._sure(symbol, own, rank, makes, where, np.repeat(least, lengths))
            symbol, weight, own, rank, makes = self._apply(symbol, weight, own, rank, makes, where)
        return out

    def _ranks(self, symbol: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, makes = np.full(len(symbol), NONE), np.zeros(len(symbol), np.int64)
        if len(symbol) > 1:
            rank[:-1], makes[:-1] = self._rank(symbol[:-1], symbol[1:])
            rank[:-1][own[1:] != own[:-1]] = NONE
        return rank, makes

    def _apply(self, symbol, weight, own, rank, makes, where):
        """Merges the pairs that start at `where`, no two of which overlap."""
        symbol, weight = symbol.copy(), weight.copy()
        symbol[where], weight[where] = makes[where], 1
        keep = np.ones(len(symbol), bool)
        keep[where + 1] = False
        new = where - np.searchsorted(where, where)
        symbol, weight, own, rank, makes = symbol[keep], weight[keep], own[keep], rank[keep], makes[keep]
        touched = np.unique(np.concatenate((new, new[new > 0] - 1)))
        last = touched == len(symbol) - 1
        rank[touched[last]] = NONE
        touched = touched[~last]
        r, m = self._rank(symbol[touched], symbol[touched + 1])
        rank[touched], makes[touched] = np.where(own[touched] == own[touched + 1], r, NONE), m
        return symbol, weight, own, rank, makes

    def _sure(self, symbol, own, rank, makes, where, least):
        """All places of each sequence's lowest rank, if no pair that comes up meanwhile ranks as low; else its first."""
        low = rank == least
        index = np.arange(len(rank))
        head = low & ~np.concatenate(([False], low[:-1]))
        start = np.maximum.accumulate(np.where(head, index, 0))
        take = low & ((index - start) % 2 == 0)
        at = np.flatnonzero(take)
        after = self._apply(symbol, np.zeros(len(symbol), np.int64), own, rank, makes, at)
        new = at - np.arange(len(at))
        bound = least[at]
        bad = after[3][new] <= bound
        before = np.maximum(new - 1, 0)
        bad |= (new > 0) & (after[3][before] <= bound) & (after[2][before] == own[at])
        near = np.minimum(at + 2, len(symbol) - 1)
        r, _ = self._rank(makes[at], symbol[near])
        bad |= (at + 2 < len(symbol)) & (own[near] == own[at]) & (r <= bound)
        unsure = np.zeros(int(own[-1]) + 1, bool)
        unsure[own[at[bad]]] = True
        first = np.zeros(len(symbol), bool)
        first[where] = True
        return np.flatnonzero(take & (~unsure[own] | first))

    def _learn(self, parts: list[bytes]) -> None:
        self.counts.add(self.merged_counts([x.decode("utf-8", "replace").replace(" ", SPACE) for x in parts]))

    def counts_of(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of an Arrow column; null counts as empty, an empty text has none."""
        out, more_of = [], 0
        for data, cuts, more in self.hasher.blocks(prefixed(column)):
            if len(self.parts) > TABLE_PARTS:
                self.parts.empty()
                self.counts = Grown(np.int64)
            starts, row = self.parts.rows(data, cuts, self._learn)
            total = np.concatenate(([0], np.cumsum(self.counts.values[row])))[np.searchsorted(starts, np.concatenate(([0], cuts)))]
            n = np.diff(total)
            n[0] += more_of
            if more:
                more_of = int(n[0])
            else:
                out.append(n)
                more_of = 0
        return np.concatenate(out) if out else np.empty(0, np.int64)


def _counted(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    tokens = counter(path)
    for batch in batches:
        n = tokens.counts_of(batch.column("text"))
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, path: str, limit: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, null text as empty with no tokens.

    Repeated rows and rows without id are counted row by row; no shuffle. A text of any length is counted whole.
    No rows: no rows. Further columns, of any name, don't count.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(lambda b: _counted(b, path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
