"""SentencePiece encoding and decoding with the N best segmentations.

The pieces of a model and their scores span a lattice over a text's characters; a character that is no piece
is one unknown edge, written as its bytes. A forward Viterbi pass gives, for every place, the best score from
the text's start to it: an exact heuristic for an A-star search that runs backward from the end, which thus
meets the N best segmentations in order and expands little else.

Text is cut where no edge can lie across; the lattices of the parts are independent, so the N best of a text
come from the N best of its parts. Parts are searched once a worker; equal parts are told by their bytes.

Scores are the model file's. In a file of a unigram model they are log probabilities, and the best segmentation
is the one the library gives. A file of a merging (BPE) model has minus the rank of each merge there: the best
segmentation is then the one whose pieces have the least sum of ranks, which is seldom the one that merging
reaches (token_counts gives the number of that one). It decodes to the same text.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parts import Grown, PartTable
from .pieces import SPACE, PartHasher, PieceModel, prefixed

N_BEST = 3
#: An unknown character scores so much less than the worst piece of the model.
UNKNOWN_STEP = 10.0
TABLE_PARTS = 1_500_000
#: Ids of a batch that goes back, about.
BATCH_IDS = 2_000_000
#: In parts of more characters edges aren't held but found again on the way back: a number a character is all that stays.
LONG_PART = 2_000

_SEARCHERS: dict[tuple[str, int], Lattice] = {}


def searcher(path: str, n: int) -> Lattice:
    if (path, n) not in _SEARCHERS:
        _SEARCHERS[path, n] = Lattice(path, n)
    return _SEARCHERS[path, n]


class Lattice:
    def __init__(self, path: str, n: int = N_BEST):
        self.model, self.n = PieceModel(path), n
        self.hasher = PartHasher(self.model)
        scores = self.model.scores
        self.pieces = {p: (i, float(scores[i])) for p, i in self.model.normal.items()}
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_STEP
        self.longest = max(map(len, self.pieces))
        self._empty()

    def _empty(self) -> None:
        self.parts = PartTable(self.hasher)
        self.pool, self.first, self.count, self.score = Grown(np.uint32), Grown(np.int64), Grown(np.int64), Grown(float)
        self.step, self.others = Grown(float, (self.n - 1,)), Grown(np.uint32)
        self.other_first, self.other_count = Grown(np.int64, (self.n - 1,)), Grown(np.int64, (self.n - 1,))

    def _edges(self, text: str, j: int, best) -> list[tuple[float, int, int | str, float]]:
        """(best score of a way over the edge, where it begins, piece or character, its score) of the edges that end at `j`, the best first."""
        get, longest = self.pieces.get, self.longest
        edges = []
        for i in range(j - 1, j - 1 - longest if j > longest else -1, -1):
            if found := get(text[i:j]):
                edges.append((best[i] + found[1], i, found[0], found[1]))
        if get(text[j - 1]) is None:
            edges.append((best[j - 1] + self.unknown, j - 1, text[j - 1], self.unknown))
        top = 0
        for k in range(1, len(edges)):
            if edges[k][0] > edges[top][0]:
                top = k
        if top:
            edges[0], edges[top] = edges[top], edges[0]
        return edges

    def search(self, text: str) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a text whose spaces are written as the piece character.

        As the heuristic is exact, the best way on from a place costs nothing more; the search follows it at
        once, and its agenda holds only the n best of the other edges it passes.
        """
        m = len(text)
        best = array("d", bytes(8 * (m + 1)))
        into: list[list[tuple[float, int, int | str, float]]] = [[]]
        for j in range(1, m + 1):
            edges = self._edges(text, j, best)
            best[j] = edges[0][0]
            if m <= LONG_PART:
                into.append(edges)
        out: list[tuple[float, tuple[int, ...]]] = []
        agenda: list[tuple[float, int, tuple, int, float]] = [(-best[m], 0, (), m, 0.0)]
        made = 0
        while agenda and len(out) < self.n:
            _, _, path, at, score = heapq.heappop(agenda)
            while at:
                edges = into[at] if m <= LONG_PART else self._edges(text, at, best)
                for v, i, piece, s in edges[1:]:
                    made += 1
                    heapq.heappush(agenda, (-(v + score), made, (piece, path), i, s + score))
                _, at, piece, s = edges[0]
                path, score = (piece, path), s + score
            if len(agenda) > 4 * self.n:
                agenda = heapq.nsmallest(self.n, agenda)
            ids: list[int] = []
            while path:
                if isinstance(path[0], str):
                    ids += [self.model.bytes[b] for b in path[0].encode("utf-8", "replace")]
                else:
                    ids.append(path[0])
                path = path[1]
            out.append((score, tuple(ids)))
        return out

    def _learn(self, parts: list[bytes]) -> None:
        found = [self.search(p.decode("utf-8", "replace").replace(" ", SPACE)) for p in parts]
        count = np.array([len(x[0][1]) for x in found], np.int64)
        steps = np.full((len(parts), self.n - 1), np.inf)
        lengths = np.zeros((len(parts), self.n - 1), np.int64)
        for k, x in enumerate(found):
            for j in range(1, len(x)):
                steps[k, j - 1] = x[0][0] - x[j][0]
                lengths[k, j - 1] = len(x[j][1])
        self.first.add(self.pool.n + np.cumsum(count) - count)
        self.pool.add(np.fromiter((i for x in found for i in x[0][1]), np.uint32, int(count.sum())))
        self.count.add(count)
        self.score.add(np.array([x[0][0] for x in found]))
        self.step.add(steps)
        self.other_first.add(self.others.n + (np.cumsum(lengths) - lengths.ravel()).reshape(lengths.shape))
        self.others.add(np.fromiter((i for x in found for y in x[1:] for i in y[1]), np.uint32, int(lengths.sum())))
        self.other_count.add(lengths)

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, list[float]]]:
        """(ids of the best segmentation, scores of the n best) of each text; an empty one: no ids, score 0."""
        for ids, scores in self.segmentations(column):
            yield ids[0], scores

    def segmentations(self, column: pa.Array) -> Iterator[tuple[list[np.ndarray], list[float]]]:
        """(ids, scores) of the n best segmentations of each text, best first."""
        held: list[tuple[np.ndarray, float, list[tuple]]] = []
        for data, cuts, more in self.hasher.blocks(prefixed(column)):
            if len(self.parts) > TABLE_PARTS:
                self._empty()
            starts, row = self.parts.rows(data, cuts, self._learn)
            count = self.count.values[row]
            total = np.concatenate(([0], np.cumsum(count)))
            ids = self.pool.values[np.repeat(self.first.values[row] - total[:-1], count) + np.arange(int(total[-1]))]
            sums = np.concatenate(([0.0], np.cumsum(self.score.values[row])))
            step = self.step.values
            edge = np.concatenate(([0], np.searchsorted(starts, cuts)))
            for k in range(len(cuts)):
                a, b = edge[k], edge[k + 1]
                mine = row[a:b]
                if self.n > 1 and len(mine) > self.n - 1:
                    near = np.argpartition(step[mine, 0], self.n - 2)[: self.n - 1].tolist()
                else:
                    near = range(len(mine) if self.n > 1 else 0)
                held.append((ids[total[a] : total[b]], float(sums[b] - sums[a]), [self._ways(int(mine[i]), int(total[a + i] - total[a])) for i in near]))
                if not more:
                    yield self._joined(held)
                    held = []

    def _ways(self, row: int, at: int) -> tuple[tuple[float, ...], int, int, list[np.ndarray]]:
        """(steps, place in the best ids, length there, ids of the other ways) of a part of a text."""
        first, count = self.other_first.values[row].tolist(), self.other_count.values[row].tolist()
        return tuple(self.step.values[row].tolist()), at, int(self.count.values[row]), [self.others.values[f : f + c].copy() for f, c in zip(first, count, strict=True)]

    def _joined(self, held: list[tuple[np.ndarray, float, list[tuple]]]) -> tuple[list[np.ndarray], list[float]]:
        """A text's, from its parts'. Only the n - 1 parts with the smallest first step can differ from the best in the n best."""
        ids = held[0][0] if len(held) == 1 else np.concatenate([x[0] for x in held])
        base, before, ways = sum(x[1] for x in held), 0, []
        for part, _, near in held:
            ways += [(steps, before + at, count, others) for steps, at, count, others in near]
            before += len(part)
        ways = sorted(ways, key=lambda x: x[:2])[: self.n - 1]
        sums = sorted((v, x) for v, x in ((sum((0.0, *w[0])[k] for w, k in zip(ways, x, strict=True)), x) for x in product(range(self.n), repeat=len(ways))) if v != np.inf)
        out = []
        for _, x in sums[: self.n]:
            cuts, end = [], 0
            for at, count, other in sorted((w[1], w[2], w[3][k - 1]) for w, k in zip(ways, x, strict=True) if k):
                cuts += [ids[end:at], other]
                end = at + count
            out.append(np.concatenate([*cuts, ids[end:]]) if cuts else ids)
        return out, [base - v for v, _ in sums[: self.n]]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes joined, piece characters as spaces, the first space gone."""
        raw = b"".join(bytes([int(self.model.names[i][3:5], 16)]) if self.model.kinds[i] == 6 else self.model.names[i].encode() for i in ids)
        return raw.decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")

    def table(self) -> list[bytes]:
        return [bytes([int(x[3:5], 16)]) if k == 6 else x.replace(SPACE, " ").encode() for x, k in zip(self.model.names, self.model.kinds, strict=True)]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint32), *values]).astype(np.int32), kind))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, n: int) -> Iterator[pa.RecordBatch]:
    lattice = searcher(path, n)
    table = lattice.table()
    mark = SPACE.encode()
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.bool_())
    names = ["doc_id", "n_pieces", "ids_crc32", "best_score", "n_best_scores", "round_trip", "n_best_ids"]

    def emitted(rows: list[tuple], segments: list[list[np.ndarray]]) -> pa.RecordBatch:
        inner = _lists([x for ids in segments for x in ids], pa.int32())
        nested = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, segments)]), pa.int32()), inner)
        return pa.RecordBatch.from_arrays([*[pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], nested], names)

    for batch in batches:
        rows, segments, size = [], [], 0
        texts = batch.column("text").cast(pa.large_binary() if pa.types.is_large_string(batch.column("text").type) else pa.binary())
        for doc_id, (all_ids, scores), text in zip(batch.column("doc_id"), lattice.segmentations(batch.column("text")), texts, strict=True):
            ids = all_ids[0]
            back = b"".join([table[i] for i in ids.tolist()])
            rows.append((doc_id.as_py(), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), scores[0], scores, back.removeprefix(b" ") == (text.as_py() or b"").replace(mark, b" ")))
            segments.append(all_ids)
            size += sum(map(len, all_ids))
            if size > BATCH_IDS:
                yield emitted(rows, segments)
                rows, segments, size = [], [], 0
        if rows:
            yield emitted(rows, segments)


def encode_nbest(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, best_score, n_best_scores, round_trip, n_best_ids) of each row.

    n_best_ids has the ids of the n best segmentations, best first, and n_best_scores their scores; fewer where
    there are not so many. ids_crc32 is of the best one's ids (little-endian unsigned 32-bit); round_trip:
    decoding them gives the text (in which a written piece character counts as a space, as the model has it).
    Segmentations of equal score come in a fixed order: the one found first, which is that of the shorter last piece.
    Null and empty texts have one segmentation without pieces, of score 0. Texts of any length are encoded whole.
    Repeated rows and rows without id are encoded row by row; no shuffle. No rows: no rows. Further columns, of any
    name, don't count.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(lambda b: _encoded(b, path, n), "doc_id long, n_pieces long, ids_crc32 long, best_score double, n_best_scores array<double>, round_trip boolean, n_best_ids array<array<int>>")


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    lattice = searcher(path, N_BEST)
    for batch in batches:
        texts = [None if x is None else lattice.decode(x) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode_pieces(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of each row of `rows` (doc_id, ids array<int>); null ids give null."""
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(lambda b: _decoded(b, path), "doc_id long, text string")
