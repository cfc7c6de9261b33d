"""Exact Jaccard self-join on word shingles, by prefix filters under several global token orders.

Let t be the threshold, n a set's size and m <= n its partner's. Sets that link share at least ceil(t * n)
tokens, and at least ceil(2t / (1 + t) * m); so under any one order of all tokens they meet in the larger's first
n - ceil(t * n) + 1 ("full" prefix) and the smaller's first m - ceil(2t / (1 + t) * m) + 1 ("mid" prefix).

Order 1 has two levels. Under the order of the hashes, both prefixes made longer by l(size) - 1 have l(m) tokens
in common; so only these few tokens are counted over the corpus, and among them, under the order (documents
that hold it, hash), the first ones must meet. Rare tokens come first, so tokens of passages that many
documents share find hardly a partner. Orders 2 and 3 are other permutations of the hashes. A pair whose
prefixes don't meet under all of them goes before its sets are compared in full. So does one whose bitmaps differ too much: bit i of a set's bitmap is the
parity of its tokens that hash to i, so no fewer tokens than bits can differ. That test is part of the joins'
conditions, for sets that share nearly all tokens but too few.

Links are needed only up to components. Equal sets are one node. As long as tokens join many nodes of different
components, each token's nodes are compared with one leader, and found components merged; what then still lies
in two components is paired in full, so no link between two of them is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, in_parts, written
from .components import components
from .shingles import Hasher, lists, mixed

SHINGLE_WORDS, PERCENT = 3, 90
#: Share of a set's tokens by which the extended prefix is longer than the plain one, in percent.
SLACK_PERCENT = 6
SEEDS = (0x632BE59BD9B4E019, 0xD6E8FEB86659FD93)
#: Nodes are paired in full once that makes no more than so many pairs for each row of the prefixes, or after so many rounds against leaders.
FULL_RATIO, LEADER_ROUNDS = 2, 16
#: Leaders are given up as well when less than this share of a round's pairs links.
FRUITFUL_PERCENT = 5
#: A token's rows are paired in full block by block, of about so many rows each, so that a frequent token is many tasks' work.
BLOCK_ROWS = 2048
#: 64-bit words of a bitmap.
BITMAP_WORDS = 8
BITS = [f"b{i}" for i in range(BITMAP_WORDS)]


def at_least(n, percent: int):
    """ceil(n * percent / 100) in whole numbers."""
    return -(-n * percent // 100)


def extra(n):
    return 1 + n * SLACK_PERCENT // 100


def _digest(s: np.ndarray) -> np.ndarray:
    """128 bits that stand for a set."""
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)


def mid_least(n, percent: int):
    """The overlap that a set of n needs with any partner as large or larger."""
    return -(-2 * percent * n // (100 + percent))


def _bitmap(s: np.ndarray) -> np.ndarray:
    at = (s >> np.uint64(7)).astype(np.int64) & (64 * BITMAP_WORDS - 1)
    odd = np.bincount(at, minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in in_parts(batches):
        sizes, ids, ext, bits = [], [], [], []
        for s in hasher.sets(batch.column("text"), k):
            n = len(s)
            sizes.append(n)
            ids.append(_digest(s))
            bits.append(_bitmap(s))
            ext.append(s[: n - at_least(n, percent) + extra(n)] if n else s)
        two = np.array(ids, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), lists(ext), *[pa.array(x) for x in np.array(bits, np.int64).reshape(-1, BITMAP_WORDS).T.copy()]], ["doc_id", "n", "s1", "s2", "e", *BITS])


def _full(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Sets of the documents of candidate pairs, and their prefixes under orders 2 and 3."""
    hasher = Hasher()
    for batch in in_parts(batches):
        sets = list(hasher.sets(batch.column("text"), k))
        ids = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
        first: tuple[list, list] = ([], [])
        for s in sets:
            for out, seed in zip(first, SEEDS, strict=True):
                p = len(s) - at_least(len(s), percent) + 1
                out.append(s[np.argpartition(mixed(s ^ np.uint64(seed)), p - 1)[:p]] if len(s) else s)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids[:, 0]), pa.array(ids[:, 1]), lists(first[0]), lists(first[1]), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "s1", "s2", "p2", "p3", "s"])


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        keep = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate((x, y))
            both.sort()
            same = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * same >= percent * (len(x) + len(y) - same))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Join:
    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), k, percent
        schema = "doc_id long, n long, s1 long, s2 long, e array<long>, " + ", ".join(f"{b} long" for b in BITS)
        self.sketches = written(self.docs.mapInArrow(lambda b: _sketches(b, k, percent), schema), "sketches")

    def nodes(self) -> None:
        """Sets `member` (doc_id, node): the smallest doc_id with an equal set; and `node`: the sketches of nodes."""
        known = self.sketches.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        one = known.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("s")).select("doc_id", "s.s1", "s.s2")
        first = one.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"))
        self.member = written(one.join(first, ["s1", "s2"]).select("doc_id", "node"), "members")
        head = first.select(F.col("node").alias("doc_id"), "s1", "s2")
        #: Of rows that share a doc_id, one counts; where there are none, nothing need be grouped.
        self.many = known.count() > one.count()
        self.node = known.join(head, ["doc_id", "s1", "s2"], "left_semi")
        self.node = self.node.dropDuplicates(["doc_id"]) if self.many else self.node

    def prefixes(self) -> DataFrame:
        """(token, doc_id, n, c, full, mid) of the prefixes under order 1, of nodes that can have a partner at all.

        full, mid: in that prefix. c: how much the node's tokens are shared, by which leaders are chosen.
        """
        t = self.percent
        tokens = self.node.select("doc_id", "n", F.size("e").alias("ne"), F.posexplode("e").alias("pos", "token"))
        held = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
        least, mid = F.expr(f"(n * {t} + 99) div 100"), F.expr(f"(2 * {t} * n + {99 + t}) div {100 + t}")
        slack = lambda n: F.lit(1) + F.floor(n * SLACK_PERCENT / 100)
        size_mid = F.least(F.col("ne"), F.col("n") - mid + slack(F.col("n")))
        one = F.struct("df", "token", (F.col("pos") < size_mid).alias("mid"))
        shared = tokens.join(held, "token").groupBy("doc_id").agg(F.first("n").alias("n"), F.first("ne").alias("ne"), F.sort_array(F.collect_list(one)).alias("t"))
        shared = shared.withColumn("m", F.filter("t", lambda x: x["mid"])).withColumn("c", F.aggregate("t", F.lit(0.0), lambda acc, x: acc + x["df"]) / F.col("n"))
        full_left = F.size("t") - slack(least) + 1
        mid_left = size_mid - slack(F.col("n")) + 1 - (size_mid - F.size("m"))
        edge = F.get("m", F.greatest(mid_left, F.lit(0)) - 1)  # the last of the mid prefix; null if it is empty
        cut = shared.select("doc_id", "n", "c", "t", full_left.alias("k"), edge.alias("edge"))
        flagged = F.transform("t", lambda x, i: F.struct(x["token"].alias("token"), (i < F.col("k")).alias("full"), F.coalesce(x["mid"] & (F.struct(x["df"], x["token"]) <= F.struct(F.col("edge.df"), F.col("edge.token"))) & F.col("edge").isNotNull(), F.lit(False)).alias("mid")))
        rows = cut.select("doc_id", "n", "c", F.explode(F.filter(flagged, lambda x: x["full"] | x["mid"])).alias("x"))
        return rows.select("x.token", "doc_id", "n", "c", "x.full", "x.mid")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of `pairs` (a, b) that link: prefixes meet under orders 2 and 3, then the sets are compared."""
        k, percent = self.k, self.percent
        who = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = self.docs.join(who, "doc_id", "left_semi").mapInArrow(lambda x: _full(x, k, percent), "doc_id long, s1 long, s2 long, p2 array<long>, p3 array<long>, s binary")
        if self.many:
            sets = sets.join(self.node.select("doc_id", "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi").dropDuplicates(["doc_id"])
        sets = written(sets, "sets")
        first, whole = sets.select("doc_id", "p2", "p3"), sets.select("doc_id", "s")
        met = pairs.join(first.toDF("a", "a2", "a3"), "a").join(first.toDF("b", "b2", "b3"), "b").where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b")
        both = met.join(whole.toDF("a", "sa"), "a").join(whole.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
        out = written(both.mapInArrow(lambda x: _verified(x, percent), "a long, b long"), "links")
        forget(sets)
        return out

    def may(self, n: Column, full: Column, mid: Column, n2: Column, full2: Column, mid2: Column) -> Column:
        """Whether a token's two nodes are candidates: sizes fit, the smaller has it in its mid prefix, the larger in its full one."""
        one = F.when(n <= n2, mid).otherwise(full) & F.when(n2 <= n, mid2).otherwise(full2)
        return one & (100 * F.least(n, n2) >= self.percent * F.greatest(n, n2))

    def alike(self, x: str, y: str) -> Column:
        """Whether the bitmaps of two rows allow the overlap that a link of their sizes needs."""
        n = F.col(f"{x}.n") + F.col(f"{y}.n")
        least = F.ceil(n * self.percent / (100 + self.percent) - F.lit(1e-9))
        apart = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in BITS), F.lit(0))
        return apart <= n - 2 * least

    def run(self) -> DataFrame:
        self.nodes()
        prefix = written(self.prefixes().join(self.node.select("doc_id", *BITS), "doc_id"), "prefixes")
        size = prefix.count()
        links = done = merged = None
        over: list[DataFrame] = [prefix]
        fruitful = True
        for turn in range(LEADER_ROUNDS + 1):
            own = prefix.withColumn("root", F.col("doc_id")) if merged is None else prefix.join(merged, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
            held = own.groupBy("token", "root").agg(F.count("*").cast("double").alias("m"), F.sum(F.col("mid").cast("double")).alias("s"), F.max(F.struct(F.col("c") if turn % 2 == 0 else F.xxhash64("token", F.lit(turn), "root").cast("double").alias("c"), "doc_id", "n", "full", "mid", "root", *BITS)).alias("lead"))
            open_ = held.groupBy("token").agg(F.count("*").alias("roots"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum(F.col("m") * F.col("s")).alias("ms"), F.max("lead").alias("lead")).where("roots > 1 and s > 0")
            work = open_.agg(F.sum(F.col("m") * F.col("s") - F.col("ms"))).first()[0]
            if not work:
                break
            last = work <= FULL_RATIO * size or turn == LEADER_ROUNDS or not fruitful
            if last:
                # tokens of one component are gone, so a group of near copies that leaders have joined makes no pairs here
                blocks = open_.select("token", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("blocks"))
                rest = own.join(blocks, "token").withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
                row, each = ["token", "doc_id", "n", "full", "mid", "root", *BITS], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
                x, y = rest.select(*row, F.col("mine").alias("i"), each.alias("j")).alias("x"), rest.select(*row, each.alias("i"), F.col("mine").alias("j")).alias("y")
                c = lambda t, *names: [F.col(f"{t}.{i}") for i in names]
                pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.root") != F.col("y.root")) & self.may(*c("x", "n", "full", "mid"), *c("y", "n", "full", "mid")) & self.alike("x", "y"))
                pairs = pairs.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
            else:
                ahead = own.alias("x").join(open_.select("token", "lead"), "token").where((F.col("root") != F.col("lead.root")) & self.may(F.col("n"), F.col("full"), F.col("mid"), F.col("lead.n"), F.col("lead.full"), F.col("lead.mid")) & self.alike("x", "lead"))
                pairs = ahead.select(F.least("x.doc_id", "lead.doc_id").alias("a"), F.greatest("x.doc_id", "lead.doc_id").alias("b"))
            pairs = pairs.distinct()
            pairs = written(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
            over.append(pairs)
            tried = pairs.count()
            fruitful = False
            if tried:
                found = self.linked(pairs)
                done = pairs if done is None else done.unionByName(pairs)
                over.append(found)
                hits = found.count()
                fruitful = 100 * hits >= FRUITFUL_PERCENT * tried
                if hits:
                    links = found if links is None else links.unionByName(found)
                    old, merged = merged, written(components(links), "roots")
                    forget(old)
            if last:
                break
        forget(*over)
        if merged is None:
            return self.member.select("doc_id", F.col("node").alias("component_id"))
        roots = self.member.join(merged.select(F.col("doc_id").alias("node"), "root"), "node", "left")
        return roots.select("doc_id", F.coalesce("root", "node").alias("component_id"))


def jaccard_components(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of `docs` (doc_id, text; further columns don't count).

    component_id is the smallest doc_id that links reach. Null, empty and blank texts have no shingles and
    link with nothing. Rows without doc_id keep a null component and link with nothing. Rows that share a
    doc_id are one document: the set of one of them, the one with the smallest set hash, links; each row
    returns its own n_shingles.
    """
    join = _Join(docs, k, percent)
    found = join.run()
    rows = join.sketches.select("doc_id", F.col("n").alias("n_shingles"))
    return rows.join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
