"""Document fingerprints: the k smallest hashes of a text's word shingles (a bottom-k sketch).

A sketch is a sorted array<bigint>. Sketches of parts merge into the sketch of the whole, and two of them
estimate resemblance, containment and the number of distinct shingles. All of it runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, words

SHINGLE_WORDS, SKETCH_SIZE = 5, 128
#: Ranges that follow_up() cuts the ids into: by quantiles, then evenly until about ROWS rows are in each.
COARSE, ROWS = 128, 8192


def shingles(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """Distinct 64-bit hashes of the k-word shingles; a text of fewer words is one shingle, one without words has none."""

    def hashed(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(F.size(w) >= k, each).when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.size(w), F.array_join(w, " "))))

    return F.array_distinct(let(words(text), hashed))


def sketch(text: Column, size: int = SKETCH_SIZE, k: int = SHINGLE_WORDS) -> Column:
    return F.slice(F.sort_array(shingles(text, k)), 1, size)


def merged(a: Column, b: Column, size: int = SKETCH_SIZE) -> Column:
    """The sketch of what two sketches cover together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def merge_groups(df: DataFrame, key: str, column: str, size: int = SKETCH_SIZE) -> DataFrame:
    """(key, column): the sketch of all rows of each key. Each task keeps `size` hashes a key at most, so hot keys are no burden."""
    each = df.select(key, F.explode(column).alias("_h")).distinct()
    first = each.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_h"))).where(F.col("_r") <= size)
    return first.groupBy(key).agg(F.sort_array(F.collect_list("_h")).alias(column))


def resemblance(a: Column, b: Column, size: int = SKETCH_SIZE) -> Column:
    """Share of the smallest hashes of both that both have: an estimate of their Jaccard similarity, exact below `size` shingles. Two empty ones: 1."""
    found = let(merged(a, b, size), lambda u: F.try_divide(F.size(F.array_intersect(F.array_intersect(a, b), u)).cast("double"), F.size(u).cast("double")))
    return F.coalesce(found, F.lit(1.0))


def distinct_shingles(a: Column, size: int = SKETCH_SIZE) -> Column:
    """How many distinct shingles a text has: exact below `size`, else from how dense the smallest hashes lie."""
    reach = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise(F.try_divide(F.lit(float(size - 1)), reach))


def containment(a: Column, b: Column, size: int = SKETCH_SIZE) -> Column:
    """The share of a's shingles that b has, 0 to 1; an empty a: 1."""
    both = resemblance(a, b, size) * distinct_shingles(merged(a, b, size), size)
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(both, distinct_shingles(a, size))), F.lit(1.0))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def follow_up(docs: DataFrame) -> DataFrame:
    """(b, extra, doc_id, h, text): documents in ranges b of doc_id, ordered within one by extra, doc_id, h (a hash of the text).

    The last row of each range, extra = 1, repeats the first row after it, in the last range the very first
    row; so a lead within a range sees every document's successor. Bounds come from COARSE quantiles and the
    least and largest id, the only values that go to the driver. Rows without id, and rows of an id that holds
    several quantiles, are cut into ranges by h.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    at = [i / COARSE for i in range(1, COARSE)]
    found = d.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.percentile_approx("doc_id", at, 10_000).alias("q")).first()
    lo, hi = (found["lo"], found["hi"]) if found["lo"] is not None else (0, 0)
    cuts = [x for x in found["q"] or [] if lo <= x <= hi]
    hot = {x for x in cuts if cuts.count(x) > 1}  # an id of so many rows has ranges of its own, by the hash of the text
    starts = sorted({lo, *(x for x in cuts if x > lo), *hot, *(x + 1 for x in hot if x < hi)})
    stops = [*starts[1:], hi + 1]
    rows = -(-found["ids"] // COARSE)
    parts = [max(1, -(-rows * max(1, cuts.count(x) if x in hot else 1) // ROWS)) for x in starts]
    before = [sum(parts[:i]) for i in range(len(parts))]
    none = max(1, -(-(found["n"] - found["ids"]) // ROWS))
    numbers = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    share = F.col("h").cast("double") / F.lit(2.0**64) + F.lit(0.5)

    def place(c: Column) -> Column:
        first, stop, n = F.get(numbers(starts), c), F.get(numbers(stops), c), F.get(numbers(parts), c)
        part = F.when(F.array_contains(numbers(hot), F.col("doc_id")) if hot else F.lit(False), share).otherwise((F.col("doc_id") - first) / (stop - first))
        return F.get(numbers(before), c) + F.least(F.floor(part * n), n - 1)

    coarse = F.size(F.filter(numbers(starts), lambda x: x <= F.col("doc_id"))) - 1
    b = F.when(F.col("doc_id").isNull(), F.least(F.floor(share * none), F.lit(none - 1)) - none).otherwise(let(coarse, place)).cast("bigint")
    #: A range is some ROWS rows; a task takes two or so, however many there are.
    tasks = max(1, (sum(parts) + none) // 2)
    ranged = d.select(b.alias("b"), F.lit(0).alias("extra"), "doc_id", "h", "text")
    first = ranged.groupBy("b").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    by = Window.orderBy("b")  # a row for each range
    after = first.select("b", F.coalesce(F.lead("first").over(by), F.first("first").over(by)).alias("s")).select("b", "s.doc_id", "s.h")
    texts = ranged.select("doc_id", "h", "text").alias("t").join(F.broadcast(after.select("doc_id", "h").distinct()).alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.h") == F.col("w.h")), "left_semi").dropDuplicates(["doc_id", "h"])
    extra = after.alias("a").join(texts.alias("t"), F.col("a.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("a.h") == F.col("t.h"))).select("a.b", F.lit(1).alias("extra"), "a.doc_id", "a.h", "t.text")
    return ranged.unionByName(extra).repartition(tasks, "b")


def edited_fingerprints(docs: DataFrame, size: int = SKETCH_SIZE, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    A row's edited text has its last floor(n_chars / 2) code points replaced by as many of the next row's
    first, or all it has. Rows follow each other by doc_id, without id first, rows of one id by a hash of the
    text; the first follows the last. Null text is empty. No rows: none. Further columns don't count.
    """
    w = Window.partitionBy("b").orderBy("extra", "doc_id", "h")
    d = follow_up(docs).withColumn("next", F.coalesce(F.lead("text").over(w), F.lit("")))
    half = F.floor(F.length("text") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half)))
    d = d.select("b", "extra", "doc_id", "h", F.length("text").cast("bigint").alias("n_chars"), F.when(F.col("extra") == 0, F.sha2("edited", 256)).alias("edited_sha256"), sketch(F.col("text"), size, k).alias("f"), F.when(F.col("extra") == 0, sketch(F.col("edited"), size, k)).alias("e"))
    d = d.withColumn("g", F.lead("f").over(w)).where("extra = 0")
    return d.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("f")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), resemblance(F.col("f"), F.col("e"), size).alias("near_edited"), resemblance(F.col("f"), F.col("g"), size).alias("near_next"))
