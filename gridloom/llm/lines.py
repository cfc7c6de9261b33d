"""Line dedup: lines whose normalised form stands in many documents go from all but one of them.

Lines are exploded with their places, keyed by 128 bits of hash of their normalised form, and the
distinct documents of each key counted with a partial sum on the map side. Only places of lines to
drop come back to a document; its text moves once, in the join that reassembles it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, strip, written

MIN_CHARS, MIN_DOCS = 20, 3
#: The lines of a key are spread over so many tasks where they meet its row, which is repeated as often.
SALTS = 16


def line_places(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(doc_id, t, pos, h1, h2) of each line with a key of `min_chars` code points or more; t: a hash of the text."""
    whole = docs.select("doc_id", F.xxhash64(text).alias("t"), F.split(lower_ascii(F.col(text)), "\n", -1).alias("lines"))
    each = whole.select("doc_id", "t", F.posexplode("lines").alias("pos", "line")).select("doc_id", "t", "pos", strip(F.col("line")).alias("key"))
    return each.where(F.length("key") >= min_chars).select("doc_id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, keeper) of keys in at least `min_docs` distinct documents; keeper: the largest id."""
    once = lines.where(F.col("doc_id").isNotNull()).select("h1", "h2", "doc_id").distinct()
    return once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")


def dedup_lines(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` with `text` reassembled from the lines that stay, and `n_lines`, `n_dropped` (long).

    Null or empty text is one empty line and gives empty text. A row without doc_id counts for no
    key and loses its lines with frequent keys, as it is not the keeper. Rows that share a doc_id
    count once; the keeper's rows all keep their lines, repeats inside a text included. All other
    columns stay, names that begin with _line_dedup_ excepted; `n_lines` and `n_dropped` of the input, if any, are replaced.
    """
    d = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    lines = written(line_places(d, text, min_chars), "lines")
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "t"), F.lit(SALTS)))
    often = frequent_lines(lines, min_docs).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    hit = salted.join(often, ["h1", "h2", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = hit.groupBy(F.col("doc_id").alias("_line_dedup_id"), F.col("t").alias("_line_dedup_text")).agg(F.collect_set("pos").alias("_line_dedup_drop"))
    on = F.col("doc_id").eqNullSafe(F.col("_line_dedup_id")) & (F.xxhash64(text) == F.col("_line_dedup_text"))
    out = d.join(drops, on, "left")
    split = F.split(F.col(text), "\n", -1)

    def kept(ls: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_line_dedup_drop"))
        return F.struct(F.size(ls).cast("bigint").alias("n"), F.when(F.col("_line_dedup_drop").isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(ls, i)), "\n")).alias("text"))

    out = out.withColumn("_line_dedup_kept", let(split, kept))
    return out.withColumns({"n_lines": F.col("_line_dedup_kept")["n"], "n_dropped": F.coalesce(F.size("_line_dedup_drop"), F.lit(0)).cast("bigint"), text: F.col("_line_dedup_kept")["text"]}).drop("_line_dedup_id", "_line_dedup_text", "_line_dedup_drop", "_line_dedup_kept")
