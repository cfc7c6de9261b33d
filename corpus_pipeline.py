"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the
columns of `documents`; the last returns the packed pieces. Further columns of `docs`, of any name, go. No rows:
no rows. What a stage writes for itself is deleted once its result is written.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import forget, made, only, table, written
from gridloom.llm.jaccard import jaccard_components
from gridloom.llm.lines import dedup_lines
from gridloom.llm.packing import pack
from gridloom.llm.quality import judged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go: null, empty and blank texts too. Each row is judged by itself, repeated ones and those without id too."""
    return judged(docs, table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents go from all but the largest doc_id; n_chars is counted anew. No document goes: one without lines left has empty text, as has one of null text. Rows that share an id count once."""
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 0.8 or more hold together the smallest doc_id stays, with all its rows; documents without words or id stay."""
    gone = jaccard_components(docs, NEAR_WORDS, NEAR_PERCENT).where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of what is left, each row packed by itself; null and empty texts are their end id."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("best_fit_packing", packing),
]

#: Learned rules, similarity components and packing aren't SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        old = made()
        docs = written(stage(spark, docs, sf_dir), name)
        only(old, docs)
        forget(before)
        before = docs
    return docs
