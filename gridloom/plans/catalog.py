"""All queries on the driver's tables, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import grid as g
from . import aggregates, flows, graphs, joins, scalar, views  # noqa: F401
from .registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    poles = views.Views(spark, sf_dir).v_pole
    pairs = g.near_join(poles, poles, views.CELLS_110, 100.0).where("a.id < b.id")
    d = geo.direction(*[F.col(c) for c in ("a.lat", "a.lon", "b.lat", "b.lon")])
    return pairs.groupBy(F.floor(d / 30).cast("int").alias("sector")).agg(F.count("*").alias("pairs"), F.round(F.avg("d"), 4).alias("mean_d"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
