"""Where queries are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of Views under its name; sql: what the other engine runs for the same rows."""

    def put(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return put


def r6(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) and name is None else F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) if name is None else F.round(c, 6).alias(name)


def sql_distance(a: str = "a", b: str = "b", radius: float = 6378000.0) -> str:
    return f"({radius!r} * sqrt(radians({a}.lat - {b}.lat) * radians({a}.lat - {b}.lat) + (radians({a}.lon - {b}.lon) * cos(radians(({a}.lat + {b}.lat) / 2))) * (radians({a}.lon - {b}.lon) * cos(radians(({a}.lat + {b}.lat) / 2)))))"


def sql_x(grid, lon: str = "lon") -> str:
    return f"CAST(trunc(({lon} - ({grid.lon0!r}::DOUBLE)) / {grid.dlon!r}::DOUBLE) AS INT)"


def sql_y(grid, lat: str = "lat") -> str:
    return f"CAST(trunc(({lat} - ({grid.lat0!r}::DOUBLE)) / {grid.dlat!r}::DOUBLE) AS INT)"


def sql_direction(a: str = "a", b: str = "b") -> str:
    d = f"degrees(atan2({b}.lat - {a}.lat, {b}.lon - {a}.lon))"
    return f"(CASE WHEN {d} < 0 THEN {d} + 180 WHEN {d} >= 180 THEN {d} - 180 ELSE {d} END)"
