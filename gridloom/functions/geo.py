"""Scalar geometry as Column expressions: all of it stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two earth radii in metres, the latitude step of a metre, the mesh step in degrees.
EARTH, EARTH_RAYS = 6_378_000.0, 6_378_137.0
DEGREES_PER_METRE, MESH_STEP = 8.9831528e-6, 0.000089


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH) -> Column:
    """Equirectangular distance in metres."""
    dlat = F.radians(lat1 - lat2)
    dlon = F.radians(lon1 - lon2) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.lit(radius) * F.sqrt(dlat * dlat + dlon * dlon)


def direction(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Direction of a pair in raw degrees, 0 to below 180."""
    a = F.degrees(F.atan2(lat2 - lat1, lon2 - lon1))
    return F.when(a < 0, a + 180).when(a >= 180, a - 180).otherwise(a)


def ray_end(lat: Column, lon: Column, angle: Column, length: float) -> tuple[Column, Column]:
    """The end of a drawn ray; angle in degrees, length in degrees of latitude."""
    return lat + F.sin(F.radians(angle)) * length, lon + F.cos(F.radians(angle)) * length


def lat_at(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lon: Column) -> Column:
    return lat1 + (lat2 - lat1) * (lon - lon1) / (lon2 - lon1)


def cell(value: Column, origin: Column | float, step: Column | float) -> Column:
    """The index of the cell that holds a coordinate: truncated, as all values lie beyond the origin."""
    return ((value - origin) / step).cast("int")


def corner(index: Column, origin: Column | float, step: Column | float) -> Column:
    """The south or west edge of a cell."""
    return index * step + origin


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd test of a point against an array of (lat, lon) corners, the last tied to the first; lower edges are in."""

    def flipped(odd: Column, edge: Column) -> Column:
        a, b = edge["a"], edge["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        cross = F.when(spans, lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]).otherwise(False)
        return odd != cross

    rotated = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, rotated, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.lit(False), flipped)


def unwrapped(angle: Column) -> Column:
    """An angle of atan2 as 0 to below a full turn, in radians."""
    return F.when(angle < 0, angle + 2 * 3.141592653589793).otherwise(angle)


def positive_share(logit0: Column, logit1: Column) -> Column:
    """Softmax of two logits, second class."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(logit0 - logit1))


def level(value: Column) -> Column:
    """Heat-map value to vote weight."""
    return F.when(value > 80, 10).when(value > 10, 1).otherwise(0)


def bearing_bin(y: Column, x: Column, height: int, width: int) -> Column:
    """Bearing (0 to 359) of a heat-map cell from the image centre; halves round to even."""
    return F.pmod(F.rint(F.degrees(F.atan2((y - height // 2).cast("double"), (x - width // 2).cast("double")))).cast("int"), F.lit(360))


def ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def f1_scores(tp: Column, fp: Column, fn: Column, eps: float = 1e-8, digits: int = 4) -> list[Column]:
    """precision, recall, f1 with a guard added to denominators, rounded."""
    p, r = tp / (tp + fp + eps), tp / (tp + fn + eps)
    return [F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(2 * p * r / (p + r + eps), digits).alias("f1")]
