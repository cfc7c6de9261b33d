"""Grids and joins on them. Every distance join is an equi-join on cells with the distance as a residual."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .storage import saved


@dataclass(frozen=True)
class Grid:
    """Origin and cell size in degrees; `metres` is the least width of a cell either way."""

    lat0: float
    lon0: float
    dlat: float
    dlon: float
    metres: float

    def x(self, lon: Column) -> Column:
        return geo.cell(lon, self.lon0, self.dlon)

    def y(self, lat: Column) -> Column:
        return geo.cell(lat, self.lat0, self.dlat)

    def scaled(self, by: float) -> Grid:
        return Grid(self.lat0, self.lon0, self.dlat * by, self.dlon * by, self.metres * by)


def points(df: DataFrame, grid: Grid, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.withColumns({"x": grid.x(F.col(lon)), "y": grid.y(F.col(lat))})


def around(df: DataFrame, reach: int = 1) -> DataFrame:
    """Each row once for each cell within `reach` of its own."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return df.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumns({"x": F.col("x") + F.col("_dx"), "y": F.col("y") + F.col("_dy")}).drop("_dx", "_dy")


def near_join(left: DataFrame, right: DataFrame, grid: Grid, within: float, radius: float = geo.EARTH, inclusive: bool = False, wide: float | None = None) -> DataFrame:
    """Pairs of rows (a: struct of left, b: struct of right, d: metres) closer than `within`. Both have lat and lon.

    The side that is repeated for its nine cells is `left`: give the smaller one. A cell must be as wide as
    `within`, or pairs would be missed; wider ones are narrowed to it. The join sorts, as Spark takes the repeated
    side for as small as before and would gather it on the driver for a broadcast. Crowded cells are left to the
    adaptive skew join. wide: cells are so many times as wide as `within` instead, and a row goes only to those that its
    reach touches, (1 + 2 / wide) ** 2 on average: for rows with few neighbours, which cost less than nine copies.
    """
    if grid.metres < within:
        raise ValueError("cells are narrower than the distance")
    if wide:
        reach, grid = grid.scaled(1.01 * within / grid.metres), grid.scaled(wide * within / grid.metres)
        span = lambda f, c, by: F.explode(F.sequence(f(F.col(c) - by), f(F.col(c) + by)))
        a = left.select(F.struct("*").alias("a"), "lat", "lon").withColumn("x", span(grid.x, "lon", reach.dlon)).withColumn("y", span(grid.y, "lat", reach.dlat)).select("a", "x", "y")
    else:
        grid = grid.scaled(min(1.0, max(1.01 * within, grid.metres / 64) / grid.metres))
        a = around(points(left.select(F.struct("*").alias("a"), "lat", "lon"), grid)).select("a", "x", "y")
    b = points(right.select(F.struct("*").alias("b"), "lat", "lon"), grid).select("b", "x", "y")
    d = geo.distance(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"), radius)
    far = F.abs(F.radians(F.col("a.lat") - F.col("b.lat"))) * radius > 1.001 * within  # cheaper than the distance
    both = a.hint("merge").join(b, ["x", "y"]).where(~far).withColumn("d", d)
    return both.where(F.col("d") <= within if inclusive else F.col("d") < within).select("a", "b", "d")


def forward(df: DataFrame, reach: int) -> DataFrame:
    """Each row once for its own cell (own) and for half of the cells within `reach` of it: of two cells so near each other one is forward of the other."""
    steps = [(dx, dy) for dx in range(reach + 1) for dy in range(-reach, reach + 1) if dx or dy >= 0]
    each = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps]))
    return df.withColumn("_s", each).withColumns({"x": F.col("x") + F.col("_s.dx"), "y": F.col("y") + F.col("_s.dy"), "own": (F.col("_s.dx") == 0) & (F.col("_s.dy") == 0)}).drop("_s")


def near_pairs(rows: DataFrame, grid: Grid, within: float, radius: float = geo.EARTH) -> DataFrame:
    """(a, b, d): ids of two rows (id, lat, lon) closer than `within`, a < b, and their metres. Repeated rows stay repeated.

    near_join() of a table with itself, with two pairs in five of those to be looked at there: cells are half as wide as
    `within`, and a pair is met once, from the one of its cells of which the other is forward.
    """
    if grid.metres < within:
        raise ValueError("cells are narrower than the distance")
    grid, at = grid.scaled(1.01 * within / 2 / grid.metres), points(rows.select("id", "lat", "lon"), grid)
    p, q = forward(at, 2).toDF("p", "plat", "plon", "x", "y", "own"), at.toDF("q", "qlat", "qlon", "x", "y")
    far = F.abs(F.radians(F.col("plat") - F.col("qlat"))) * radius > 1.001 * within  # cheaper than the distance
    both = p.hint("merge").join(q, ["x", "y"]).where(~far & F.when(F.col("own"), F.col("p") < F.col("q")).otherwise(F.col("p") != F.col("q")))
    near = both.withColumn("d", geo.distance(F.col("plat"), F.col("plon"), F.col("qlat"), F.col("qlon"), radius)).where(F.col("d") < within)
    return near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "d")


def far_from(rows: DataFrame, others: DataFrame, grid: Grid, within: float, key: str = "id") -> DataFrame:
    """Rows without any of `others` closer than `within`."""
    near = near_join(others.select("lat", "lon"), rows, grid, within).select(F.col(f"b.{key}").alias(key)).distinct()
    return rows.join(near, key, "left_anti")


def segments(ways: DataFrame) -> DataFrame:
    """(way, lid, lat1, lon1, lat2, lon2) of consecutive vertices of ways (way, nid, lat, lon)."""
    w = Window.partitionBy("way").orderBy("nid")
    out = ways.select("way", F.col("nid").alias("lid"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"))
    return out.where(F.col("lat2").isNotNull())


def line_cells(lines: DataFrame, grid: Grid, *keep: str) -> DataFrame:
    """Distinct (keep..., x, y) of all cells that lines (lat1, lon1, lat2, lon2) touch.

    The cells of both ends, and on each grid line that is crossed the cells on its two sides.
    """
    x1, y1, x2, y2 = grid.x(F.col("lon1")), grid.y(F.col("lat1")), grid.x(F.col("lon2")), grid.y(F.col("lat2"))
    base = lines.select(*keep, "lat1", "lon1", "lat2", "lon2", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    def crossed(a: str, b: str, kind: int) -> Column:
        lo, hi = F.least(a, b), F.greatest(a, b)
        return F.when(lo < hi, F.transform(F.sequence(lo + 1, hi), lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("c")))).otherwise(F.array().cast("array<struct<kind:int,c:int>>"))

    ends = F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).alias("c")))
    each = base.withColumn("g", F.explode(F.concat(ends, crossed("x1", "x2", 1), crossed("y1", "y2", 2))))
    kind, c = F.col("g.kind"), F.col("g.c")
    lon, lat = F.lit(grid.lon0) + c * F.lit(grid.dlon), F.lit(grid.lat0) + c * F.lit(grid.dlat)
    y = grid.y(F.col("lat1") + (F.col("lat2") - F.col("lat1")) * F.try_divide(lon - F.col("lon1"), F.col("lon2") - F.col("lon1")))
    x = grid.x(F.col("lon1") + (F.col("lon2") - F.col("lon1")) * F.try_divide(lat - F.col("lat1"), F.col("lat2") - F.col("lat1")))
    cell = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    two = F.when(kind == 0, F.array(cell(F.col("x1"), F.col("y1")), cell(F.col("x2"), F.col("y2"))))
    two = two.when(kind == 1, F.array(cell(c, y), cell(c - 1, y))).otherwise(F.array(cell(x, c), cell(x, c - 1)))
    return each.select(*keep, F.explode(two).alias("_c")).select(*keep, "_c.x", "_c.y").distinct()


def disk(radius: int) -> list[tuple[int, int, int]]:
    """(ring, dx, dy) within a radius: ring r holds r - 1 < distance <= r; in order of distance, dx, dy."""
    from math import ceil, sqrt

    out = [(dx * dx + dy * dy, dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    return [(ceil(sqrt(q)), dx, dy) for q, dx, dy in sorted(out)]


def offsets(radius: int) -> Column:
    """The disk as an array literal, made in the JVM from two sequences."""
    one = F.sequence(F.lit(-radius), F.lit(radius))
    each = F.flatten(F.transform(one, lambda dx: F.transform(one, lambda dy: F.struct(dx.alias("dx"), dy.alias("dy")))))
    return F.filter(each, lambda o: o["dx"] * o["dx"] + o["dy"] * o["dy"] <= radius * radius)


def dilate(cells: DataFrame, radius: int, *keep: str, distinct: bool = True) -> DataFrame:
    """Cells (keep..., x, y) within `radius` of any. Without `distinct` a cell comes once for each cell it is near."""
    out = cells.withColumn("_o", F.explode(offsets(radius))).select(*keep, (F.col("x") + F.col("_o.dx")).alias("x"), (F.col("y") + F.col("_o.dy")).alias("y"))
    return out.distinct() if distinct else out


def nearest_cell(rows: DataFrame, cells: DataFrame, radius: int, key: str = "id") -> DataFrame:
    """rows (key, x, y) with the nearest of `cells` as nx, ny within `radius`, null if there is none.

    Nearest by ring, then distance, dx, dy. Both sides meet on coarse tiles as wide as the radius, so a row is
    repeated nine times, not once for each cell of the disk.
    """
    tile = max(1, radius)
    t = lambda c: F.floor(F.col(c) / tile).cast("int")
    a = around(rows.select(F.col(key).alias("_k"), F.col("x").alias("ax"), F.col("y").alias("ay")).select("_k", "ax", "ay", F.floor(F.col("ax") / tile).cast("int").alias("x"), F.floor(F.col("ay") / tile).cast("int").alias("y")))
    b = cells.select(F.col("x").alias("bx"), F.col("y").alias("by"), t("x").alias("x"), t("y").alias("y"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    hit = a.hint("merge").join(b, ["x", "y"]).withColumn("q", dx * dx + dy * dy).where(F.col("q") <= radius * radius)
    best = hit.groupBy("_k").agg(F.min(F.struct("q", dx.alias("dx"), dy.alias("dy"), F.col("bx").alias("nx"), F.col("by").alias("ny"))).alias("m"))
    return rows.join(best.select(F.col("_k").alias(key), "m.nx", "m.ny"), key, "left")


def nearest_within(rows: DataFrame, others: DataFrame, grid: Grid, within: float, key: str = "id") -> DataFrame:
    """(row's key, key of the nearest of `others` as nearest) of rows that have one closer than `within`. Ties: the smaller key.

    Reach grows threefold up to `within` and a turn looks at the rows that no nearer turn has served, so crowds are not
    paired in full.
    """
    found = None
    for reach in (within / 27, within / 9, within / 3, within):
        near = near_join(others, rows, grid, reach).select(F.col(f"b.{key}").alias(key), F.struct("d", f"a.{key}").alias("m"))
        best = saved(near.groupBy(key).agg(F.min("m").alias("m")).select(key, F.col(f"m.{key}").alias("nearest")))
        found = best if found is None else found.unionByName(best)
        rows = rows.join(best.select(key), key, "left_anti")
    return found


def nearest_of(rows: DataFrame, others: DataFrame, grid: Grid, key: str = "id") -> DataFrame:
    """(a: row, b: the nearest of `others`, d) of every row: cells and reach grow fourfold until each row has one. Ties: the smaller key of b.

    Rows and others without coordinates have no neighbour: they are left out, as all rows are if `others` has none.
    Each turn's rest is written, and turns end when cells are wider than the earth.
    """
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    left, others = rows.where(placed), others.where(placed)
    found, scale = None, 1
    while True:
        wide = grid.scaled(scale)
        near = near_join(left, others, wide, wide.metres)
        best = saved(near.groupBy("a").agg(F.min_by(F.struct("b", "d"), F.struct("d", f"b.{key}")).alias("m")).select("a", "m.b", "m.d"))
        found = best if found is None else found.unionByName(best)
        left = saved(left.join(best.select(F.col(f"a.{key}").alias(key)).distinct(), key, "left_anti"))
        if left.isEmpty() or wide.metres > 2 * geo.EARTH * 3.15:
            return found
        scale *= 4


def holding(spots: DataFrame, areas: DataFrame, grid: Grid) -> DataFrame:
    """(lat, lon, area) of distinct `spots` and every one of `areas` (area, ring) that holds them.

    An area lies on the level whose cells, 2 ** level times the grid's, are as wide as its box, so it covers four of
    them at most; a spot is looked up once on each level there is. An equi-join on level and cell, whatever the number of
    areas, with the box and the ring as residuals. Areas without ring, and spots without coordinates, are in none.
    """
    ends = {f"{n}_{k}": f(F.col(f"ring.{k}")) for k in ("lat", "lon") for n, f in (("lo", F.array_min), ("hi", F.array_max))}
    boxes = areas.where(F.size("ring") > 0).select("area", "ring", *[c.alias(n) for n, c in ends.items()])
    wide = F.greatest((F.col("hi_lat") - F.col("lo_lat")) / grid.dlat, (F.col("hi_lon") - F.col("lo_lon")) / grid.dlon, F.lit(1.0))
    boxes = boxes.withColumn("level", F.ceil(F.log2(wide)).cast("int"))
    cell = lambda c, origin, size: F.floor((c - F.lit(origin)) / (F.lit(size) * F.pow(F.lit(2.0), F.col("level"))))
    span = lambda k, origin, size: F.explode(F.sequence(cell(F.col(f"lo_{k}"), origin, size), cell(F.col(f"hi_{k}"), origin, size)))
    cover = boxes.withColumn("y", span("lat", grid.lat0, grid.dlat)).withColumn("x", span("lon", grid.lon0, grid.dlon))
    levels = [r[0] for r in boxes.select("level").distinct().collect()]  # some thirty at most
    at = spots.select("lat", "lon").where("lat is not null and lon is not null").distinct().withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    at = at.withColumn("y", cell(F.col("lat"), grid.lat0, grid.dlat)).withColumn("x", cell(F.col("lon"), grid.lon0, grid.dlon))
    inside = (F.col("lat") >= F.col("lo_lat")) & (F.col("lat") <= F.col("hi_lat")) & (F.col("lon") >= F.col("lo_lon")) & (F.col("lon") <= F.col("hi_lon")) & geo.in_ring(F.col("lat"), F.col("lon"), F.col("ring"))
    return at.join(cover, ["level", "x", "y"]).where(inside).select("lat", "lon", "area")


def locate(rows: DataFrame, areas: DataFrame, grid: Grid) -> DataFrame:
    """rows (lat, lon) with `area`, the lowest of `areas` (area, ring) that holds the point, -1 if none does or a coordinate is null. Repeated rows stay repeated."""
    best = holding(rows, areas, grid).groupBy("lat", "lon").agg(F.min("area").alias("area"))
    return rows.join(best, ["lat", "lon"], "left").withColumn("area", F.coalesce("area", F.lit(-1))).select(*rows.columns, "area")
