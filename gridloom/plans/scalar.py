"""Queries on projections, filters, grids and linear references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import grid as g
from ..operators import linear
from . import views
from .registry import query, r6, sql_direction, sql_distance, sql_x, sql_y

C2, C40, C110 = views.CELLS_2, views.CELLS_40, views.CELLS_110
_BOX = "lat BETWEEN 37.005 AND 37.030 AND lon BETWEEN -121.990 AND -121.960"


@query(f"""
SELECT a.i, b.j, round(37.0::DOUBLE + a.i * 0.000089::DOUBLE, 6) AS lat, round(-122.0::DOUBLE + b.j * (0.000089::DOUBLE / cos(radians(37.0025::DOUBLE))), 6) AS lon
FROM (SELECT unnest(range(0, 57)) AS i) a, (SELECT unnest(range(0, 45)) AS j) b""")
def p01_mesh(v):
    lat0, lat1, lon0, lon1 = 37.0, 37.005, -122.0, -121.995
    step = F.lit(geo.MESH_STEP) / F.cos(F.radians(F.lit((lat0 + lat1) / 2)))
    one = v.spark.range(1)
    i = F.explode(F.sequence(F.lit(0), F.ceil(F.lit((lat1 - lat0) / geo.MESH_STEP)).cast("int") - 1))
    j = F.explode(F.sequence(F.lit(0), F.ceil(F.lit(lon1 - lon0) / step).cast("int") - 1))
    out = one.select(i.alias("i")).select("i", j.alias("j"))
    return out.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), r6(F.lit(lat0) + F.col("i") * geo.MESH_STEP, "lat"), r6(F.lit(lon0) + F.col("j") * step, "lon"))


@query("SELECT n_regionkey AS region, round(min(lo_lat), 6) AS s, round(max(hi_lat), 6) AS n, round(min(lo_lon), 6) AS w, round(max(hi_lon), 6) AS e FROM (SELECT region AS n_regionkey, * FROM v_area) GROUP BY 1")
def p02_bbox(v):
    p = v.areas().select(F.col("region"), F.explode("ring").alias("p"))
    return p.groupBy("region").agg(r6(F.min("p.lat"), "s"), r6(F.max("p.lat"), "n"), r6(F.min("p.lon"), "w"), r6(F.max("p.lon"), "e"))


@query(f"SELECT way, count(*) AS vertices FROM v_way WHERE way IN (SELECT way FROM v_way WHERE {_BOX}) GROUP BY way")
def p03_way_bbox_semi(v):
    ways = v.v_way
    inside = ways.where(F.col("lat").between(37.005, 37.030) & F.col("lon").between(-121.990, -121.960)).select("way").distinct()
    return ways.join(inside, "way", "left_semi").groupBy("way").agg(F.count("*").alias("vertices"))


_IN = "p.lat >= t.lo_lat AND p.lat <= t.hi_lat AND p.lon >= t.lo_lon AND p.lon <= t.hi_lon"


@query(f"SELECT t.area, count(*) AS n FROM v_pole p JOIN v_area t ON {_IN} GROUP BY t.area")
def p04_pip(v):
    p = v.v_pole
    return p.join(g.holding(p, v.areas(), C110), ["lat", "lon"]).groupBy("area").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT w.way FROM v_way w JOIN v_area t ON t.area % 2 = 0 AND {_IN.replace('p.', 'w.')}")
def p05_poly_semi(v):
    ways = v.v_way
    spots = ways.select("lat", "lon").distinct()
    hit = g.locate(spots, v.areas().where("area % 2 = 0"), C110).where("area >= 0")
    return ways.join(hit, ["lat", "lon"], "left_semi").select("way").distinct()


@query("SELECT way, max(CASE WHEN status <> 'P' THEN tag END) AS top, coalesce(last(tag ORDER BY nid) FILTER (WHERE tag <> '1-URGENT'), 'none') AS tag FROM v_way GROUP BY way")
def p06_tag(v):
    tags = v.v_way.groupBy("way").agg(F.max(F.when(F.col("status") != "P", F.col("tag"))).alias("top"), F.array_sort(F.collect_list(F.struct("nid", "tag"))).alias("t"))
    kept = F.filter(F.transform("t", lambda x: x["tag"]), lambda t: t != "1-URGENT")
    return tags.select("way", "top", F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("none")).alias("tag"))


@query("SELECT way, count(*) AS n FROM v_way WHERE status NOT IN ('P') GROUP BY way")
def p07_class_filter(v):
    return v.v_way.where(~F.col("status").isin("P")).groupBy("way").agg(F.count("*").alias("n"))


@query(f"SELECT p.id, min(t.area) AS area FROM v_true p JOIN v_area t ON {_IN} WHERE p.lat BETWEEN 37.005 AND 37.030 AND p.lon BETWEEN -121.990 AND -121.960 GROUP BY p.id")
def p08_building_filter(v):
    box = v.v_true.where(F.col("lat").between(37.005, 37.030) & F.col("lon").between(-121.990, -121.960))
    return g.locate(box, v.areas(), C110).where("area >= 0").select("id", "area")


@query("SELECT vec_id, label >= 5 AS positive, round(sum(CASE WHEN label >= 5 THEN v ELSE 0 END), 4) AS heat FROM v_cam GROUP BY vec_id, label")
def p09_threshold(v):
    cam = F.when(F.col("label") >= 5, F.transform("embedding", lambda x: x.cast("double"))).otherwise(F.transform("embedding", lambda x: F.lit(0.0)))
    heat = F.aggregate(cam, F.lit(0.0), lambda acc, x: acc + x)
    return v.embeddings.select("vec_id", (F.col("label") >= 5).alias("positive"), F.round(heat, 4).alias("heat"))


@query("SELECT vec_id, round(1 / (1 + exp(embedding[1]::DOUBLE - embedding[2]::DOUBLE)), 6) AS p FROM embeddings")
def p10_softmax(v):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return v.embeddings.select("vec_id", r6(geo.positive_share(e(0), e(1)), "p"))


@query("SELECT sv_id, count(*) AS lines, max(strength) > 50 AS positive FROM v_line GROUP BY sv_id")
def p11_pos_neg(v):
    return v.v_line.groupBy("sv_id").agg(F.count("*").alias("lines"), (F.max("strength") > 50).alias("positive"))


_SEG = "SELECT * FROM (SELECT way, nid AS lid, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM v_way WINDOW w AS (PARTITION BY way ORDER BY nid)) WHERE lat2 IS NOT NULL"


@query(f"SELECT way, lid, round(lat1, 6) AS lat1, round(lon1, 6) AS lon1, round(lat2, 6) AS lat2, round(lon2, 6) AS lon2 FROM ({_SEG})")
def p12_segments(v):
    return g.segments(v.v_way).select("way", "lid", *[r6(c).alias(c) for c in ("lat1", "lon1", "lat2", "lon2")])


@query("""SELECT round(min(lat) - 100 * 8.9831528E-6, 6) AS lat_s, round(max(lat) + 100 * 8.9831528E-6, 6) AS lat_n,
round(min(lon) - 100 * 8.9831528E-6 / cos(radians((min(lat) + max(lat)) / 2)), 6) AS lon_w, round(max(lon) + 100 * 8.9831528E-6 / cos(radians((min(lat) + max(lat)) / 2)), 6) AS lon_e FROM v_way""")
def p13_grid_params(v):
    d = F.lit(geo.DEGREES_PER_METRE)
    dlon = d / F.cos(F.radians((F.min("lat") + F.max("lat")) / 2))
    return v.v_way.agg(r6(F.min("lat") - 100 * d, "lat_s"), r6(F.max("lat") + 100 * d, "lat_n"), r6(F.min("lon") - 100 * dlon, "lon_w"), r6(F.max("lon") + 100 * dlon, "lon_e"))


@query(f"SELECT id, {sql_x(C2)} AS x, {sql_y(C2)} AS y, round({sql_x(C2)} * {C2.dlon!r}::DOUBLE + ({C2.lon0!r}::DOUBLE), 6) AS lon, round({sql_y(C2)} * {C2.dlat!r}::DOUBLE + {C2.lat0!r}::DOUBLE, 6) AS lat FROM v_pole")
def p14_cells(v):
    p = g.points(v.v_pole, C2)
    return p.select("id", "x", "y", r6(geo.corner(F.col("x"), C2.lon0, C2.dlon), "lon"), r6(geo.corner(F.col("y"), C2.lat0, C2.dlat), "lat"))


@query(f"SELECT x, y, count(*) AS n, min(id) AS id FROM (SELECT id, {sql_x(C110)} AS x, {sql_y(C110)} AS y FROM v_pole) GROUP BY x, y")
def p16_raster_points(v):
    return g.points(v.v_pole, C110).groupBy("x", "y").agg(F.count("*").alias("n"), F.min("id").alias("id"))


def _cells_sql(inner: str, grid, keep: str = "way") -> str:
    """Cells of lines (keep, lat1, lon1, lat2, lon2)."""
    lon, lat = f"({grid.lon0!r}::DOUBLE + c * {grid.dlon!r}::DOUBLE)", f"({grid.lat0!r}::DOUBLE + c * {grid.dlat!r}::DOUBLE)"
    ay = sql_y(grid, f"(lat1 + (lat2 - lat1) * ({lon} - lon1) / (lon2 - lon1))")
    ax = sql_x(grid, f"(lon1 + (lon2 - lon1) * ({lat} - lat1) / (lat2 - lat1))")
    return f"""WITH s AS ({inner}), e AS (SELECT *, {sql_x(grid, 'lon1')} AS x1, {sql_y(grid, 'lat1')} AS y1, {sql_x(grid, 'lon2')} AS x2, {sql_y(grid, 'lat2')} AS y2 FROM s),
cx AS (SELECT *, unnest(range(least(x1, x2) + 1, greatest(x1, x2) + 1))::INT AS c FROM e WHERE x1 <> x2),
cy AS (SELECT *, unnest(range(least(y1, y2) + 1, greatest(y1, y2) + 1))::INT AS c FROM e WHERE y1 <> y2),
cells AS (SELECT {keep}, x1 AS x, y1 AS y FROM e UNION SELECT {keep}, x2, y2 FROM e UNION SELECT {keep}, c, {ay} FROM cx UNION SELECT {keep}, c - 1, {ay} FROM cx
UNION SELECT {keep}, {ax}, c FROM cy UNION SELECT {keep}, {ax}, c - 1 FROM cy)"""


@query(_cells_sql(_SEG, C40) + " SELECT way, count(*) AS cells, min(x) AS x0, max(x) AS x1, sum(x * 7 + y) AS mix FROM cells GROUP BY way")
def p17_raster_lines(v):
    c = g.line_cells(g.segments(v.v_way), C40, "way")
    return c.groupBy("way").agg(F.count("*").alias("cells"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.sum((F.col("x") * 7 + F.col("y")).cast("bigint")).alias("mix"))


_LEN = f"SELECT s.*, {sql_distance('a', 'b')} AS len FROM ({_SEG}) s, LATERAL (SELECT s.lat1 AS lat, s.lon1 AS lon) a, LATERAL (SELECT s.lat2 AS lat, s.lon2 AS lon) b"


@query(f"SELECT way, lid, round(len, 4) AS len, round(sum(len) OVER (PARTITION BY way ORDER BY lid), 4) AS cum FROM ({_LEN})")
def p20_cumlen(v):
    s = linear.measured(g.segments(v.v_way))
    return s.select("way", "lid", F.round("len", 4).alias("len"), F.round(F.col("before") + F.col("len"), 4).alias("cum"))


@query(f"""SELECT s.way, s.lid, round(greatest(0, least(1, ((p.lat - lat1) * (lat2 - lat1) + (p.lon - lon1) * (lon2 - lon1)) / ((lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * (lon2 - lon1)))), 6) AS share
FROM ({_SEG}) s JOIN v_pole p ON p.id = s.way WHERE lat1 <> lat2 OR lon1 <> lon2""")
def p21_project(v):
    s = g.segments(v.v_way).where("lat1 <> lat2 or lon1 <> lon2").join(v.v_pole, F.col("way") == F.col("id"))
    return s.select("way", "lid", r6(linear.share_along(F.col("lat"), F.col("lon")), "share"))


@query(f"""WITH l AS ({_LEN}), m AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY way ORDER BY lid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
t AS (SELECT way, sum(len) / 2 AS half FROM l GROUP BY way),
f AS (SELECT m.*, t.half, row_number() OVER (PARTITION BY m.way ORDER BY lid) AS k FROM m JOIN t ON m.way = t.way WHERE before + len > half)
SELECT way, round(lat1 + (lat2 - lat1) * (half - before) / len, 6) AS lat, round(lon1 + (lon2 - lon1) * (half - before) / len, 6) AS lon FROM f WHERE k = 1""")
def p22_interpolate(v):
    s = linear.measured(g.segments(v.v_way))
    half = s.groupBy("way").agg((F.sum("len") / 2).alias("at"))
    return linear.place_at(s, half).select("way", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query("SELECT p_partkey AS id, p_size AS n, unnest(range(0, p_size + 1))::INT AS k, round(p_retailprice + unnest(range(0, p_size + 1)) * (p_retailprice * 2 - p_retailprice) / p_size, 6) AS at FROM part")
def p23_equisect(v):
    cuts = linear.equisect(F.col("p_retailprice"), F.col("p_retailprice") * 2, F.col("p_size"))
    return v.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n"), F.posexplode(cuts).alias("k", "at")).withColumn("at", F.round("at", 6))


@query(f"SELECT a.id, round({sql_direction()}, 6) AS direction, round({sql_distance()}, 4) AS d FROM v_pole a JOIN v_true b ON a.id = b.id WHERE a.lat <> b.lat OR a.lon <> b.lon")
def p24_direction(v):
    a, b = v.v_pole.alias("a"), v.v_true.alias("b")
    c = [F.col(x) for x in ("a.lat", "a.lon", "b.lat", "b.lon")]
    return a.join(b, F.col("a.id") == F.col("b.id")).where("a.lat <> b.lat or a.lon <> b.lon").select("a.id", r6(geo.direction(*c), "direction"), F.round(geo.distance(*c), 4).alias("d"))


@query("SELECT DISTINCT least(o_orderkey, o_custkey) AS a, greatest(o_orderkey, o_custkey) AS b FROM orders")
def p26_canonical(v):
    a, b = geo.ordered(F.col("o_orderkey"), F.col("o_custkey"))
    return v.orders.select(a.alias("a"), b.alias("b")).distinct()


@query("SELECT event_id, round(-degrees(value / 100), 6) AS angle FROM events")
def p27_angle(v):
    return v.events.select("event_id", r6(-F.degrees(F.col("value") / 100), "angle"))


@query("SELECT vec_id, sum(CASE WHEN v * 300 > 80 THEN 10 WHEN v * 300 > 10 THEN 1 ELSE 0 END)::BIGINT AS votes FROM v_cam GROUP BY vec_id")
def p28_regularize(v):
    levels = F.transform("embedding", lambda x: geo.level(x.cast("double") * 300))
    return v.embeddings.select("vec_id", F.aggregate(levels, F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("votes"))


@query(f"SELECT a.id, round({sql_distance('a', 'b')}, 4) AS d1, round({sql_distance('a', 'b', 6378137.0)}, 4) AS d2 FROM v_pole a JOIN v_ins b ON a.id // 20 = b.id")
def p29_distance(v):
    a, b = v.v_pole.alias("a"), v.v_ins.alias("b")
    c = [F.col(x) for x in ("a.lat", "a.lon", "b.lat", "b.lon")]
    return a.join(b, F.floor(F.col("a.id") / 20) == F.col("b.id")).select("a.id", F.round(geo.distance(*c), 4).alias("d1"), F.round(geo.distance(*c, geo.EARTH_RAYS), 4).alias("d2"))


@query(f"SELECT way, round(sum(len), 3) AS total, round(max(len), 4) AS longest FROM ({_LEN}) GROUP BY way")
def p31_hops(v):
    ways = v.v_way.groupBy("way").agg(F.array_sort(F.collect_list(F.struct("nid", "lat", "lon"))).alias("p"))
    hops = ways.withColumn("h", linear.hop_distances(F.col("p"))).where(F.size("h") > 0)
    return hops.select("way", F.round(F.aggregate("h", F.lit(0.0), lambda acc, x: acc + x), 3).alias("total"), F.round(F.array_max("h"), 4).alias("longest"))
