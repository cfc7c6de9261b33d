"""Queries on aggregates, windows, set operations and rasters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import cam, linear
from ..operators import grid as g
from ..sources import kml
from . import views
from .joins import _POS, _near_sql, marks
from .registry import query, r6, sql_x, sql_y
from .scalar import _SEG, _cells_sql

C2, C40, C110 = views.CELLS_2, views.CELLS_40, views.CELLS_110


@query("SELECT node, count(*) AS refs, string_agg(way || ':' || nid, ',' ORDER BY way, nid) AS list FROM v_way GROUP BY node")
def a01_node_refs(v):
    ref = F.array_sort(F.collect_list(F.struct("way", "nid")))
    return v.v_way.groupBy("node").agg(F.count("*").alias("refs"), F.array_join(F.transform(ref, lambda x: F.concat_ws(":", x["way"], x["nid"])), ",").alias("list"))


@query("""WITH e AS (SELECT way, max(nid) AS last FROM v_way GROUP BY way) SELECT node FROM v_way JOIN e ON v_way.way = e.way
GROUP BY node HAVING count(*) = 2 AND min(CASE WHEN nid = 0 OR nid = last THEN 1 ELSE 0 END) = 1 AND min(v_way.way) <> max(v_way.way)""")
def a02_mergeable(v):
    w = v.v_way
    ends = w.groupBy("way").agg(F.max("nid").alias("last"))
    end = ((F.col("nid") == 0) | (F.col("nid") == F.col("last"))).cast("int")
    n = w.join(ends, "way").groupBy("node").agg(F.count("*").alias("refs"), F.min(end).alias("ends"), F.min("way").alias("a"), F.max("way").alias("b"))
    return n.where("refs = 2 and ends = 1 and a <> b").select("node")


#: Road classes' weights, by the priorities that stand for classes here.
WEIGHTS = {"1-URGENT": 0.1, "2-HIGH": 0.125, "3-MEDIUM": 0.2, "4-NOT SPECIFIED": 0.25, "5-LOW": 1 / 3}
_W = "CASE tag " + " ".join(f"WHEN '{k}' THEN {w!r}::DOUBLE" for k, w in WEIGHTS.items()) + " ELSE 1.0 END"


@query(f"SELECT x, y, round(min(w), 6) AS w FROM (SELECT {sql_x(C40)} AS x, {sql_y(C40)} AS y, {_W} AS w FROM v_way) GROUP BY x, y")
def a04_cell_weight(v):
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("tag")), F.lit(1.0))
    return g.points(v.v_way, C40).groupBy("x", "y").agg(r6(F.min(w), "w"))


@query("""WITH b AS (SELECT vec_id, ((round_even(degrees(atan2(y - 4, x - 4)), 0)::INT % 360) + 360) % 360 AS bin, sum(v) AS heat FROM v_cam GROUP BY 1, 2)
SELECT vec_id, bin AS bearing, round(heat, 4) AS heat FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(heat, 4) DESC, bin) AS k FROM b) WHERE k = 1""")
def a05_bearing(v):
    return cam.bearings(cam.pixels(v.embeddings, "vec_id", "embedding", 8), "vec_id", 8, 8)


_VOTES = """SELECT vec_id, round(round(x * cos(radians(t::DOUBLE)) + y * sin(radians(t::DOUBLE)), 9))::INT AS rho, t::INT AS theta, sum(CASE WHEN v * 300 > 80 THEN 10 ELSE 1 END)::BIGINT AS votes
FROM v_cam, (SELECT unnest(range(-90, 91)) AS t) WHERE v * 300 > 10 GROUP BY 1, 2, 3"""


def _votes(cams):
    return cam.hough_votes(cam.pixels(cams, "vec_id", "embedding", 8), "vec_id", 300.0)


@query(_VOTES)
def a06_hough_votes(v):
    return _votes(v.embeddings)


@query(f"SELECT vec_id, rho, theta, votes FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, rho, theta) AS k FROM ({_VOTES})) WHERE k = 1")
def a07_hough_peak(v):
    return cam.peaks(_votes(v.embeddings), "vec_id")


@query("SELECT sv_id, round(coalesce(sum(angle * strength) / nullif(sum(strength), 0), -180), 6) AS angle FROM v_line GROUP BY sv_id")
def a08_weighted_avg(v):
    return v.v_line.groupBy("sv_id").agg(r6(F.coalesce(F.try_divide(F.sum(F.col("angle") * F.col("strength")), F.sum("strength")), F.lit(-180.0)), "angle"))


@query("SELECT sv_id, event_id, round(d, 6) AS d FROM (SELECT sv_id, event_id, abs(angle - 30) AS d, row_number() OVER (PARTITION BY sv_id ORDER BY abs(angle - 30), event_id) AS k FROM v_line) WHERE k = 1")
def a09_min_angle(v):
    d = F.abs(F.col("angle") - 30)
    m = v.v_line.groupBy("sv_id").agg(F.min(F.struct(d.alias("d"), "event_id")).alias("m"))
    return m.select("sv_id", "m.event_id", r6("m.d").alias("d"))


@query("SELECT c_custkey AS id, round(coalesce(avg(CASE WHEN strength > 50 THEN 1.0::DOUBLE ELSE 0 END), 0), 6) AS rate FROM customer LEFT JOIN v_line ON sv_id % 3000 = c_custkey GROUP BY 1")
def a10_pos_rate(v):
    both = v.customer.join(v.v_line, F.col("sv_id") % 3000 == F.col("c_custkey"), "left")
    return both.groupBy(F.col("c_custkey").alias("id")).agg(r6(F.coalesce(F.avg(F.when(F.col("strength") > 50, 1.0).when(F.col("strength").isNotNull(), 0.0)), F.lit(0.0)), "rate"))


def _prf(eps: str) -> str:
    p, r = f"tp / (tp + fp + {eps}::DOUBLE)", f"tp / (tp + fn + {eps}::DOUBLE)"
    return f"round({p}, 4) AS precision, round({r}, 4) AS recall, round(2 * ({p}) * ({r}) / (({p}) + ({r}) + {eps}::DOUBLE), 4) AS f1"


def confusion(truth, guess):
    c = lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("double")
    return [c(truth & guess).alias("tp"), c(~truth & guess).alias("fp"), c(truth & ~guess).alias("fn"), c(~truth & ~guess).alias("tn")]


_CONF = "sum(CASE WHEN {t} AND {g} THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN NOT {t} AND {g} THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN {t} AND NOT {g} THEN 1 ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN NOT {t} AND NOT {g} THEN 1 ELSE 0 END)::DOUBLE AS tn"


@query(f"SELECT tp, fp, fn, tn, {_prf('0.00000001')} FROM (SELECT {_CONF.format(t='truth = 1', g='score >= 0.2')} FROM v_pred)")
def a11_confusion(v):
    c = v.v_pred.agg(*confusion(F.col("truth") == 1, F.col("score") >= 0.2))
    return c.select("*", *geo.f1_scores(F.col("tp"), F.col("fp"), F.col("fn")))


@query(f"SELECT n AS bucket, {_prf('0.00001')} FROM (SELECT doc_id % 5 AS n, {_CONF.format(t='truth = 1', g='score >= 0.3')} FROM v_pred GROUP BY 1)")
def a12_image_metrics(v):
    c = v.v_pred.groupBy((F.col("doc_id") % 5).alias("bucket")).agg(*confusion(F.col("truth") == 1, F.col("score") >= 0.3))
    return c.select("bucket", *geo.f1_scores(F.col("tp"), F.col("fp"), F.col("fn"), 1e-5))


_SWEEP = f"SELECT k, {_prf('0.00001')} FROM (SELECT k, {_CONF.format(t='truth = 1', g='score >= k / 100.0::DOUBLE')} FROM v_pred, (SELECT unnest(range(0, 101)) AS k) GROUP BY k)"


@query(f"SELECT k::INT AS k, precision, recall, f1, f1 = max(f1) OVER () AND k = (SELECT min(k) FROM ({_SWEEP}) WHERE f1 = (SELECT max(f1) FROM ({_SWEEP}))) AS best FROM ({_SWEEP})")
def a13_sweep(v):
    # scores are counted per whole hundredth first, so thresholds multiply 101 rows, not the table
    step = F.floor(F.col("score") * 100)
    step = step + F.when((step + 1) / 100 <= F.col("score"), 1).otherwise(0) - F.when(step / 100 > F.col("score"), 1).otherwise(0)
    per = v.v_pred.groupBy(step.alias("s")).agg(F.sum(F.col("truth").cast("double")).alias("pos"), F.sum(1.0 - F.col("truth")).alias("neg"))
    at = per.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(100))))
    on = F.col("s") >= F.col("k")
    c = at.groupBy("k").agg(F.sum(F.when(on, F.col("pos")).otherwise(0.0)).alias("tp"), F.sum(F.when(on, F.col("neg")).otherwise(0.0)).alias("fp"), F.sum(F.when(~on, F.col("pos")).otherwise(0.0)).alias("fn"))
    c = c.select("k", *geo.f1_scores(F.col("tp"), F.col("fp"), F.col("fn"), 1e-5))
    best = c.agg(F.max_by("k", F.struct("f1", -F.col("k"))).alias("b"))
    return c.join(F.broadcast(best), F.lit(True)).select("k", "precision", "recall", "f1", (F.col("k") == F.col("b")).alias("best"))  # one row




def _sets_sql(grid) -> str:
    return _cells_sql(_SEG, grid) + ", p AS (SELECT DISTINCT x, y FROM cells WHERE way % 3 <> 0), t AS (SELECT DISTINCT x, y FROM cells WHERE way % 3 <> 1)"


def cell_sets(v, grid):
    c = g.line_cells(g.segments(v.v_way), grid, "way")
    return c.where("way % 3 <> 0").select("x", "y").distinct(), c.where("way % 3 <> 1").select("x", "y").distinct()


_IOU = "SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp + fn), 6) AS iou FROM m"


@query(_sets_sql(C40) + f", m AS (SELECT (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM t))::DOUBLE AS tp, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM t))::DOUBLE AS fp, (SELECT count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM p))::DOUBLE AS fn) {_IOU}")
def a16_discretized(v):
    p, t = cell_sets(v, C40)
    both = p.withColumn("p", F.lit(1)).join(t.withColumn("t", F.lit(1)), ["x", "y"], "full")
    m = both.agg(F.sum(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1.0).otherwise(0.0)).alias("tp"), F.sum(F.when(F.col("t").isNull(), 1.0).otherwise(0.0)).alias("fp"), F.sum(F.when(F.col("p").isNull(), 1.0).otherwise(0.0)).alias("fn"))
    return _ratios(m)


def _ratios(m):
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return m.select("*", r6(F.try_divide(tp, tp + fp), "precision"), r6(F.try_divide(tp, tp + fn), "recall"), r6(F.try_divide(tp, tp + fp + fn), "iou"))


_ROLL = _cells_sql(_SEG, C40) + """, p AS (SELECT DISTINCT way % 4 AS area, x, y FROM cells WHERE way % 3 <> 0), t AS (SELECT DISTINCT way % 4 AS area, x, y FROM cells WHERE way % 3 <> 1),
b AS (SELECT coalesce(p.area, t.area) AS area, p.x IS NOT NULL AS p, t.x IS NOT NULL AS t FROM p FULL JOIN t ON p.area = t.area AND p.x = t.x AND p.y = t.y)
SELECT area, sum((p AND t)::INT)::BIGINT AS tp, sum((NOT t)::INT)::BIGINT AS fp, sum((NOT p)::INT)::BIGINT AS fn FROM b GROUP BY ROLLUP(area)"""


@query(_ROLL)
def a17_rollup(v):
    c = g.line_cells(g.segments(v.v_way), C40, "way").withColumn("area", F.col("way") % 4)
    p = c.where("way % 3 <> 0").select("area", "x", "y").distinct().withColumn("p", F.lit(True))
    t = c.where("way % 3 <> 1").select("area", "x", "y").distinct().withColumn("t", F.lit(True))
    n = lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("bigint")
    both = p.join(t, ["area", "x", "y"], "full")
    return both.rollup("area").agg(n(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), n(F.col("t").isNull()).alias("fp"), n(F.col("p").isNull()).alias("fn"))


def _points_sql(view: str, grid, where: str = "TRUE") -> str:
    return f"SELECT DISTINCT {sql_x(grid)} AS x, {sql_y(grid)} AS y FROM {view} WHERE {where}"


def _dilated_sql(cells: str, r: int) -> str:
    return f"SELECT DISTINCT x + dx AS x, y + dy AS y FROM {cells}, (SELECT unnest(range(-{r}, {r + 1}))::INT AS dx) i, (SELECT unnest(range(-{r}, {r + 1}))::INT AS dy) j WHERE dx * dx + dy * dy <= {r * r}"


@query(f"WITH p AS ({_points_sql('v_pole', C2)}), t AS ({_points_sql('v_true', C2)}), dp AS ({_dilated_sql('p', 10)}), dt AS ({_dilated_sql('t', 10)}) SELECT round((SELECT count(*) FROM p SEMI JOIN dt USING (x, y)) / (SELECT count(*) FROM p)::DOUBLE, 6) AS precision, round((SELECT count(*) FROM t SEMI JOIN dp USING (x, y)) / (SELECT count(*) FROM t)::DOUBLE, 6) AS recall")
def a18_dilated(v):
    p, t = (g.points(x, C2).select("x", "y").distinct() for x in (v.v_pole, v.v_true))
    share = lambda a, b, name: a.join(g.dilate(b, 10).withColumn("in", F.lit(1)), ["x", "y"], "left").agg(r6(F.try_divide(F.count("in").cast("double"), F.count("*").cast("double")), name))
    return share(p, t, "precision").join(share(t, p, "recall"), F.lit(True))  # one row each


@query(f"WITH p AS (SELECT DISTINCT id % 4 AS area, {sql_x(C2)} AS x, {sql_y(C2)} AS y FROM v_pole), t AS (SELECT DISTINCT {sql_x(C2)} AS x, {sql_y(C2)} AS y FROM v_true), dt AS ({_dilated_sql('t', 10)}) SELECT area, count(*) AS n, count(dt.x) AS hit FROM p LEFT JOIN dt USING (x, y) GROUP BY ROLLUP(area)")
def a19_dilated_rollup(v):
    p = g.points(v.v_pole, C2).select((F.col("id") % 4).alias("area"), "x", "y").distinct()
    d = g.dilate(g.points(v.v_true, C2).select("x", "y").distinct(), 10).withColumn("in", F.lit(1))
    return p.join(d, ["x", "y"], "left").rollup("area").agg(F.count("*").alias("n"), F.count("in").alias("hit"))


@query(f"SELECT count(*) AS pairs, sum((a % 2 = 0 AND b % 2 = 0)::INT)::BIGINT AS both_matched, sum((a % 2 = 1 OR b % 2 = 1)::INT)::BIGINT AS some_unmatched FROM ({_near_sql('v_pole', 'v_pole', 100.0, 'a.id < b.id')})")
def a22_coverage(v):
    e = g.near_pairs(v.v_pole, C110, 100.0)
    even = (F.col("a") % 2 == 0) & (F.col("b") % 2 == 0)
    n = lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("bigint")
    return e.agg(F.count("*").alias("pairs"), n(even).alias("both_matched"), n(~even).alias("some_unmatched"))


@query(f"""WITH e AS (SELECT a, b FROM ({_near_sql('v_pole', 'v_pole', 60.0, 'a.id < b.id')})), t AS (SELECT a, b FROM ({_near_sql('v_pole', 'v_pole', 80.0, 'a.id < b.id')}) WHERE (a + b) % 2 = 0),
m AS (SELECT (SELECT count(*) FROM e SEMI JOIN t USING (a, b))::DOUBLE AS tp, (SELECT count(*) FROM e ANTI JOIN t USING (a, b))::DOUBLE AS fp, (SELECT count(*) FROM t ANTI JOIN e USING (a, b))::DOUBLE AS fn) {_IOU}""")
def a15_link_metrics(v):
    e = g.near_pairs(v.v_pole, C110, 80.0)
    p, t = F.col("d") < 60, (F.col("a") + F.col("b")) % 2 == 0
    return _ratios(e.agg(*[F.sum(F.when(x, 1.0).otherwise(0.0)).alias(n) for x, n in ((p & t, "tp"), (p & ~t, "fp"), (~p & t, "fn"))]))


@query(f"WITH m AS ({_POS}) SELECT way, id, row_number() OVER (PARTITION BY way ORDER BY length, kind, id) - 1 AS rank FROM m WHERE kind < 2")
def w01_rank(v):
    return linear.ranked(marks(v).where("kind < 2")).select("way", "id", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH m AS ({_POS}) SELECT s.way, s.id AS sv_id, (SELECT count(*) FROM m p WHERE p.kind < 2 AND p.way = s.way AND p.length <= s.length) - 1 AS slot FROM m s WHERE s.kind = 2")
def w02_slots(v):
    m = marks(v)
    return linear.slots(m.where("kind < 2"), m.where("kind = 2").withColumnRenamed("id", "sv_id")).select("way", "sv_id", F.col("slot").cast("bigint").alias("slot"))


_GAPS = f"WITH m AS ({_POS}), g AS (SELECT way, id, length AS a, lead(length) OVER (PARTITION BY way ORDER BY length, kind, id) AS b FROM m WHERE kind < 2)"


@query(_GAPS + " SELECT way, id, round(b - a, 6) AS gap FROM g WHERE b IS NOT NULL")
def w03_gaps(v):
    return gaps(v).select("way", "id", r6(F.col("b") - F.col("a"), "gap"))


def gaps(v):
    w = Window.partitionBy("way").orderBy("length", "kind", "id")
    return marks(v).where("kind < 2").select("way", "id", F.col("length").alias("a"), F.lead("length").over(w).alias("b")).where("b is not null")


def road_poles(v, kinds="kind < 2"):
    """(way, id, length, lat, lon): marks of ways, at their length modulo the way's, a few metres beside the road."""
    s = linear.measured(g.segments(v.v_way)).where("len > 0")
    size = s.groupBy("way").agg(F.sum("len").alias("all"))
    m = marks(v).where(kinds).join(size, "way").select("way", "id", (F.col("length") % F.col("all")).alias("at"))
    beside = F.lit(0.00002) * (F.col("id") % 3)
    return linear.place_at(s, m).select("way", "id", F.col("at").alias("length"), (F.col("lat") + beside).alias("lat"), (F.col("lon") - beside).alias("lon"))


def road_gaps(poles):
    """(way, id, a, b, p, q) of neighbouring poles of a way; id is the first one's."""
    w = Window.partitionBy("way").orderBy("length", "id")
    here = F.struct("lat", "lon")
    return poles.select("way", "id", F.col("length").alias("a"), F.lead("length").over(w).alias("b"), here.alias("p"), F.lead(here).over(w).alias("q")).where("b is not null")


_D = lambda a, b, c, d: f"(6378000.0 * sqrt(radians({a} - {c}) ** 2 + (radians({b} - {d}) * cos(radians(({a} + {c}) / 2))) ** 2))"


@query(f"""WITH e AS (SELECT way, nid, lat AS y1, lon AS x1, lead(lat) OVER w AS y2, lead(lon) OVER w AS x2 FROM v_way WINDOW w AS (PARTITION BY way ORDER BY nid)),
l AS (SELECT *, {_D('y1', 'x1', 'y2', 'x2')} AS len FROM e WHERE y2 IS NOT NULL),
s AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY way ORDER BY nid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l WHERE len > 0),
m AS ({_POS}), t AS (SELECT way, sum(len) AS total FROM s GROUP BY way),
u AS (SELECT m.way, m.id, m.length % t.total AS pos FROM m JOIN t ON m.way = t.way WHERE kind < 2),
p AS (SELECT u.way, u.id, u.pos, y1 + (y2 - y1) * (u.pos - before) / len + 0.00002 * (u.id % 3) AS lat, x1 + (x2 - x1) * (u.pos - before) / len - 0.00002 * (u.id % 3) AS lon FROM u JOIN s ON u.way = s.way AND before <= u.pos AND before + len > u.pos),
g AS (SELECT way, id, pos AS a, lead(pos) OVER w AS b, lat AS py, lon AS px, lead(lat) OVER w AS qy, lead(lon) OVER w AS qx FROM p WINDOW w AS (PARTITION BY way ORDER BY pos, id)),
c AS (SELECT g.*, n, k, a + k * (b - a) / n AS pos FROM g, (SELECT unnest(range(2, 6)) AS n) nn, LATERAL (SELECT unnest(range(1, n)) AS k) kk WHERE b IS NOT NULL AND {_D('py', 'px', 'qy', 'qx')} > 70),
i AS (SELECT c.*, y1 + (y2 - y1) * (c.pos - before) / len AS y, x1 + (x2 - x1) * (c.pos - before) / len AS x FROM c JOIN s ON c.way = s.way AND before <= c.pos AND before + len > c.pos),
h AS (SELECT *, CASE WHEN k = 1 THEN {_D('py', 'px', 'y', 'x')} ELSE {_D('lag(y) OVER w', 'lag(x) OVER w', 'y', 'x')} END AS d1, CASE WHEN k = n - 1 THEN {_D('y', 'x', 'qy', 'qx')} ELSE 0 END AS d2 FROM i WINDOW w AS (PARTITION BY way, id, n ORDER BY k)),
f AS (SELECT way, id, min(n) AS n FROM (SELECT way, id, n FROM h GROUP BY way, id, n HAVING max(greatest(d1, d2)) <= 70 AND count(*) = n - 1) GROUP BY way, id)
SELECT h.way, h.id, h.k::INT AS k, round(h.pos, 3) AS at, round(h.y, 6) AS lat, round(h.x, 6) AS lon FROM h JOIN f ON h.way = f.way AND h.id = f.id AND h.n = f.n""")
def w08_insert(v):
    new = linear.insertions(road_gaps(road_poles(v)), linear.measured(g.segments(v.v_way)).where("len > 0"))
    return new.select("way", "id", "k", F.round("at", 3).alias("at"), r6("lat").alias("lat"), r6("lon").alias("lon"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def w10_last_write(v):
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("m")
    return v.events.groupBy("user_id").agg(last).select("user_id", "m.event_id", "m.event_type")


@query(_sets_sql(C40) + " SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM p INTERSECT SELECT * FROM t) UNION ALL SELECT 'only_p', count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM t) UNION ALL SELECT 'only_t', count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM p)")
def u01_pixel_sets(v):
    p, t = cell_sets(v, C40)
    n = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n(p.intersect(t), "both").unionByName(n(p.subtract(t), "only_p")).unionByName(n(t.subtract(p), "only_t"))


@query("SELECT 0 AS kind, id, round(lat, 6) AS lat FROM v_pole UNION ALL SELECT 1, id, round(lat, 6) FROM v_ins")
def u02_union_poles(v):
    one = lambda d, k: d.select(F.lit(k).alias("kind"), "id", r6("lat").alias("lat"))
    return one(v.v_pole, 0).unionByName(one(v.v_ins, 1))


@query("SELECT id, src FROM (SELECT id, src, row_number() OVER (PARTITION BY id ORDER BY src) AS k FROM (SELECT id, 0 AS src FROM v_ins UNION ALL SELECT id, 1 FROM v_true)) WHERE k = 1")
def u03_priority_union(v):
    both = v.v_ins.select("id", F.lit(0).alias("src")).unionByName(v.v_true.select("id", F.lit(1).alias("src")))
    return both.groupBy("id").agg(F.min("src").alias("src"))


@query("SELECT DISTINCT o_custkey AS a, o_orderkey % 100 AS b FROM orders EXCEPT SELECT c_custkey, c_custkey % 100 FROM customer")
def u04_edge_difference(v):
    e = v.orders.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 100).alias("b")).distinct()
    return e.join(v.customer.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") % 100).alias("b")), ["a", "b"], "left_anti")


@query(f"{_points_sql('v_pole', C40)} UNION {_points_sql('v_true', C40)}")
def u06_raster_or(v):
    return g.points(v.v_pole, C40).select("x", "y").union(g.points(v.v_true, C40).select("x", "y")).distinct()


@query(f"WITH p AS ({_points_sql('v_pole', C40)}), d AS ({_dilated_sql('p', 1)}), t AS ({_points_sql('v_true', C40)}) SELECT x, y FROM t ANTI JOIN d USING (x, y)")
def u07_raster_mask(v):
    t = g.points(v.v_true, C40).select("x", "y").distinct()
    return t.join(g.dilate(g.points(v.v_pole, C40).select("x", "y").distinct(), 1), ["x", "y"], "left_anti")


@query(f"WITH p AS ({_points_sql('v_pole', C2)}) {_dilated_sql('p', 3)}")
def x03_dilate(v):
    return g.dilate(g.points(v.v_pole, C2).select("x", "y").distinct(), 3)


@query(f"WITH c AS (SELECT {sql_x(C40)} AS x, {sql_y(C40)} AS y, min({_W}) AS w FROM v_way GROUP BY 1, 2), p AS (SELECT {sql_x(C40)} AS x, {sql_y(C40)} AS y FROM v_pole), h AS (SELECT x + dx AS x, y + dy AS y, count(*) AS n FROM p, (SELECT unnest(range(-2, 3))::INT AS dx) i, (SELECT unnest(range(-2, 3))::INT AS dy) j WHERE dx * dx + dy * dy <= 4 GROUP BY 1, 2) SELECT c.x, c.y, round(CASE WHEN w < 1 THEN least(1, w * power(1.1::DOUBLE, coalesce(n, 0))) ELSE w END, 6) AS w FROM c LEFT JOIN h ON c.x = h.x AND c.y = h.y")
def x05_scale_weights(v):
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("tag")), F.lit(1.0))
    cells = g.points(v.v_way, C40).groupBy("x", "y").agg(F.min(w).alias("w"))
    hits = g.dilate(g.points(v.v_pole, C40).select("x", "y"), 2, distinct=False).groupBy("x", "y").agg(F.count("*").alias("n"))
    scaled = F.when(F.col("w") < 1, F.least(F.lit(1.0), F.col("w") * F.pow(F.lit(1.1), F.coalesce("n", F.lit(0))))).otherwise(F.col("w"))
    return cells.join(hits, ["x", "y"], "left").select("x", "y", r6(scaled, "w"))


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) % 7 AS key_no, 'https://meta.example.com/v1?location=' || user_id || ',' || event_id || '&key=' || ((row_number() OVER (ORDER BY event_id) - 1) % 7) AS url FROM events")
def s07_round_robin(v):
    # ranks without a global window: a range partition's own numbers after the counts of those before it
    from ..operators.order import numbered

    e = numbered(v.events.select("event_id", "user_id"), "event_id")
    k = F.pmod(F.col("n"), F.lit(7))
    return e.select("event_id", k.alias("key_no"), F.concat(F.lit("https://meta.example.com/v1?location="), F.col("user_id"), F.lit(","), F.col("event_id"), F.lit("&key="), k).alias("url"))


@query("SELECT user_id, count(*) AS seen, sum((event_type = 'error')::INT)::BIGINT AS failed, max(event_id) FILTER (WHERE event_type <> 'error') AS last_ok FROM events WHERE event_id >= 100 GROUP BY user_id")
def s08_upsert(v):
    e = v.events.where("event_id >= 100")
    return e.groupBy("user_id").agg(F.count("*").alias("seen"), F.sum((F.col("event_type") == "error").cast("int")).cast("bigint").alias("failed"), F.max(F.when(F.col("event_type") != "error", F.col("event_id"))).alias("last_ok"))


@query("SELECT id, '<Placemark><name>' || id || '</name><Point><altitudeMode>clampToGround</altitudeMode><coordinates>' || printf('%.6f,%.6f,%.1f', lon, lat, 0.0) || '</coordinates></Point></Placemark>' AS kml FROM v_pole")
def s14_kml(v):
    geojson = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("id").cast("string").alias("name")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry")))
    return kml.placemarks(v.v_pole.select("id", geojson.alias("feature")), "feature").select("id", "kml")


@query("SELECT doc_id, truth = 1 AS linked, round(score, 6) AS score FROM v_pred WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def l10_labels(v):
    known = v.documents.where("lang = 'en'").select("doc_id")
    return v.v_pred.join(known, "doc_id", "left_semi").select("doc_id", (F.col("truth") == 1).alias("linked"), r6("score").alias("score"))
