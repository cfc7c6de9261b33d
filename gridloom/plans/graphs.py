"""Queries on graphs and on steps whose order decides."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cam, graph, linear
from ..operators import grid as g
from . import views
from .joins import _near_sql, rays
from .registry import query, r6

C2, C40, C110 = views.CELLS_2, views.CELLS_40, views.CELLS_110


def links(v, within: float = 45.0):
    return g.near_join(v.v_pole, v.v_pole, C110, within).where("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "d")


@query()
def x01_hough_lines(v):
    return cam.hough_lines(v.embeddings, "vec_id", "embedding", 8, 300.0, 20)


@query()
def g01_merge_directions(v):
    lines = v.v_line.groupBy("sv_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "angle", "strength"))).alias("l"))
    m = cam.merged_directions(F.transform("l", lambda x: F.struct(x["angle"].alias("angle"), x["strength"].alias("strength"))))
    return lines.select("sv_id", F.posexplode(m).alias("seq", "m")).select("sv_id", "seq", "m.cnt", r6("m.angle").alias("angle"), r6("m.strength").alias("strength"))


@query()
def g03_cluster(v):
    c = graph.clustered(rays(v), C110)
    return c.groupBy("g", "cluster").agg(r6(F.avg("lat"), "lat"), r6(F.avg("lon"), "lon"), F.count("*").alias("n"))


@query()
def g04_match(v):
    return graph.matched(v.v_true, v.v_pole, C110).select("a", "b", F.round("d", 4).alias("d"))


def _merge_ways(_, rows: list[tuple]) -> list[tuple]:
    ways: dict = {}
    for w, _nid, node in rows:
        ways.setdefault(w, []).append(node)
    ends: dict = {}
    for w, nodes in ways.items():
        for n in {nodes[0], nodes[-1]}:
            ends.setdefault(n, set()).add(w)
    seen = Counter(node for _, _, node in rows)
    out = graph.merged_chains(ways, {n: s for n, s in ends.items() if len(s) == 2 and seen[n] == 2})
    return [(w, len(x), int(x[0]), int(x[-1])) for w, x in out.items()]


@query()
def g05_chain_merge(v):
    w = v.v_way.select("way", "nid", "node")
    ends = w.groupBy("way").agg(F.min_by("node", "nid").alias("s"), F.max_by("node", "nid").alias("t"))
    twice = w.groupBy("node").agg(F.count("*").alias("n")).where("n = 2").select("node")
    end = ends.select("way", F.explode(F.array("s", "t")).alias("node")).distinct().join(twice, "node")
    p, q = end.alias("p"), end.alias("q")
    edges = p.join(q, (F.col("p.node") == F.col("q.node")) & (F.col("p.way") < F.col("q.way"))).select(F.col("p.way").alias("a"), F.col("q.way").alias("b"))
    root = graph.components(edges).toDF("way", "root")
    rows = w.join(root, "way", "left").select(F.coalesce("root", "way").alias("root"), "way", "nid", "node")
    return graph.by_group(rows, "root", _merge_ways, "way long, vertices int, first long, last long")


def _snap(way: int, rows: list[tuple]) -> list[tuple]:
    of = lambda k: [(i, at) for kind, at, i in rows if kind == k]
    return [(way, a, b) for a, b in graph.snapped(of(0), of(1))]


@query()
def w07_snap(v):
    from .joins import marks

    m = marks(v).where("kind < 2").select("way", F.col("kind").cast("int").alias("kind"), "length", "id")
    return graph.by_group(m, "way", _snap, "way long, node long, pole long")


def _search(f: pd.DataFrame) -> pd.DataFrame:
    w = {(int(x), int(y)): c for x, y, c in f[f.kind == 0][["x", "y", "w"]].itertuples(index=False)}
    spots = lambda k: [(int(x), int(y)) for x, y in f[f.kind == k].sort_values(["x", "y"])[["x", "y"]].itertuples(index=False)]
    box = (int(f.x.min()), int(f.y.min()), int(f.x.max()), int(f.y.max()))
    _, edges = graph.many_to_many(spots(1), spots(2), w, box)
    return pd.DataFrame([(int(f.region.iloc[0]), *t, *o) for t, o in edges], columns=["region", "tx", "ty", "ox", "oy"])


def search_cells(v):
    """(region, kind 0 road cell / 1 origin / 2 target, x, y, w): regions are quarters of the views' square."""
    from .aggregates import WEIGHTS

    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("tag")), F.lit(1.0))
    region = (F.col("x") > 65).cast("int") * 2 + (F.col("y") > 65).cast("int")
    roads = g.points(v.v_way, C40).groupBy("x", "y").agg(F.min(w).alias("w")).select(F.lit(0).alias("kind"), "x", "y", "w")
    poles = g.points(v.v_pole, C40).select("x", "y").distinct().select(F.lit(2).alias("kind"), "x", "y", F.lit(0.0).alias("w"))
    cells = roads.unionByName(poles).withColumn("region", region)
    first = poles.withColumn("region", region).groupBy("region").agg(F.min(F.struct("x", "y")).alias("o")).select(F.lit(1).alias("kind"), "o.x", "o.y", F.lit(0.0).alias("w"), "region")
    return cells.unionByName(first)


@query()
def g09_many_to_many(v):
    return search_cells(v).groupBy("region").applyInPandas(_search, "region int, tx int, ty int, ox int, oy int")


@query(f"WITH e AS (SELECT a, b FROM ({_near_sql('v_pole', 'v_pole', 45.0, 'a.id < b.id')})) SELECT id, count(*) AS degree FROM (SELECT a AS id, b AS o FROM e UNION SELECT b, a FROM e) GROUP BY id")
def g12_degree(v):
    """A cell has all neighbours of its poles, so they are counted there and a row a pole is moved, not the links both ways. Ids are unique."""
    pole = v.v_pole.distinct()
    return g.near_join(pole, pole, C110, 45.0).where("a.id <> b.id").groupBy(F.col("b.id").alias("id")).agg(F.count("*").alias("degree"))


@query()
def g13_chains(v):
    return graph.near_chains(v.v_pole.distinct(), C110, 45.0)


@query("SELECT l_orderkey AS way, i::INT AS i, j::INT AS j, list_aggregate(list_slice(nodes, i, j), 'sum')::BIGINT AS total FROM (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nodes FROM lineitem GROUP BY 1), LATERAL (SELECT unnest(range(1, len(nodes))) AS i), LATERAL (SELECT unnest(range(i + 1, len(nodes) + 1)) AS j)")
def g14_subpaths(v):
    lines = v.lineitem
    n = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))), lambda x: x["l_partkey"])
    p = lines.groupBy(F.col("l_orderkey").alias("way")).agg(n.alias("p")).where(F.size("p") > 1)
    p = p.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("p") - 1))).withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.size("p"))))
    total = F.aggregate(F.slice("p", F.col("i"), F.col("j") - F.col("i") + 1), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return p.select("way", "i", "j", total.alias("total"))


@query()
def g15_pardon(v):
    return graph.near_pardon(v.v_pole.distinct(), C110, 60.0, (F.col("a.id") + F.col("b.id")) % 2 == 0, lambda k: k % 5 != 0)


@query()
def g16_mst(v):
    return graph.near_forest(v.v_pole.distinct(), C110, 60.0)[0].select("a", "b", F.round("d", 4).alias("d"))


@query()
def a14_pole_metrics(v):
    """Truth is matched with detected poles first, what is left with inserted ones."""
    det = graph.matched(v.v_true, v.v_pole, C110)
    rest = v.v_true.join(det.select(F.col("a").alias("id")), "id", "left_anti")
    ins = graph.matched(rest, v.v_ins, C110)
    sizes = {"truth": v.v_true, "detected": v.v_pole, "inserted": v.v_ins, "m1": det, "m2": ins}
    each = reduce(DataFrame.unionByName, [d.agg(F.lit(k).alias("k"), F.count("*").alias("n")) for k, d in sizes.items()])
    out = each.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).cast("double").alias(k) for k in sizes])
    hit = F.col("m1") + F.col("m2")
    return out.select("truth", "detected", "inserted", r6(F.coalesce(F.try_divide(hit, F.col("truth")), F.lit(1.0)), "recall"), r6(F.try_divide(hit, F.col("detected") + F.col("inserted")), "precision"))


@query("""WITH s AS (SELECT way, nid, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM v_way WINDOW w AS (PARTITION BY way ORDER BY nid))
SELECT way, CASE WHEN nid > 0 THEN nid + 1 ELSE nid END AS nid, round(lat, 6) AS lat, round(lon, 6) AS lon FROM s
UNION ALL SELECT way, 1, round((lat + lat2) / 2, 6), round((lon + lon2) / 2, 6) FROM s WHERE nid = 0 AND lat2 IS NOT NULL""")
def g08_new_vertex(v):
    """A vertex put into each way after its first: later places shift by one."""
    w = v.v_way.select("way", "nid", "lat", "lon")
    s = linear.measured(g.segments(w)).where("lid = 0")
    new = s.select("way", F.lit(1).alias("nid"), ((F.col("lat1") + F.col("lat2")) / 2).alias("lat"), ((F.col("lon1") + F.col("lon2")) / 2).alias("lon"))
    moved = w.withColumn("nid", F.col("nid") + (F.col("nid") > 0).cast("int"))
    return moved.unionByName(new).select("way", "nid", r6("lat").alias("lat"), r6("lon").alias("lon"))
