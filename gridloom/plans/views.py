"""Views of the driver's tables as poles, roads, views and areas. The SQL is the same in both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.grid import Grid

_UM, _WM = "(({k} * {k} * 31 + {k} * 7919) % 5003)", "(({k} * {k} * 17 + {k} * 104729) % 5009)"
_LAT, _LON = "37.0E0 + {um} * 8.9831528E-6", "-122.0E0 + {wm} * 1.12E-5"


def _spots(key: str, table: str, du: str = "0", dw: str = "0") -> str:
    um, wm = _UM.format(k=key), _WM.format(k=key)
    return f"SELECT {key} AS id, {_LAT.format(um=f'({um} + {du})')} AS lat, {_LON.format(wm=f'({wm} + {dw})')} AS lon FROM {table}"


def _way(inner: str) -> str:
    um, wm = _UM.format(k="node"), _WM.format(k="node")
    return f"SELECT *, {_LAT.format(um=um)} AS lat, {_LON.format(wm=wm)} AS lon FROM ({inner}) AS s"


SQL = {
    "v_pole": _spots("p_partkey", "part"),
    "v_true": _spots("c_custkey", "customer", "(c_custkey % 7) * 5", "(c_custkey % 3) * 5"),
    "v_ins": _spots("s_suppkey", "supplier"),
    "v_way": _way(
        "SELECT o_custkey AS way, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS nid, CAST(floor(o_orderkey / 2.0E0) AS BIGINT) AS node, o_orderpriority AS tag, o_orderstatus AS status FROM orders"
    ),
    "v_way_dense": _way(
        "SELECT l_orderkey AS way, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS nid, l_partkey AS node FROM lineitem"
    ),
    "v_line": "SELECT event_id, user_id * 100 + day(ts) AS sv_id, value % 180 - 90 AS angle, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS strength FROM events",
    "v_pred": "SELECT l.doc_id, l.quality AS truth, least(d.n_chars / 8000.0E0, 1.0E0) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Cells of about 2, 40 and 110 metres over the views' square.
CELLS_2 = Grid(36.999, -122.001, 2 * 8.9831528e-6, 2 * 1.12e-5, 1.98)
CELLS_40 = Grid(36.999, -122.001, 40 * 8.9831528e-6, 40 * 1.12e-5, 39.0)
CELLS_110 = Grid(36.999, -122.001, 110 * 8.9831528e-6, 110 * 1.12e-5, 108.0)


class Views:
    """Tables and views of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        used = [t for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", SQL[name])]
        sql = SQL[name]
        for t in used:
            sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        return self.spark.sql(sql, **{t: getattr(self, t) for t in used})

    def areas(self) -> DataFrame:
        """(area, ring): nations as 25 squares of 900 metres."""
        return self.spark.sql(f"SELECT n_nationkey AS area, n_regionkey AS region, {RING} AS ring FROM {{nation}}", nation=self.nation)


_S = "37.0E0 + (floor(n_nationkey / 5.0E0) * 1000 + {u}) * 8.9831528E-6"
_W = "-122.0E0 + ((n_nationkey % 5) * 1000 + {w}) * 1.12E-5"
RING = "array(" + ", ".join(f"named_struct('lat', {_S.format(u=u)}, 'lon', {_W.format(w=w)})" for u, w in ((0.5, 0.5), (900.5, 0.5), (900.5, 900.5), (0.5, 900.5))) + ")"


def oracle(sql: str) -> str:
    """SQL for the other engine with the views it names put before it."""
    used = [v for v in SQL if re.search(rf"\b{v}\b", sql)]
    extra = {"v_area": "SELECT n_nationkey AS area, n_regionkey AS region, " + ", ".join(f"{e.format(u=k, w=k)} AS {n}_{c}" for c, e in (("lat", _S), ("lon", _W)) for n, k in (("lo", 0.5), ("hi", 900.5))) + " FROM nation", "v_cam": "SELECT vec_id, label, CAST(floor((generate_subscripts(embedding, 1) - 1) / 8.0) AS INT) AS y, CAST((generate_subscripts(embedding, 1) - 1) % 8 AS INT) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"}
    used_extra = [v for v in extra if re.search(rf"\b{v}\b", sql)]
    parts = [f"{v} AS ({SQL[v]})" for v in used] + [f"{v} AS ({extra[v]})" for v in used_extra]
    body = sql.strip()
    if not parts:
        return body
    if body[:4].upper() == "WITH":
        rest = body[4:].lstrip()
        recursive = rest[:9].upper() == "RECURSIVE"
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + ",\n" + (rest[9:].lstrip() if recursive else rest)
    return "WITH " + ",\n".join(parts) + "\n" + body
