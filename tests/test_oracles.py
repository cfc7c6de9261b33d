"""Every query with SQL, on the smallest tables, against that SQL."""

import pytest

import __spark_entry__
from tests.compare import connect, rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in ORACLES if not n.startswith("op")])
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = con.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["sector", "pairs", "mean_d"] and df.count() > 0


@pytest.mark.parametrize("name", ["g01_merge_directions", "g03_cluster", "g05_chain_merge", "g09_many_to_many", "g13_chains", "x01_hough_lines", "w07_snap"])
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert len({tuple(map(str, r)) for r in df.collect()}) > 0
