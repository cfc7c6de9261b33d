"""The queries with SQL against that SQL, and that the engine stands without them."""

import subprocess
import sys
from pathlib import Path

import pytest

from gridloom.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    got = connect(FOLDER).execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


def test_entry_without_this_package(tmp_path):
    root = Path(__file__).resolve().parents[2]
    for p in root.iterdir():
        if p.name not in ("corpus_pipeline.py", "gridloom") and not p.name.startswith("."):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "gridloom").mkdir()
    for p in (root / "gridloom").iterdir():
        if p.name != "llm":
            (tmp_path / "gridloom" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
