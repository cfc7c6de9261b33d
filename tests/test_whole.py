"""Queries over whole tables, against the engine's kernels."""

import numpy as np

import __spark_entry__
from gridloom.operators import cam
from tests.compare import connect

FOLDER = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()


def test_hough_lines_of_all_images(spark):
    want = []
    for k, e in connect(FOLDER).execute("SELECT vec_id, embedding FROM embeddings").fetchall():
        want += [(k, i, *x) for i, x in enumerate(cam.image_lines(np.asarray(e, float).reshape(-1, 8) * 300.0, 20))]
    got = [tuple(r) for r in QUERIES["x01_hough_lines"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(want) and max(r[0] for r in got) >= 100
