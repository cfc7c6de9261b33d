"""Heat maps: votes, peaks, lines and the merge of directions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

#: Least votes of a line, lines an image, half width of what a line suppresses, and what it subtracts.
LEAST_VOTES, MOST_LINES, HALF_WIDTH, SUPPRESSED = 80, 10, 3, 9999.0


def pixels(cams: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """(key, y, x, v) of heat maps held as flat arrays, row by row."""
    p = cams.select(key, F.posexplode(column).alias("i", "v"))
    return p.select(key, F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).alias("x"), F.col("v").cast("double").alias("v"))


def bearings(px: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """(key, bearing, heat): the bin around the centre with the most heat, the lowest of equals."""
    b = px.select(key, geo.bearing_bin(F.col("y"), F.col("x"), height, width).alias("bin"), "v")
    bins = b.groupBy(key, "bin").agg(F.round(F.sum("v"), 4).alias("heat"))
    best = bins.groupBy(key).agg(F.max(F.struct("heat", (-F.col("bin")).alias("b"))).alias("m"))
    return best.select(key, (-F.col("m.b")).alias("bearing"), F.col("m.heat").alias("heat"))


def hough_votes(px: DataFrame, key: str, scale: float = 1.0) -> DataFrame:
    """(key, rho, theta, votes): theta in whole degrees -90 to 90 (both kept), rho rounded half away from zero."""
    lit = px.select(key, "y", "x", geo.level(F.col("v") * scale).alias("w")).where("w > 0")
    each = lit.withColumn("theta", F.explode(F.sequence(F.lit(-90), F.lit(90))))
    t = F.radians(F.col("theta").cast("double"))
    rho = F.round(F.round(F.col("x") * F.cos(t) + F.col("y") * F.sin(t), 9)).cast("int")
    return each.groupBy(key, rho.alias("rho"), "theta").agg(F.sum("w").cast("bigint").alias("votes"))


def peaks(votes: DataFrame, key: str) -> DataFrame:
    """The cell with the most votes; of equals the first by rho, then theta."""
    best = votes.groupBy(key).agg(F.max_by(F.struct("rho", "theta", "votes"), F.struct("votes", -F.col("rho"), -F.col("theta"))).alias("m"))
    return best.select(key, "m.rho", "m.theta", "m.votes")


def image_lines(cam: np.ndarray, least: float = LEAST_VOTES, most: int = MOST_LINES) -> list[tuple[int, int, int]]:
    """(rho, theta, votes) of an image's lines: the peak is taken, pixels near its line are put out, and so on."""
    cam = np.array(cam, float)
    h, w = cam.shape
    diag = int(np.ceil(np.hypot(h, w)))
    theta = np.radians(np.arange(-90, 91, dtype=float))
    out: list[tuple[int, int, int]] = []
    ys, xs = np.mgrid[0:h, 0:w]
    for _ in range(most):
        weight = np.where(cam > 80, 10, np.where(cam > 10, 1, 0))
        y, x = np.nonzero(weight)
        if not len(y):
            break
        r = np.round(x[:, None] * np.cos(theta) + y[:, None] * np.sin(theta), 9)
        rho = (np.sign(r) * np.floor(np.abs(r) + 0.5)).astype(int) + diag
        votes = np.bincount((rho * 181 + np.arange(181)).ravel(), np.repeat(weight[y, x], 181))
        at = int(votes.argmax())
        if votes[at] < least:
            break
        p, t = at // 181 - diag, at % 181
        out.append((p, t - 90, int(votes[at])))
        a, b = np.cos(theta[t]), np.sin(theta[t])
        x1, y1, x2, y2 = (int(v) for v in (a * p - 1000 * b, b * p + 1000 * a, a * p + 1000 * b, b * p - 1000 * a))
        far = np.abs((y2 - y1) * xs - (x2 - x1) * ys + x2 * y1 - y2 * x1) / np.hypot(y2 - y1, x2 - x1)
        cam[far < HALF_WIDTH] -= SUPPRESSED
    return out


def hough_lines(cams: DataFrame, key: str, column: str, width: int, scale: float = 1.0, least: float = LEAST_VOTES) -> DataFrame:
    """(key, seq, rho, theta, votes) of each image: order decides, so an image is one kernel call; images are independent."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, *line) for k, v in zip(f[key], f[column], strict=True) for i, line in enumerate(image_lines(np.asarray(v, float).reshape(-1, width) * scale, least))]
            yield pd.DataFrame(rows, columns=[key, "seq", "rho", "theta", "votes"])

    return cams.select(key, column).mapInPandas(run, f"{key} long, seq int, rho int, theta int, votes long")


def merged_directions(lines: Column, within: float = 20.0, compat: bool = False) -> Column:
    """Greedy merge of array<struct<angle, strength>> in order: array<struct<cnt, angle, strength>>, strongest first.

    A line joins the first held one whose angle is within `within`, directly or across +-90; the angle becomes
    the weighted mean. compat: a mean above 90 loses 90 instead of 180.
    """
    empty = F.array().cast("array<struct<cnt:int,angle:double,strength:double>>")

    def step(held: Column, line: Column) -> Column:
        gap = lambda h: F.abs(h["angle"] - line["angle"])
        like = F.transform(held, lambda h: (gap(h) < within) | (180 - gap(h) < within))
        at = F.array_position(like, F.lit(True))

        def joined(h: Column) -> Column:
            direct = gap(h) < within
            mine = F.when(direct, line["angle"]).when(line["angle"] < 0, line["angle"] + 180).otherwise(line["angle"])
            theirs = F.when(direct, h["angle"]).when(line["angle"] < 0, h["angle"]).otherwise(h["angle"] + 180)
            total = h["strength"] + line["strength"]
            mean = F.coalesce(F.try_divide(theirs * h["strength"] + mine * line["strength"], total), (theirs + mine) / 2)  # without strength: the middle
            mean = F.when((~direct) & (mean > 90), mean - (90 if compat else 180)).otherwise(mean)
            return F.struct((h["cnt"] + 1).alias("cnt"), mean.alias("angle"), total.alias("strength"))

        new = F.struct(F.lit(1).alias("cnt"), line["angle"].alias("angle"), line["strength"].alias("strength"))
        out = F.when(at > 0, F.transform(held, lambda h, i: F.when(i == at - 1, joined(h)).otherwise(h))).otherwise(F.concat(held, F.array(new)))
        places = F.transform(out, lambda h, i: F.struct((-h["strength"]).alias("k"), i.alias("i"), h["cnt"].alias("cnt"), h["angle"].alias("angle"), h["strength"].alias("strength")))
        return F.transform(F.array_sort(places), lambda p: F.struct(p["cnt"].alias("cnt"), p["angle"].alias("angle"), p["strength"].alias("strength")))

    return F.aggregate(lines, empty, step)
