"""Readers of the file kinds the flows start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """(tract, ring) from headless lat,lon CSV files named 1400000US<tract>_*.csv; corners in the order of the file."""
    raw = spark.read.schema("lat double, lon double").option("pathGlobFilter", "*.csv").csv(folder)
    named = raw.select("lat", "lon", F.substring(F.col("_metadata.file_name"), 10, 11).alias("tract"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    ring = F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return named.groupBy("tract").agg(ring.alias("ring"))


def buildings(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon) from CSV files with centroid_lat and centroid_lon among their columns."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("centroid_lat").cast("double").alias("lat"), F.col("centroid_lon").cast("double").alias("lon"))


def images(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """(path, length[, content]) of the images of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,JPEG,jpeg}").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", *["content"] * content)


def labelled_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images with `label`, the rank of their folder's name among all."""
    files = images(spark, folder).withColumn("kind", F.element_at(F.split("path", "/"), -2))
    kinds = files.select("kind").distinct().orderBy("kind").collect()  # a row a class
    rank = F.create_map(*[F.lit(x) for i, (k,) in enumerate(kinds) for x in (k, i)]) if kinds else F.create_map().cast("map<string,int>")
    return files.withColumn("label", F.try_element_at(rank, F.col("kind")))


def listed_images(spark: SparkSession, folders: dict[int, list[str]]) -> DataFrame:
    """Images of the folders given for each label."""
    out = None
    for label, paths in sorted(folders.items()):
        for p in paths:
            one = images(spark, p).withColumn("label", F.lit(label))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no folders")
    return out


_META = "status string, pano_id string, location struct<lat:double,lng:double>, date string"


def metadata(responses: DataFrame, column: str = "value") -> DataFrame:
    """(status, pano_id, lat, lon) of stored metadata responses (JSON text); what isn't JSON has status null."""
    r = F.from_json(column, _META)
    return responses.select(r["status"].alias("status"), r["pano_id"].alias("pano_id"), r["location"]["lat"].alias("lat"), r["location"]["lng"].alias("lon"))


def request(base: str, size: int, lat, lon, heading: int, pitch: int, fov: int, key) -> Column:
    """A request's address, from columns or values."""
    c = lambda x: x if not isinstance(x, (int, float, str)) else F.lit(x)
    return F.format_string(f"{base}?size={size}x{size}&location=%s,%s&heading={heading}&pitch={pitch}&fov={fov}&key=%s", c(lat).cast("string"), c(lon).cast("string"), c(key))
