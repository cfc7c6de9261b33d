"""GeoJSON features to KML placemarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FEATURE = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def _place(point: Column, altitude: float) -> Column:
    return F.format_string(f"%.6f,%.6f,{altitude:.1f}", point[0], point[1])


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def placemarks(df: DataFrame, column: str, color: str | None = None, mode: str = "clampToGround", altitude: float = 0.0, properties: bool = False) -> DataFrame:
    """`df` with `kml`: a Placemark for a Point or LineString feature; other kinds of geometry raise an error."""
    f = F.from_json(column, _FEATURE)
    kind, raw = f["geometry"]["type"], f["geometry"]["coordinates"]
    head = F.concat(F.lit(f"<altitudeMode>{mode}</altitudeMode><coordinates>"))
    point = F.concat(F.lit("<Point>"), head, _place(F.from_json(raw, "array<double>"), altitude), F.lit("</coordinates></Point>"))
    line = F.concat(F.lit("<LineString>"), head, F.array_join(F.transform(F.from_json(raw, "array<array<double>>"), lambda p: _place(p, altitude)), " "), F.lit("</coordinates></LineString>"))
    body = F.when(kind == "Point", point).when(kind == "LineString", line).otherwise(F.raise_error(F.concat(F.lit("no KML for geometry "), F.coalesce(kind, F.lit("null")))))
    name = F.concat(F.lit("<name>"), _escaped(F.coalesce(f["properties"]["name"], F.lit(""))), F.lit("</name>"))
    style = F.lit(f"<Style><IconStyle><color>{color}</color></IconStyle><LineStyle><color>{color}</color></LineStyle></Style>" if color else "")
    entries = F.array_join(F.transform(F.map_entries(f["properties"]), lambda e: F.concat(F.lit('<Data name="'), e["key"], F.lit('"><value>'), _escaped(e["value"]), F.lit("</value></Data>"))), "")
    data = F.concat(F.lit("<ExtendedData>"), entries, F.lit("</ExtendedData>")) if properties else F.lit("")
    return df.withColumn("kml", F.concat(F.lit("<Placemark>"), name, style, data, body, F.lit("</Placemark>")))


def document(marks: DataFrame, name: str, path: str) -> None:
    """Writes placemarks as one KML text: a head, the marks in parts, a tail; each part file stays in order by its name."""
    spark = marks.sparkSession
    head = spark.createDataFrame([(0, f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{name}</name>')], "o int, value string")
    tail = spark.createDataFrame([(2, "</Document></kml>")], "o int, value string")
    out = head.unionByName(marks.select(F.lit(1).alias("o"), F.col("kml").alias("value"))).unionByName(tail)
    out.repartitionByRange("o", "value").sortWithinPartitions("o", "value").select("value").write.text(path)
