"""GeoJSON, GeoJSON text sequences and delimited text as feature tables, batch and stream; and writing them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geojson, shapes
from tilewright.functions.geometry import area
from tilewright.session import ship
from tilewright.types import GEOM_DDL, PROPS_DDL, point_geom, string_props

RECORD_MARK = "\x1e"


def _features(rows: DataFrame, feature: Column, srid: Column, keep: list[str] = []) -> DataFrame:
    f = rows.select(feature.alias("f"), srid.alias("srid"), *keep)
    out = f.select(F.explode(geojson.geometries(F.col("f.geometry"))).alias("geom"), geojson.properties(F.col("f.properties"), F.col("f.id")).alias("props"), "srid", *keep)
    # one ring is turned here; only polygons of several go to Python, all else as null
    rings = F.col("geom.rings")
    several = (F.col("geom.typ") == 3) & (F.size(rings) > 1)
    turned = F.transform(rings, lambda r: F.when(area(r) < 0, F.reverse(r)).otherwise(r))
    single = F.struct(F.col("geom.typ").alias("typ"), F.when(F.col("geom.typ") == 3, turned).otherwise(rings).alias("rings")).cast(GEOM_DDL)
    return out.withColumn("geom", F.coalesce(shapes.fix_winding(F.when(several, F.col("geom").cast(GEOM_DDL))), F.when(F.col("geom").isNotNull(), single)))


def read_geojson(spark: SparkSession, path: str, srid: str | None = None) -> DataFrame:
    """Features of whole feature collection files: ``geom, props, srid``.

    Multi geometries are several features with the same properties; polygons get
    their winding set right. With ``srid`` given, a file of another known
    coordinate system is an error; unknown names are ignored.
    """
    ship(spark)
    schema = f"features array<struct<{_nested(geojson.FEATURE_SCHEMA)}>>, crs struct<type:string, properties:struct<name:string>>"
    files = spark.read.schema(schema).option("multiLine", True).json(path)
    known = F.create_map(*[F.lit(v) for pair in geojson.SRID_OF_CRS.items() for v in pair])
    own = known[F.col("crs.properties.name")]
    if srid is not None:
        own = F.when(own.isNotNull() & (own != srid), F.raise_error(F.concat(F.lit("coordinates are in "), own, F.lit(f", not in {srid}")))).otherwise(F.lit(srid))
    return _features(files.select(F.explode("features").alias("f"), own.alias("own")), F.col("f"), F.col("own"))


def _nested(ddl: str) -> str:
    """Top-level column list as struct fields."""
    out, depth = [], 0
    for part in ddl.split(", "):
        if depth == 0:
            name, kind = part.split(" ", 1)
            part = f"{name}:{kind}"
        depth += part.count("<") - part.count(">")
        out.append(part)
    return ", ".join(out)


def parse_sequence(lines: DataFrame) -> DataFrame:
    """Features of records (column ``value``) that a record mark began; blank ones are dropped, a record that is no JSON is an error."""
    text = F.trim(F.regexp_replace("value", r"[\r\n]+\z", ""))
    records = lines.select(text.alias("t")).where(F.col("t") != "")
    return _features(records, F.from_json("t", f"struct<{_nested(geojson.FEATURE_SCHEMA)}>", {"mode": "FAILFAST"}), F.lit("4326"))


def read_geojsonseq(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return parse_sequence(spark.read.option("lineSep", RECORD_MARK).text(path))


def stream_geojsonseq(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return parse_sequence(spark.readStream.option("lineSep", RECORD_MARK).text(path))


def csv_features(rows: DataFrame, lat: int, lon: int) -> DataFrame:
    """Points of delimited rows: all columns become text properties, also the two coordinates (by index from 0)."""
    names = rows.columns
    x, y = (F.col(f"`{names[i]}`").cast("double") for i in (lon, lat))
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"`{n}`").cast("string").alias("value")) for n in names])
    return rows.select(point_geom(x, y).alias("geom"), string_props(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], F.coalesce(e["value"], F.lit("")))))).alias("props"), F.lit("4326").alias("srid"))


def read_csv(spark: SparkSession, path: str, lat: int = 1, lon: int = 2, sep: str = ",") -> DataFrame:
    """Point features of delimited text with a header; a row of another width or a coordinate that is no number is an error."""
    rows = spark.read.csv(path, header=True, sep=sep, mode="FAILFAST", enforceSchema=False)
    return csv_features(rows, lat, lon)


def stream_csv(spark: SparkSession, path: str, columns: list[str], lat: int = 1, lon: int = 2, sep: str = ",") -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return csv_features(spark.readStream.schema(schema).csv(path, header=True, sep=sep, mode="FAILFAST"), lat, lon)


def feature_text(features: DataFrame) -> DataFrame:
    """One GeoJSON feature per row, column ``value``."""
    return features.select(geojson.feature_json(F.col("geom"), F.col("props").cast(PROPS_DDL)).alias("value"))


def write_geojsonseq(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    feature_text(features).select(F.concat(F.lit(RECORD_MARK), "value").alias("value")).write.mode(mode).text(path)


def write_geojson(features: DataFrame, path: str, srid: str | None = "4326", mode: str = "errorifexists") -> None:
    """A feature collection file per partition, streamed line by line; coalesce first if there must be one file."""
    ship(features.sparkSession)
    name = geojson.CRS_OF_SRID.get(srid or "", "")
    crs = f'"crs":{{"type":"name","properties":{{"name":"{name}"}}}},' if srid else ""

    def collection(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = f'{{"type":"FeatureCollection",{crs}"features":['
        for batch in batches:
            lines = []
            for value in batch.column("value").to_pylist():
                lines.append(lead + value)
                lead = ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": pa.array([("" if lead == "," else lead) + "]}"], pa.string())})

    feature_text(features).mapInArrow(collection, "value string").write.mode(mode).text(path)
