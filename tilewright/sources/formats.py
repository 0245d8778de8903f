"""Formats by file extension, and the four programs as functions on DataFrames."""

from __future__ import annotations

import shutil
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.geometry import geom_text, type_name
from tilewright.operators import assembly, mapping, tiling
from tilewright.session import scratch_path
from tilewright.sources import binary, text
from tilewright.types import prop_text

#: Extension to format; extend it for further spellings.
EXTENSIONS = {"geojson": "geojson", "json": "geojson", "geojsonseq": "geojsonseq", "csv": "csv", "txt": "csv", "blocks": "featureblocks"}


def format_of(path: str, extensions: dict[str, str] = EXTENSIONS) -> str:
    """By suffix, in any case."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in extensions:
        raise ValueError(f"no format for {path}")
    return extensions[suffix]


def read_features(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """``geom, props, srid`` of one file or folder."""
    kind = kind or format_of(path)
    if kind == "geojson":
        return text.read_geojson(spark, path, **options)
    if kind == "geojsonseq":
        return text.read_geojsonseq(spark, path)
    if kind == "csv":
        return text.read_csv(spark, path, **options)
    binary.register(spark)
    return spark.read.format(kind).options(**options).load(path)


def write_features(features: DataFrame, path: str, kind: str | None = None, mode: str = "overwrite") -> None:
    kind = kind or format_of(path)
    features = features.select("geom", "props", "srid")
    if kind == "geojson":
        text.write_geojson(features, path, mode=mode)
    elif kind == "geojsonseq":
        text.write_geojsonseq(features, path, mode=mode)
    elif kind == "featureblocks":
        binary.register(features.sparkSession)
        features.write.format(kind).mode(mode).save(path)
    else:
        raise ValueError(f"cannot write {kind}")


def concatenated(spark: SparkSession, paths: list[str], kind: str | None = None, options: dict[str, dict] | None = None) -> DataFrame:
    """All features of all inputs, each once; they may differ in format, and ``options`` has those of each format."""
    kinds = [kind or format_of(p) for p in paths]
    return reduce(DataFrame.unionByName, [read_features(spark, p, k, **(options or {}).get(k, {})) for p, k in zip(paths, kinds, strict=True)])


def converted(spark: SparkSession, inputs: list[str], rules: list[mapping.Rule] | None = None, kind: str | None = None, options: dict[str, dict] | None = None) -> DataFrame:
    return mapping.apply_rules(concatenated(spark, inputs, kind, options), rules or [])


def convert(spark: SparkSession, inputs: list[str], out: str, rules: list[mapping.Rule] | None = None, kind: str | None = None, options: dict[str, dict] | None = None) -> None:
    write_features(converted(spark, inputs, rules, kind, options), out)


def take_in(spark: SparkSession, stream, kind: str) -> str:
    """What a byte stream (such as standard input) holds, stored in the shared folder, where every executor can read it; its path."""
    suffix = next(k for k, v in EXTENSIONS.items() if v == kind)
    path = f"{scratch_path(spark, 'input')}.{suffix}"
    where, p = binary.file_system(path)
    where.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(p) as f:
        shutil.copyfileobj(stream, f)
    return path


def put_out(features: DataFrame, stream, kind: str = "geojsonseq") -> None:
    """Features as text to a stream (such as standard output), partition after partition, as a sequence or one collection."""
    rows = (r.value for r in text.feature_text(features.select("geom", "props", "srid")).toLocalIterator())
    if kind == "geojsonseq":
        for value in rows:
            stream.write(f"{text.RECORD_MARK}{value}\n")
    elif kind == "geojson":
        lead = '{"type":"FeatureCollection","features":['
        for value in rows:
            stream.write(f"{lead}{value}\n")
            lead = ","
        stream.write(("" if lead == "," else lead) + "]}\n")
    else:
        raise ValueError(f"cannot write {kind} to a stream of text")


def spatialize(spark: SparkSession, extract: str, rules: list[mapping.Rule] | None = None) -> DataFrame:
    """Features of an OpenStreetMap extract."""
    binary.register(spark)
    kinds = [spark.read.format("osmpbf").option("kind", k).load(extract) for k in ("node", "way", "relation")]
    return assembly.spatialize(*kinds, rules or mapping.DEFAULT)


def make_tiles(features: DataFrame, zooms: list[int], out: str, codec: str = "mvt", default_layer: str | None = "default", compress: bool = False) -> None:
    """Writes all tiles of the zooms as ``mvt`` or ``geojson``."""
    make = {"mvt": tiling.vector_tiles, "geojson": tiling.geojson_tiles}[codec]
    tiling.write_tiles(make(features, zooms, default_layer), out, codec, compress)


def inspect(features: DataFrame, colour: bool = False) -> DataFrame:
    """``value``: type, sorted properties and geometry of each feature as a line."""

    def pair(k):
        shown = F.concat(k, F.lit("="), prop_text(F.col("props")[k]), F.lit(" "))
        return F.when(k.startswith("@"), F.concat(F.lit("\x1b[37m"), shown, F.lit("\x1b[0m"))).otherwise(shown) if colour else shown

    props = F.array_join(F.transform(F.array_sort(F.map_keys("props")), pair), "")
    kind, shape = type_name(F.col("geom.typ")), geom_text(F.col("geom"))
    if colour:
        kind, shape = F.concat(F.lit("\x1b[34m"), kind, F.lit("\x1b[0m")), F.concat(F.lit("\x1b[31m"), shape, F.lit("\x1b[0m"))
    return features.select(F.concat(kind, F.lit(" "), F.coalesce(props, F.lit("")), shape).alias("value"))
