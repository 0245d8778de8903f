"""The programs on the command line: ``python -m tilewright convert | spatialize | tile | inspect``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tilewright.operators.boxes import filter_box
from tilewright.operators.mapping import parse_rules
from tilewright.sources import formats


def zooms(text: str) -> list[int]:
    """Comma-separated numbers, blanks skipped, each once."""
    return sorted({int(x) for x in text.replace(" ", "").split(",") if x})


def box(text: str) -> tuple[float, float, float, float]:
    """South-west and north-east corner as four comma-separated numbers."""
    values = tuple(float(x) for x in text.split(","))
    if len(values) != 4:
        raise ValueError("a box has four numbers")
    return values


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tilewright")
    sub = p.add_subparsers(dest="program", required=True)
    c = sub.add_parser("convert", help="read, filter and map features, write another format")
    c.add_argument("--in", dest="inputs", required=True, help="files or folders, separated by commas; - is standard input")
    c.add_argument("--out", required=True, help="file or folder; - is standard output")
    c.add_argument("--out-codec", choices=["geojson", "geojsonseq"], default="geojsonseq", help="format of standard output")
    c.add_argument("--mapping", help="YAML rules")
    c.add_argument("--in-codec", help="format of the inputs where their names do not tell")
    c.add_argument("--csv-lat", type=int, default=1)
    c.add_argument("--csv-lon", type=int, default=2)
    c.add_argument("--csv-delimiter", default=",")
    s = sub.add_parser("spatialize", help="features of an OpenStreetMap extract")
    s.add_argument("--in", dest="input", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--mapping")
    t = sub.add_parser("tile", help="vector or GeoJSON tiles")
    t.add_argument("--in", dest="input", required=True)
    t.add_argument("--out", required=True, help="folder or URI")
    t.add_argument("--zoom", type=zooms, required=True)
    t.add_argument("--codec", choices=["mvt", "geojson"], default="mvt")
    t.add_argument("--no-default-layer", action="store_true")
    t.add_argument("--compress", action="store_true")
    t.add_argument("--bbox", type=box)
    i = sub.add_parser("inspect", help="features as lines of text")
    i.add_argument("input")
    i.add_argument("--colour", action="store_true")
    i.add_argument("--limit", type=int, help="lines shown; all without it")
    return p


def main(args: list[str], spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("tilewright").getOrCreate()
    rules = None
    if getattr(a, "mapping", None):
        with open(a.mapping) as f:
            rules = parse_rules(f.read())
    if a.program == "convert":
        inputs = a.inputs.split(",")
        options = {"csv": {"lat": a.csv_lat, "lon": a.csv_lon, "sep": a.csv_delimiter}}
        kind = a.in_codec and formats.EXTENSIONS.get(a.in_codec, a.in_codec)
        if "-" in inputs and not kind:
            raise SystemExit("standard input needs --in-codec")
        inputs = [formats.take_in(spark, sys.stdin.buffer, kind) if i == "-" else i for i in inputs]
        if a.out == "-":
            formats.put_out(formats.converted(spark, inputs, rules, kind, options), sys.stdout, a.out_codec)
        else:
            formats.convert(spark, inputs, a.out, rules, kind, options)
    elif a.program == "spatialize":
        formats.write_features(formats.spatialize(spark, a.input, rules), a.out)
    elif a.program == "tile":
        features = formats.read_features(spark, a.input)
        if a.bbox:
            features = filter_box(features, a.bbox)
        formats.make_tiles(features, a.zoom, a.out, a.codec, None if a.no_default_layer else "default", a.compress)
    else:
        lines = formats.inspect(formats.read_features(spark, a.input), a.colour)
        for row in (lines if a.limit is None else lines.limit(a.limit)).toLocalIterator():
            print(row.value)


if __name__ == "__main__":
    main(sys.argv[1:])
