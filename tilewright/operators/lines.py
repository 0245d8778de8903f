"""Loading delimited gazetteer lines, with a reason for each that cannot be loaded."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.kernels.repair import NUMBER, parse
from tilewright.operators.skew import fresh
from tilewright.session import ship

#: The fields of a gazetteer line in order, with their types.
GAZETTEER = [
    ("geonameid", "bigint"), ("name", "string"), ("asciiname", "string"), ("alternatenames", "string"),
    ("latitude", "double"), ("longitude", "double"), ("feature_class", "string"), ("feature", "string"),
    ("country", "string"), ("cc2", "string"), ("admin1", "string"), ("admin2", "string"), ("admin3", "string"),
    ("admin4", "string"), ("population", "bigint"), ("elevation", "int"), ("dem", "int"), ("timezone", "string"),
    ("modification_date", "date"),
]
RANGES = {"latitude": 90.0, "longitude": 180.0}
#: Valid quoting of a line; possessive, so that long fields take no stack. Stands for a tab inside quotes.
QUOTING = r'(?s)\A(?:"[^"]*+(?:""[^"]*+)*+"|[^\t"]*+)(?:\t(?:"[^"]*+(?:""[^"]*+)*+"|[^\t"]*+))*+\z'
MARK = "\x01"
PARSED = "fields array<string>, reason string, edits string"
_NUMBER = r"\A" + NUMBER.pattern.replace(r"\Z", r"\z")


def _parser(width: int, checks: dict[int, float], names: dict[int, str]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lines in batches:
            rows = [(None, None, None) if x is None else parse(x, width, checks, names) for x in lines]
            yield pd.DataFrame(rows, columns=["fields", "reason", "edits"])

    return F.pandas_udf(run, PARSED)


def parse_lines(df: DataFrame, line: str = "line", schema=GAZETTEER, ranges=RANGES) -> DataFrame:
    """Adds ``_fields`` (array, null for a line put aside), ``_reason`` and ``_edits``.

    A line is valid if it can be read without an edit: quoting right, as many
    fields as the schema has, and each field of ``ranges`` a plain number within
    its range. Lines that pass these tests as they stand never leave the JVM; all
    others take the minimum-cost parse. An empty line has one
    field; a null line is put aside as ``column_count`` (it has none).
    """
    ship(df.sparkSession)
    names = {i: n for i, (n, _) in enumerate(schema) if n in ranges}
    checks = {i: ranges[n] for i, n in names.items()}
    text, quote = F.col(line), F.contains(F.col(line), F.lit('"'))
    # a line with valid quotes: tabs inside them are marked, so that the others can be split at
    inside = F.transform(F.split(text, '"', -1), lambda s, i: F.when(i % 2 == 1, F.translate(s, "\t", MARK)).otherwise(s))
    bare = F.transform(F.split(F.array_join(inside, '"'), "\t", -1), lambda v: F.translate(F.when(v.startswith('"'), F.replace(F.substr(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v), MARK, "\t"))
    parts = F.when(quote, bare).otherwise(F.split(text, "\t", -1))
    easy = text.isNotNull() & (~quote | (text.rlike(QUOTING) & ~F.contains(text, F.lit(MARK)))) & (F.size(parts) == len(schema))
    for i, limit in checks.items():
        number = F.get(parts, F.lit(i))
        easy = easy & number.rlike(_NUMBER) & (F.abs(number.try_cast("double")) <= limit)
    marked = df.withColumn("_easy", F.coalesce(easy, F.lit(False)))
    hard = F.when(~F.col("_easy"), F.col(line))
    marked = marked.withColumn("_hard", _parser(len(schema), checks, names)(hard))
    reason = F.when(F.col(line).isNull(), F.lit("column_count")).otherwise(F.col("_hard.reason"))
    out = marked.withColumn("_fields", F.when(F.col("_easy"), parts).otherwise(F.col("_hard.fields")))
    return out.withColumn("_reason", reason).withColumn("_edits", F.col("_hard.edits")).drop("_easy", "_hard")


def typed(fields: Column, schema=GAZETTEER) -> list[Column]:
    """The schema's columns from the array; an empty field is null, as is one that does not fit its type."""
    out = []
    for i, (name, kind) in enumerate(schema):
        text = F.nullif(F.get(fields, F.lit(i)), F.lit(""))
        out.append((text if kind == "string" else text.try_cast(kind)).alias(name))
    return out


def _kept(df: DataFrame, keep: list[str], line: str, taken: list[str]) -> tuple[DataFrame, list[str]]:
    """``keep`` and the line alone; kept columns named like one of the output get ``_source`` behind their name."""
    lower = {t.lower() for t in taken}
    names = [fresh([*taken, *keep], c + "_source") if c.lower() in lower else c for c in keep]
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{line}`").alias("_line")), names


def load_lines(df: DataFrame, keep: list[str], line: str = "line", schema=GAZETTEER, ranges=RANGES) -> DataFrame:
    """The valid lines as ``keep`` and the typed columns of the schema."""
    df, names = _kept(df, keep, line, [n for n, _ in schema])
    got = parse_lines(df, "_line", schema, ranges).where(F.col("_reason").isNull())
    return got.select(*[f"`{c}`" for c in names], *typed(F.col("_fields"), schema))


def rejected_lines(df: DataFrame, keep: list[str], line: str = "line", schema=GAZETTEER, ranges=RANGES) -> DataFrame:
    """The lines put aside: ``keep``, ``reason``, ``edits``."""
    df, names = _kept(df, keep, line, ["reason", "edits"])
    got = parse_lines(df, "_line", schema, ranges).where(F.col("_reason").isNotNull())
    return got.select(*[f"`{c}`" for c in names], F.col("_reason").alias("reason"), F.col("_edits").alias("edits"))
