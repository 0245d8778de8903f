"""Several values packed in one field, split to one row each, at separators that are declared or inferred per source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.skew import fresh
from tilewright.session import scratch_path

#: Characters that are scored as possible separators, in one width; a chosen one separates in its full-width form too.
CANDIDATES = ",;|/:·、-_\t"
#: A candidate separates if its score is at least this.
MIN_SCORE = 0.05
#: Segments of evidence that all sources together lend to each source.
PRIOR = 30
MARK, ESCAPE = "\x01", "\x02"


def widths(separators: str) -> str:
    """The characters and the full-width forms of those that have one."""
    return separators + "".join(chr(ord(c) + 0xFEE0) for c in separators if "!" <= c <= "~")


def _outside(text: Column, change) -> Column:
    """``change`` applied to the parts of the text outside double quotes; an unclosed quote reaches to the end."""
    parts = F.split(text, '"', -1)
    return F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 0, change(s)).otherwise(s)), '"')


def pieces(text: Column, separators: str | Column) -> Column:
    """Array of the values of a packed field, in order, without the empty ones; null for a null field.

    Separators are the characters of a string, or of one string per row (null: none).
    They count outside double quotes. Outer spaces go; a value in double quotes
    loses them, two quotes inside stand for one, outer spaces go again.
    """
    if isinstance(separators, Column):
        sign = F.coalesce(separators, F.lit(""))
        cut = lambda s: F.call_function("translate", s, sign, F.repeat(F.lit(MARK), F.length(sign)))
    else:
        cut = lambda s: F.translate(s, separators, MARK * len(separators))
    safe = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(MARK), F.lit(ESCAPE + "m"))
    marked = _outside(safe, cut)

    def clean(v: Column) -> Column:
        v = F.trim(v)
        quoted = (F.length(v) >= 2) & v.startswith('"') & v.endswith('"')
        v = F.when(quoted, F.trim(F.replace(F.substr(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"')))).otherwise(v)
        return F.replace(F.replace(v, F.lit(ESCAPE + "m"), F.lit(MARK)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))

    return F.filter(F.transform(F.split(marked, MARK, -1), clean), lambda v: v != "")


def split_packed(df: DataFrame, field: str, keep: list[str], separators: str | Column) -> DataFrame:
    """``keep`` columns, ``pos`` (from 0) and ``item``: one row per value at declared separators; repeated rows give theirs again.

    Null, empty and all-empty fields give no row. Kept columns named pos or item get ``_source`` behind their name.
    """
    names = [fresh([*keep, "pos", "item"], c + "_source") if c.lower() in ("pos", "item") else c for c in keep]
    kept = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)]
    return df.select(*kept, F.posexplode(pieces(F.col(f"`{field}`"), separators)).alias("pos", "item"))


def _folded(df: DataFrame, field: str, source: str) -> DataFrame:
    """``source, t``: filled fields in one width, with a letter for each quoted part."""
    f = F.col(f"`{field}`")
    bare = F.array_join(F.transform(F.split(f, '"', -1), lambda s, i: F.when(i % 2 == 0, s).otherwise("q")), "")
    plain = "".join(map(chr, range(0x21, 0x7F)))
    return df.where(f.isNotNull() & (f != "")).select(F.col(f"`{source}`").alias("source"), F.translate(bare, widths(plain)[len(plain) :], plain).alias("t"))


def _evidence(texts: DataFrame, better: dict[str, str], by: list[str]) -> DataFrame:
    """``by, delimiter, segments, lists, pieces, regular``: how each candidate cuts the segments that the better ones leave.

    Rows are combined before the shuffle, so a source of any size costs one partial row per task and candidate.
    """
    looks = r"\A[\p{L}\p{M}\p{N}][^/:]*[\p{L}\p{M}\p{N})']\z"
    each = F.array(*[F.struct(F.lit(c).alias("delimiter"), F.lit(b).alias("b")) for c, b in better.items()])
    rows = texts.select(*by, "t", F.inline(each)).where(F.contains("t", "delimiter"))
    if any(better.values()):
        cut = F.split(F.call_function("translate", "t", "b", F.repeat(F.lit(MARK), F.length("b"))), MARK, -1)
        rows = rows.select(*by, "delimiter", F.explode(cut).alias("s")).where(F.contains("s", "delimiter"))
    else:
        rows = rows.withColumnRenamed("t", "s")
    p = F.split(F.replace("s", "delimiter", F.lit(MARK)), MARK, -1)
    rows = rows.select(*by, "delimiter", F.size(p).alias("n"), F.size(F.filter(p, lambda v: F.trim(v).rlike(looks))).alias("ok"))
    return rows.groupBy(*by, "delimiter").agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(F.col("n") > 2).alias("lists"), F.sum("n").alias("pieces"), F.sum("ok").alias("regular")
    )


def _better(texts: DataFrame, candidates: str) -> dict[str, str]:
    """For each candidate the ones that cut the whole fields better; a row per candidate comes to the driver."""
    raw = {r.delimiter: r.lists / r.segments * r.regular / r.pieces for r in _evidence(texts, dict.fromkeys(candidates, ""), []).collect()}
    order = sorted(candidates, key=lambda c: -raw.get(c, 0.0))
    return {c: "".join(b for b in order[:i] if raw.get(b, 0.0) >= MIN_SCORE) for i, c in enumerate(order)}


def delimiter_scores(df: DataFrame, field: str, source: str, candidates: str = CANDIDATES) -> DataFrame:
    """How well each candidate separates a field, per source: ``source, delimiter, segments, lists, pieces, regular, score, chosen``.

    Candidates are first ranked over all fields; each is then scored in the
    segments that the better ones leave. Piece count: a separator gives as many
    pieces as a list has values, a mark inside values only two, so ``lists`` counts
    the segments with three pieces or more. Piece type: ``regular`` counts the pieces
    that look like values (letters at both ends, two characters or more). The score
    multiplies the two shares; all sources together count as ``PRIOR`` segments (and
    pieces) of each, so that a small source is judged mostly by the others.
    ``chosen`` marks every candidate of at least ``MIN_SCORE``. Null and empty fields say
    nothing; a null source is a source of its own; the ranking is a job of its own.
    """
    texts = _folded(df, field, source)
    return _scored(_evidence(texts, _better(texts, candidates), ["source"]))


def _scored(evidence: DataFrame) -> DataFrame:
    names = ("segments", "lists", "pieces", "regular")
    all_ = evidence.groupBy("delimiter").agg(*[F.sum(n).alias(f"all_{n}") for n in names])
    share = lambda n, of: (F.col(n) + PRIOR * F.col(f"all_{n}") / F.col(f"all_{of}")) / (F.col(of) + PRIOR)
    out = evidence.join(all_, "delimiter").select("source", "delimiter", *names, F.round(share("lists", "segments") * share("regular", "pieces"), 6).alias("score"))
    return out.withColumn("chosen", F.col("score") >= MIN_SCORE)


def split_inferred(df: DataFrame, field: str, source: str, keep: list[str], candidates: str = CANDIDATES) -> DataFrame:
    """``keep``, ``pos``, ``item`` like :func:`split_packed`, each source split at the set of delimiters that its scores choose.

    The set of all sources together holds where a source says nothing else; only
    sources that differ from it are joined to the rows, by a table of exact size
    that the planner broadcasts where it is small and joins by shuffle otherwise. A source in which no
    candidate separates keeps its fields whole; a null source is a source of its own.
    Inference is three small jobs (two passes over the field) before the rows are planned.
    """
    spark = df.sparkSession
    key = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n"))
    names = [fresh([*keep, "pos", "item"], c + "_source") if c.lower() in ("pos", "item") else c for c in keep]
    rows = df.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(f"`{field}`").alias("_field"), key.alias("_key"))
    texts = _folded(rows, "_field", "_key")
    path = scratch_path(spark, "delimiters")
    _evidence(texts, _better(texts, candidates), ["source"]).write.parquet(path)
    evidence = spark.read.schema("source string, delimiter string, segments bigint, lists bigint, pieces bigint, regular bigint").parquet(path)
    total = {r.delimiter: r.lists / r.segments * r.regular / r.pieces for r in evidence.groupBy("delimiter").agg(*[F.sum(n).alias(n) for n in ("segments", "lists", "pieces", "regular")]).collect()}
    common = "".join(c for c in candidates if round(total.get(c, 0.0), 6) >= MIN_SCORE)
    other = _scored(evidence).where(F.col("chosen") != F.contains(F.lit(common), F.col("delimiter")))
    other = other.groupBy(F.col("source").alias("_key")).agg(F.collect_set("delimiter").alias("_turned"))
    kept = [F.col(f"_k{i}").alias(n) for i, n in enumerate(names)]
    if other.isEmpty():
        return rows.select(*kept, F.posexplode(pieces(F.col("_field"), widths(common))).alias("pos", "item"))
    turned = F.coalesce(F.col("_turned"), F.array().cast("array<string>"))
    own = [F.when(F.array_contains(turned, c) != F.lit(c in common), F.lit(widths(c))).otherwise("") for c in candidates]
    got = rows.join(other, "_key", "left").withColumn("_set", reduce(F.concat, own))
    return got.select(*kept, F.posexplode(pieces(F.col("_field"), F.col("_set"))).alias("pos", "item"))
