"""One form for texts that look the same, and the records that agree only in it."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.skew import bounded, heavy_keys, salted
from tilewright.session import scratch_path, ship

#: Records of one look that a task of a join takes before they are salted.
ROWS_PER_SALT = 20_000
#: Code points that leave no mark besides those of category Cf: joiner, fillers and variation selectors.
BLANK = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
#: Format characters that are seen (signs above or around numbers).
SEEN = [*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD]
#: Compatibility forms that look like the plain characters.
SAME_FORM = ("<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
_tables: dict[int, dict[int, str | None]] = {}


def prototypes(spark: SparkSession) -> dict[int, str | None]:
    """Code point to its prototype, for str.translate; a few thousand entries, made once on the driver.

    Invisible characters go to nothing and spaces to a space. Forms of another width or font,
    ligatures and number letters go to their plain letters. Other letters go to the prototype of the public
    confusables data in the ICU library that Spark ships, if it is one letter, with accents or
    without. That data takes I and l for the same; here case is seen, so what is no small letter goes
    to I. Prototypes that are digits or signs are left out: 3 is no letter of another script.
    """
    key = id(spark.sparkContext)
    if key not in _tables:
        _tables.clear()
        _tables[key] = _prototypes(spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build())
    return _tables[key]


def _prototypes(checker) -> dict[int, str | None]:
    decomposed, category = unicodedata.normalize, unicodedata.category
    letters = lambda t: all(category(c)[0] in "LM" for c in t) and category(t[0])[0] == "L"
    out: dict[int, str | None] = {}
    others = []
    for c in range(0x80, sys.maxunicode + 1):
        ch = chr(c)
        kind, form = category(ch), unicodedata.decomposition(ch)
        if kind == "Cf":
            out[c] = None
        elif kind == "Zs":
            out[c] = " "
        elif form.startswith(("<wide>", "<narrow>")) or (kind[0] in "LN" and form.startswith(SAME_FORM) and letters(decomposed("NFKD", ch))):
            out[c] = decomposed("NFKD", ch)
        elif (kind[0] == "L" or kind == "Nl") and not form and not 0xAC00 <= c < 0xD7A4:
            others.append(ch)
    for ch, found in zip(others, checker.getSkeleton(0, "\n".join(others)).split("\n"), strict=True):
        bases = [c for c in found if not unicodedata.combining(c)]
        if found == "l" and category(ch) != "Ll":
            found = "I"
        if len(bases) == 1 and letters(found) and found != ch:
            out[ord(ch)] = found
    for c in SEEN:
        out.pop(c, None)
    out |= dict.fromkeys(BLANK, None)
    # a prototype that has one itself
    for c, t in list(out.items()):
        if t and any(ord(x) in out for x in t):
            out[c] = decomposed("NFD", t).translate(out)
    return out


def skeleton(text: str | None, table: dict[int, str | None]) -> str | None:
    """Decompose, replace every character by its prototype, decompose again. Null stays null."""
    if text is None or text.isascii():
        return text
    n = unicodedata.normalize
    return n("NFD", n("NFD", text).translate(table))


def skeleton_of(text: Column, spark: SparkSession) -> Column:
    """:func:`skeleton` of a column; ASCII texts, which are their own skeleton, do not go to Python."""
    shared = spark.sparkContext.broadcast(prototypes(spark))

    def run(texts: pd.Series) -> pd.Series:
        table = shared.value
        return texts.map(lambda t: skeleton(t, table), na_action="ignore")

    ascii_only = text.rlike(r"\A[\x00-\x7F]*+\z")
    return F.coalesce(F.pandas_udf(run, "string")(F.when(~ascii_only, text)), text)


def _digest(text: Column) -> Column:
    """128 bits of a text, to compare long texts without moving them."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _alike(df: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """``id, field, text, skeleton`` of the records whose skeleton has several spellings, written once to the shared folder.

    First only digests are grouped: a skeleton whose least and greatest spelling
    digest are equal has one spelling and is done, so a name that many records
    share costs nothing. Rows of very common skeletons are salted when the others are picked.
    """
    spark = df.sparkSession
    ship(spark)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("text")) for f in fields])
    rows = df.select(F.col(f"`{record}`").alias("id"), F.inline(each)).where("id is not null and text != ''")
    looks = rows.withColumn("look", F.xxhash64(skeleton_of(F.col("text"), spark)))
    several = looks.select("field", "look", _digest(F.col("text")).alias("d")).groupBy("field", "look").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a != b").select("field", "look")
    heavy = bounded(spark, heavy_keys(looks, ["field", "look"], 0.002))
    picked = salted(looks, ["field", "look"], heavy, ROWS_PER_SALT, F.xxhash64("id")).join(salted(several, ["field", "look"], heavy, ROWS_PER_SALT, None), ["field", "look", "_salt"], "left_semi")
    path = scratch_path(spark, "alike")  # few rows, used several times
    picked.select("id", "field", "text").distinct().withColumn("skeleton", skeleton_of(F.col("text"), spark)).write.parquet(path)
    return spark.read.schema(f"id {dict(df.dtypes)[record]}, field string, text string, skeleton string").parquet(path)


def lookalikes(df: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """``field, id_a, id_b``, id_a < id_b: different records whose field looks the same without being the same characters.

    Null and empty texts and null records take no part; repeated rows count once.
    Spellings of one skeleton are paired, then their records by two equi-joins, salted where one
    spelling has very many. Rows grow with the records of such pairs; :func:`look_classes`
    gives the same in a row per record.
    """
    spark = df.sparkSession
    rows = _alike(df, record, fields)
    spellings = rows.select("field", "skeleton", "text").distinct()
    one, two = spellings.withColumnRenamed("text", "text_a"), spellings.withColumnRenamed("text", "text_b")
    pairs = one.join(two, ["field", "skeleton"]).where("text_a < text_b").select(F.concat_ws(":", "field", "text_a").alias("k"), F.concat_ws(":", "field", "text_b").alias("k_b"), "field")
    members = rows.select("id", F.concat_ws(":", "field", "text").alias("k"))
    heavy = bounded(spark, heavy_keys(members, "k", 0.002))
    spread = salted(members, "k", heavy, ROWS_PER_SALT, F.xxhash64("id"))
    first = spread.join(salted(pairs, "k", heavy, ROWS_PER_SALT, None), ["k", "_salt"]).select("field", F.col("id").alias("x"), F.col("k_b").alias("k"))
    both = salted(first, "k", heavy, ROWS_PER_SALT, None).join(spread.withColumnRenamed("id", "y"), ["k", "_salt"]).where("x != y")
    return both.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def look_classes(df: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """``field, id, class_id, n_spellings, n_records``: each record of a class of several spellings that look the same, once.

    ``class_id`` is the class's least record. Nulls, empty texts and repeated rows as in :func:`lookalikes`.
    """
    spark = df.sparkSession
    rows = _alike(df, record, fields).withColumn("k", F.concat_ws(":", "field", "skeleton"))
    spellings = rows.groupBy("k", "text").agg(F.min("id").alias("least")).groupBy("k").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n_spellings"))
    members = rows.select("k", "field", "id").distinct()
    classes = spellings.join(members.groupBy("k").agg(F.count(F.lit(1)).alias("n_records")), "k")
    heavy = bounded(spark, heavy_keys(members, "k", 0.002))
    got = salted(members, "k", heavy, ROWS_PER_SALT, F.xxhash64("id")).join(salted(classes, "k", heavy, ROWS_PER_SALT, None), ["k", "_salt"])
    return got.select("field", "id", "class_id", "n_spellings", "n_records")
