import unicodedata

import pytest
from pyspark.sql import functions as F

from tilewright.llm import lookalike


@pytest.fixture(scope="module")
def look(spark):
    return lambda text: lookalike.skeleton(text, lookalike.prototypes(spark))


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ａｂ１，", "Ab1,"), ("e\u0301", "é"), ("ṩ", "s\u0307\u0323"), ("zero\u200bwidth", "zerowidth"), ("a\u00a0b", "a b"), ("a\u3000b", "a\u2007b"), ("soft\u00adhy", "softhy"),
        ("Раris", "Paris"), ("Ѕοbum", "Sobum"), ("ё", "ë"), ("カ", "ｶ"), ("ガ", "ｶﾞ"), ("\ufeffx\u2060", "x"), ("к", "κ"),
        ("ꓮꓐ", "AB"), ("Ⅴ", "V"), ("Ⅰ", "I"), ("ⅼ", "l"), ("ﬁn", "fin"), ("𝐀", "A"), ("ᎪⲟΟ", "AoO"), ("Ø", "O\u0338"), ("ǀ", "I"), ("ロ", "口"), ("Ⅻ", "XII"),
    ],
)
def test_same_look(look, a, b):
    assert a != b and look(a) == look(b)


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("e", "é"), ("a b", "ab"), ("a-b", "ab"), ("a,b", "a;b"), ("1", "l"), ("0", "O"), ("и", "й"), ("a  b", "a b"), ("З", "3"), ("б", "6"), ("I", "l"), ("І", "l"), ("ª", "a"), ("æ", "ae"), ("ソ", "ン"), ("シ", "ツ"), ("ß", "b")])
def test_different_look(look, a, b):
    assert look(a) != look(b)


def test_skeleton_is_stable(spark, look):
    assert look(None) is None and look("") == ""
    table = lookalike.prototypes(spark)
    assert 2000 < len(table) < 20_000
    for c in table:
        s = look("x" + chr(c))
        assert look(s) == s == unicodedata.normalize("NFD", s), hex(c)


def brute(data, look):
    out = set()
    for f in (1, 2):
        for a in data:
            for b in data:
                if None not in (a[0], b[0]) and a[0] < b[0] and a[f] and b[f] and a[f] != b[f] and look(a[f]) == look(b[f]):
                    out.add((("name", "other")[f - 1], a[0], b[0]))
    return out


def test_against_all_pairs(spark, look):
    names = ["Ron", "Rοn", "R\u200bon", "Ron", "ron", None, "", "Ｒon", "x" * 50_000, "x" * 50_000 + "\u200b"]
    data = [(i % 17, names[i % len(names)], names[i * 7 % 10]) for i in range(40)] + [(None, "Ron", "Rοn")]
    df = spark.createDataFrame(data, "id bigint, name string, other string").withColumn("skeleton", F.lit(1)).withColumn("text", F.lit("t")).withColumn("_salt", F.lit(0))
    got = lookalike.lookalikes(df, "id", ["name", "other"]).collect()
    assert len(set(map(tuple, got))) == len(got) and set(map(tuple, got)) == brute(data, look)


def test_shared_names_and_empty_table(spark):
    data = [(i, "same", None) for i in range(3000)] + [(9000, "sаme", None)]
    got = lookalike.lookalikes(spark.createDataFrame(data, "id bigint, name string, other string"), "id", ["name", "other"])
    assert got.count() == 3000
    assert lookalike.lookalikes(spark.createDataFrame([], "id bigint, name string"), "id", ["name"]).count() == 0
    classes = lookalike.look_classes(spark.createDataFrame(data + data[:5], "id bigint, name string, other string"), "id", ["name", "other"])
    got = classes.agg(F.count("id"), F.countDistinct("id"), F.max("class_id"), F.max("n_spellings"), F.min("n_records")).first()
    assert tuple(got) == (3001, 3001, 0, 2, 3001)
    assert lookalike.look_classes(spark.createDataFrame([], "id bigint, name string"), "id", ["name"]).count() == 0
