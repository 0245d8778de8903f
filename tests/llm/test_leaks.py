import random
import sys
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.llm import leaks
from tilewright.llm.words import WORD, words


def test_words():
    assert words("A\\emph{Ünïted}-x2\\frac12 ½ ٣ don't _a_ \\\\b") == ["a", "ünïted", "x2", "12", "½", "٣", "don", "t", "a"]
    assert words(None) == words("") == words("\\alpha") == []
    for c in map(chr, range(sys.maxunicode + 1)):
        assert bool(WORD.fullmatch(c)) == (unicodedata.category(c)[0] in "LN"), c


def brute(texts, items, m):
    runs = lambda ws: [tuple(ws[i : i + m]) for i in range(len(ws) - m + 1)]
    out = set()
    for a, t in enumerate(texts):
        for k, (_, ws) in enumerate(items):
            n = sum(r in set(runs(ws)) for r in runs(t))
            if n:
                out.add((a, k, n))
    return out


@settings(max_examples=200, deadline=None)
@given(st.data(), st.integers(1, 6))
def test_search_against_all_places(data, m):
    word = st.sampled_from("abc")
    items = [(i, data.draw(st.lists(word, max_size=9))) for i in range(data.draw(st.integers(0, 4)))]
    texts = data.draw(st.lists(st.lists(word, max_size=30), max_size=5))
    assert set(leaks.PatternSearch(items, m).find(texts)) == brute(texts, items, m)


def test_long_texts_cross_lanes():
    r = random.Random(2)
    item = [f"w{i}" for i in range(40)]
    texts = []
    for start in (0, 500, 505, 511, 512, 1023, 5000):
        t = [f"x{r.randrange(99)}" for _ in range(6000)]
        t[start : start + 12] = item[7:19]
        texts.append(t)
    items = [(5, item)]
    assert set(leaks.PatternSearch(items, 10).find(texts)) == brute(texts, items, 10)


@pytest.mark.parametrize("block", [10, 20_000_000])
def test_tables(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "ITEM_CHARS", block)
    monkeypatch.setattr(leaks, "SIEVE_BITS", 12)
    item = " ".join(f"word{i}" for i in range(15))
    docs = [(1, "Intro. " + item.upper() + " end"), (2, None), (3, ""), (4, " ".join(item.split()[:9])), (5, "\\textbf{" + ", ".join(item.split()[3:13]) + "}"), (None, item), (1, item)]
    items = [(7, item), (8, "too short"), (9, None), (None, item), (10, item), (7, item), (10, "more " + item)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0)).withColumn("r", F.lit(0))
    got = leaks.leaked(d, "doc_id", "text", spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text").collect()
    want = {(a, b, n) for a, n in ((1, 6), (5, 1), (None, 6)) for b in (7, 10)}
    assert {tuple(r) for r in got} == want and len(got) == 8
    none = leaks.leaked(d, "doc_id", "text", spark.createDataFrame([], "item_id bigint, text string"), "item_id", "text")
    assert none.count() == 0
    assert leaks.leaked(d.limit(0), "doc_id", "text", spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text").count() == 0


def test_items_that_share_runs_and_texts_of_one_item():
    r = random.Random(4)
    shared = [f"s{i}" for i in range(12)]
    items = [(i, shared + [f"i{i}w{j}" for j in range(r.randrange(12))]) for i in range(300)] + [(5, ["x", *shared])]
    search = leaks.PatternSearch(items, 10)
    assert len(search.items) == 300
    got = search.find([shared, ["y", *shared, "i7w0"], shared[:9]])
    assert {(a, search.items[k]) for a, k, _ in got} == {(a, i) for a in (0, 1) for i in range(300)} and len(got) == 600


def test_shift_table_grows_with_the_items():
    r = random.Random(5)
    items = [(i, [f"w{r.randrange(50_000)}" for _ in range(200)]) for i in range(500)]
    search = leaks.PatternSearch(items, 10)
    assert (search.shift == 0).mean() < 0.1
