from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.llm.repetition import COLUMNS, repeated_content, repetition


def brute(ws, size):
    n = len(ws)
    windows = [tuple(ws[i : i + size]) for i in range(n - size + 1)]
    longest, spans = 0, [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and ws[i + k] == ws[j + k]:
                    k += 1
                spans[i] = max(spans[i], k)
        longest = max(longest, spans[i])
    covered = {p for i, k in enumerate(spans) if k >= size for p in range(i, i + k)}
    return n, len(windows), len(windows) - len(set(windows)), len(covered), longest


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), max_size=6), st.integers(1, 5))
def test_against_all_pairs(texts, size):
    got = repetition(texts, size)
    assert [tuple(int(got[c][i]) for c in COLUMNS) for i in range(len(texts))] == [brute(t, size) for t in texts]


def test_long_repeats():
    got = repetition([["a"] * 5000, [str(i) for i in range(5000)], [str(i % 1000) for i in range(3000)]], 5)
    assert got["n_repeated"].tolist() == [4995, 0, 1996] and got["longest"].tolist() == [4999, 0, 2000] and got["n_covered"].tolist() == [5000, 0, 3000]


def test_memory_of_a_very_long_text():
    import tracemalloc

    words = ["a"] * 400_000
    tracemalloc.start()
    got = repetition([words], 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["longest"].tolist() == [399_999] and peak < 400_000 * 260


def test_table(spark):
    phrase = "one two three four five six "
    data = [(1, phrase * 3), (2, None), (3, ""), (4, "a b c d"), (5, phrase), (1, phrase * 3), (None, phrase * 2)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("n_words", F.lit(1)).withColumn("t", F.lit(1))
    got = sorted(repeated_content(df, "doc_id", "text").collect(), key=str)
    assert sorted((tuple(r) for r in got), key=str) == sorted(
        [(1, 18, 14, 8, 18, 12), (1, 18, 14, 8, 18, 12), (2, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0), (4, 4, 0, 0, 0, 0), (5, 6, 2, 0, 0, 0), (None, 12, 8, 2, 12, 6)], key=str
    )
    assert repeated_content(df.limit(0), "doc_id", "text").count() == 0
