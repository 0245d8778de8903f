from collections import defaultdict

from pyspark.sql import functions as F

from tilewright.llm import frequency


def counts(df, term=("k", "v")):
    return {tuple(r[c] for c in term): (r.occurrences, r.records) for r in frequency.term_counts(df, "id", list(term)).collect()}


def test_against_counting(spark):
    data = [(i % 50, "hot", "") for i in range(2000)] + [(i, f"k{i % 97}", f"v:{i % 11}") for i in range(1500)]
    data += [(None, "hot", ""), (None, "only", "null"), (1, None, "x"), (1, "x", None), (1, "3:a", "b"), (1, "3", "a:b"), (1, "é" * 2000, "long"), (1, " hot", "")]
    df = spark.createDataFrame(data, "id bigint, k string, v string").withColumn("slot", F.lit(1)).withColumn("n", F.lit(1)).withColumn("_term", F.lit("x")).withColumn("occurrences", F.lit(1))
    want = defaultdict(lambda: [0, set()])
    for i, k, v in data:
        if k is not None and v is not None:
            want[k, v][0] += 1
            want[k, v][1] |= {i} - {None}
    assert counts(df) == {t: (n, len(ids)) for t, (n, ids) in want.items()}


def test_empty_and_only_nulls(spark):
    ddl = "id bigint, k string, v string"
    assert counts(spark.createDataFrame([], ddl)) == {} == counts(spark.createDataFrame([(1, None, None)], ddl))


def test_all_terms_heavy(spark):
    assert counts(spark.createDataFrame([(i, "a", "b") for i in range(9)] * 3, "id bigint, k string, v string")) == {("a", "b"): (27, 9)}


def test_no_heavy_row_is_shuffled(spark):
    """What is shuffled first: light rows, a set per record, and a sum per heavy term and task."""
    data = [(i % 100, f"h{i % 70}") for i in range(7000)] + [(i, f"l{i}") for i in range(300)]
    df = spark.createDataFrame(data, "id bigint, k string").repartition(3)
    seen = []
    run = frequency._count_heavy(spark.sparkContext.broadcast([f"{len(k)}:{k}" for k in sorted({k for _, k in data if k[0] == "h"})]))
    import pyarrow as pa

    rows = df.select("id", F.concat(F.length("k").cast("string"), F.lit(":"), "k").alias("t")).toArrow().to_batches()
    for b in run([pa.RecordBatch.from_arrays([b.column("id"), b.column("t")], names=["_record", "_term"]) for b in rows]):
        seen += b.to_pylist()
    assert sum(r["_term"] is not None and r["_record"] is not None for r in seen) == 300
    assert sum(r["_term"] is None for r in seen) <= 100 * len(rows) and sum(r["_record"] is None for r in seen) == 70
    want = defaultdict(lambda: [0, set()])
    for i, k in data:
        want[k,][0] += 1
        want[k,][1].add(i)
    assert counts(df, ("k",)) == {t: (n, len(ids)) for t, (n, ids) in want.items()}


def test_marks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 25), ("e", 26)], "k string, records bigint")
    got = {r.k: r.mark for r in frequency.marks(df, F.lit(100)).collect()}
    assert got == {"a": "rare", "b": "rare", "c": None, "d": None, "e": "common"}
