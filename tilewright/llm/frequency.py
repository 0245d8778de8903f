"""How often every distinct term occurs, and in how many records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.skew import frequent
from tilewright.session import ship

#: A term is heavy with about this share of all rows; there are at most MAX_HEAVY of them, of at most MAX_TERM characters.
HEAVY_SHARE, MAX_HEAVY, MAX_TERM = 0.002, 256, 256
WORDS = MAX_HEAVY // 64


def _count_heavy(names):
    """Counts heavy rows where they are read: an exact array of occurrences a task, a set of slots per record and batch.

    ``_record, _term`` to ``_record, _term, _n, _b0..``: a row of another term as it is, a record with its set (no term), or
    a heavy term with a sum of the array (no record).
    """
    columns = ["_record", "_term", "_n", *[f"_b{i}" for i in range(WORDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names.value, pa.string())
        occurs = np.zeros(len(known), np.int64)
        kind = pa.null()

        def rows(record, term, n, words=None) -> pa.RecordBatch:
            words = [pa.nulls(len(n), pa.int64())] * WORDS if words is None else [pa.array(w.view(np.int64)) for w in words]
            return pa.RecordBatch.from_arrays([record, term, pa.array(n, pa.int64()), *words], names=columns)

        for b in batches:
            record, term = b.column("_record"), b.column("_term").cast(pa.string())
            kind = record.type
            slot = pc.fill_null(pc.index_in(term, value_set=known), -1).to_numpy(zero_copy_only=False)
            other = pa.array(slot < 0)
            yield rows(record.filter(other), term.filter(other), np.ones(int((slot < 0).sum()), np.int64))
            heavy = slot >= 0
            occurs += np.bincount(slot[heavy], minlength=len(known))
            heavy &= record.is_valid().to_numpy(zero_copy_only=False)
            own = record.filter(pa.array(heavy)).dictionary_encode()
            at = slot[heavy]
            words = np.zeros((WORDS, len(own.dictionary)), np.uint64)
            np.bitwise_or.at(words, (at >> 6, own.indices.to_numpy(zero_copy_only=False)), np.uint64(1) << (at & 63).astype(np.uint64))
            yield rows(own.dictionary, pa.nulls(len(own.dictionary), pa.string()), np.zeros(len(own.dictionary), np.int64), words)
        used = np.flatnonzero(occurs)
        if len(used):
            yield rows(pa.nulls(len(used), kind), known.take(pa.array(used)), occurs[used])

    return run


def _count_records(names):
    """Adds up the sets of records in an exact local array; other rows pass. ``_term, occurrences, records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names.value, pa.string())
        records = np.zeros(MAX_HEAVY, np.int64)
        for b in batches:
            is_set = b.column("_term").is_null()
            sets = b.filter(is_set)
            words = np.stack([sets.column(f"_b{i}").to_numpy(zero_copy_only=False) for i in range(WORDS)], axis=1).astype("<i8")
            records += np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            rest = b.filter(pc.invert(is_set))
            yield pa.RecordBatch.from_arrays([rest.column("_term"), rest.column("_n"), rest.column("_record").is_valid().cast(pa.int64())], names=["_term", "occurrences", "records"])
        used = np.flatnonzero(records)
        yield pa.RecordBatch.from_arrays([known.take(pa.array(used)), pa.array(np.zeros(len(used), np.int64)), pa.array(records[used])], names=["_term", "occurrences", "records"])

    return run


def term_counts(terms: DataFrame, record: str, term: list[str]) -> DataFrame:
    """``term`` columns, ``occurrences`` (rows) and ``records`` (distinct non-null records) of every distinct term.

    ``term`` names string columns, compared exactly, as stored. Rows with a null in one
    are left out; a null record occurs but is no record. Two passes over the rows: a sketch
    finds heavy terms, a bounded list that is broadcast; the second pass adds up
    their occurrences in exact local arrays, so no row of a heavy term is shuffled.
    To count records, a record's heavy terms become one set of ``MAX_HEAVY`` bits,
    shuffled by record and added up in local arrays behind the shuffle. Rows of the other terms are shuffled
    by record and term, which spreads any term over all tasks, and the two
    tables are united by a last sum over partial counts. A heavy term of more than ``MAX_TERM``
    characters goes the way of the others.
    """
    spark = terms.sparkSession
    ship(spark)
    some = " and ".join(f"`{c}` is not null" for c in term)
    joined = F.concat(*[x for c in term for x in (F.length(f"`{c}`").cast("string"), F.lit(":"), F.col(f"`{c}`"))])
    rows = terms.where(some).select(F.col(f"`{record}`").alias("_record"), joined.alias("_term"))
    names = sorted(r.item for r in frequent(rows.where(F.length("_term") <= MAX_TERM), "_term", HEAVY_SHARE, MAX_HEAVY).collect())
    shared = spark.sparkContext.broadcast(names)
    words = [f"_b{i}" for i in range(WORDS)]
    shape = f"_record {dict(rows.dtypes)['_record']}, _term string, _n bigint, " + ", ".join(f"{w} bigint" for w in words)
    each = rows.mapInArrow(_count_heavy(shared), shape).groupBy("_record", "_term").agg(F.sum("_n").alias("_n"), *[F.bit_or(w).alias(w) for w in words])
    counts = each.mapInArrow(_count_records(shared), "_term string, occurrences bigint, records bigint")
    out = counts.groupBy(F.col("_term").alias("_rest")).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    for c in term:
        n = F.substring_index("_rest", ":", 1)
        size = n.cast("int")
        out = out.withColumn(c, F.substr(F.col("_rest"), F.length(n) + 2, size)).withColumn("_rest", F.substr(F.col("_rest"), F.length(n) + 2 + size))
    return out.select(*[f"`{c}`" for c in term], "occurrences", "records")


def marks(counts: DataFrame, total_records: Column, rare: int = 2, common_share: tuple[int, int] = (1, 4)) -> DataFrame:
    """Adds ``mark``: ``rare`` (in at most ``rare`` records), ``common`` (in more than the share of all records) or null."""
    a, b = common_share
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") * b > total_records * a, "common")
    return counts.withColumn("mark", mark)
