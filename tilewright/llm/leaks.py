"""Passages of held-out test items inside corpus texts.

Items and texts are sequences of words; a leak is a run of ``length`` words of
an item standing in a text. All runs of all items are the patterns of one
multi-pattern search with block shifts, which looks at every block position
only where the shift table leaves no choice.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.words import slices, words
from tilewright.session import ship

#: Words of a block; a window moves by at most length - BLOCK + 1 words.
BLOCK = 3
#: Words of a text that one lane of the search reads, and slots of the shift table for each word of the items.
LANE, SLOTS_PER_WORD = 512, 16
#: Characters of items up to which they are broadcast and searched for in tables; beyond it their runs are joined.
ITEM_CHARS = 20_000_000
#: Bits (as a power of two) of the sieve that passes over most text places before that join.
SIEVE_BITS = 27
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    h = (h + words.astype(np.uint64)) * MIX
    return h ^ (h >> np.uint64(29))


def _hash(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64 bits of the ``n`` words from each place."""
    h = np.zeros(len(at), np.uint64)
    for i in range(n):
        h = _mix(h, words[at + i])
    return h


class PatternSearch:
    """Wu-Manber search for all runs of ``length`` words of all items.

    Items stay one flat array of word numbers; a pattern is a place in it, so the
    tables take a few dozen bytes per word of the items. Texts of one item id are one item.
    Equal runs are one pattern with a list of its items.
    """

    def __init__(self, items: Iterable[tuple[object, list[str]]], length: int) -> None:
        self.m, self.block = length, min(BLOCK, length)
        self.vocabulary: dict[str, int] = {}
        numbers_of: dict[object, int] = {}
        sizes, owners, numbers, known = [], [], array("i"), self.vocabulary
        for name, ws in items:
            owners.append(numbers_of.setdefault(name, len(numbers_of)))
            sizes.append(len(ws))
            numbers.extend(known.setdefault(w, len(known) + 1) for w in ws)
        self.items = list(numbers_of)
        size = np.array(sizes, np.int64)
        self.words = np.array(numbers, np.int32)
        ends = np.repeat(np.cumsum(size), size)
        place = np.flatnonzero(np.arange(len(self.words)) + length <= ends) if len(ends) else np.zeros(0, np.int64)
        self.bits = max(16, int(SLOTS_PER_WORD * len(self.words)).bit_length())
        step = length - self.block + 1
        self.shift = np.full(1 << self.bits, step, np.uint8 if step < 256 else np.int32)
        for q in range(step):  # a block that ends q + block words into a pattern allows a move of the words behind it
            slots = self._slot(_hash(self.words, place + q, self.block))
            self.shift[slots] = np.minimum(self.shift[slots], step - 1 - q)
        tails = self._key(_hash(self.words, place + step - 1, self.block), _hash(self.words, place, self.block))
        order = np.lexsort((_hash(self.words, place, length), tails))
        tails, place = tails[order], place[order]
        new = np.ones(len(place), bool)
        if len(place):
            new[1:] = tails[1:] != tails[:-1]
            for i in range(length):
                new[1:] |= self.words[place[1:] + i] != self.words[place[:-1] + i]
        start = np.flatnonzero(new)
        self.tails, self.place = tails[start], place[start]
        owner = np.repeat(np.array(owners, np.int64), size)[place] if len(place) else place
        pairs = np.unique(np.stack([np.cumsum(new) - 1, owner], axis=1), axis=0) if len(place) else np.zeros((0, 2), np.int64)
        self.owner = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(start) + 1))

    @staticmethod
    def _key(tail: np.ndarray, head: np.ndarray) -> np.ndarray:
        return tail ^ (head * MIX)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, texts: list[list[str]]) -> list[tuple[int, int, int]]:
        """(text, item, places of the text at which a run of the item ends), each pair once."""
        if not len(self.place):
            return []
        get = self.vocabulary.get
        size = np.array([len(t) for t in texts], np.int64)
        w = np.fromiter((get(x, 0) for t in texts for x in t), np.int32, int(size.sum()))
        ends = np.cumsum(size)
        # lanes: stretches of LANE window ends of one text
        count = np.where(size >= self.m, -(-(size - self.m + 1) // LANE), 0)
        text = np.repeat(np.arange(len(texts)), count)
        number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        pos = (ends - size)[text] + self.m - 1 + number * LANE
        stop = np.minimum(pos + LANE, ends[text])
        hits: list[np.ndarray] = []
        back, along = np.arange(self.m)[::-1], np.arange(self.m)
        while len(pos):
            tail = _hash(w, pos - self.block + 1, self.block)
            move = self.shift[self._slot(tail)].astype(np.int64)
            still = np.flatnonzero(move == 0)
            if len(still):
                key = self._key(tail[still], _hash(w, pos[still] - self.m + 1, self.block))
                lo, hi = np.searchsorted(self.tails, key, "left"), np.searchsorted(self.tails, key, "right")
                for k in range(int((hi - lo).max())):  # different patterns of one bucket, one after the other
                    some = np.flatnonzero(lo + k < hi)
                    p = lo[some] + k
                    at = pos[still[some]]
                    same = (w[at[:, None] - back] == self.words[self.place[p][:, None] + along]).all(axis=1)
                    hits.append(np.stack([text[still[some[same]]], p[same], at[same]], axis=1))
                move[still] = 1
            pos = pos + move
            go = pos < stop
            pos, stop, text = pos[go], stop[go], text[go]
        found = np.concatenate(hits) if hits else np.zeros((0, 3), np.int64)
        if not len(found):
            return []
        n = self.first[found[:, 1] + 1] - self.first[found[:, 1]]
        at = np.repeat(self.first[found[:, 1]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        found = np.stack([np.repeat(found[:, 0], n), self.owner[at], np.repeat(found[:, 2], n)], axis=1)
        places = np.unique(found, axis=0)  # a text's place counts once for an item that says the run twice
        pairs, n = np.unique(places[:, :2], axis=0, return_counts=True)
        return [(a, k, c) for (a, k), c in zip(pairs.tolist(), n.tolist(), strict=True)]


def leaked(docs: DataFrame, record: str, text: str, items: DataFrame, item: str, item_text: str, length: int = 10) -> DataFrame:
    """``record, item, n_runs``: texts that hold at least ``length`` consecutive words of an item; n_runs counts the places.

    Null and empty texts, texts and items with fewer words, and null ids of items
    give no row; a row of ``docs`` that is repeated gives its rows again; texts of one item id are one item. The texts are read
    once. Items of up to ``ITEM_CHARS`` characters in all are broadcast and searched for; more
    of them never meet in one place: their runs are joined with the places of the
    texts that a sieve of fixed size lets through, run by run, as text.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("t")).distinct()
    source = docs.selectExpr(f"`{record}` as r", f"`{text}` as t")
    kind, item_kind = dict(docs.dtypes)[record], dict(items.dtypes)[item]
    chars = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    if chars <= ITEM_CHARS:
        shared = spark.sparkContext.broadcast([tuple(r) for r in rows.collect()])  # at most ITEM_CHARS
        return source.mapInArrow(_finder(shared, length, record, item), f"`{record}` {kind}, `{item}` {item_kind}, n_runs bigint")
    runs = rows.mapInArrow(_runs(length, None), f"i {item_kind}, n bigint, at int, h bigint, run string").select("i", "run", "h").distinct()
    words = runs.groupBy(F.shiftrightunsigned("h", 64 - SIEVE_BITS + 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - SIEVE_BITS}) & 63 as int))")).alias("b"))
    sieve = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    got = words.toArrow()  # at most 2^SIEVE_BITS bits
    sieve[got.column("w").to_numpy()] = got.column("b").to_numpy()
    rows = source.withColumnRenamed("r", "i").mapInArrow(_runs(length, spark.sparkContext.broadcast(sieve)), f"i {kind}, n bigint, at int, h bigint, run string")
    met = rows.select(F.col("i").alias("r"), "n", "at", "run").join(runs.select("i", "run"), "run")
    met = met.groupBy("r", "n", "i").agg(F.countDistinct("at").alias("n_runs"))
    return met.select(F.col("r").alias(record), F.col("i").alias(item), "n_runs")


def _runs(length: int, sieve):
    """Runs of ``length`` words of each row ``(i, t)``: the id, a number for the row, the place, 64 bits and the text of the run, if the sieve lets it through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "t"):
                for n, t in enumerate(part.column("t").to_pylist()):
                    row += 1
                    ws = words(t)
                    if len(ws) < length:
                        continue
                    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ws), np.uint64, len(ws))
                    h = _hash(codes, np.arange(len(ws) - length + 1), length)
                    at = np.arange(len(h))
                    if sieve is not None:
                        bit = h >> np.uint64(64 - SIEVE_BITS)
                        at = np.flatnonzero(sieve.value[(bit >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (bit & np.uint64(63)) & np.uint64(1))
                    if len(at):
                        texts = pa.array([" ".join(ws[k : k + length]) for k in at.tolist()], pa.string())
                        own = part.column("i").take(pa.array(np.full(len(at), n)))
                        yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(at), row)), pa.array(at, pa.int32()), pa.array(h[at].view(np.int64)), texts], names=["i", "n", "at", "h", "run"])

    return run


#: The last tables a worker built, with the broadcast items they are of.
_ready: list = []


def _finder(shared, length: int, record: str, item: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tilewright.llm.leaks import _ready as ready  # the worker's own, which lasts from task to task

        if not ready or ready[0] is not shared.value or ready[1] != length:
            ready[:] = [shared.value, length, PatternSearch(((i, words(t)) for i, t in shared.value), length)]
        search = ready[2]
        for batch in batches:
            for part in slices(batch, "t"):
                texts = [words(x) for x in part.column("t").to_pylist()]
                got = search.find(texts)
                ids = part.column("r").take(pa.array([a for a, _, _ in got], pa.int64()))
                names = pa.array([search.items[k] for _, k, _ in got])
                if got:
                    yield pa.RecordBatch.from_arrays([ids, names, pa.array([n for _, _, n in got], pa.int64())], names=[record, item, "n_runs"])

    return run
