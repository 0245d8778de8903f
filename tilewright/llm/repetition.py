"""Repeated content inside each text, by a suffix array over its words.

The suffix arrays of a batch are built together by prefix doubling: the first
rank of a suffix holds its text, so texts never mix. Common prefix lengths of
neighbours come from the ranks of the doubling rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.llm.words import slices, words
from tilewright.session import ship


def suffix_order(symbols: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array, and the ranks after each doubling round (equal ranks: equal first 1, 2, 4, ... symbols).

    ``symbols`` differ between texts; ``stops`` gives for each position the end of
    its text. Each round sorts only the suffixes that still tie.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)  # one array a round is kept
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is its first place
    levels, k = [rank], 1
    while True:
        edge = np.append(new, True)
        tied = np.flatnonzero(~(edge[:-1] & edge[1:]))  # places in the order that are in groups of two or more
        if not len(tied):
            return order, levels
        at = order[tied]
        behind = at + k
        second = np.where(behind < stops[at], rank[np.minimum(behind, n - 1)] + np.int64(1), 0)
        first = rank[at]
        o = np.lexsort((second, first))
        order[tied] = at[o]
        f, g = first[o], second[o]
        fresh = np.ones(len(o), bool)
        fresh[1:] = (f[1:] != f[:-1]) | (g[1:] != g[:-1])
        new[tied] = fresh
        rank = rank.copy()
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(o)), 0))]
        levels.append(rank)
        k *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], stops: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in the order with the one before it (0 for the first)."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])  # the others share nothing
    a, b = order[pairs].copy(), order[pairs + 1].copy()
    length = np.zeros(len(pairs), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        inside = (a < stops[order[pairs]]) & (b < stops[order[pairs + 1]])
        same = inside & (levels[j][np.minimum(a, n - 1)] == levels[j][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << j
        a, b, length = a + step, b + step, length + step
    out[pairs + 1] = length
    return out


def repetition(texts: list[list[str]], size: int) -> dict[str, np.ndarray]:
    """Per text: words, windows of ``size`` words, windows that repeat an earlier one, words covered by repeats, longest repeat."""
    counts = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(counts)
    n = int(counts.sum())
    zero = np.zeros(len(texts), np.int64)
    out = {"n_words": counts, "n_windows": np.maximum(counts - size + 1, 0), "n_repeated": zero, "n_covered": zero.copy(), "longest": zero.copy()}
    if not n:
        return out
    coded = pa.array([w for t in texts for w in t], pa.large_string()).dictionary_encode()
    text = np.repeat(np.arange(len(texts)), counts)
    symbols = text * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
    stops = ends[text]
    order, levels = suffix_order(symbols, stops)
    lcp = common_prefixes(order, levels, stops)
    long = lcp >= size
    out["n_repeated"] = np.bincount(text[order[long]], minlength=len(texts))
    # the longest repeat that starts at each word, on either side in the order
    reach = np.zeros(n, np.int64)
    reach[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    longest = out["longest"]
    np.maximum.at(longest, text, reach)
    reach[reach < size] = 0
    covered = np.maximum.accumulate(np.arange(n) + reach) > np.arange(n)
    out["n_covered"] = np.bincount(text[covered], minlength=len(texts))
    return out


COLUMNS = ("n_words", "n_windows", "n_repeated", "n_covered", "longest")


def repeated_content(df: DataFrame, record: str, text: str, size: int = 5) -> DataFrame:
    """``record, n_words, n_windows, n_repeated, n_covered, longest`` of every text.

    n_repeated counts the windows of ``size`` words that equal an earlier one,
    n_covered the words inside repeats of at least ``size`` words, longest the words
    of the longest repeat of any length. Null and empty texts have zeros; every row
    gives one row. No shuffle.
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[record]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                got = repetition([words(x) for x in part.column("t").to_pylist()], size)
                yield pa.RecordBatch.from_arrays([part.column("r"), *[pa.array(got[c], pa.int64()) for c in COLUMNS]], names=[record, *COLUMNS])

    return df.selectExpr(f"`{record}` as r", f"`{text}` as t").mapInArrow(run, f"`{record}` {kind}, " + ", ".join(f"{c} bigint" for c in COLUMNS))
