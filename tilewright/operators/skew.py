"""Per-key work whose pace the largest keys do not set.

Heavy keys are found with a frequent-items sketch of fixed size over 64-bit
digests of the keys, so the list of them is small and bounded whatever the data and however
long a key is. Everything else is exact: the list only decides which way a row takes, and
keys that share a digest take the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most heavy keys that are ever broadcast.
MAX_HEAVY = 512
#: Rows of a heavy key that one salt takes.
ROWS_PER_SALT = 1_000_000


def frequent(df: DataFrame, column: str, min_share: float, most: int) -> DataFrame:
    """``item, count``: values with about ``min_share`` of the non-null rows or more, at most ``most``, by a sketch of 16 times as many counters."""
    top = df.where(F.col(column).isNotNull()).agg(F.expr(f"approx_top_k(`{column}`, {most}, {16 * most})").alias("top"), F.count(F.lit(1)).alias("n"))
    return top.select(F.explode("top").alias("t"), "n").where(F.col("t.count") >= F.greatest(F.lit(2.0), F.col("n") * min_share)).select("t.item", "t.count")


def digest(key: str | Sequence[str]) -> Column:
    """64 bits of the key columns; the digest of a null key is a number too."""
    return F.xxhash64(*[F.col(f"`{k}`") for k in ([key] if isinstance(key, str) else key)])


def heavy_keys(df: DataFrame, key: str | Sequence[str], min_share: float = 0.01, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """Digests of keys that hold about ``min_share`` of the rows or more: ``(_digest, heavy_rows)``, at most ``max_heavy`` rows.

    One pass. A key the sketch overlooks or adds only changes speed, never a
    result. Rows with a null in the key do not count; an empty table has no heavy key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    some = df.where(" and ".join(f"`{k}` is not null" for k in keys)).select(digest(keys).alias("_digest"))
    return frequent(some, "_digest", min_share, max_heavy).select(F.col("item").alias("_digest"), F.col("count").alias("heavy_rows"))


def bounded(spark, small: DataFrame) -> DataFrame:
    """The heavy list as a literal relation (its size is bounded by ``max_heavy``), so that later plans do not redo the sketch."""
    return spark.createDataFrame(small.limit(MAX_HEAVY).toArrow(), small.schema)


def fresh(taken: list[str], base: str) -> str:
    """``base``, with underscores added until no column is named so (in any case)."""
    lower = {c.lower() for c in taken}
    while base.lower() in lower:
        base += "_"
    return base


def salts_of(heavy_rows: Column, rows_per_salt: int) -> Column:
    """Salts of a key by the sketch's estimate of its rows; one for a key that is not heavy."""
    return F.coalesce(F.ceil(heavy_rows / F.lit(float(rows_per_salt))), F.lit(1)).cast("int")


def _marked(df: DataFrame, key: str | Sequence[str], heavy: DataFrame, name: str) -> DataFrame:
    """Adds the estimate of a heavy key's rows, null for any other key, by a broadcast join with the bounded list."""
    d = fresh([*df.columns, name], "_digest")
    return df.withColumn(d, digest(key)).join(F.broadcast(heavy.select(F.col("_digest").alias(d), F.col("heavy_rows").alias(name))), d, "left").drop(d)


def aggregate_by_key(df: DataFrame, key: str, aggs: list[Column], merges: list[Column], heavy: DataFrame, rows_per_salt: int | None = None) -> DataFrame:
    """Per-key aggregates in one pass: a heavy key is spread over as many partial groups as the sketch's estimate asks for, any other has one.

    ``aggs`` are partial aggregates, ``merges`` combine their output columns, which unites
    the two. Null keys form one group like the others. Heavy rows are recognised by a broadcast
    join with the bounded list. An empty table gives no group; columns of ``df``
    may have any names.
    """
    size, salt = fresh(df.columns, "_heavy"), fresh(df.columns, "_salt")
    plain = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    n = salts_of(F.col(size), rows_per_salt or ROWS_PER_SALT)
    marked = _marked(df, key, heavy, size).withColumn(salt, F.when(F.col(size).isNotNull(), F.pmod(F.xxhash64(*plain), n)))
    return marked.groupBy(key, salt).agg(*aggs).groupBy(key).agg(*merges)


def skew_join(fact: DataFrame, dim: DataFrame, key: str, heavy: DataFrame, how: str = "left") -> DataFrame:
    """``fact`` joined to ``dim`` (unique ``key``): heavy keys by broadcast, the rest by shuffle, united.

    The broadcast part of ``dim`` has at most one row per heavy key (and per key that shares
    its digest). A null key matches nothing; a left join keeps its row without sending it
    through a shuffle. Columns of ``dim`` that ``fact`` has too get ``_dim`` behind their name.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    taken = list(fact.columns)
    names = {}
    for c in dim.columns:
        if c != key:
            names[c] = fresh(taken, c + "_dim") if c.lower() in {t.lower() for t in taken} else c
            taken.append(names[c])
    dim = dim.select(F.col(f"`{key}`"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    size = fresh(taken, "_heavy")
    facts, dims = _marked(fact, key, heavy, size), _marked(dim, key, heavy, size)
    is_hot, is_null = F.col(size).isNotNull(), F.col(f"`{key}`").isNull()
    near = facts.where(is_hot | is_null if how == "left" else is_hot).drop(size).join(F.broadcast(dims.where(is_hot).drop(size)), key, how)
    return near.unionByName(facts.where(~is_hot & ~is_null).drop(size).join(dims.where(~is_hot).drop(size), key, how))


def salted(df: DataFrame, key: str | Sequence[str], heavy: DataFrame, rows_per_salt: int, spread: Column | None) -> DataFrame:
    """Adds ``_salt`` for a join on (key, _salt): a heavy key has heavy_rows / rows_per_salt salts, others one.

    ``spread`` hashes a row to one of its salts; without it the row is repeated for every salt (the other side).
    """
    out = _marked(df, key, heavy, "_heavy_rows")
    n = salts_of(F.col("_heavy_rows"), rows_per_salt)
    salt = F.explode(F.sequence(F.lit(0), n - 1)) if spread is None else F.pmod(spread, n).cast("int")
    return out.withColumn("_salt", salt).drop("_heavy_rows")


def both_salted(left: DataFrame, right: DataFrame, key: str, heavy_left: DataFrame, heavy_right: DataFrame, rows_per_salt: int, spread_left: Column, spread_right: Column) -> tuple[DataFrame, DataFrame]:
    """The two sides of an equi-join with ``_sa`` and ``_sb``, to be joined on (key, _sa, _sb).

    A key with very many rows on either side is split there and repeated on the other; with very many on both, every
    part of one side meets every part of the other.
    """
    name = lambda df, c: df.withColumnRenamed("_salt", c)
    left = name(salted(name(salted(left, key, heavy_left, rows_per_salt, spread_left), "_sa"), key, heavy_right, rows_per_salt, None), "_sb")
    right = name(salted(name(salted(right, key, heavy_left, rows_per_salt, None), "_sa"), key, heavy_right, rows_per_salt, spread_right), "_sb")
    return left, right
