"""Entity, attribute, value rows to one wide, typed row per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.session import scratch_path

STRING, INT, DOUBLE = 0, 1, 2
#: Bytes of source rows for each bucket, most buckets (a bound of Spark's own), and attributes that one leaf of the join tree takes.
BUCKET_BYTES, MAX_BUCKETS, LEAF = 1 << 30, 100_000, 4
SQL_TYPE = {STRING: "string", INT: "bigint", DOUBLE: "double"}


def _hex(value: Column) -> Column:
    """Sixteen hex digits of eight little-endian bytes, most significant first."""
    h = F.hex(value)
    return F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])


def int64_le(value: Column) -> Column:
    """Signed integer of 8 little-endian bytes, null for any other length."""
    return F.when(F.octet_length(value) == 8, F.conv(_hex(value), 16, -10).cast("bigint"))


def float64_bits(bits: Column) -> Column:
    """Double with these 64 bits."""
    sign = F.when(bits < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(2047))
    part = bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)
    number = (
        F.when(exponent == 2047, F.when(part == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
        .when(exponent == 0, part * F.pow(F.lit(2.0), F.lit(-1022.0)))
        .otherwise((part + 1) * F.pow(F.lit(2.0), exponent.cast("double") - 1023))
    )
    return sign * number


def decoded(rows: DataFrame, value: str = "value", kind: str = "type") -> DataFrame:
    """Adds ``_text``, ``_whole``, ``_real``: what the raw bytes say as text, 8-byte integer and 8-byte double, by type."""
    is_kind = lambda k: F.col(kind) == k
    out = rows.withColumn("_bits", int64_le(F.col(value)))
    return out.select(
        *rows.columns, F.when(is_kind(STRING), F.col(value).cast("string")).alias("_text"),
        F.when(is_kind(INT), F.col("_bits")).alias("_whole"), F.when(is_kind(DOUBLE), float64_bits(F.col("_bits"))).alias("_real"),
    )


def read_value(wanted: int) -> Column:
    """The decoded value as the wanted type, or null where it cannot be read so.

    STRING reads text as it stands and 8-byte integers as decimals. INT reads
    8-byte integers, 8-byte doubles that are whole and fit, and text that is an
    optional sign and digits between outer spaces. DOUBLE reads both numbers and
    decimal text.
    """
    text, whole, real, bare = F.col("_text"), F.col("_whole"), F.col("_real"), F.trim("_text")
    if wanted == STRING:
        return F.coalesce(text, whole.cast("string"))
    if wanted == INT:
        fits = (F.floor(real) == real) & (F.abs(real) < 2.0**63)
        return F.coalesce(whole, F.when(fits, real.cast("bigint")), F.when(bare.rlike(r"\A[+-]?[0-9]+\z"), bare.try_cast("bigint")))
    number = F.when(bare.rlike(r"\A[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"), bare.try_cast("double"))
    return F.coalesce(real, whole.cast("double"), number)


def _buckets(rows: DataFrame) -> int:
    """Buckets of the narrow tables by the size of their source: ``BUCKET_BYTES`` each, at least one per core."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)), MAX_BUCKETS)


def _bucketed(rows: DataFrame, entity: str, n: int, label: str, *by: str) -> DataFrame:
    """The rows written to the shared folder in ``n`` buckets of an entity's hash, sorted by entity, and read again.

    Readers see their partitioning and order, so joins on the entity neither shuffle nor sort.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    name = "tilewright_" + path.rsplit("/", 1)[1].replace("-", "_")
    out = rows.repartition(n, F.col(f"`{entity}`")).write.format("parquet").option("path", path).bucketBy(n, entity).sortBy(entity)
    (out.partitionBy(*by) if by else out).saveAsTable(name)
    # one file per bucket and attribute: its order may be relied on
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return spark.table(name)


def widen(rows: DataFrame, schema: list[tuple[str, int]], entity: str = "feature_id", keep_all: bool = True) -> DataFrame:
    """One row per entity with a typed column for each ``(attribute, type)`` of ``schema``.

    ``rows`` has the entity, ``seq``, ``key``, ``value``, ``type``. A row belongs to
    the attribute that equals its key in lower case without outer spaces; of an
    entity's readable rows for it the one with the highest ``seq`` counts (of ties
    the largest value). Rows with a null entity, key, value or an unknown type give
    nothing. With ``keep_all`` every entity of ``rows`` has a row.

    Rows are reduced to one per entity and attribute (in part before the shuffle, so an
    entity of very many rows makes no task long) and written once to the shared folder, partitioned by
    attribute: narrow typed tables, all in the same buckets of the entity's hash and sorted
    by entity. They and the entity list are joined in a balanced tree of left joins,
    whose leaves start from that list; no join shuffles or sorts.
    """
    attribute = F.lower(F.trim("key"))
    names = [a for a, _ in schema]
    if len(set(names)) != len(names) or entity in names:
        raise ValueError("an attribute occurs twice in the schema or is named like the entity")
    spine = rows.where(F.col(entity).isNotNull()).select(entity)
    mine = rows.select(entity, "seq", attribute.alias("attr"), "value", "type").where(F.col(entity).isNotNull() & F.col("attr").isin(names))
    if not keep_all:
        spine = mine.select(entity)
    spine = spine.distinct()
    if not names:
        return spine
    n = _buckets(rows)
    typed = {kind: [a for a, k in schema if k == kind] for kind in SQL_TYPE}
    read = [F.when(F.col("attr").isin(attrs), read_value(kind)).alias(f"v{kind}") for kind, attrs in typed.items()]
    out = decoded(mine).select(entity, "seq", "attr", *read)
    out = out.where(F.coalesce(*[F.col(f"v{k}").cast("string") for k in typed]).isNotNull())
    # null seq sorts below every number in max(struct)
    out = out.groupBy(entity, "attr").agg(F.max(F.struct("seq", *[f"v{k}" for k in typed])).alias("best"))
    written = _bucketed(out.select(entity, "attr", *[F.col(f"best.v{k}").alias(f"v{k}") for k in typed]), entity, n, "narrow", "attr")
    listed = _bucketed(spine, entity, n, "entities")

    def narrow(name: str, kind: int) -> DataFrame:
        return written.where(F.col("attr") == name).select(entity, F.col(f"v{kind}").alias(name)).hint("merge")

    def node(part: list[tuple[str, int]]) -> DataFrame:
        if len(part) <= LEAF:
            out = listed
            for name, kind in part:
                out = out.join(narrow(name, kind), entity, "left")
            return out
        half = (len(part) + 1) // 2
        return node(part[:half]).join(node(part[half:]).hint("merge"), entity, "inner")

    return node(schema).select(entity, *[f"`{n}`" for n in names])


def cells(wide: DataFrame, schema: list[tuple[str, int]], entity: str = "feature_id") -> DataFrame:
    """Filled cells as ``(entity, tag_key, val)`` text, integers in plain decimal form."""
    pairs = [F.struct(F.lit(name).alias("tag_key"), F.col(f"`{name}`").cast("string").alias("val")) for name, _ in schema]
    return wide.select(entity, F.inline(F.array(*pairs))).where(F.col("val").isNotNull())
