"""Geometry derived from the star-schema tables, the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.geometry import bbox
from tilewright.session import table
from tilewright.types import string_props


def lon(key: str) -> Column:
    return ((F.col(key) * 7919) % 36000) / 100.0 - 180


def lat(key: str) -> Column:
    return ((F.col(key) * 104729) % 17000) / 100.0 - 85


def lon_sql(key: str) -> str:
    return f"((({key} * 7919) % 36000) / 100.0::DOUBLE - 180)"


def lat_sql(key: str) -> str:
    return f"((({key} * 104729) % 17000) / 100.0::DOUBLE - 85)"


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", lon("c_custkey").alias("lon"), lat("c_custkey").alias("lat"))


CUSTOMERS = f"pt AS (SELECT c_custkey, c_mktsegment, {lon_sql('c_custkey')} AS lon, {lat_sql('c_custkey')} AS lat FROM customer)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """A segment per customer, a second one from its neighbours, and a point."""
    k, one, two = F.col("c_custkey"), F.col("c_custkey") + 1, F.col("c_custkey") + 2
    c = table(spark, d, "customer").select(k.alias("c_custkey"), one.alias("k1"), two.alias("k2"), (k + 3).alias("k3"))
    return c.select(
        "c_custkey", lon("c_custkey").alias("x1"), lat("c_custkey").alias("y1"), lon("k1").alias("x2"), lat("k1").alias("y2"),
        lon("k2").alias("x3"), lat("k2").alias("y3"), lon("k3").alias("x4"), lat("k3").alias("y4"),
    )


SEGMENTS = (
    "sg AS (SELECT c_custkey, "
    + ", ".join(f"{lon_sql(k)} AS x{i}, {lat_sql(k)} AS y{i}" for i, k in enumerate(["c_custkey", "(c_custkey + 1)", "(c_custkey + 2)", "(c_custkey + 3)"], 1))
    + " FROM customer)"
)


def rectangles(spark: SparkSession, d: str) -> DataFrame:
    """Boxes round the suppliers, within ±180 and ±85."""
    half = 1 + F.col("s_suppkey") % 5
    x, y = lon("s_suppkey"), lat("s_suppkey")
    box = bbox(F.greatest(x - half, F.lit(-180.0)), F.greatest(y - half, F.lit(-85.0)), F.least(x + half, F.lit(180.0)), F.least(y + half, F.lit(85.0)))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), box.alias("box"))


_X, _Y, _H = lon_sql("s_suppkey"), lat_sql("s_suppkey"), "(1 + s_suppkey % 5)"
RECTANGLES = (
    f"rect AS (SELECT s_suppkey AS id, greatest({_X} - {_H}, -180.0) AS minx, greatest({_Y} - {_H}, -85.0) AS miny,"
    f" least({_X} + {_H}, 180.0) AS maxx, least({_Y} + {_H}, 85.0) AS maxy FROM supplier)"
)


def part_tags() -> Column:
    return F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))


def part_features(spark: SparkSession, d: str) -> DataFrame:
    """A point per part with its type, brand and size as text properties."""
    from tilewright.types import point_geom

    return table(spark, d, "part").select("p_partkey", point_geom(lon("p_partkey"), lat("p_partkey")).alias("geom"), string_props(part_tags()).alias("props"))


def osm_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes from parts, ways from orders with their line items as references, relations from customers with their orders as members."""
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), lat("p_partkey").alias("lat"), lon("p_partkey").alias("lon"), F.create_map(F.lit("brand"), "p_brand", F.lit("type"), F.col("p_type")).alias("tags"))
    refs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"))
    orders = table(spark, d, "orders")
    ways = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority"), F.col("o_orderstatus")).join(refs, "id", "left")
    node_ids = F.coalesce(F.transform("r", lambda s: s["l_partkey"]), F.array().cast("array<bigint>"))
    ways = ways.select("id", node_ids.alias("node_ids"), F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus")).alias("tags"))
    member = F.struct("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "outer").otherwise("inner").alias("role"))
    members = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(member)).alias("m"))
    relations = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment").join(members, "id", "left")
    as_member = F.transform("m", lambda s: F.struct(s["o_orderkey"].alias("id"), F.lit("way").alias("type"), s["role"].alias("role")))
    relations = relations.select("id", F.coalesce(as_member, F.array().cast("array<struct<id:bigint,type:string,role:string>>")).alias("members"), F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("type"), F.lit("multipolygon")).alias("tags"))
    return nodes, ways, relations


WAYS = f"""wl AS (SELECT o_orderkey AS id, o_orderpriority, o_orderstatus,
  (SELECT list({{'x': {lon_sql('l_partkey')}, 'y': {lat_sql('l_partkey')}}} ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS line FROM orders)"""


def area_sql(r: str) -> str:
    """Twice the signed area of a list of vertices."""
    return f"list_sum(list_transform(range(1, len({r}) + 1), lambda i: ({r}[i].y + {r}[i % len({r}) + 1].y) * ({r}[i].x - {r}[i % len({r}) + 1].x)))"


def length_sql(r: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, len({r})), lambda i: sqrt(pow({r}[i + 1].x - {r}[i].x, 2) + pow({r}[i + 1].y - {r}[i].y, 2)))), 0)"


def rings(spark: SparkSession, d: str) -> DataFrame:
    """``feature_id, typ, ring_no, ring`` of every ring of two or more vertices."""
    f = table(spark, d, "features").where("geom is not null")
    return f.select("feature_id", F.col("geom.typ").alias("typ"), F.posexplode("geom.rings").alias("ring_no", "ring")).where(F.size("ring") > 1)


RINGS = """rg AS (SELECT feature_id, typ, CAST(i - 1 AS INT) AS ring_no, rings[i] AS ring FROM (
  SELECT feature_id, geom.typ AS typ, geom.rings AS rings, unnest(range(1, len(geom.rings) + 1)) AS i FROM features WHERE geom IS NOT NULL) WHERE len(rings[i]) > 1)"""
