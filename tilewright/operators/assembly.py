"""Geometries from node, way and relation tables.

``nodes(id, lat, lon, tags)``, ``ways(id, node_ids, tags)``,
``relations(id, members array<struct<id, type, role>>, tags)``, with tags as maps of strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geometry import clockwise
from tilewright.operators.mapping import Rule, apply_rules, matches
from tilewright.types import RINGS_DDL, line_geom, point, point_geom, polygon_geom, string_props


def with_props(elements: DataFrame) -> DataFrame:
    return elements.withColumn("props", string_props(F.coalesce(F.col("tags"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))


def referenced_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Nodes that a way refers to."""
    wanted = ways.select(F.explode("node_ids").alias("id")).distinct()
    return nodes.join(wanted, "id", "left_semi")


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``way_id, line``: vertices in the order of the way's node list. A missing node is the point 0, 0; a way without nodes an empty line.

    References are grouped back by way after one join on node id; both sides carry
    only ids and coordinates.
    """
    refs = ways.select(F.col("id").alias("way_id"), F.posexplode("node_ids").alias("pos", "node_id"))
    at = refs.join(nodes.select(F.col("id").alias("node_id"), "lon", "lat"), "node_id", "left")
    vertex = point(F.coalesce("lon", F.lit(0.0)), F.coalesce("lat", F.lit(0.0)))
    lines = at.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", vertex.alias("p")))).alias("v"))
    lines = lines.select("way_id", F.transform("v", lambda s: s["p"]).alias("line"))
    whole = ways.select(F.col("id").alias("way_id")).join(lines, "way_id", "left")
    return whole.select("way_id", F.coalesce("line", F.array().cast("array<struct<x:double,y:double>>")).alias("line"))


def _counter(line: Column) -> Column:
    """Reversed if its signed area is positive."""
    return F.when(clockwise(line), F.reverse(line)).otherwise(line)


def node_features(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """A point per node and matching rule."""
    hit = with_props(nodes).withColumn("geom", point_geom("lon", "lat"))
    return apply_rules(hit, rules).select("geom", "props")


def way_features(ways: DataFrame, nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """A line per way and matching rule; mapped ``__type=area`` makes a polygon and is stripped. Rings of positive signed area are reversed."""
    hit = apply_rules(with_props(ways), rules, None).select("id", "node_ids", "props")
    lines = way_lines(hit.select("id", "node_ids").dropDuplicates(["id"]), nodes)
    got = hit.select(F.col("id").alias("way_id"), "props").join(lines, "way_id")
    line = _counter(F.col("line"))
    area = F.coalesce(F.col("props")["__type"]["s"] == "area", F.lit(False))
    g = F.when(area, polygon_geom(F.array(line))).otherwise(line_geom(line))
    props = F.when(area, F.map_filter("props", lambda k, _: k != "__type")).otherwise(F.col("props"))
    return got.select(g.alias("geom"), props.alias("props"))


def relation_rings(relations: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``relation_id, rings``: each outer or inner way member of at least three vertices as a ring, in member order.

    Outer rings get a signed area that is not positive, inner rings a positive one.
    Unknown ways give nothing; a relation without a ring has an empty array.
    """
    members = relations.select(F.col("id").alias("relation_id"), F.posexplode("members").alias("pos", "m"))
    members = members.where((F.col("m.type") == "way") & F.col("m.role").isin("outer", "inner")).select("relation_id", "pos", F.col("m.id").alias("id"), F.col("m.role").alias("role"))
    used = ways.join(members.select("id").distinct(), "id", "left_semi")
    rings = members.join(way_lines(used, nodes).withColumnRenamed("way_id", "id"), "id").where(F.size("line") >= 3)
    ring = F.when(clockwise(F.col("line")) == (F.col("role") == "outer"), F.reverse("line")).otherwise(F.col("line"))
    got = rings.groupBy("relation_id").agg(F.array_sort(F.collect_list(F.struct("pos", ring.alias("r")))).alias("v"))
    got = got.select("relation_id", F.transform("v", lambda s: s["r"]).alias("rings"))
    whole = relations.select(F.col("id").alias("relation_id")).join(got, "relation_id", "left")
    return whole.select("relation_id", F.coalesce("rings", F.array().cast(RINGS_DDL)).alias("rings"))


def relation_features(relations: DataFrame, ways: DataFrame, nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """A polygon per relation and matching rule whose mapped properties say ``type=multipolygon`` or ``__type=area``."""
    hit = apply_rules(with_props(relations), rules, None)
    p = F.col("props")
    hit = hit.where(F.coalesce(p["type"]["s"] == "multipolygon", F.lit(False)) | F.coalesce(p["__type"]["s"] == "area", F.lit(False)))
    rings = relation_rings(hit.select("id", "members").dropDuplicates(["id"]), ways, nodes)
    got = hit.select(F.col("id").alias("relation_id"), "props").join(rings, "relation_id")
    return got.select(polygon_geom(F.col("rings")).alias("geom"), "props")


def spatialize(nodes: DataFrame, ways: DataFrame, relations: DataFrame, rules: list[Rule]) -> DataFrame:
    """Features of all three kinds with srid 4326."""
    out = node_features(nodes, rules).unionByName(way_features(ways, nodes, rules)).unionByName(relation_features(relations, ways, nodes, rules))
    return out.withColumn("srid", F.lit("4326"))


def matching(elements: DataFrame, rules: list[Rule]) -> DataFrame:
    """Elements that any rule matches, once each."""
    hit = F.lit(False)
    for r in rules:
        hit = hit | matches(F.col("props"), r)
    return with_props(elements).where(hit)
