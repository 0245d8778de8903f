"""Queries over points, boxes, segments and tiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geometry as g
from tilewright.functions import tiles as t
from tilewright.operators import boxes, tiling
from tilewright.plans.derived import CUSTOMERS, RECTANGLES, SEGMENTS, customers, lat, lat_sql, lon, lon_sql, rectangles, segments
from tilewright.session import table
from tilewright.types import point_geom, prop

ZOOMS = (5, 9, 14)
S1, S2 = ("x1", "y1", "x2", "y2"), ("x3", "y3", "x4", "y4")
#: A box that many of the derived segments cross.
BOX = (-60.0, -40.0, 80.0, 50.0)


def _at_zooms(df: DataFrame) -> DataFrame:
    return df.withColumn("z", F.explode(F.array(*[F.lit(z) for z in ZOOMS])))


def tile_name(spark: SparkSession, d: str) -> DataFrame:
    return _at_zooms(customers(spark, d)).select("c_custkey", "z", t.tile_name("lon", "lat", F.col("z")).alias("tile"))


def tile_feature_counts(spark: SparkSession, d: str) -> DataFrame:
    """Features of each layer in each tile."""
    f = customers(spark, d).select(point_geom("lon", "lat").alias("geom"), F.create_map(F.lit("@layer"), prop("string", F.col("c_mktsegment"))).alias("props"))
    return tiling.tile_rows(f, list(ZOOMS)).groupBy("z", "x", "y", "layer").agg(F.count(F.lit(1)).alias("n"))


def tile_bbox(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d).select("c_custkey", t.tile_x("lon", 9).alias("x"), t.tile_y("lat", 9).alias("y"))
    return c.withColumn("b", t.tile_bbox("x", "y", F.lit(9))).select("c_custkey", *[F.round(f"b.{n}", 6).alias(n) for n in ("minx", "miny", "maxx", "maxy")])


def tile_resolution(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select((F.col("p_size") % 20).alias("z")).distinct()
    return p.select("z", F.round(t.resolution(F.col("z")), 12).alias("degrees_per_unit"))


def mercator_project(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).select("c_custkey", F.round(t.mercator_x("lon"), 3).alias("mx"), F.round(t.mercator_y("lat"), 3).alias("my"))


def tile_point(spark: SparkSession, d: str) -> DataFrame:
    """Position of each point in the grid of its tile at zoom 9."""
    c = customers(spark, d).withColumn("b", t.tile_bbox(t.tile_x("lon", 9), t.tile_y("lat", 9), F.lit(9)))
    p = t.tile_point("lon", "lat", F.col("b.minx"), F.col("b.miny"), F.col("b.maxx"), F.col("b.maxy"))
    return c.select("c_custkey", p.alias("p")).select("c_custkey", F.round("p.x", 4).alias("px"), F.col("p.y").alias("py"))


def haversine(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("c_custkey", F.round(g.haversine_m(*S1), 3).alias("metres"))


def bearing(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("c_custkey", F.round(g.bearing(*S1), 6).alias("degrees"))


def segment_length(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("c_custkey", F.round(g.segment_length(*S1), 6).alias("length"))


def segment_distance(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("c_custkey", F.round(g.distance_to_point(*S1, "x3", "y3"), 6).alias("distance"))


def line_coefficients(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).select("c_custkey", g.line_coefficients(*S1).alias("l"))
    return s.select("c_custkey", *[F.round(f"l.{n}", 6).alias(n) for n in "abc"])


def segment_intersection(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).select("c_custkey", g.intersection(S1, S2).alias("i"))
    near = (F.abs("i.x") < 1e6) & (F.abs("i.y") < 1e6)  # crossings of almost parallel lines lie beyond the digits of a double
    return s.select("c_custkey", F.when(near, F.round("i.x", 6)).alias("ix"), F.when(near, F.round("i.y", 6)).alias("iy"), F.col("i.hit").alias("hit"))


def segment_split(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).select("c_custkey", F.posexplode(g.split_at(*S1, "x3", "y3")).alias("half", "s"))
    return s.select("c_custkey", "half", F.round(g.segment_length("s.a.x", "s.a.y", "s.b.x", "s.b.y"), 6).alias("length"))


def segment_box(spark: SparkSession, d: str) -> DataFrame:
    """Whether a segment is wholly in the box, and the length of its part inside."""
    b = g.bbox(*BOX)
    s = segments(spark, d).select("c_custkey", g.segment_fully_in_bbox(*S1, b).alias("inside"), g.clip_segment(*S1, b).alias("c"))
    length = F.coalesce(g.segment_length("c.a.x", "c.a.y", "c.b.x", "c.b.y"), F.lit(0.0))
    return s.select("c_custkey", "inside", F.round(length, 5).alias("length_inside"))


def rounded_coords(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).select("c_custkey", g.round8(F.col("lon") / 7).alias("rx"), g.round8(F.col("lat") / 7).alias("ry"))


def point_clip(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).where(g.in_bbox("lon", "lat", g.bbox(*BOX))).select("c_custkey")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each rectangle with that of the next supplier."""
    r = rectangles(spark, d)
    return r.join(r.select((F.col("id") - 1).alias("id"), F.col("box").alias("other")), "id")


def bbox_relations(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    a, b = F.col("box"), F.col("other")
    return p.select("id", g.bbox_overlaps_corner(a, b).alias("corner"), g.bbox_intersects(a, b).alias("meets"), g.bbox_fully_in(a, b).alias("within"))


def bbox_extent(spark: SparkSession, d: str) -> DataFrame:
    e = boxes.extent(table(spark, d, "features"))
    return e.select(*[F.round(c, 9).alias(c) for c in e.columns])


def bbox_filter_corner(spark: SparkSession, d: str) -> DataFrame:
    return boxes.filter_box(table(spark, d, "features"), BOX, corner_rule=True).select("feature_id")


def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    return boxes.filter_box(table(spark, d, "features"), BOX).select("feature_id")


def bbox_intersects_join(spark: SparkSession, d: str) -> DataFrame:
    """Features whose box meets a supplier's rectangle."""
    f = table(spark, d, "features").select(F.col("feature_id").alias("id"), g.geom_bbox(F.col("geom")).alias("box")).dropDuplicates(["id"])
    return boxes.box_join(f, rectangles(spark, d)).select(F.col("id_a").alias("feature_id"), F.col("id_b").alias("s_suppkey"))


def coverage_explode(spark: SparkSession, d: str) -> DataFrame:
    """Tiles at zoom 6 that each rectangle covers."""
    r = rectangles(spark, d)
    c = t.coverage(F.col("box.minx"), F.col("box.miny"), F.col("box.maxx"), F.col("box.maxy"), F.lit(6))
    return r.select("id", F.explode(c).alias("t")).select("id", F.col("t.x").alias("x"), F.col("t.y").alias("y"))


def coverage_size(spark: SparkSession, d: str) -> DataFrame:
    return rectangles(spark, d).select("id", t.coverage_size(F.col("box.minx"), F.col("box.miny"), F.col("box.maxx"), F.col("box.maxy"), F.lit(9)).alias("n"))


def bbox_segments(spark: SparkSession, d: str) -> DataFrame:
    s = rectangles(spark, d).select("id", F.posexplode(g.bbox_segments(F.col("box"))).alias("side", "s"))
    return s.select("id", "side", *[F.round(f"s.{p}.{v}", 6).alias(p + v) for p in "ab" for v in "xy"])


def nation_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each customer from the first supplier of its nation."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("s_suppkey"))
    j = table(spark, d, "customer").join(s, "c_nationkey")
    m = g.haversine_m(lon("c_custkey"), lat("c_custkey"), lon("s_suppkey"), lat("s_suppkey"))
    return j.select("c_custkey", "s_suppkey", F.round(m, 3).alias("metres"))


QUERIES = {
    f.__name__: f
    for f in (
        tile_feature_counts, tile_name, tile_bbox, tile_resolution, mercator_project, tile_point, haversine, bearing, segment_length, segment_distance,
        line_coefficients, segment_intersection, segment_split, segment_box, rounded_coords, point_clip, bbox_relations, bbox_extent, bbox_filter_corner,
        bbox_filter, bbox_intersects_join, coverage_explode, coverage_size, bbox_segments, nation_distance,
    )
}


def tx(x: str, z: str) -> str:
    return f"CAST(greatest(0, least(floor(({x} + 180.0) / 360.0 * pow(2, {z})), pow(2, {z}) - 1)) AS INT)"


def ty(y: str, z: str) -> str:
    phi = f"radians(greatest(-85.0511287, least({y}, 85.0511287)))"
    return f"CAST(greatest(0, least(floor((1 - ln(tan({phi}) + 1 / cos({phi})) / pi()) / 2 * pow(2, {z})), pow(2, {z}) - 1)) AS INT)"


def west(x: str, z: str) -> str:
    return f"({x} / pow(2, {z}) * 360.0 - 180.0)"


def north(y: str, z: str) -> str:
    return f"degrees(atan(sinh(pi() * (1 - 2.0 * ({y}) / pow(2, {z})))))"


def _hav(x1: str, y1: str, x2: str, y2: str) -> str:
    a = f"(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))"
    return f"6371000.0 * 2 * atan2(sqrt({a}), sqrt(1 - {a}))"


def r8(v: str) -> str:
    return f"(CASE WHEN {v} < 0 THEN ceil({v} * 1e8 - 0.5) ELSE floor({v} * 1e8 + 0.5) END / 1e8)"


def _within(v: str, a: str, b: str) -> str:
    return f"{v} BETWEEN least({r8(a)}, {r8(b)}) AND greatest({r8(a)}, {r8(b)})"


_Z = f"z AS (SELECT unnest([{', '.join(map(str, ZOOMS))}]) AS z)"
_DET = "nullif((y1 - y2) * (x4 - x3) - (x2 - x1) * (y3 - y4), 0)"
_IX = r8(f"(((x2 * y1 - x1 * y2) * (x4 - x3) - (x2 - x1) * (x4 * y3 - x3 * y4)) / {_DET})")
_IY = r8(f"(((y1 - y2) * (x4 * y3 - x3 * y4) - (x2 * y1 - x1 * y2) * (y3 - y4)) / {_DET})")
_T = "greatest(0.0, least(coalesce(((x3 - x1) * (x2 - x1) + (y3 - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0.0), 1.0))"
_HYP = lambda a, b: f"sqrt(pow({a}, 2) + pow({b}, 2))"
_LO = f"greatest(0.0, least(({BOX[0]} - x1) / nullif(x2 - x1, 0), ({BOX[2]} - x1) / nullif(x2 - x1, 0)), least(({BOX[1]} - y1) / nullif(y2 - y1, 0), ({BOX[3]} - y1) / nullif(y2 - y1, 0)))"
_HI = f"least(1.0, greatest(({BOX[0]} - x1) / nullif(x2 - x1, 0), ({BOX[2]} - x1) / nullif(x2 - x1, 0)), greatest(({BOX[1]} - y1) / nullif(y2 - y1, 0), ({BOX[3]} - y1) / nullif(y2 - y1, 0)))"
_FB = "fb AS (SELECT feature_id, list_min(list_transform(v, lambda p: p.x)) AS minx, list_min(list_transform(v, lambda p: p.y)) AS miny, list_max(list_transform(v, lambda p: p.x)) AS maxx, list_max(list_transform(v, lambda p: p.y)) AS maxy FROM (SELECT feature_id, flatten(geom.rings) AS v FROM features) WHERE len(v) > 0)"
_IN = lambda x, y, b: f"({x} BETWEEN {b[0]} AND {b[2]} AND {y} BETWEEN {b[1]} AND {b[3]})"
_A, _B = ("a.minx", "a.miny", "a.maxx", "a.maxy"), ("b.minx", "b.miny", "b.maxx", "b.maxy")

SQL = {
    "tile_name": f"WITH {CUSTOMERS}, {_Z} SELECT c_custkey, z, concat(z, '/', {tx('lon', 'z')}, '/', {ty('lat', 'z')}) AS tile FROM pt, z",
    "tile_feature_counts": f"WITH {CUSTOMERS}, {_Z} SELECT z, {tx('lon', 'z')} AS x, {ty('lat', 'z')} AS y, c_mktsegment AS layer, count(*) AS n FROM pt, z GROUP BY ALL",
    "tile_bbox": f"WITH {CUSTOMERS}, t AS (SELECT c_custkey, {tx('lon', '9')} AS x, {ty('lat', '9')} AS y FROM pt) SELECT c_custkey, round({west('x', '9')}, 6) AS minx, round({north('y + 1', '9')}, 6) AS miny, round({west('(x + 1)', '9')}, 6) AS maxx, round({north('y', '9')}, 6) AS maxy FROM t",
    "tile_resolution": "SELECT DISTINCT p_size % 20 AS z, round(360.0::DOUBLE / (pow(2, p_size % 20) * 4096), 12) AS degrees_per_unit FROM part",
    "mercator_project": f"WITH {CUSTOMERS} SELECT c_custkey, round(radians(lon) * 6378137.0, 3) AS mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) AS my FROM pt",
    "tile_point": f"""WITH {CUSTOMERS}, t AS (SELECT *, {tx('lon', '9')} AS x, {ty('lat', '9')} AS y FROM pt),
b AS (SELECT *, {west('x', '9')} AS minx, {north('y + 1', '9')} AS miny, {west('(x + 1)', '9')} AS maxx, {north('y', '9')} AS maxy FROM t),
m AS (SELECT c_custkey, radians(lon) * 6378137.0 AS mx, radians(minx) * 6378137.0 AS l, radians(maxx) * 6378137.0 AS r, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 AS my,
  ln(tan(pi() / 4 + radians(miny) / 2)) * 6378137.0 AS lo, ln(tan(pi() / 4 + radians(maxy) / 2)) * 6378137.0 AS hi FROM b)
SELECT c_custkey, round((mx - l) / (r - l) * 4096, 4) AS px, CAST(4096 - CAST(trunc((my - lo) / (hi - lo) * 4096) AS BIGINT) AS DOUBLE) AS py FROM m""",
    "haversine": f"WITH {SEGMENTS} SELECT c_custkey, round({_hav('x1', 'y1', 'x2', 'y2')}, 3) AS metres FROM sg",
    "bearing": f"WITH {SEGMENTS}, b AS (SELECT c_custkey, degrees(atan2(sin(radians(x2 - x1)) * cos(radians(y2)), cos(radians(y1)) * sin(radians(y2)) - sin(radians(y1)) * cos(radians(y2)) * cos(radians(x2 - x1)))) AS v FROM sg) SELECT c_custkey, round(CASE WHEN v < 0 THEN v + 360 ELSE v END, 6) AS degrees FROM b",
    "segment_length": f"WITH {SEGMENTS} SELECT c_custkey, round({_HYP('x2 - x1', 'y2 - y1')}, 6) AS length FROM sg",
    "segment_distance": f"WITH {SEGMENTS} SELECT c_custkey, round({_HYP(f'x3 - (x1 + {_T} * (x2 - x1))', f'y3 - (y1 + {_T} * (y2 - y1))')}, 6) AS distance FROM sg",
    "line_coefficients": f"WITH {SEGMENTS} SELECT c_custkey, round(y1 - y2, 6) AS a, round(x2 - x1, 6) AS b, round(x2 * y1 - x1 * y2, 6) AS c FROM sg",
    "segment_intersection": f"WITH {SEGMENTS}, i AS (SELECT *, {_IX} AS ix, {_IY} AS iy FROM sg) SELECT c_custkey, CASE WHEN abs(ix) < 1e6 AND abs(iy) < 1e6 THEN round(ix, 6) END AS ix, CASE WHEN abs(ix) < 1e6 AND abs(iy) < 1e6 THEN round(iy, 6) END AS iy, coalesce({_within('ix', 'x1', 'x2')} AND {_within('iy', 'y1', 'y2')} AND {_within('ix', 'x3', 'x4')} AND {_within('iy', 'y3', 'y4')}, false) AS hit FROM i",
    "segment_split": f"WITH {SEGMENTS} SELECT c_custkey, 0 AS half, round({_HYP('x3 - x1', 'y3 - y1')}, 6) AS length FROM sg UNION ALL SELECT c_custkey, 1, round({_HYP('x2 - x3', 'y2 - y3')}, 6) FROM sg",
    "segment_box": f"""WITH {SEGMENTS}, c AS (SELECT *, {_LO} AS lo, {_HI} AS hi FROM sg)
SELECT c_custkey, {_IN('x1', 'y1', BOX)} AND {_IN('x2', 'y2', BOX)} AS inside,
  round(CASE WHEN lo < hi AND (x1 <> x2 OR x1 BETWEEN {BOX[0]} AND {BOX[2]}) AND (y1 <> y2 OR y1 BETWEEN {BOX[1]} AND {BOX[3]}) THEN (hi - lo) * {_HYP('x2 - x1', 'y2 - y1')} ELSE 0 END, 5) AS length_inside FROM c""",
    "rounded_coords": f"WITH {CUSTOMERS} SELECT c_custkey, {r8('(lon / 7)')} AS rx, {r8('(lat / 7)')} AS ry FROM pt",
    "point_clip": f"WITH {CUSTOMERS} SELECT c_custkey FROM pt WHERE {_IN('lon', 'lat', BOX)}",
    "bbox_relations": f"WITH {RECTANGLES} SELECT a.id, {_IN('a.minx', 'a.miny', _B)} OR {_IN('a.maxx', 'a.maxy', _B)} OR {_IN('b.minx', 'b.miny', _A)} OR {_IN('b.maxx', 'b.maxy', _A)} AS corner, a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy AS meets, {_IN('a.minx', 'a.miny', _B)} AND {_IN('a.maxx', 'a.maxy', _B)} AS within FROM rect a JOIN rect b ON b.id = a.id + 1",
    "bbox_extent": f"WITH {_FB} SELECT round(min(minx), 9) AS minx, round(min(miny), 9) AS miny, round(max(maxx), 9) AS maxx, round(max(maxy), 9) AS maxy FROM fb",
    "bbox_filter_corner": f"WITH {_FB} SELECT feature_id FROM fb a WHERE {_IN('a.minx', 'a.miny', BOX)} OR {_IN('a.maxx', 'a.maxy', BOX)} OR {_IN(BOX[0], BOX[1], _A)} OR {_IN(BOX[2], BOX[3], _A)}",
    "bbox_filter": f"WITH {_FB} SELECT feature_id FROM fb WHERE minx <= {BOX[2]} AND maxx >= {BOX[0]} AND miny <= {BOX[3]} AND maxy >= {BOX[1]}",
    "bbox_intersects_join": f"WITH {_FB}, {RECTANGLES} SELECT DISTINCT f.feature_id, r.id AS s_suppkey FROM fb f JOIN rect r ON f.minx <= r.maxx AND r.minx <= f.maxx AND f.miny <= r.maxy AND r.miny <= f.maxy",
    "coverage_explode": f"WITH {RECTANGLES}, c AS (SELECT id, unnest(range({tx('minx', '6')}, {tx('maxx', '6')} + 1)) AS x, {ty('maxy', '6')} AS y0, {ty('miny', '6')} AS y1 FROM rect) SELECT id, CAST(x AS INT) AS x, CAST(unnest(range(y0, y1 + 1)) AS INT) AS y FROM c",
    "coverage_size": f"WITH {RECTANGLES} SELECT id, ({tx('maxx', '9')} - {tx('minx', '9')} + 1)::BIGINT * ({ty('miny', '9')} - {ty('maxy', '9')} + 1) AS n FROM rect",
    "bbox_segments": f"WITH {RECTANGLES} "
    + " UNION ALL ".join(
        f"SELECT id, {i} AS side, round({a}, 6) AS ax, round({b}, 6) AS ay, round({c}, 6) AS bx, round({e}, 6) AS by FROM rect"
        for i, (a, b, c, e) in enumerate([("minx", "miny", "minx", "maxy"), ("minx", "maxy", "maxx", "maxy"), ("maxx", "maxy", "maxx", "miny"), ("maxx", "miny", "minx", "miny")])
    ),
    "nation_distance": f"WITH s AS (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey) SELECT c_custkey, s_suppkey, round({_hav(lon_sql('c_custkey'), lat_sql('c_custkey'), lon_sql('s_suppkey'), lat_sql('s_suppkey'))}, 3) AS metres FROM customer JOIN s ON s_nationkey = c_nationkey",
}
