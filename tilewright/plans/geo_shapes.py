"""Queries over lines and polygons, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geometry as g
from tilewright.functions import shapes
from tilewright.plans.derived import RINGS, SEGMENTS, WAYS, area_sql, length_sql, osm_tables, rings, segments
from tilewright.plans.geo_points import BOX, S1, r8
from tilewright.operators import assembly
from tilewright.session import table, ship
from tilewright.types import line_geom, point

#: Tolerance of the simplification query, degrees.
TOLERANCE = 30.0


def _ways(spark: SparkSession, d: str) -> DataFrame:
    nodes, ways, _ = osm_tables(spark, d)
    return assembly.way_lines(ways, nodes)


def ring_area(spark: SparkSession, d: str) -> DataFrame:
    """Twice the signed area of each polygon ring."""
    return rings(spark, d).where("typ = 3").select("feature_id", "ring_no", F.round(g.area(F.col("ring")), 9).alias("area2"))


def ring_clockwise(spark: SparkSession, d: str) -> DataFrame:
    return rings(spark, d).where("typ = 3").select("feature_id", "ring_no", g.clockwise(F.col("ring")).alias("clockwise"))


def ring_centroid(spark: SparkSession, d: str) -> DataFrame:
    r = _ways(spark, d).where(F.size("line") > 2).select("way_id", g.center(F.col("line")).alias("c"))
    ok = (F.abs("c.x") < 1e6) & (F.abs("c.y") < 1e6)
    return r.select("way_id", F.when(ok, F.round("c.x", 3)).alias("cx"), F.when(ok, F.round("c.y", 3)).alias("cy"))


def line_bbox(spark: SparkSession, d: str) -> DataFrame:
    b = _ways(spark, d).select("way_id", g.line_bbox(F.col("line")).alias("b")).where("b is not null")
    return b.select("way_id", *[F.round(f"b.{n}", 6).alias(n) for n in ("minx", "miny", "maxx", "maxy")])


def line_segments(spark: SparkSession, d: str) -> DataFrame:
    s = _ways(spark, d).select("way_id", F.posexplode(g.segments(F.col("line"))).alias("n", "s"))
    return s.select("way_id", "n", *[F.round(f"s.{p}.{v}", 6).alias(p + v) for p in "ab" for v in "xy"])


def line_closed(spark: SparkSession, d: str) -> DataFrame:
    return rings(spark, d).select("feature_id", "ring_no", g.closed(F.col("ring")).alias("closed"))


def line_length(spark: SparkSession, d: str) -> DataFrame:
    return _ways(spark, d).select("way_id", F.round(g.line_length(F.col("line")), 5).alias("length"))


def line_reverse(spark: SparkSession, d: str) -> DataFrame:
    """First vertex of the reversed line."""
    r = _ways(spark, d).where(F.size("line") > 0).select("way_id", F.get(g.reverse_line(F.col("line")), F.lit(0)).alias("p"))
    return r.select("way_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def polygon_rewind(spark: SparkSession, d: str) -> DataFrame:
    """Ring areas after every ring is reversed."""
    f = table(spark, d, "features").where("geom.typ = 3").select("feature_id", F.posexplode(g.rewind(F.col("geom.rings"))).alias("ring_no", "ring"))
    return f.where(F.size("ring") > 1).select("feature_id", "ring_no", F.round(g.area(F.col("ring")), 9).alias("area2"))


def line_intersections(spark: SparkSession, d: str) -> DataFrame:
    """Points at which a three-vertex line meets the two diagonals of a box."""
    s = segments(spark, d)
    line = F.array(point("x1", "y1"), point("x2", "y2"), point("x3", "y3"))
    ends = [point(*BOX[:2]), point(*BOX[2:]), point(BOX[0], BOX[3]), point(BOX[2], BOX[1])]
    others = F.array(F.struct(ends[0].alias("a"), ends[1].alias("b")), F.struct(ends[2].alias("a"), ends[3].alias("b")))
    return s.select("c_custkey", F.explode(g.intersections(line, others)).alias("p")).select("c_custkey", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def line_extended(spark: SparkSession, d: str) -> DataFrame:
    """Second-vertex test and end-to-end merge of two lines of each customer."""
    s = segments(spark, d)
    a, b = F.array(point("x1", "y1"), point("x2", "y2")), F.array(point("x2", "y2"), point("x3", "y3"))
    c = F.array(point("x3", "y3"), point("x2", "y2"))
    merged = g.merge_lines(a, b)
    return s.select("c_custkey", g.is_extended_by(a, c).alias("extended"), F.size(merged).alias("n"), F.round(F.element_at(merged, -1)["x"], 6).alias("end_x"))


def line_clip(spark: SparkSession, d: str) -> DataFrame:
    """Length of each line inside a box, cut in Arrow batches."""
    ship(spark)
    w = _ways(spark, d).where(F.size("line") > 1)
    parts = shapes.clip(line_geom(F.col("line")), g.bbox(*BOX))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + g.line_length(p["rings"][0]))
    return w.select("way_id", F.round(total, 5).alias("length_inside"))


def line_clip_columns(spark: SparkSession, d: str) -> DataFrame:
    """The same with Column expressions alone (cut points have 8 decimals)."""
    w = _ways(spark, d).where(F.size("line") > 1)
    total = F.aggregate(g.clip_line(F.col("line"), g.bbox(*BOX)), F.lit(0.0), lambda acc, p: acc + g.line_length(p))
    return w.select("way_id", F.round(total, 2).alias("length_inside"))


def polygon_clip(spark: SparkSession, d: str) -> DataFrame:
    """Area of each polygon, summed over its parts in the cells of a grid: cutting must keep it."""
    ship(spark)
    f = table(spark, d, "features").where("geom.typ = 3 and size(flatten(geom.rings)) > 2").select("feature_id", "geom").dropDuplicates(["feature_id"])
    f = f.withColumn("b", g.geom_bbox(F.col("geom")))
    step = F.greatest(F.col("b.maxx") - F.col("b.minx"), F.col("b.maxy") - F.col("b.miny")) / 3
    f = f.withColumn("h", step).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    x, y = F.col("b.minx") + (F.col("i") - 0.5) * F.col("h"), F.col("b.miny") + (F.col("j") - 0.5) * F.col("h")
    f = f.withColumn("part", F.explode_outer(shapes.clip(F.col("geom"), g.bbox(x, y, x + F.col("h"), y + F.col("h")))))
    area = F.aggregate(F.coalesce(F.col("part.rings"), F.array()), F.lit(0.0), lambda acc, r: acc + g.area(r))
    return f.groupBy("feature_id").agg(F.round(F.sum(area), 8).alias("area2"))


def polygon_clip_points(spark: SparkSession, d: str) -> DataFrame:
    """For a point in each cell of the grid: whether it lies in what of the polygon the cell keeps."""
    ship(spark)
    f = table(spark, d, "features").where("geom.typ = 3 and size(flatten(geom.rings)) > 2").select("feature_id", "geom").dropDuplicates(["feature_id"])
    f = f.withColumn("b", g.geom_bbox(F.col("geom"))).withColumn("w", F.col("b.maxx") - F.col("b.minx")).withColumn("h", F.col("b.maxy") - F.col("b.miny"))
    f = f.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    x, y = F.col("b.minx") + F.col("i") * F.col("w") / 3, F.col("b.miny") + F.col("j") * F.col("h") / 3
    f = f.withColumn("x", x + F.col("w") * 0.13).withColumn("y", y + F.col("h") * 0.17)
    f = f.withColumn("parts", shapes.clip(F.col("geom"), g.bbox(x, y, x + F.col("w") / 3, y + F.col("h") / 3)))
    inside = g.point_in_polygon(F.col("x"), F.col("y"), F.flatten(F.transform("parts", lambda p: p["rings"])))
    return f.select("feature_id", "i", "j", inside.alias("inside"))


def simplify(spark: SparkSession, d: str) -> DataFrame:
    """Vertices before and after simplification, and whether both ends stayed."""
    ship(spark)
    w = _ways(spark, d).where(F.size("line") > 0)
    s = w.select("way_id", F.col("line").alias("a"), shapes.simplify(line_geom(F.col("line")), TOLERANCE)["rings"][0].alias("b"))
    ends = (F.get("a", F.lit(0)) == F.get("b", F.lit(0))) & (F.element_at("a", -1) == F.element_at("b", -1))
    return s.select("way_id", F.size("a").alias("n_before"), F.size("b").alias("n_after"), ends.alias("ends_kept"))


def simplify_three(spark: SparkSession, d: str) -> DataFrame:
    """Three-vertex lines: the middle stays exactly if it is further from the chord than the tolerance."""
    ship(spark)
    s = segments(spark, d)
    line = F.array(point("x1", "y1"), point("x3", "y3"), point("x2", "y2"))
    return s.select("c_custkey", F.size(shapes.simplify(line_geom(line), TOLERANCE)["rings"][0]).alias("n_after"))


def fix_winding(spark: SparkSession, d: str) -> DataFrame:
    """Orientation of the outer ring once the winding is set right."""
    ship(spark)
    f = table(spark, d, "features").where("geom.typ = 3 and size(geom.rings) > 0").select("feature_id", shapes.fix_winding(F.col("geom"))["rings"][0].alias("r"))
    return f.where(F.size("r") > 2).select("feature_id", (g.area(F.col("r")) >= 0).alias("positive"), F.round(F.abs(g.area(F.col("r"))), 9).alias("area2"))


def valid_topology(spark: SparkSession, d: str) -> DataFrame:
    """Polygons of the feature table with and without a ring that crosses itself."""
    ship(spark)
    f = table(spark, d, "features").where("geom.typ = 3 and size(geom.rings) > 0")
    return f.select("feature_id", shapes.valid_topology(F.col("geom")).alias("valid"))


def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Whether the middle of a polygon's box is inside it."""
    f = table(spark, d, "features").where("geom.typ = 3 and size(flatten(geom.rings)) > 2").withColumn("b", g.geom_bbox(F.col("geom")))
    x, y = (F.col("b.minx") + F.col("b.maxx")) / 2, (F.col("b.miny") + F.col("b.maxy")) / 2
    return f.select("feature_id", g.point_in_polygon(x, y, F.col("geom.rings")).alias("inside"))


def merge_lines(spark: SparkSession, d: str) -> DataFrame:
    """The edges of every ring, merged again: one line of as many edges and the same length."""
    ship(spark)
    w = _ways(spark, d).where(F.size("line") > 1).select("way_id", g.segments(F.array_distinct("line"), True).alias("s"))
    lines = F.transform("s", lambda s: F.array(s["a"], s["b"]))
    m = w.select("way_id", shapes.merged_lines(lines).alias("m"))
    total = F.aggregate("m", F.lit(0.0), lambda acc, line: acc + g.line_length(line))
    return m.select("way_id", F.size("m").alias("n_lines"), F.round(total, 5).alias("length"))


QUERIES = {
    f.__name__: f
    for f in (
        ring_area, ring_clockwise, ring_centroid, line_bbox, line_segments, line_closed, line_length, line_reverse, polygon_rewind, line_intersections,
        line_extended, line_clip, line_clip_columns, polygon_clip, polygon_clip_points, simplify, simplify_three, fix_winding, valid_topology, point_in_polygon, merge_lines,
    )
}

_CROSS = "(line[i].x * line[i % len(line) + 1].y - line[i % len(line) + 1].x * line[i].y)"
_SUM = lambda e: f"list_sum(list_transform(range(1, len(line) + 1), lambda i: {e}))"
_TOTAL = f"nullif({_SUM(_CROSS)} * 3, 0)"
_EDGES = "e AS (SELECT way_id, n, line[n].x AS x1, line[n].y AS y1, line[n + 1].x AS x2, line[n + 1].y AS y2 FROM (SELECT id AS way_id, line, unnest(range(1, len(line))) AS n FROM wl WHERE len(line) > 1))"
_T0 = f"greatest(0.0, least(({BOX[0]} - x1) / nullif(x2 - x1, 0), ({BOX[2]} - x1) / nullif(x2 - x1, 0)), least(({BOX[1]} - y1) / nullif(y2 - y1, 0), ({BOX[3]} - y1) / nullif(y2 - y1, 0)))"
_T1 = f"least(1.0, greatest(({BOX[0]} - x1) / nullif(x2 - x1, 0), ({BOX[2]} - x1) / nullif(x2 - x1, 0)), greatest(({BOX[1]} - y1) / nullif(y2 - y1, 0), ({BOX[3]} - y1) / nullif(y2 - y1, 0)))"
_CLIP = f"""WITH {WAYS}, {_EDGES}, c AS (SELECT *, {_T0} AS lo, {_T1} AS hi FROM e)
SELECT way_id, round(sum(CASE WHEN lo < hi AND (x1 <> x2 OR x1 BETWEEN {BOX[0]} AND {BOX[2]}) AND (y1 <> y2 OR y1 BETWEEN {BOX[1]} AND {BOX[3]}) THEN (hi - lo) * sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) ELSE 0 END), 5) AS length_inside FROM c GROUP BY way_id"""


def _cross_point(box: tuple, edge: tuple) -> str:
    """Crossing of an edge with a fixed diagonal, as a select of x and y where both have it."""
    (ax, ay, bx, by), (x1, y1, x2, y2) = box, edge
    a, b, c = f"({y1} - {y2})", f"({x2} - {x1})", f"({x2} * {y1} - {x1} * {y2})"
    p, q, r = f"({ay} - {by})", f"({bx} - {ax})", f"({bx} * {ay} - {ax} * {by})"
    det = f"nullif({a} * {q} - {b} * {p}, 0)"
    x, y = r8(f"(({c} * {q} - {b} * {r}) / {det})"), r8(f"(({a} * {r} - {c} * {p}) / {det})")
    on = " AND ".join(f"{v} BETWEEN least({r8(m)}, {r8(n)}) AND greatest({r8(m)}, {r8(n)})" for v, m, n in (("ix", x1, x2), ("iy", y1, y2), ("ix", f"{ax}::DOUBLE", f"{bx}::DOUBLE"), ("iy", f"{ay}::DOUBLE", f"{by}::DOUBLE")))
    return f"SELECT c_custkey, ix, iy FROM (SELECT *, {x} AS ix, {y} AS iy FROM sg) WHERE {on}"


def _meets() -> str:
    """Edges of one ring that meet elsewhere than at an end of the first."""
    det = "nullif((a.y1 - a.y2) * (b.x2 - b.x1) - (a.x2 - a.x1) * (b.y1 - b.y2), 0)"
    m, n = "(a.x2 * a.y1 - a.x1 * a.y2)", "(b.x2 * b.y1 - b.x1 * b.y2)"
    x, y = r8(f"(({m} * (b.x2 - b.x1) - (a.x2 - a.x1) * {n}) / {det})"), r8(f"(((a.y1 - a.y2) * {n} - {m} * (b.y1 - b.y2)) / {det})")
    on = " AND ".join(f"i{v} BETWEEN least({r8(f'{e}{v}1')}, {r8(f'{e}{v}2')}) AND greatest({r8(f'{e}{v}1')}, {r8(f'{e}{v}2')})" for e in ("a", "b") for v in "xy")
    ends = " OR ".join(f"(ix = {r8(f'ax{k}')} AND iy = {r8(f'ay{k}')})" for k in (1, 2))
    names = ", ".join(f"{e}.{v}{k} AS {e}{v}{k}" for e in "ab" for v in "xy" for k in (1, 2))
    return f"SELECT DISTINCT r FROM (SELECT a.r, {names}, {x} AS ix, {y} AS iy FROM e a JOIN e b ON a.r = b.r AND a.no = b.no AND a.i <> b.i) WHERE {on} AND NOT ({ends})"


_DIAGONALS = [(BOX[0], BOX[1], BOX[2], BOX[3]), (BOX[0], BOX[3], BOX[2], BOX[1])]
_TWO = [S1, ("x2", "y2", "x3", "y3")]
_CHORD = "(CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE greatest(0.0, least(1.0, ((x3 - x1) * (x2 - x1) + (y3 - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0))) END)"
_MIDDLE = f"sqrt(pow(x3 - x1 - {_CHORD} * (x2 - x1), 2) + pow(y3 - y1 - {_CHORD} * (y2 - y1), 2))"
_OUTER = "poly AS (SELECT feature_id, any_value(geom.rings) AS rings FROM features WHERE geom.typ = 3 AND len(flatten(geom.rings)) > 2 GROUP BY feature_id)"

SQL = {
    "ring_area": f"WITH {RINGS} SELECT feature_id, ring_no, round({area_sql('ring')}, 9) AS area2 FROM rg WHERE typ = 3",
    "ring_clockwise": f"WITH {RINGS} SELECT feature_id, ring_no, {area_sql('ring')} > 0 AS clockwise FROM rg WHERE typ = 3",
    "ring_centroid": f"WITH {WAYS}, c AS (SELECT id AS way_id, {_SUM(f'(line[i].x + line[i % len(line) + 1].x) * {_CROSS}')} / {_TOTAL} AS cx, {_SUM(f'(line[i].y + line[i % len(line) + 1].y) * {_CROSS}')} / {_TOTAL} AS cy FROM wl WHERE len(line) > 2) SELECT way_id, CASE WHEN abs(cx) < 1e6 AND abs(cy) < 1e6 THEN round(cx, 3) END AS cx, CASE WHEN abs(cx) < 1e6 AND abs(cy) < 1e6 THEN round(cy, 3) END AS cy FROM c",
    "line_bbox": f"WITH {WAYS} SELECT id AS way_id, " + ", ".join(f"round(list_{m}(list_transform(line, lambda p: p.{v})), 6) AS {m}{v}" for m in ("min", "max") for v in "xy") + " FROM wl WHERE len(line) > 0",
    "line_segments": f"WITH {WAYS}, {_EDGES} SELECT way_id, CAST(n - 1 AS INT) AS n, round(x1, 6) AS ax, round(y1, 6) AS ay, round(x2, 6) AS bx, round(y2, 6) AS by FROM e",
    "line_closed": f"WITH {RINGS} SELECT feature_id, ring_no, ring[1].x = ring[len(ring)].x AND ring[1].y = ring[len(ring)].y AS closed FROM rg",
    "line_length": f"WITH {WAYS} SELECT id AS way_id, round(CASE WHEN line IS NULL THEN 0 ELSE {length_sql('line')} END, 5) AS length FROM wl",
    "line_reverse": f"WITH {WAYS} SELECT id AS way_id, round(line[len(line)].x, 6) AS x, round(line[len(line)].y, 6) AS y FROM wl WHERE len(line) > 0",
    "polygon_rewind": f"WITH {RINGS} SELECT feature_id, ring_no, round({area_sql('list_reverse(ring)')}, 9) AS area2 FROM rg WHERE typ = 3",
    "line_intersections": f"WITH {SEGMENTS}, all_hits AS (" + " UNION ALL ".join(_cross_point(b, e) for e in _TWO for b in _DIAGONALS) + ") SELECT DISTINCT c_custkey, round(ix, 6) AS x, round(iy, 6) AS y FROM all_hits",
    "line_extended": f"WITH {SEGMENTS} SELECT c_custkey, true AS extended, 3 AS n, round(x3, 6) AS end_x FROM sg",
    "line_clip": _CLIP,
    "line_clip_columns": _CLIP.replace("END), 5)", "END), 2)"),
    "polygon_clip": f"""WITH {_OUTER},
q AS (SELECT feature_id, i AS no, rings[i] AS ring FROM (SELECT *, unnest(range(1, len(rings) + 1)) AS i FROM poly) WHERE len(rings[i]) > 2),
e AS (SELECT feature_id, no, ring[i].x AS x1, ring[i].y AS y1, ring[i % len(ring) + 1].x AS x2, ring[i % len(ring) + 1].y AS y2 FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM q)),
a AS (SELECT q.feature_id, q.no, e.no AS other FROM q JOIN e ON q.feature_id = e.feature_id AND q.no <> e.no AND (y1 > q.ring[1].y) <> (y2 > q.ring[1].y)
  AND q.ring[1].x < (x2 - x1) * (q.ring[1].y - y1) / nullif(y2 - y1, 0) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
depth AS (SELECT feature_id, no, count(*) AS n FROM a GROUP BY ALL)
SELECT feature_id, round(sum(abs({area_sql('ring')}) * CASE WHEN coalesce(n, 0) % 2 = 0 THEN 1 ELSE -1 END), 8) AS area2 FROM q LEFT JOIN depth USING (feature_id, no) GROUP BY feature_id""",
    "polygon_clip_points": f"""WITH {_OUTER}, v AS (SELECT feature_id, rings, flatten(rings) AS v FROM poly),
bx AS (SELECT feature_id, rings, list_min(list_transform(v, lambda p: p.x)) AS minx, list_max(list_transform(v, lambda p: p.x)) AS maxx, list_min(list_transform(v, lambda p: p.y)) AS miny, list_max(list_transform(v, lambda p: p.y)) AS maxy FROM v),
pts AS (SELECT feature_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, minx + i * (maxx - minx) / 3 + (maxx - minx) * 0.13 AS x, miny + j * (maxy - miny) / 3 + (maxy - miny) * 0.17 AS y FROM bx, (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j)),
q AS (SELECT feature_id, unnest(rings) AS ring FROM bx),
e AS (SELECT feature_id, ring[k].x AS x1, ring[k].y AS y1, ring[k % len(ring) + 1].x AS x2, ring[k % len(ring) + 1].y AS y2 FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS k FROM q WHERE len(ring) > 2)),
n AS (SELECT p.feature_id, i, j, count(*) AS n FROM pts p JOIN e ON p.feature_id = e.feature_id AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 GROUP BY ALL)
SELECT feature_id, i, j, coalesce(n, 0) % 2 = 1 AS inside FROM pts LEFT JOIN n USING (feature_id, i, j)""",
    "valid_topology": f"""WITH p AS (SELECT row_number() OVER () AS r, feature_id, geom.rings AS rings FROM features WHERE geom.typ = 3 AND len(geom.rings) > 0),
q AS (SELECT r, no, rings[no] AS ring FROM (SELECT r, rings, unnest(range(1, len(rings) + 1)) AS no FROM p)),
e AS (SELECT r, no, i, ring[i].x AS x1, ring[i].y AS y1, ring[i % len(ring) + 1].x AS x2, ring[i % len(ring) + 1].y AS y2 FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM q)),
bad AS ({_meets()})
SELECT feature_id, bad.r IS NULL AS valid FROM p LEFT JOIN bad USING (r)""",
    "merge_lines": f"""WITH {WAYS}, u AS (SELECT id AS way_id, list_filter(line, lambda p, i: list_position(line, p) = i) AS line FROM wl WHERE len(line) > 1)
SELECT way_id, CASE WHEN len(line) > 1 THEN 1 ELSE 0 END AS n_lines, round({_SUM("sqrt(pow(line[i % len(line) + 1].x - line[i].x, 2) + pow(line[i % len(line) + 1].y - line[i].y, 2))")}, 5) AS length FROM u""",
    "simplify_three": f"WITH {SEGMENTS} SELECT c_custkey, CASE WHEN {_MIDDLE} > {TOLERANCE} THEN 3 ELSE 2 END AS n_after FROM sg",
    "fix_winding": f"WITH {RINGS} SELECT feature_id, true AS positive, round(abs({area_sql('ring')}), 9) AS area2 FROM rg WHERE typ = 3 AND ring_no = 0 AND len(ring) > 2",
    "point_in_polygon": """WITH b AS (SELECT row_number() OVER () AS r, feature_id, geom.rings AS rings, flatten(geom.rings) AS v FROM features WHERE geom.typ = 3 AND len(flatten(geom.rings)) > 2),
m AS (SELECT r, feature_id, rings, (list_min(list_transform(v, lambda p: p.x)) + list_max(list_transform(v, lambda p: p.x))) / 2 AS px, (list_min(list_transform(v, lambda p: p.y)) + list_max(list_transform(v, lambda p: p.y))) / 2 AS py FROM b),
q AS (SELECT r, px, py, unnest(rings) AS ring FROM m),
e AS (SELECT r, px, py, ring[i].x AS x1, ring[i].y AS y1, ring[i % len(ring) + 1].x AS x2, ring[i % len(ring) + 1].y AS y2 FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM q)),
n AS (SELECT r, count(*) AS n FROM e WHERE (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / nullif(y2 - y1, 0) + x1 GROUP BY r)
SELECT feature_id, coalesce(n, 0) % 2 = 1 AS inside FROM m LEFT JOIN n USING (r)""",
}
