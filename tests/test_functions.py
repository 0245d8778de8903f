import math

import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry as g
from tilewright.functions import shapes
from tilewright.functions import tiles as t
from tilewright.types import GEOM_DDL, LINE_DDL, RINGS_DDL, as_line, as_point, as_polygon, point_geom, polygon_geom, prop, props_key


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def line(*pts):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])


def pts(value):
    return [(p.x, p.y) for p in value]


@pytest.mark.parametrize(
    ("lon", "lat", "z", "name"),
    [
        (13.73630, 51.05377, 14, "14/8817/5481"), (18.39856, -33.90184, 14, "14/9029/9833"), (-54.59123, -25.59547, 14, "14/5707/9397"),
        (-21.94073, 64.14607, 14, "14/7193/4354"), (-31.16580, 83.65691, 14, "14/6773/648"), (-64.45649, -85.04438, 14, "14/5258/16380"),
        (180, -90, 1, "1/1/1"), (-180, 90, 1, "1/0/0"),
    ],
)
def test_tile_name(spark, lon, lat, z, name):
    assert one(spark, t.tile_name(F.lit(float(lon)), F.lit(float(lat)), z))[0] == name


def test_tiles(spark):
    b = one(spark, t.tile_bbox(F.lit(0), F.lit(0), 0))[0]
    assert tuple(round(v, 8) for v in b) == (-180, -85.05112878, 180, 85.05112878)
    b = one(spark, t.tile_bbox(F.lit(1), F.lit(2), 2))[0]
    assert tuple(round(v, 8) for v in b) == (-90, -66.51326044, 0, 0)
    x, y = one(spark, t.mercator_x(F.lit(41.1)), t.mercator_y(F.lit(20.1)))
    assert (round(x, 8), round(y, 8)) == (4575231.07160354, 2284881.07006733)
    for lon, lat, want in ((50, 10, (0, 4096)), (51, 10, (2048, 4096)), (52, 12, (4096, 0))):
        p = one(spark, t.tile_point(F.lit(lon), F.lit(lat), *[F.lit(v) for v in (50.0, 10.0, 52.0, 12.0)]))[0]
        assert (round(p.x, 6), p.y) == want
    assert one(spark, t.tile_name(F.lit(None).cast("double"), F.lit(1.0), 4), t.tile_name(F.lit(float("nan")), F.lit(1.0), 4)) == (None, None)
    assert len(one(spark, t.coverage(F.lit(-180.0), F.lit(-85.0), F.lit(180.0), F.lit(85.0), 2))[0]) == 16
    assert one(spark, t.coverage_size(F.lit(-180.0), F.lit(-85.0), F.lit(180.0), F.lit(85.0), 2))[0] == 16


def test_points_and_segments(spark):
    # one degree along a meridian, a quarter of the equator, and from pole to pole
    for ends, part in (((3, 20, 3, 21), 1 / 360), ((-30, 0, 60, 0), 1 / 4), ((5, -90, 77, 90), 1 / 2)):
        assert one(spark, g.haversine_m(*[F.lit(float(v)) for v in ends]))[0] == pytest.approx(2 * math.pi * 6371000 * part)
    assert one(spark, g.bearing(F.lit(33), F.lit(-8), F.lit(33), F.lit(12)), g.bearing(F.lit(33), F.lit(12), F.lit(33), F.lit(-8))) == (0, 180)
    assert one(spark, g.round8(F.lit(-71.250000004)), g.round8(F.lit(71.250000006))) == (-71.25, 71.25000001)
    assert tuple(one(spark, g.line_coefficients(F.lit(0), F.lit(3), F.lit(4), F.lit(1)))[0]) == (2, 4, 12)
    s = tuple(map(F.lit, (0.0, 0.0, 0.0, 2.0)))
    for other, want in (((-1, 1, 1, 1), (0, 1, True)), ((1, 1, 2, 1), (0, 1, False)), ((0, 3, 0, 4), (None, None, False))):
        assert tuple(one(spark, g.intersection(s, tuple(F.lit(float(v)) for v in other)))[0]) == want
    c = one(spark, g.clip_segment(*[F.lit(v) for v in (0.0, 0.0, 4.0, 4.0)], g.bbox(1.0, 1.0, 2.0, 3.0)))[0]
    assert (c.a.x, c.a.y, c.b.x, c.b.y) == (1, 1, 2, 2)
    assert one(spark, g.clip_segment(*[F.lit(v) for v in (1.0, 1.0, 1.0, 1.0)], g.bbox(0.0, 0.0, 2.0, 2.0)))[0] is None


def test_boxes(spark):
    box = lambda *v: g.bbox(*map(float, v))
    cross = (box(0, 0, 2, 2), box(1, -1, 3, 1))
    assert one(spark, g.bbox_overlaps_corner(*cross), g.bbox_intersects(*cross)) == (False, True)
    assert one(spark, g.bbox_fully_in(box(1, 1, 2, 2), box(0, 0, 2, 2)), g.in_bbox(F.lit(2.0), F.lit(0.0), box(0, 0, 2, 2))) == (True, True)
    assert len(one(spark, g.bbox_segments(box(0, 0, 1, 1)))[0]) == 4


def test_lines(spark):
    square = line((0, 0), (1, 0), (1, 1), (0, 1))
    r = one(spark, g.area(square), g.clockwise(square), g.center(square), g.closed(square), g.line_length(square), g.area(g.reverse_line(square)))
    assert (r[0], r[1], tuple(r[2]), r[3], r[4], r[5]) == (2, True, (0.5, 0.5), False, 3, -2)
    empty = F.array().cast(LINE_DDL)
    r = one(spark, g.area(empty), g.closed(empty), g.line_bbox(empty), F.size(g.segments(empty)), g.center(empty))
    assert (r[0], r[1], r[2], r[3], r[4].x) == (0, False, None, 0, None)
    r = one(spark, g.clip_line(line((1, 1), (3, 3), (5, 1)), g.bbox(1.0, 1.0, 5.0, 2.0)))[0]
    assert [pts(x) for x in r] == [[(1, 1), (2, 2)], [(4, 2), (5, 1)]]
    assert pts(one(spark, g.merge_lines(line((0, 0), (1, 1)), line((1, 1), (2, 0))))[0]) == [(0, 0), (1, 1), (2, 0)]
    assert pts(one(spark, g.merge_lines(line((0, 0), (1, 1)), line((5, 5), (2, 0))))[0]) == []
    assert one(spark, g.is_extended_by(line((0, 0), (1, 1)), line((2, 0), (1, 1))))[0]
    assert len(one(spark, g.intersections(line((0, 0), (4, 0)), g.segments(line((1, -1), (1, 1), (2, 1), (2, -1)))))[0]) == 2


def test_polygons(spark):
    rings = F.array(line((0, 0), (10, 0), (10, 10), (0, 10)), line((2, 2), (4, 2), (4, 4), (2, 4)))
    inside = lambda x, y: one(spark, g.point_in_polygon(F.lit(float(x)), F.lit(float(y)), rings))[0]
    assert [inside(1, 1), inside(3, 3), inside(5, 5), inside(11, 1)] == [True, False, True, False]
    assert one(spark, g.geom_text(polygon_geom(rings)), g.geom_text(point_geom(1, 2.5)), g.type_name(F.lit(3)))[1:] == ("(X: 1, Y: 2.5)", "Polygon")
    r = one(spark, as_point(point_geom(1, 2)), as_line(point_geom(1, 2)), as_polygon(polygon_geom(rings)))
    assert r[0].x == 1 and r[1] is None and len(r[2]) == 2


def test_shapes(spark):
    ragged = F.array(line((0, 0), (9, 0), (9, 9), (0, 9)), line((2, 2), (4, 2), (4, 4)))
    rows = spark.createDataFrame([(1,), (2,)], "i int").withColumn("geom", F.when(F.col("i") == 1, polygon_geom(ragged)).cast(GEOM_DDL))
    out = rows.select(
        "i", shapes.fix_winding("geom").alias("w"), shapes.clip(F.col("geom"), g.bbox(1.0, 1.0, 3.0, 3.0)).alias("c"), shapes.from_wkb(shapes.to_wkb(F.col("geom"))).alias("b"),
        shapes.valid_topology("geom").alias("v"), shapes.simplify(F.col("geom"), 1.0).alias("s"), shapes.tile_commands(F.col("geom")).alias("m"),
    ).orderBy("i").collect()
    full, none = out
    assert [len(x) for x in full.w.rings] == [4, 3] and full.b == full.s and full.v and len(full.c) == 1 and full.m[0] == 9
    assert (none.w, none.b, none.v, none.s, none.m, none.c) == (None, None, None, None, None, [])
    merged = one(spark, shapes.merged_lines(F.array(line((0, 0), (1, 1)), line((1, 1), (2, 2), (3, 3)), line((7, 7), (8, 8))).cast(RINGS_DDL)))[0]
    assert [len(x) for x in merged] == [4, 2]


def test_properties_are_equal_whatever_their_order(spark):
    a = F.create_map(F.lit("a"), prop("int", 1), F.lit("b"), prop("string", "1"))
    b = F.create_map(F.lit("b"), prop("string", "1"), F.lit("a"), prop("int", 1))
    c = F.create_map(F.lit("b"), prop("string", "1"), F.lit("a"), prop("double", 1.0))
    r = one(spark, props_key(a), props_key(b), props_key(c))
    assert r[0] == r[1] != r[2]


def test_sql_names(spark):
    from tilewright.functions import registry

    registry.register(spark)
    r = spark.sql(
        "select tile_x(13.7363d, 14), tile_y(51.05377d, 14), tile_x(cast(null as double), 3), round(haversine_m(7.06659d, 50.88354d, 6.96299d, 50.93846d)), bearing(-10, 0, 0, 0),"
        " round8(-5.4213000001d), ring_area2(array(named_struct('x', 0d, 'y', 0d), named_struct('x', 1d, 'y', 0d), named_struct('x', 1d, 'y', 1d), named_struct('x', 0d, 'y', 1d))),"
        " hex(to_wkb(named_struct('typ', 1, 'rings', array(array(named_struct('x', 1d, 'y', 2d))))))"
    ).first()
    assert tuple(r)[:7] == (8817, 5481, None, 9490, 90, -5.4213, 2) and r[7] == "0101000000000000000000F03F0000000000000040"


def test_json_text(spark):
    from tilewright.functions import geojson

    p = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    r = one(spark, geojson.segment_json(p(1.0, 2.5), p(3.0, -4.0)), geojson.geometry_json(polygon_geom(F.array(line((0, 0), (1, 0), (1, 1))))), geojson.geometry_json(F.lit(None).cast(GEOM_DDL)), geojson.quoted(F.lit('a"b\n')))
    assert r[0] == '{"type":"Feature","properties":{},"geometry":{"type":"LineString","coordinates":[[1,2.5],[3,-4]]}}'
    assert r[1] == '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}' and r[2] == "null" and r[3] == '"a\\"b\\n"'


def test_clip_passes_over_shapes_beside_the_box(spark):
    ring = lambda x: [[{"x": x, "y": 0.0}, {"x": x + 1, "y": 0.0}, {"x": x + 1, "y": 1.0}]]
    box = {"minx": 0.0, "miny": 0.0, "maxx": 2.0, "maxy": 2.0}
    data = [(1, (3, ring(0.5)), box), (2, (3, ring(5.0)), box), (3, None, box), (4, (3, ring(0.5)), None), (5, (2, []), box), (6, (2, [[]]), box), (7, (2, [[{"x": None, "y": 1.0}, {"x": 9.0, "y": 1.0}]]), box), (8, (3, ring(2.0)), box)]
    df = spark.createDataFrame(data, f"i int, geom {GEOM_DDL}, box struct<minx:double,miny:double,maxx:double,maxy:double>").coalesce(1)
    got = {r.i: r.n for r in df.select("i", F.size(shapes.clip(F.col("geom"), F.col("box"))).alias("n")).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0}
