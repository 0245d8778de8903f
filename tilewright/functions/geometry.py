"""Points, boxes, segments, lines and polygons as Column expressions; no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.types import LINE_DDL, RINGS_DDL, number_text, point

EARTH_RADIUS_M = 6371000.0


def c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


# Points and boxes. A box is a struct minx, miny, maxx, maxy.


def bbox(minx, miny, maxx, maxy) -> Column:
    return F.struct(*[c(v).cast("double").alias(n) for v, n in ((minx, "minx"), (miny, "miny"), (maxx, "maxx"), (maxy, "maxy"))])


def in_bbox(x, y, b: Column) -> Column:
    """Closed on all sides."""
    return c(x).between(b["minx"], b["maxx"]) & c(y).between(b["miny"], b["maxy"])


def bbox_overlaps_corner(a: Column, b: Column) -> Column:
    """South-west or north-east corner of either box inside the other; misses boxes that cross like a plus sign."""
    return (
        in_bbox(a["minx"], a["miny"], b) | in_bbox(a["maxx"], a["maxy"], b)
        | in_bbox(b["minx"], b["miny"], a) | in_bbox(b["maxx"], b["maxy"], a)
    )


def bbox_intersects(a: Column, b: Column) -> Column:
    """Closed boxes with a common point."""
    return (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])


def bbox_fully_in(a: Column, b: Column) -> Column:
    return in_bbox(a["minx"], a["miny"], b) & in_bbox(a["maxx"], a["maxy"], b)


def bbox_segments(b: Column) -> Column:
    """The four edges, west, north, east, south, from the south-west corner."""
    at = [point(b[x], b[y]) for x, y in (("minx", "miny"), ("minx", "maxy"), ("maxx", "maxy"), ("maxx", "miny"))]
    return F.array(*[F.struct(at[i].alias("a"), at[(i + 1) % 4].alias("b")) for i in range(4)])


def line_bbox(line: Column) -> Column:
    """Null for an empty line."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.when(F.size(line) > 0, bbox(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def geom_bbox(g: Column) -> Column:
    """Box of all vertices, null without any."""
    return line_bbox(F.flatten(g["rings"]))


def round8(v) -> Column:
    """To 8 decimals, halves away from zero; a double too large to have that many comes back as it is."""
    v = c(v)
    return F.when(F.abs(v) >= 4e7, v).when(v < 0, F.ceil(v * 1e8 - 0.5) / 1e8).otherwise(F.floor(v * 1e8 + 0.5) / 1e8)


def haversine_m(x1, y1, x2, y2) -> Column:
    a = F.pow(F.sin(F.radians(c(y2) - c(y1)) / 2), 2) + F.cos(F.radians(c(y1))) * F.cos(F.radians(c(y2))) * F.pow(F.sin(F.radians(c(x2) - c(x1)) / 2), 2)
    return EARTH_RADIUS_M * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


# Segments, given by their coordinates.


def segment_length(x1, y1, x2, y2) -> Column:
    return F.hypot(c(x2) - c(x1), c(y2) - c(y1))


def line_coefficients(x1, y1, x2, y2) -> Column:
    """a, b, c of a x + b y + c = 0 in the sense of the cross products used by :func:`intersection`."""
    x1, y1, x2, y2 = map(c, (x1, y1, x2, y2))
    return F.struct((y1 - y2).alias("a"), (x2 - x1).alias("b"), (x2 * y1 - x1 * y2).alias("c"))


def has_point(x1, y1, x2, y2, x, y) -> Column:
    """Whether the point lies in the segment's box, all rounded to 8 decimals."""
    x1, y1, x2, y2, x, y = (round8(v) for v in (x1, y1, x2, y2, x, y))
    return x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))


def intersection(s: tuple, t: tuple) -> Column:
    """Struct x, y, hit: crossing of the two infinite lines, rounded, and whether both segments have it. Null x, y for parallels."""
    p, q = line_coefficients(*s), line_coefficients(*t)
    det = p["a"] * q["b"] - p["b"] * q["a"]
    det = F.nullif(det, F.lit(0.0))
    x = round8((p["c"] * q["b"] - p["b"] * q["c"]) / det)
    y = round8((p["a"] * q["c"] - p["c"] * q["a"]) / det)
    hit = F.coalesce(has_point(*s, x, y) & has_point(*t, x, y), F.lit(False))
    return F.struct(x.alias("x"), y.alias("y"), hit.alias("hit"))


def split_at(x1, y1, x2, y2, x, y) -> Column:
    """The two halves as an array of struct a, b."""
    return F.array(F.struct(point(x1, y1).alias("a"), point(x, y).alias("b")), F.struct(point(x, y).alias("a"), point(x2, y2).alias("b")))


def segment_fully_in_bbox(x1, y1, x2, y2, b: Column) -> Column:
    r = bbox(round8(b["minx"]), round8(b["miny"]), round8(b["maxx"]), round8(b["maxy"]))
    return in_bbox(x1, y1, r) & in_bbox(x2, y2, r)


def clip_segment(x1, y1, x2, y2, b: Column) -> Column:
    """Part of the segment in the closed box as struct a, b (8 decimals); null if there is none or it is a single point."""
    x1, y1, x2, y2 = map(c, (x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    lo, hi, ok = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for d, at, low, high in ((dx, x1, b["minx"], b["maxx"]), (dy, y1, b["miny"], b["maxy"])):
        safe = F.nullif(d, F.lit(0.0))
        lo.append(F.least((low - at) / safe, (high - at) / safe))
        hi.append(F.greatest((low - at) / safe, (high - at) / safe))
        ok = ok & ((d != 0) | at.between(low, high))
    t0, t1 = F.greatest(*lo), F.least(*hi)  # both pass over the null of a segment along an axis
    at = lambda t: point(round8(x1 + t * dx), round8(y1 + t * dy))
    return F.when(ok & (t0 < t1) & ((dx != 0) | (dy != 0)), F.struct(at(t0).alias("a"), at(t1).alias("b")))


def distance_to_point(x1, y1, x2, y2, x, y) -> Column:
    """Distance of a point from the segment."""
    x1, y1, x2, y2, x, y = map(c, (x1, y1, x2, y2, x, y))
    dx, dy = x2 - x1, y2 - y1
    t = ((x - x1) * dx + (y - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.coalesce(t, F.lit(0.0)), F.lit(1.0)))
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def bearing(x1, y1, x2, y2) -> Column:
    """Initial great-circle bearing in degrees from 0 to 360."""
    d, a, b = F.radians(c(x2) - c(x1)), F.radians(c(y1)), F.radians(c(y2))
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360.0, F.lit(360.0))


# Lines: arrays of struct x, y.


def segments(line: Column, closing: bool = False) -> Column:
    """Array of struct a, b; with ``closing`` the edge from the last vertex to the first too."""
    n = F.size(line)
    many = n if closing else n - 1
    at = lambda i: F.element_at(line, i)
    pairs = F.transform(F.sequence(F.lit(1), many), lambda i: F.struct(at(i).alias("a"), at(i % n + 1).alias("b")))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, s: acc + f(s))


def area(line: Column) -> Column:
    """Twice the signed area, positive for counter-clockwise rings with y upwards."""
    return _sum(segments(line, True), lambda s: (s["a"]["y"] + s["b"]["y"]) * (s["a"]["x"] - s["b"]["x"]))


def clockwise(line: Column) -> Column:
    """Whether :func:`area` is positive, which with y downwards (as in tiles) is clockwise."""
    return area(line) > 0


def center(line: Column) -> Column:
    """Area centroid of the ring; null for a ring without area."""
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    edges = segments(line, True)
    total = F.nullif(_sum(edges, cross) * 3, F.lit(0.0))
    return point(_sum(edges, lambda s: (s["a"]["x"] + s["b"]["x"]) * cross(s)) / total, _sum(edges, lambda s: (s["a"]["y"] + s["b"]["y"]) * cross(s)) / total)


def closed(line: Column) -> Column:
    """First vertex equals last; lines of fewer than two vertices are not closed."""
    return F.when(F.size(line) < 2, F.lit(False)).otherwise(F.element_at(line, 1) == F.element_at(line, -1))


def reverse_line(line: Column) -> Column:
    return F.reverse(line)


def rewind(rings: Column) -> Column:
    """Every ring of a polygon reversed."""
    return F.transform(rings, F.reverse)


def line_length(line: Column) -> Column:
    return _sum(segments(line), lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))


def intersections(line: Column, others: Column) -> Column:
    """Distinct points at which the line's own segments hit the given segments (array of struct a, b)."""
    corners = lambda s: (s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])
    found = F.flatten(F.transform(segments(line), lambda s: F.transform(others, lambda o: intersection(corners(s), corners(o)))))
    return F.array_distinct(F.transform(F.filter(found, lambda p: p["hit"]), lambda p: point(p["x"], p["y"])))


def lines_from_segments(parts: Column) -> Column:
    """Lines stitched from segments in order; a new line starts wherever a segment does not start where the last one ended."""
    empty = F.array().cast(RINGS_DDL)

    def add(lines: Column, s: Column) -> Column:
        last = F.get(lines, F.size(lines) - 1)
        goes_on = F.coalesce(F.element_at(last, -1) == s["a"], F.lit(False))
        longer = F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.array_append(last, s["b"])))
        return F.when(goes_on, longer).otherwise(F.array_append(lines, F.array(s["a"], s["b"])))

    return F.aggregate(parts, empty, add)


def clip_line(line: Column, b: Column) -> Column:
    """Parts of the line in the closed box, as an array of lines."""
    parts = F.filter(F.transform(segments(line), lambda s: clip_segment(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], b)), lambda s: s.isNotNull())
    return lines_from_segments(parts)


def is_extended_by(a: Column, b: Column) -> Column:
    """Whether the second vertices of the two lines are equal."""
    return F.coalesce(F.get(a, F.lit(1)) == F.get(b, F.lit(1)), F.lit(False))


def merge_lines(a: Column, b: Column) -> Column:
    """The two lines joined at a common end (head-head, tail-tail, head-tail, tail-head, in this order), else an empty line."""
    rest = lambda line: F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))
    head, tail = (lambda line: F.element_at(line, 1)), (lambda line: F.element_at(line, -1))
    return (
        F.when(head(a) == head(b), F.concat(F.reverse(b), rest(a)))
        .when(tail(a) == tail(b), F.concat(a, rest(F.reverse(b))))
        .when(head(a) == tail(b), F.concat(b, rest(a)))
        .when(tail(a) == head(b), F.concat(a, rest(b)))
        .otherwise(F.array().cast(LINE_DDL))
    )


def project(rings: Column, f) -> Column:
    """A point function over every vertex of a geometry's rings."""
    return F.transform(rings, lambda ring: F.transform(ring, f))


# Polygons: arrays of rings, each ring closed by its first vertex.


def point_in_polygon(x, y, rings: Column) -> Column:
    """Even-odd rule over all rings; points on an edge fall as the half-open rule has it."""
    x, y = c(x), c(y)
    edges = F.flatten(F.transform(rings, lambda r: segments(r, True)))

    def crosses(s: Column) -> Column:
        at = (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / F.nullif(s["b"]["y"] - s["a"]["y"], F.lit(0.0)) + s["a"]["x"]
        return F.coalesce(((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < at), F.lit(False))

    return F.aggregate(edges, F.lit(False), lambda acc, s: acc != crosses(s))


# Text.


def type_name(typ) -> Column:
    t = c(typ)
    return F.when(t == 0, "Empty").when(t == 1, "Point").when(t == 2, "LineString").when(t == 3, "Polygon").otherwise("Invalid")


def point_text(p: Column) -> Column:
    return F.concat(F.lit("(X: "), number_text(p["x"]), F.lit(", Y: "), number_text(p["y"]), F.lit(")"))


def line_text(line: Column) -> Column:
    return F.array_join(F.transform(line, point_text), ", ")


def geom_text(g: Column) -> Column:
    polygon = F.concat(F.lit("("), F.array_join(F.transform(g["rings"], lambda r: F.concat(F.lit("("), line_text(r), F.lit(")"))), ", "), F.lit(")"))
    return F.when(g["typ"] == 1, point_text(F.get(F.get(g["rings"], F.lit(0)), F.lit(0)))).when(g["typ"] == 2, line_text(F.get(g["rings"], F.lit(0)))).when(g["typ"] == 3, polygon).otherwise("")
