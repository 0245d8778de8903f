"""Points near points, and polygons that contain points, without a spatial index.

Both are equi-joins on grid cells followed by the exact test, so Spark can hash
or sort-merge them; hot cells are salted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.skew import both_salted, bounded, heavy_keys, salted

EARTH_RADIUS_M = 6371000.0
#: Rows of one cell that a task of the join handles before the cell is salted.
ROWS_PER_SALT = 4000
#: Cells above this share of all rows are looked at for salting.
HOT_SHARE = 0.002


def usable(lat: str, lon: str) -> Column:
    """Neither null nor NaN, within ±90 and ±180."""
    return (
        F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
        & F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)
    )


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def near_pairs(points: DataFrame, radius_m: float, cell_m: float | None = None) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: pairs of different ids at most ``radius_m`` apart by the haversine distance.

    ``points`` has ``id``, ``lat``, ``lon``; unusable points and null ids take no
    part, repeated rows count once, the 180th meridian and the poles are no edge.
    Each latitude band is cut into whole cells round the globe; a point is kept
    in its own cell and looked up in every cell its circle touches.
    """
    spark = points.sparkSession
    raw = points.where(usable("lat", "lon") & F.col("id").isNotNull()).select("id", "lat", "lon")
    p = raw.distinct()
    size = math.degrees((cell_m or 4 * radius_m) / EARTH_RADIUS_M)
    reach = math.degrees(radius_m / EARTH_RADIUS_M) + 1e-9
    bands = max(1, int(180 / size))
    height = 180.0 / bands

    def cells(band: Column) -> Column:
        nearest = F.least(F.abs(band * height - 90), F.abs((band + 1) * height - 90))
        nearest = F.when((band * height - 90) * ((band + 1) * height - 90) <= 0, F.lit(0.0)).otherwise(nearest)
        return F.greatest(F.lit(1), F.floor(F.cos(F.radians(nearest)) * (360.0 / height))).cast("long")

    def in_cell(band: Column, lon: Column) -> Column:
        return F.floor((lon + 180) / 360 * cells(band)).cast("long")

    def number(band: Column, cell: Column) -> Column:
        return band * F.lit(1 << 32) + F.pmod(cell, cells(band))

    band = F.least(F.floor((F.col("lat") + 90) / height), F.lit(bands - 1)).cast("long")
    own = number(band, in_cell(band, F.col("lon"))).alias("cell")
    home = p.select("id", "lat", "lon", own)
    s = F.sin(F.lit(math.radians(reach))) / F.cos(F.radians("lat"))
    wide = F.when((F.abs("lat") + reach >= 90) | (s >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(s)) + 1e-9)
    first = F.greatest(F.floor((F.col("lat") - reach + 90) / height), F.lit(0))
    last = F.least(F.floor((F.col("lat") + reach + 90) / height), F.lit(bands - 1))
    probe = p.select("id", "lat", "lon", wide.alias("wide"), F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("band"))
    lo, hi, n = in_cell(F.col("band"), F.col("lon") - F.col("wide")), in_cell(F.col("band"), F.col("lon") + F.col("wide")), cells(F.col("band"))
    span = F.when(hi - lo + 1 >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.sequence(lo, hi))
    probe = probe.select("id", "lat", "lon", "band", F.explode(span).alias("c"))
    probe = probe.select("id", "lat", "lon", number(F.col("band"), F.col("c")).alias("cell"))

    heavy = bounded(spark, heavy_keys(raw.select(own), "cell", HOT_SHARE))
    a = salted(home, "cell", heavy, ROWS_PER_SALT, F.xxhash64("id")).select("cell", "_salt", F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = salted(probe, "cell", heavy, ROWS_PER_SALT, None).select("cell", "_salt", F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    hit = (F.col("id_a") < F.col("id_b")) & (F.abs(F.col("lat_a") - F.col("lat_b")) <= reach) & (haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= radius_m)
    return a.join(b, ["cell", "_salt"]).where(hit).select("id_a", "id_b").distinct()


#: Grid levels of the containment join: a cell of level l is 180 / 2^l degrees wide. Its strip is as high, and finer by 1 / 4, 1 / 16, ...
#: for a polygon of very many edges, so that a strip has about STRIP_EDGES of them.
MAX_LEVEL, MAX_STRIP, STRIP_EDGES = 18, 26, 256


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """One row per edge: ``region, shape, level, fine, minx, x1, y1, x2, y2``.

    ``polygons`` has ``region`` (id) and ``rings``. Rings are closed by their
    first vertex, whatever their winding. Edges with a null or not finite
    coordinate and edges of no length are left out; copies of a polygon count once.
    ``shape`` tells different polygons of one region apart.
    """
    p = polygons.where(F.col("region").isNotNull() & (F.size("rings") > 0)).select("region", "rings")
    p = p.withColumn("shape", F.xxhash64("rings")).dropDuplicates(["region", "shape"])
    edges = F.expr(
        "flatten(transform(filter(rings, r -> size(r) > 1), r -> transform(sequence(1, size(r)),"
        " i -> struct(element_at(r, i).x as x1, element_at(r, i).y as y1,"
        " element_at(r, i % size(r) + 1).x as x2, element_at(r, i % size(r) + 1).y as y2))))"
    )
    good = "filter(edges, e -> abs(e.x1) + abs(e.y1) + abs(e.x2) + abs(e.y2) < double('Infinity') and not (e.x1 = e.x2 and e.y1 = e.y2))"
    p = p.select("region", "shape", edges.alias("edges")).withColumn("edges", F.expr(good)).where(F.size("edges") > 0)
    low, high = "array_min(transform(edges, e -> least(e.{0}1, e.{0}2)))", "array_max(transform(edges, e -> greatest(e.{0}1, e.{0}2)))"
    p = p.select("region", "shape", "edges", *[F.expr(f.format(c)).alias(n + c) for c in "xy" for n, f in (("min", low), ("max", high))])
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.lit(1e-6))
    level = F.floor(F.log2(F.lit(720.0) / extent) / 2) * 2
    p = p.withColumn("level", F.least(F.greatest(level, F.lit(0)), F.lit(MAX_LEVEL)).cast("int"))
    fine = F.greatest(F.lit(0), F.ceil(F.log2(F.size("edges") / F.lit(float(STRIP_EDGES))) / 2) * 2)
    p = p.withColumn("fine", F.least(fine, F.lit(MAX_STRIP) - F.col("level")).cast("int"))
    return p.select("region", "shape", "level", "fine", "minx", F.inline("edges"))


def containing_regions(points: DataFrame, polygons: DataFrame, boundary: str = "half_open") -> DataFrame:
    """``(id, region)``: points inside polygons by the parity of ray crossings, once each.

    Edges are binned into latitude strips, the narrower the more edges a polygon has, and,
    along the ray, into the cells from the polygon's west end to the edge; points of a
    cell meet just those. Cells of very many points and cells of very many edges are split. A ray to
    the east crosses an edge if exactly one end lies above the point and the
    crossing lies east of it; an odd number means inside. On the boundary itself
    that rule decides as it falls (``half_open``); ``include`` and ``exclude``
    settle those points explicitly. Null or not usable points are in no region.
    """
    spark = points.sparkSession
    raw = points.where(usable("lat", "lon") & F.col("id").isNotNull()).select("id", "lat", "lon")
    edges = polygon_edges(polygons)
    levels = edges.select("level", "fine").distinct().collect()  # at most (MAX_LEVEL / 2 + 1) * (MAX_STRIP / 2 + 1) pairs

    h = F.lit(180.0) / F.pow(F.lit(2.0), F.col("level"))
    top = F.pow(F.lit(2.0), F.col("level"))
    rows = F.pow(F.lit(2.0), F.col("level") + F.col("fine"))
    strip = lambda y: F.greatest(F.lit(0.0), F.least(F.floor((y + 90) / (F.lit(180.0) / rows)), rows)).cast("long")
    column = lambda x: F.greatest(F.lit(-1.0), F.least(F.floor((x + 180) / h), 2 * top + 1)).cast("long")
    number = lambda y, x: ((F.col("level") * 32 + F.col("fine")).cast("long") * F.lit(1 << 27) + y) * F.lit(1 << 21) + x
    kinds = F.array(*[F.struct(F.lit(r.level).alias("level"), F.lit(r.fine).alias("fine")) for r in levels]).cast("array<struct<level:int,fine:int>>")

    def cells(p: DataFrame) -> DataFrame:
        p = p.select("id", "lat", "lon", F.inline(kinds))
        return p.select("id", "lat", "lon", number(strip(F.col("lat")), column(F.col("lon"))).alias("cell"))

    at = cells(raw.distinct())
    cut = edges.where((F.greatest("y1", "y2") >= -90) & (F.least("y1", "y2") <= 90) & (F.greatest("x1", "x2") >= -180))
    cut = cut.select("*", F.explode(F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2")))).alias("s"))
    cut = cut.select("*", F.explode(F.sequence(column(F.col("minx")), column(F.greatest("x1", "x2")))).alias("c"))
    cut = cut.select("region", "shape", "x1", "y1", "x2", "y2", number(F.col("s"), F.col("c")).alias("cell"))

    many_points, many_edges = bounded(spark, heavy_keys(cells(raw), "cell", HOT_SHARE)), bounded(spark, heavy_keys(cut, "cell", HOT_SHARE))
    at, cut = both_salted(at, cut, "cell", many_points, many_edges, ROWS_PER_SALT, F.xxhash64("id"), F.xxhash64("region", "x1", "y1", "x2", "y2"))
    x, y = F.col("lon"), F.col("lat")
    across = (F.col("y1") > y) != (F.col("y2") > y)
    crossing = across & (x < (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1"))
    on = F.lit(False)
    if boundary != "half_open":
        turn = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1"))
        on = (turn == 0) & x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    hits = at.join(cut, ["cell", "_sa", "_sb"]).select("id", "lat", "lon", "region", "shape", crossing.alias("crossing"), on.alias("on_edge"))
    counts = hits.where("crossing or on_edge").groupBy("id", "lat", "lon", "region", "shape").agg(F.sum(F.col("crossing").cast("long")).alias("n"), F.max("on_edge").alias("on_edge"))
    odd = F.col("n") % 2 == 1
    inside = {"half_open": odd, "include": odd | F.col("on_edge"), "exclude": odd & ~F.col("on_edge")}[boundary]
    return counts.where(inside).select("id", "region").distinct()
