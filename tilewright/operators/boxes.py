"""Filters and joins by bounding box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geometry import bbox, bbox_intersects, bbox_overlaps_corner, geom_bbox
from tilewright.operators.skew import both_salted, bounded, heavy_keys


def extent(features: DataFrame, geom: str = "geom") -> DataFrame:
    """One row minx, miny, maxx, maxy: the box of all geometries; nulls for none."""
    boxes = features.select(geom_bbox(F.col(geom)).alias("b"))
    return boxes.agg(F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"))


def filter_box(features: DataFrame, box: tuple[float, float, float, float], geom: str = "geom", corner_rule: bool = False) -> DataFrame:
    """Features whose box meets the given one; ``corner_rule`` asks only whether a south-west or north-east corner is inside."""
    test = bbox_overlaps_corner if corner_rule else bbox_intersects
    return features.where(test(geom_bbox(F.col(geom)), bbox(*box)))


#: Boxes of one cell and side that a task takes before the cell is salted.
ROWS_PER_SALT = 4000
#: Cells along an axis that a box may cover before it moves to a coarser level.
SPREAD, FINEST = 4, 18


def _level(box: Column) -> Column:
    size = F.greatest(box["maxx"] - box["minx"], box["maxy"] - box["miny"], F.lit(1e-9))
    return F.greatest(F.lit(0), F.least(F.floor(F.log2(F.lit(360.0 * SPREAD / 2) / size) / 2) * 2, F.lit(FINEST))).cast("int")


def _cells(box: Column, level: Column) -> Column:
    """Numbers of the cells of 360 / 2^level degrees that the box covers; beyond the world the outermost cell stands for all."""
    n = F.pow(F.lit(2.0), level)
    at = lambda v: F.least(F.greatest(F.floor((v + 180.0) / 360.0 * n), F.lit(-1)), n).cast("long")
    xs, ys = F.sequence(at(box["minx"]), at(box["maxx"])), F.sequence(at(box["miny"]), at(box["maxy"]))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: (x + 1) * F.lit(1 << 20) + y + 1)))


def box_join(left: DataFrame, right: DataFrame, left_box: str = "box", right_box: str = "box", left_id: str = "id", right_id: str = "id") -> DataFrame:
    """``left_id, right_id`` (as id_a, id_b) of all pairs with intersecting closed boxes, each once.

    Each side keeps its boxes at the level of a grid pyramid that suits their
    size; pairs of levels that occur on both sides are joined at the coarser one,
    so no box is spread over many cells. A pair that meets in several cells is
    kept in the cell of its common corner only, which needs no shuffle to de-duplicate.
    """
    spark = left.sparkSession
    a = left.select(F.col(left_id).alias("id_a"), F.col(left_box).alias("a")).where("id_a is not null and a.minx is not null").withColumn("la", _level(F.col("a")))
    b = right.select(F.col(right_id).alias("id_b"), F.col(right_box).alias("b")).where("id_b is not null and b.minx is not null").withColumn("lb", _level(F.col("b")))
    levels_a = [r[0] for r in a.select("la").distinct().collect()]  # at most FINEST / 2 + 1 numbers a side
    levels_b = [r[0] for r in b.select("lb").distinct().collect()]

    def reach(own: str, others: list[int]) -> Column:
        """Struct (own level, other level) for each other level, at the coarser of which the box is spread."""
        return F.explode(F.array(*[F.struct(F.col(own).alias("own"), F.lit(o).alias("other")) for o in others]))

    if not levels_a or not levels_b:
        return a.join(b, F.lit(False)).select("id_a", "id_b")
    a = a.select("id_a", "a", reach("la", levels_b).alias("p")).select("id_a", "a", F.col("p.own").alias("la"), F.col("p.other").alias("lb"))
    b = b.select("id_b", "b", reach("lb", levels_a).alias("p")).select("id_b", "b", F.col("p.own").alias("lb"), F.col("p.other").alias("la"))
    level = F.least("la", "lb")
    key = lambda cell: (F.col("la").cast("long") * 32 + F.col("lb")) * F.lit(1 << 42) + cell
    a = a.select("id_a", "a", "la", "lb", F.explode(_cells(F.col("a"), level)).alias("cell")).select("id_a", "a", "la", "lb", "cell", key(F.col("cell")).alias("k"))
    b = b.select("id_b", "b", "la", "lb", F.explode(_cells(F.col("b"), level)).alias("cell")).select("id_b", "b", key(F.col("cell")).alias("k"))
    many_a, many_b = bounded(spark, heavy_keys(a, "k", 0.005)), bounded(spark, heavy_keys(b, "k", 0.005))
    a, b = both_salted(a, b, "k", many_a, many_b, ROWS_PER_SALT, F.xxhash64("id_a"), F.xxhash64("id_b"))
    met = a.join(b, ["k", "_sa", "_sb"]).where(bbox_intersects(F.col("a"), F.col("b")))
    corner = F.struct(
        F.greatest("a.minx", "b.minx").alias("minx"), F.greatest("a.miny", "b.miny").alias("miny"),
        F.greatest("a.minx", "b.minx").alias("maxx"), F.greatest("a.miny", "b.miny").alias("maxy"),
    )
    return met.where(F.get(_cells(corner, F.least("la", "lb")), F.lit(0)) == F.col("cell")).select("id_a", "id_b")
