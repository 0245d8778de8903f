"""Types of a feature row and constructors for its parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT_TYPE, LINE_TYPE, POLYGON_TYPE, EMPTY_TYPE = 1, 2, 3, 0
POINT_DDL = "struct<x:double,y:double>"
LINE_DDL = f"array<{POINT_DDL}>"
RINGS_DDL = f"array<{LINE_DDL}>"
GEOM_DDL = f"struct<typ:int,rings:{RINGS_DDL}>"
PROP_DDL = "struct<t:string,s:string,i:bigint,d:double,b:boolean>"
PROPS_DDL = f"map<string,{PROP_DDL}>"
BBOX_DDL = "struct<minx:double,miny:double,maxx:double,maxy:double>"
FEATURE_DDL = f"geom {GEOM_DDL}, props {PROPS_DDL}, srid string"


def point(x, y) -> Column:
    return F.struct(_d(x).alias("x"), _d(y).alias("y"))


def _d(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)).cast("double")


def geom(kind: int, rings: Column) -> Column:
    return F.struct(F.lit(kind).alias("typ"), rings.cast(RINGS_DDL).alias("rings"))


def point_geom(x, y) -> Column:
    return geom(POINT_TYPE, F.array(F.array(point(x, y))))


def line_geom(line: Column) -> Column:
    return geom(LINE_TYPE, F.array(line))


def polygon_geom(rings: Column) -> Column:
    return geom(POLYGON_TYPE, rings)


def as_point(g: Column) -> Column:
    """Vertex of a point geometry, null for any other type."""
    return F.when(g["typ"] == POINT_TYPE, F.get(F.get(g["rings"], F.lit(0)), F.lit(0)))


def as_line(g: Column) -> Column:
    return F.when(g["typ"] == LINE_TYPE, F.get(g["rings"], F.lit(0)))


def as_polygon(g: Column) -> Column:
    return F.when(g["typ"] == POLYGON_TYPE, g["rings"])


def prop(kind: str, value) -> Column:
    """A typed property value: kind string, int, double, bool or null."""
    v = value if isinstance(value, Column) else F.lit(value)
    slot = {"string": "s", "int": "i", "double": "d", "bool": "b"}
    parts = [F.lit(kind).alias("t")]
    for k, sql in (("string", "string"), ("int", "bigint"), ("double", "double"), ("bool", "boolean")):
        parts.append((v if k == kind else F.lit(None)).cast(sql).alias(slot[k]))
    return F.struct(*parts)


def prop_of(value) -> Column:
    """A typed property from a Python value."""
    if value is None:
        return prop("null", F.lit(None))
    kind = "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "double" if isinstance(value, float) else "string"
    return prop(kind, value)


def string_props(tags: Column) -> Column:
    """Typed properties from a map of strings."""
    return F.transform_values(tags, lambda _, v: prop("string", v))


def empty_props() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{PROP_DDL}>"))


def props_key(props: Column) -> Column:
    """Text that is equal exactly for equal properties, whatever their order; group and join on this, not on the map."""
    return F.to_json(F.array_sort(F.map_entries(props)))


def number_text(v: Column) -> Column:
    """Shortest decimal text of a double, without a trailing .0."""
    return F.regexp_replace(v.cast("string"), r"\.0$", "")


def prop_text(p: Column) -> Column:
    """Value of a typed property as text."""
    return (
        F.when(p["t"] == "string", p["s"]).when(p["t"] == "int", p["i"].cast("string"))
        .when(p["t"] == "double", number_text(p["d"])).when(p["t"] == "bool", p["b"].cast("string")).otherwise(F.lit("<nil>"))
    )
