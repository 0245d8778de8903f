"""GeoJSON text to geometry and property columns, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.types import GEOM_DDL, PROP_DDL, PROPS_DDL, number_text, point

#: Schema of one feature; coordinates stay raw text, whatever their depth.
FEATURE_SCHEMA = "type string, id string, geometry struct<type:string, coordinates:string>, properties map<string, variant>"
# The one known pair of coordinate system name and srid.
CRS_OF_SRID = {"4326": "urn:ogc:def:crs:OGC:1.3:CRS84"}
SRID_OF_CRS = {v: k for k, v in CRS_OF_SRID.items()}


def _coords(raw: Column, depth: int) -> Column:
    return F.from_json(raw, "array<" * depth + "double" + ">" * depth)


def _vertex(v: Column) -> Column:
    return point(F.get(v, F.lit(0)), F.get(v, F.lit(1)))


def _line(v: Column) -> Column:
    return F.transform(v, _vertex)


def _rings(v: Column) -> Column:
    """Rings without their last vertex, which repeats the first."""
    return F.transform(v, lambda r: F.slice(_line(r), 1, F.greatest(F.size(r) - 1, F.lit(0))))


def geometries(geometry: Column) -> Column:
    """Array of geometries of a ``struct<type, coordinates text>``: multi geometries fall into their parts.

    Type names are matched in any case; a null geometry or an empty type gives one
    empty geometry; an unknown type gives none. Further ordinates are dropped.
    """
    raw, kind = geometry["coordinates"], F.lower(geometry["type"])
    make = lambda typ, rings: F.struct(F.lit(typ).alias("typ"), rings.alias("rings")).cast(GEOM_DDL)
    return (
        F.when(kind == "point", F.array(make(1, F.array(F.array(_vertex(_coords(raw, 1)))))))
        .when(kind == "linestring", F.array(make(2, F.array(_line(_coords(raw, 2))))))
        .when(kind == "polygon", F.array(make(3, _rings(_coords(raw, 3)))))
        .when(kind == "multipoint", F.transform(_coords(raw, 2), lambda v: make(1, F.array(F.array(_vertex(v))))))
        .when(kind == "multilinestring", F.transform(_coords(raw, 3), lambda v: make(2, F.array(_line(v)))))
        .when(kind == "multipolygon", F.transform(_coords(raw, 4), lambda v: make(3, _rings(v))))
        .when(kind.isNull() | (kind == ""), F.array(make(0, F.array())))
    )


def properties(props: Column, ident: Column) -> Column:
    """Typed properties of a map of variants; every number is a double, lists and objects are their JSON text; a text id is added."""

    def typed(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(v))
        number = F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double"))
        flag = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        t = F.when(text.isNotNull(), "string").when(number.isNotNull(), "double").when(flag.isNotNull(), "bool").otherwise("null")
        return F.struct(t.alias("t"), text.alias("s"), F.lit(None).cast("bigint").alias("i"), number.alias("d"), flag.alias("b"))

    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{PROP_DDL}>"))
    own = F.coalesce(F.transform_values(props, lambda _, v: typed(v)), none).cast(PROPS_DDL)
    given = F.map_from_arrays(F.array(F.lit("id")), F.array(F.struct(F.lit("string").alias("t"), ident.alias("s"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("boolean").alias("b"))))
    return F.when(ident.isNull(), own).otherwise(F.map_concat(F.map_filter(own, lambda k, _: k != "id"), given.cast(PROPS_DDL)))


def quoted(text: Column) -> Column:
    """A JSON string."""
    whole = F.to_json(F.array(text))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def _vertex_json(p: Column) -> Column:
    return F.concat(F.lit("["), number_text(p["x"]), F.lit(","), number_text(p["y"]), F.lit("]"))


def _line_json(line: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(line, _vertex_json), ","), F.lit("]"))


def geometry_json(g: Column) -> Column:
    """GeoJSON of a geometry, rings closed; ``null`` for none or an empty one."""
    ring = lambda r: _line_json(F.concat(r, F.slice(r, 1, 1)))
    coords = (
        F.when(g["typ"] == 1, _vertex_json(F.get(F.get(g["rings"], F.lit(0)), F.lit(0))))
        .when(g["typ"] == 2, _line_json(F.get(g["rings"], F.lit(0))))
        .when(g["typ"] == 3, F.concat(F.lit("["), F.array_join(F.transform(g["rings"], ring), ","), F.lit("]")))
    )
    name = F.when(g["typ"] == 1, "Point").when(g["typ"] == 2, "LineString").when(g["typ"] == 3, "Polygon")
    return F.coalesce(F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":'), coords, F.lit("}")), F.lit("null"))


def segment_json(a: Column, b: Column) -> Column:
    """A segment as a line feature without properties."""
    return F.concat(F.lit('{"type":"Feature","properties":{},"geometry":{"type":"LineString","coordinates":'), _line_json(F.array(a, b)), F.lit("}}"))


def properties_json(props: Column) -> Column:
    """A JSON object with sorted keys."""

    def value(p: Column) -> Column:
        plain = F.when(p["t"] == "string", quoted(p["s"])).when(p["t"] == "int", p["i"].cast("string")).when(p["t"] == "double", number_text(p["d"])).when(p["t"] == "bool", p["b"].cast("string"))
        return F.coalesce(plain, F.lit("null"))

    pairs = F.transform(F.array_sort(F.map_keys(props)), lambda k: F.concat(quoted(k), F.lit(":"), value(props[k])))
    return F.coalesce(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")), F.lit("{}"))


def feature_json(g: Column, props: Column) -> Column:
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry_json(g), F.lit(',"properties":'), properties_json(props), F.lit("}"))
