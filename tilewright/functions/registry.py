"""The scalar functions under SQL names, for spark.sql and expr."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tilewright.functions import shapes

#: Name, parameters, result type and body of the functions that are plain SQL.
SQL_FUNCTIONS = [
    ("tile_x", "lon double, zoom int", "int",
     "case when lon is not null and not isnan(lon) then cast(greatest(0, least(floor((lon + 180.0d) / 360.0d * pow(2, zoom)), pow(2, zoom) - 1)) as int) end"),
    ("tile_y", "lat double, zoom int", "int",
     "case when lat is not null and not isnan(lat) then cast(greatest(0, least(floor((1 - ln(tan(radians(greatest(-85.0511287d, least(lat, 85.0511287d))))"
     " + 1 / cos(radians(greatest(-85.0511287d, least(lat, 85.0511287d))))) / pi()) / 2 * pow(2, zoom)), pow(2, zoom) - 1)) as int) end"),
    ("mercator_x", "lon double", "double", "radians(lon) * 6378137.0d"),
    ("mercator_y", "lat double", "double", "ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0d"),
    ("tile_resolution", "zoom int, extent int", "double", "360.0d / (pow(2, zoom) * extent)"),
    ("haversine_m", "x1 double, y1 double, x2 double, y2 double", "double",
     "2 * 6371000.0d * asin(sqrt(least(1.0d, pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2))))"),
    ("bearing", "x1 double, y1 double, x2 double, y2 double", "double",
     "pmod(degrees(atan2(sin(radians(x2 - x1)) * cos(radians(y2)), cos(radians(y1)) * sin(radians(y2)) - sin(radians(y1)) * cos(radians(y2)) * cos(radians(x2 - x1)))) + 360.0d, 360.0d)"),
    ("round8", "v double", "double", "case when abs(v) >= 4e7d then v when v < 0 then ceil(v * 1e8d - 0.5d) / 1e8d else floor(v * 1e8d + 0.5d) / 1e8d end"),
    ("ring_area2", "ring array<struct<x:double,y:double>>", "double",
     "if(size(ring) < 1, 0.0d, aggregate(sequence(0, size(ring) - 1), 0.0d, (a, i) -> a + (ring[i].y + ring[(i + 1) % size(ring)].y) * (ring[i].x - ring[(i + 1) % size(ring)].x)))"),
]


def register(spark: SparkSession) -> None:
    """Temporary SQL functions, and the Arrow functions ``to_wkb, from_wkb, valid_topology, fix_winding, tile_commands, merged_lines``."""
    for name, parameters, result, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name in ("to_wkb", "from_wkb", "valid_topology", "fix_winding", "tile_commands", "merged_lines"):
        spark.udf.register(name, shapes.udf_of(name))
