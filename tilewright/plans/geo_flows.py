"""Queries for mapping rules, assembly, tiling, codecs and whole flows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geojson, shapes
from tilewright.functions import geometry as g
from tilewright.functions import tiles as t
from tilewright.operators import assembly, mapping, tiling
from tilewright.operators.mapping import Rule, apply_rules
from tilewright.plans.derived import CUSTOMERS, SEGMENTS, WAYS, area_sql, customers, lat_sql, lon_sql, osm_tables, part_features, segments
from tilewright.plans.geo_points import tx, ty
from tilewright.session import scratch_path, ship, table
from tilewright.sources import binary, formats, text
from tilewright.streaming.features import converted, each_batch
from tilewright.types import line_geom, point, point_geom, prop, prop_text, props_key, string_props

RULES = """
- src: {key: type, value: "*"}
  dest:
    - {key: "@layer", value: parts}
    - {key: kind, value: "$type"}
    - {key: size, value: "$size", type: int}
    - {key: brand_no, value: "$brand", type: int}
    - {key: nothing, value: "$missing"}
- src: {key: type, value: [ECONOMY, PROMO]}
  dest:
    - {key: cheap, value: 1}
"""


def _shown(df: DataFrame, key: str) -> DataFrame:
    """Properties as sorted ``key=type:value`` text."""
    p = F.col("props")
    pairs = F.transform(F.array_sort(F.map_keys(p)), lambda k: F.concat(k, F.lit("="), p[k]["t"], F.lit(":"), prop_text(p[k])))
    return df.select(key, F.array_join(pairs, " ").alias("props"))


def map_static(spark: SparkSession, d: str) -> DataFrame:
    rule = Rule("type", ("ECONOMY",), {"@layer": "parts", "n": 3, "share": 0.5, "ok": True})
    return _shown(apply_rules(part_features(spark, d), [rule]), "p_partkey")


def map_dynamic(spark: SparkSession, d: str) -> DataFrame:
    return _shown(apply_rules(part_features(spark, d), mapping.parse_rules(RULES)[:1]), "p_partkey")


def map_multi_match(spark: SparkSession, d: str) -> DataFrame:
    """Both rules of the file: a part that both match gives two features."""
    return _shown(apply_rules(part_features(spark, d), mapping.parse_rules(RULES)), "p_partkey")


def map_wildcard(spark: SparkSession, d: str) -> DataFrame:
    rules = [Rule("@zoom:min", (), {"zoomed": "yes"}), Rule("@layer", ("water", "roadway"), {}, {"class": ("@layer", None), "from": ("@zoom:min", "int")})]
    return _shown(apply_rules(table(spark, d, "features").select("feature_id", "geom", "props"), rules), "feature_id")


def map_int_cast(spark: SparkSession, d: str) -> DataFrame:
    """yes, no, digits and other text as int."""
    value = F.element_at(F.array(F.lit("yes"), F.lit("no"), F.col("p_size").cast("string"), F.concat(F.lit(" "), F.col("p_size").cast("string")), F.col("p_type")), (F.col("p_partkey") % 5 + 1).cast("int"))
    f = table(spark, d, "part").select("p_partkey", point_geom(F.lit(0), F.lit(0)).alias("geom"), string_props(F.create_map(F.lit("v"), value)).alias("props"))
    return _shown(apply_rules(f, [Rule("v", (), {}, {"v": ("v", "int")})]), "p_partkey")


def map_default(spark: SparkSession, d: str) -> DataFrame:
    """The default rules over the tags of the feature table's first seq, grouped as text properties."""
    tags = table(spark, d, "tags").where("type = 0 and key is not null and value is not null")
    last = tags.groupBy("feature_id", "key").agg(F.max(F.struct("seq", F.col("value").cast("string").alias("v"))).alias("m"))
    renamed = F.when(F.col("key") == "class", "highway").when(F.col("key") == "surface", "landuse").otherwise(F.col("key"))
    f = last.select("feature_id", renamed.alias("key"), F.when(F.col("key") == "class", F.lit("primary")).when(F.col("key") == "surface", "forest").otherwise(F.col("m.v")).alias("v"))
    f = f.groupBy("feature_id", "key").agg(F.max("v").alias("v")).groupBy("feature_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("tags"))
    return _shown(apply_rules(f.withColumn("props", string_props(F.col("tags"))), mapping.DEFAULT, None), "feature_id")


def poly_to_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every ring of a polygon as a line; other types vanish."""
    out = apply_rules(table(spark, d, "features").select("feature_id", "geom", "props"), [Rule("@layer", (), {"a": 1}, op="lines")])
    return out.select("feature_id", F.col("geom.typ").alias("typ"), F.size(F.col("geom.rings")[0]).alias("n"))


def zoom_filter(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "features").where(tiling.renderable(F.col("props"), 8))
    return f.select("feature_id")


def layer_assign(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "features").select("feature_id", tiling.layer_name(F.col("props")).alias("layer"))


def at_key_drop(spark: SparkSession, d: str) -> DataFrame:
    kept = F.map_filter("props", lambda k, _: ~k.startswith("@"))
    return table(spark, d, "features").select("feature_id", F.coalesce(F.size(kept), F.lit(0)).alias("n"))


def prop_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Features by exactly equal properties."""
    f = table(spark, d, "features").where("props is not null").withColumn("pk", props_key(F.col("props")))
    b = f.groupBy("pk").agg(F.count(F.lit(1)).alias("n"), F.min("feature_id").alias("first_id"))
    return b.select("first_id", "n")


def count_features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "features").groupBy(g.type_name(F.coalesce(F.col("geom.typ"), F.lit(0))).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def union_concat(spark: SparkSession, d: str) -> DataFrame:
    """Features of two inputs of different formats, each row once."""
    ship(spark)
    f = _whole(spark, d)
    c = customers(spark, d).select(point_geom("lon", "lat").alias("geom"), F.create_map(F.lit("@layer"), prop("string", F.col("c_mktsegment"))).alias("props"), F.lit("4326").alias("srid"))
    paths = [scratch_path(spark, "one") + ".blocks", scratch_path(spark, "two") + ".geojsonseq"]
    for part, path in zip((f, c), paths, strict=True):
        formats.write_features(part, path)
    return formats.concatenated(spark, paths).groupBy(g.type_name(F.col("geom.typ")).alias("kind"), "srid").agg(F.count(F.lit(1)).alias("n"))


def inspect_text(spark: SparkSession, d: str) -> DataFrame:
    return formats.inspect(part_features(spark, d))


def tiles_for_lines(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of lines and polygons by layer at two zooms."""
    f = table(spark, d, "features").where("geom.typ in (2, 3)").select("geom", "props")
    return tiling.tile_rows(f, [6, 10]).groupBy("z", "x", "y", "layer").agg(F.count(F.lit(1)).alias("n"))


def mvt_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Size and layers of every vector tile of the feature table at zooms 4 and 8."""
    ship(spark)
    made = tiling.vector_tiles(table(spark, d, "features").select("geom", "props"), [4, 8])
    return made.select("z", "x", "y", F.length("data").alias("n_bytes"))


def mvt_point_counts(spark: SparkSession, d: str) -> DataFrame:
    """Point tiles encoded and decoded again: features per tile and layer."""
    ship(spark)
    f = customers(spark, d).select(point_geom("lon", "lat").alias("geom"), F.create_map(F.lit("@layer"), prop("string", F.col("c_mktsegment")), F.lit("id"), prop("int", F.col("c_custkey"))).alias("props"))
    return decoded_tiles(tiling.vector_tiles(f, [3, 6])).groupBy("z", "x", "y", "layer").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def decoded_tiles(made: DataFrame) -> DataFrame:
    def run(frames):
        import pandas as pd

        from tilewright.kernels.mvt import decode_tile

        for frame in frames:
            rows = [(r.z, r.x, r.y, layer, typ, len(rings), props.get("id")) for r in frame.itertuples() for layer, fs in decode_tile(bytes(r.data)).items() for typ, rings, props in fs]
            yield pd.DataFrame(rows, columns=["z", "x", "y", "layer", "typ", "n_rings", "id"])

    return made.mapInPandas(run, "z int, x int, y int, layer string, typ int, n_rings int, id bigint")


def mvt_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Lines and polygons within one tile at zoom 8, encoded and decoded again: layer, tags and vertices in the tile's grid.

    Vertices of a line in their order, those of a polygon sorted, each once.
    """
    ship(spark)
    box = g.geom_bbox(F.col("geom"))
    f = table(spark, d, "features").where("(geom.typ = 2 and size(geom.rings) = 1 and size(array_distinct(geom.rings[0])) > 1) or (geom.typ = 3 and size(geom.rings) > 0 and forall(geom.rings, r -> size(array_distinct(r)) > 2))")
    f = f.dropDuplicates(["feature_id"]).withColumn("b", box)
    f = f.where((t.tile_x(F.col("b.minx"), 8) == t.tile_x(F.col("b.maxx"), 8)) & (t.tile_y(F.col("b.miny"), 8) == t.tile_y(F.col("b.maxy"), 8)))
    f = f.where("b.minx >= -180 and b.maxx <= 180 and b.miny >= -85 and b.maxy <= 85")
    layer = F.coalesce(F.col("props")["@layer"]["s"], F.lit("none"))
    tags = F.create_map(F.lit("@layer"), prop("string", layer), F.lit("id"), prop("int", F.col("feature_id")), F.lit("half"), prop("double", F.col("feature_id") / 2), F.lit("kind"), prop("string", F.concat(F.lit("k"), F.col("geom.typ"))))

    def run(frames):
        import pandas as pd

        from tilewright.kernels.mvt import decode_tile

        for frame in frames:
            rows = []
            for r in frame.itertuples():
                shapes_of: dict = {}  # a polygon may come out in several parts
                for name, found in decode_tile(bytes(r.data)).items():
                    for typ, rings, props in found:
                        v = shapes_of.setdefault((name, props["id"], props["half"], props["kind"], len(props), typ), [])
                        v += [p for ring in rings for p in ring]
                for (*head, typ), v in shapes_of.items():
                    v = sorted(set(v)) if typ == 3 else [p for i, p in enumerate(v) if i == 0 or p != v[i - 1]]
                    rows.append((r.z, r.x, r.y, *head, " ".join(f"{x},{y}" for x, y in v)))
            yield pd.DataFrame(rows, columns=["z", "x", "y", "layer", "feature_id", "half", "kind", "n_tags", "vertices"])

    made = tiling.vector_tiles(f.select("geom", tags.alias("props")), [8])
    return made.mapInPandas(run, "z int, x int, y int, layer string, feature_id bigint, half double, kind string, n_tags int, vertices string")


#: Keeps the derived places off the lines of the grid, where rounding decides.
OFF = 0.00171


def merged_tile_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two pieces of each line, with equal properties, in their tile at zoom 0: joined end to start to one of three vertices."""
    ship(spark)
    c = segments(spark, d).where("x1 != x3 or y1 != y3")
    piece = lambda i, j: F.array(*[point(F.col(f"x{k}") + OFF, F.col(f"y{k}") + OFF) for k in (i, j)])
    f = c.select("c_custkey", F.explode(F.array(line_geom(piece(2, 3)), line_geom(piece(1, 2)))).alias("geom"))
    f = f.select("geom", F.create_map(F.lit("id"), prop("int", F.col("c_custkey"))).alias("props"))
    got = tiling.merged_parts(tiling.tile_parts(tiling.tile_rows(f, [0])))
    v = F.array_join(F.transform(F.flatten("geom.rings"), lambda p: F.concat(p["x"].cast("int"), F.lit(","), p["y"].cast("int"))), " ")
    return got.select(F.col("props")["id"]["i"].alias("c_custkey"), v.alias("vertices"))


def mvt_point_commands(spark: SparkSession, d: str) -> DataFrame:
    """Command integers of each point in its tile at zoom 9."""
    ship(spark)
    c = customers(spark, d).withColumn("b", t.tile_bbox(t.tile_x("lon", 9), t.tile_y("lat", 9), F.lit(9)))
    p = t.tile_point("lon", "lat", F.col("b.minx"), F.col("b.miny"), F.col("b.maxx"), F.col("b.maxy"))
    c = c.select("c_custkey", p.alias("p"))
    return c.select("c_custkey", F.array_join(shapes.tile_commands(point_geom(F.col("p.x"), F.col("p.y"))), " ").alias("commands"))


def tile_geojson(spark: SparkSession, d: str) -> DataFrame:
    """Features per GeoJSON tile, read back from its text."""
    made = tiling.geojson_tiles(table(spark, d, "features").select("geom", "props"), [5])
    parsed = F.from_json(F.col("data").cast("string"), "type string, features array<struct<type:string>>")
    return made.select("x", "y", F.size(parsed["features"]).alias("n"))


def way_assembly(spark: SparkSession, d: str) -> DataFrame:
    nodes, ways, _ = osm_tables(spark, d)
    w = assembly.way_lines(ways, nodes)
    return w.select("way_id", F.size("line").alias("n"), F.round(F.when(F.size("line") > 0, g.area(F.col("line"))), 4).alias("area2"))


def referenced_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, ways, _ = osm_tables(spark, d)
    return assembly.referenced_nodes(nodes, ways.where("tags['status'] = 'F'")).select("id")


def way_area_split(spark: SparkSession, d: str) -> DataFrame:
    """Way features: urgent ones as polygons, low ones as lines."""
    nodes, ways, _ = osm_tables(spark, d)
    rules = [Rule("priority", ("1-URGENT",), {"__type": "area", "@layer": "a"}), Rule("priority", ("5-LOW",), {"@layer": "l"})]
    f = assembly.way_features(ways, nodes, rules)
    key = g.type_name(F.col("geom.typ"))
    return f.groupBy(key.alias("kind"), F.map_contains_key("props", "__type").alias("keeps_type")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.flatten("geom.rings"))).alias("vertices"), F.count_if(g.area(F.flatten("geom.rings")) > 0).alias("positive"))


def relation_rings(spark: SparkSession, d: str) -> DataFrame:
    nodes, ways, relations = osm_tables(spark, d)
    r = assembly.relation_rings(relations, ways, nodes)
    total = F.aggregate("rings", F.lit(0.0), lambda acc, q: acc + g.area(q))
    return r.select("relation_id", F.size("rings").alias("n_rings"), F.round(total, 3).alias("area2"))


def spatialize(spark: SparkSession, d: str) -> DataFrame:
    """All three kinds of element through one rule set: features by type and layer."""
    rules = [Rule("brand", ("Brand#4",), {"@layer": "nodes"}), Rule("priority", ("2-HIGH",), {"@layer": "ways"}), Rule("segment", ("BUILDING",), {"@layer": "relations", "type": "multipolygon"})]
    f = assembly.spatialize(*osm_tables(spark, d), rules)
    return f.groupBy(g.type_name(F.col("geom.typ")).alias("kind"), F.col("props")["@layer"]["s"].alias("layer"), "srid").agg(F.count(F.lit(1)).alias("n"))


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows that every format can hold: with a geometry without empty rings, numbered by feature_id."""
    f = table(spark, d, "features").where("size(geom.rings) > 0 and forall(geom.rings, r -> size(r) > 0)")
    ident = F.map_concat(F.coalesce("props", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<t:string,s:string,i:bigint,d:double,b:boolean>>"))), F.create_map(F.lit("fid"), prop("string", F.col("feature_id").cast("string"))))
    return f.select("geom", ident.alias("props"), F.lit("4326").alias("srid"))


def _summary(f: DataFrame) -> DataFrame:
    """Identity, type, vertices and a coordinate sum of each feature."""
    v = F.flatten("geom.rings")
    total = F.aggregate(v, F.lit(0.0), lambda acc, p: acc + p["x"] + 2 * p["y"])
    return f.select(F.col("props")["fid"]["s"].cast("bigint").alias("feature_id"), F.col("geom.typ").alias("typ"), F.size(v).alias("n"), F.round(total, 5).alias("total"))


def wkb_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    f = _whole(spark, d)
    return _summary(f.withColumn("geom", shapes.from_wkb(shapes.to_wkb(F.col("geom")))))


def twkb_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Points and lines with 5 decimals."""
    ship(spark)
    f = _whole(spark, d).where("geom.typ in (1, 2)").withColumn("geom", shapes.from_twkb(shapes.to_twkb(F.col("geom"), 5)))
    return _summary(f).select("feature_id", "typ", "n", F.round("total", 2).alias("total"))


def geojson_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written as feature collections to the shared folder and read again."""
    path = scratch_path(spark, "geojson") + ".geojson"
    text.write_geojson(_whole(spark, d), path)
    return _totals(text.read_geojson(spark, path))


def geojsonseq_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "seq") + ".geojsonseq"
    text.write_geojsonseq(_whole(spark, d), path)
    return _totals(text.read_geojsonseq(spark, path))


def _totals(f: DataFrame) -> DataFrame:
    """Without the vertex order, which the winding rule may turn."""
    return _summary(f)


def blocks_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    binary.register(spark)
    path = scratch_path(spark, "features") + ".blocks"
    formats.write_features(_whole(spark, d), path)
    return _summary(formats.read_features(spark, path))


def csv_points(spark: SparkSession, d: str) -> DataFrame:
    """Customers as delimited text with a header, read as point features."""
    path = scratch_path(spark, "points") + ".csv"
    customers(spark, d).select("c_custkey", "lat", "lon", "c_mktsegment").write.csv(path, header=True)
    f = text.read_csv(spark, path, lat=1, lon=2)
    p = F.col("geom.rings")[0][0]
    return f.select(F.col("props")["c_custkey"]["s"].cast("bigint").alias("c_custkey"), F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"), F.size("props").alias("n_props"))


def stream_convert(spark: SparkSession, d: str) -> DataFrame:
    """A directory of GeoJSON sequences read as a stream, mapped, and written as tables batch by batch."""
    source, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    text.write_geojsonseq(part_features(spark, d).withColumn("srid", F.lit("4326")), source)
    stream = converted(text.stream_geojsonseq(spark, source), mapping.parse_rules(RULES)[1:])
    query = each_batch(stream, scratch_path(spark, "stream-state"), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    query.awaitTermination()
    return spark.read.parquet(out).select(F.col("geom.typ").alias("typ"), F.col("props")["cheap"]["i"].alias("cheap")).groupBy("typ", "cheap").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        map_static, map_dynamic, map_multi_match, map_wildcard, map_int_cast, map_default, poly_to_lines, zoom_filter, layer_assign, at_key_drop,
        prop_buckets, count_features, union_concat, inspect_text, tiles_for_lines, mvt_tiles, mvt_shapes, merged_tile_lines, mvt_point_counts, mvt_point_commands, tile_geojson,
        way_assembly, referenced_nodes, way_area_split, relation_rings, spatialize, wkb_roundtrip, twkb_roundtrip, geojson_roundtrip,
        geojsonseq_roundtrip, blocks_roundtrip, csv_points, stream_convert,
    )
}

_L = "props['@layer'].s"
_Z = "props['@zoom:min'].i"
_KIND = "CASE typ WHEN 1 THEN 'Point' WHEN 2 THEN 'LineString' WHEN 3 THEN 'Polygon' ELSE 'Empty' END"
_DYNAMIC = "concat('@layer=string:parts brand_no=string:', p_brand, ' kind=string:', p_type, ' size=int:', p_size)"
_V = "CASE p_partkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN ' ' || p_size ELSE p_type END"
_BOXES = "bx AS (SELECT *, list_min(list_transform(v, lambda p: p.x)) AS minx, list_max(list_transform(v, lambda p: p.x)) AS maxx, list_min(list_transform(v, lambda p: p.y)) AS miny, list_max(list_transform(v, lambda p: p.y)) AS maxy FROM (SELECT feature_id, geom.typ AS typ, props, flatten(geom.rings) AS v FROM features) WHERE len(v) > 0)"


def _covered(zooms: list[int], where: str) -> str:
    zs = ", ".join(map(str, zooms))
    return f"""{_BOXES}, zz AS (SELECT unnest([{zs}]) AS z),
cx AS (SELECT feature_id, z, coalesce({_L}, 'default') AS layer, unnest(range({tx('minx', 'z')}, {tx('maxx', 'z')} + 1)) AS x, {ty('maxy', 'z')} AS y0, {ty('miny', 'z')} AS y1
  FROM bx, zz WHERE {where} AND z >= coalesce({_Z}, 0)),
cv AS (SELECT feature_id, z, layer, CAST(x AS INT) AS x, CAST(unnest(range(y0, y1 + 1)) AS INT) AS y FROM cx)"""


_WHOLE = "SELECT feature_id, geom.typ AS typ, flatten(geom.rings) AS v FROM features WHERE len(geom.rings) > 0 AND len(list_filter(geom.rings, lambda r: len(r) = 0)) = 0"
_ROUND = f"WITH w AS ({_WHOLE}) SELECT feature_id, typ, CAST(len(v) AS INT) AS n, round(list_sum(list_transform(v, lambda p: p.x + 2 * p.y)), 5) AS total FROM w"
_COUNTER = f"CASE WHEN {area_sql('line')} > 0 THEN 1 ELSE 0 END"
_ZIG = lambda v: f"(CASE WHEN {v} < 0 THEN -2 * {v} - 1 ELSE 2 * {v} END)"
_TILE9 = f"""t9 AS (SELECT *, {tx('lon', '9')} AS x, {ty('lat', '9')} AS y FROM pt), m9 AS (SELECT c_custkey, radians(lon) * 6378137.0 AS mx, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 AS my,
  radians(x / pow(2, 9) * 360.0 - 180.0) * 6378137.0 AS l, radians((x + 1) / pow(2, 9) * 360.0 - 180.0) * 6378137.0 AS r,
  ln(tan(pi() / 4 + radians(degrees(atan(sinh(pi() * (1 - 2.0 * (y + 1) / pow(2, 9)))))) / 2)) * 6378137.0 AS lo, ln(tan(pi() / 4 + radians(degrees(atan(sinh(pi() * (1 - 2.0 * y / pow(2, 9)))))) / 2)) * 6378137.0 AS hi FROM t9),
p9 AS (SELECT c_custkey, CAST(trunc((mx - l) / (r - l) * 4096) AS BIGINT) AS px, 4096 - CAST(trunc((my - lo) / (hi - lo) * 4096) AS BIGINT) AS py FROM m9)"""



def _grid(lon: str, lat: str, x: str, y: str, z: int) -> tuple[str, str]:
    """Column and row of a position in the grid of a tile."""
    mercator = lambda v: f"(ln(tan(pi() / 4 + radians({v}) / 2)) * 6378137.0)"
    low, high = (mercator(f"degrees(atan(sinh(pi() * (1 - 2.0 * ({y} + {n}) / pow(2, {z})))))") for n in (1, 0))
    left, right = (f"(radians(({x} + {n}) / pow(2, {z}) * 360.0 - 180.0) * 6378137.0)" for n in (0, 1))
    px = f"TRY_CAST(trunc((radians({lon}) * 6378137.0 - {left}) / ({right} - {left}) * 4096) AS BIGINT)"
    return px, f"(4096 - TRY_CAST(trunc(({mercator(lat)} - {low}) / ({high} - {low}) * 4096) AS BIGINT))"


_GX, _GY = _grid("vt.x", "vt.y", "x", "y", 8)
_AT = [_grid(f"(x{i} + {OFF}::DOUBLE)", f"(y{i} + {OFF}::DOUBLE)", "0", "0", 0) for i in (1, 2, 3)]
_MANY = lambda r: f"len(list_distinct(list_transform({r}, lambda p: concat(p.x, ' ', p.y))))"

SQL = {
    "map_static": "SELECT p_partkey, '@layer=string:parts n=int:3 ok=bool:true share=double:0.5' AS props FROM part WHERE p_type = 'ECONOMY'",
    "map_dynamic": f"SELECT p_partkey, {_DYNAMIC} AS props FROM part",
    "map_multi_match": f"SELECT p_partkey, {_DYNAMIC} AS props FROM part UNION ALL SELECT p_partkey, 'cheap=int:1' FROM part WHERE p_type IN ('ECONOMY', 'PROMO')",
    "map_wildcard": f"""SELECT feature_id, 'zoomed=string:yes' AS props FROM features WHERE {_Z} IS NOT NULL
  UNION ALL SELECT feature_id, 'class=string:' || {_L} || CASE WHEN {_Z} IS NULL THEN '' ELSE ' from=int:' || {_Z} END FROM features WHERE {_L} IN ('water', 'roadway')""",
    "map_int_cast": f"SELECT p_partkey, CASE WHEN v = 'yes' THEN 'v=int:1' WHEN v = 'no' THEN 'v=int:0' WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'v=int:' || CAST(v AS BIGINT) ELSE 'v=string:' || v END AS props FROM (SELECT p_partkey, {_V} AS v FROM part)",
    "map_default": """WITH k AS (SELECT DISTINCT feature_id, CASE key WHEN 'class' THEN 'highway' WHEN 'surface' THEN 'landuse' END AS k FROM tags WHERE type = 0 AND value IS NOT NULL AND key IN ('class', 'surface'))
SELECT feature_id, '@layer=string:transportation class=string:primary' AS props FROM k WHERE k = 'highway'
UNION ALL SELECT feature_id, '@layer=string:landcover __type=string:area class=string:wood' FROM k WHERE k = 'landuse'""",
    "poly_to_lines": f"SELECT feature_id, 2 AS typ, CAST(len(r) AS INT) AS n FROM (SELECT feature_id, unnest(geom.rings) AS r FROM features WHERE geom.typ = 3 AND {_L} IS NOT NULL)",
    "zoom_filter": f"SELECT feature_id FROM features WHERE coalesce({_Z}, 0) <= 8",
    "layer_assign": f"SELECT feature_id, coalesce({_L}, 'default') AS layer FROM features",
    "at_key_drop": "SELECT feature_id, CAST(coalesce(len(list_filter(map_keys(props), lambda k: NOT starts_with(k, '@'))), 0) AS INT) AS n FROM features",
    "prop_buckets": f"SELECT min(feature_id) AS first_id, count(*) AS n FROM (SELECT feature_id, {_L} AS l, {_Z} AS z FROM features WHERE props IS NOT NULL) GROUP BY l, z",
    "count_features": f"SELECT {_KIND} AS kind, count(*) AS n FROM (SELECT geom.typ AS typ FROM features) GROUP BY kind",
    "union_concat": f"SELECT {_KIND} AS kind, '4326' AS srid, count(*) AS n FROM (SELECT typ FROM ({_WHOLE}) UNION ALL SELECT 1 FROM customer) GROUP BY kind",
    "inspect_text": f"""SELECT concat('Point brand=', p_brand, ' size=', p_size, ' type=', p_type, ' (X: ', regexp_replace(CAST({lon_sql('p_partkey')} AS VARCHAR), '[.]0$', ''), ', Y: ', regexp_replace(CAST({lat_sql('p_partkey')} AS VARCHAR), '[.]0$', ''), ')') AS value FROM part""",
    "tiles_for_lines": f"WITH {_covered([6, 10], 'typ IN (2, 3)')} SELECT z, x, y, layer, count(*) AS n FROM cv GROUP BY ALL",
    "tile_geojson": f"WITH {_covered([5], 'true')} SELECT x, y, CAST(count(*) AS INT) AS n FROM cv GROUP BY ALL",
    "mvt_point_counts": f"WITH {CUSTOMERS}, zz AS (SELECT unnest([3, 6]) AS z) SELECT z, {tx('lon', 'z')} AS x, {ty('lat', 'z')} AS y, c_mktsegment AS layer, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM pt, zz GROUP BY ALL",
    "mvt_shapes": f"""WITH f AS (SELECT feature_id, any_value(geom.typ) AS typ, any_value(coalesce({_L}, 'none')) AS layer, any_value(geom.rings) AS rings FROM features
  WHERE (geom.typ = 2 AND len(geom.rings) = 1 AND {_MANY("geom.rings[1]")} > 1) OR (geom.typ = 3 AND len(geom.rings) > 0 AND len(list_filter(geom.rings, lambda r: {_MANY("r")} <= 2)) = 0) GROUP BY feature_id),
b AS (SELECT *, flatten(rings) AS v FROM f),
c AS (SELECT *, list_min(list_transform(v, lambda p: p.x)) AS minx, list_max(list_transform(v, lambda p: p.x)) AS maxx, list_min(list_transform(v, lambda p: p.y)) AS miny, list_max(list_transform(v, lambda p: p.y)) AS maxy FROM b),
k AS (SELECT *, {tx('minx', '8')} AS x, {ty('maxy', '8')} AS y FROM c WHERE minx >= -180 AND maxx <= 180 AND miny >= -85 AND maxy <= 85 AND NOT isnan(minx + maxx + miny + maxy) AND {tx('minx', '8')} = {tx('maxx', '8')} AND {ty('miny', '8')} = {ty('maxy', '8')}),
p AS (SELECT feature_id, typ, layer, x, y, unnest(v) AS vt, unnest(range(len(v))) AS i FROM k),
q AS (SELECT feature_id, typ, layer, x, y, i, {_GX} AS px, {_GY} AS py FROM p),
u AS (SELECT *, lag(px) OVER w IS NOT DISTINCT FROM px AND lag(py) OVER w IS NOT DISTINCT FROM py AS again FROM q WINDOW w AS (PARTITION BY feature_id ORDER BY i)),
ln AS (SELECT feature_id, string_agg(concat(px, ',', py), ' ' ORDER BY i) AS vertices FROM u WHERE typ = 2 AND NOT again GROUP BY feature_id),
pg AS (SELECT feature_id, string_agg(concat(px, ',', py), ' ' ORDER BY px, py) AS vertices FROM (SELECT DISTINCT feature_id, px, py FROM q WHERE typ = 3) GROUP BY feature_id)
SELECT 8 AS z, x, y, layer, feature_id, feature_id / 2 AS half, concat('k', typ) AS kind, 3 AS n_tags, vertices FROM k JOIN (SELECT * FROM ln UNION ALL SELECT * FROM pg) USING (feature_id)""",
    "merged_tile_lines": f"WITH {SEGMENTS} SELECT c_custkey, concat({", ' ', ".join(f'{a}, chr(44), {b}' for a, b in _AT)}) AS vertices FROM sg WHERE x1 <> x3 OR y1 <> y3",
    "mvt_point_commands": f"WITH {CUSTOMERS}, {_TILE9} SELECT c_custkey, concat('9 ', {_ZIG('px')}, ' ', {_ZIG('py')}) AS commands FROM p9",
    "way_assembly": f"WITH {WAYS} SELECT id AS way_id, CAST(coalesce(len(line), 0) AS INT) AS n, CASE WHEN len(line) > 0 THEN round({area_sql('line')}, 4) END AS area2 FROM wl",
    "referenced_nodes": "SELECT DISTINCT l_partkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'",
    "way_area_split": f"WITH {WAYS}, k AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Polygon' ELSE 'LineString' END AS kind, coalesce(len(line), 0) AS n FROM wl WHERE o_orderpriority IN ('1-URGENT', '5-LOW')) SELECT kind, false AS keeps_type, count(*) AS n, CAST(sum(n) AS BIGINT) AS vertices, 0::BIGINT AS positive FROM k GROUP BY kind",
    "relation_rings": f"""WITH {WAYS}, r AS (SELECT o.o_custkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * abs({area_sql('line')}) AS a FROM wl JOIN orders o ON o.o_orderkey = wl.id WHERE len(line) >= 3)
SELECT c_custkey AS relation_id, CAST(count(a) AS INT) AS n_rings, round(coalesce(sum(a), 0), 3) AS area2 FROM customer LEFT JOIN r ON r.id = c_custkey GROUP BY c_custkey""",
    "spatialize": """SELECT 'Point' AS kind, 'nodes' AS layer, '4326' AS srid, count(*) AS n FROM part WHERE p_brand = 'Brand#4' HAVING count(*) > 0
UNION ALL SELECT 'LineString', 'ways', '4326', count(*) FROM orders WHERE o_orderpriority = '2-HIGH' HAVING count(*) > 0
UNION ALL SELECT 'Polygon', 'relations', '4326', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' HAVING count(*) > 0""",
    "wkb_roundtrip": _ROUND,
    "blocks_roundtrip": _ROUND,
    "twkb_roundtrip": f"WITH w AS ({_WHOLE} AND geom.typ IN (1, 2)) SELECT feature_id, typ, CAST(len(v) AS INT) AS n, round(round(list_sum(list_transform(v, lambda p: round(p.x * 100000) / 100000 + 2 * (round(p.y * 100000) / 100000))), 5), 2) AS total FROM w",
    "geojson_roundtrip": _ROUND,
    "geojsonseq_roundtrip": _ROUND,
    "csv_points": f"WITH {CUSTOMERS} SELECT c_custkey, round(lon, 6) AS x, round(lat, 6) AS y, 4 AS n_props FROM pt",
    "stream_convert": "SELECT 1 AS typ, 1::BIGINT AS cheap, count(*) AS n FROM part WHERE p_type IN ('ECONOMY', 'PROMO')",
}
