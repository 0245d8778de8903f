"""Features to tiles: explode over the tiles they touch, project, clip, merge, encode, write."""

from __future__ import annotations

import gzip
import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geometry as g
from tilewright.functions import shapes, tiles
from tilewright.functions.geojson import feature_json
from tilewright.session import ship
from tilewright.sources.binary import file_system
from tilewright.types import GEOM_DDL, point, props_key

#: Zoom range of a feature without its own.
MIN_ZOOM, MAX_ZOOM = 0, 99


def _zoom_of(props: Column, key: str, default: int) -> Column:
    p = props[key]
    return F.coalesce(F.when(p["t"] == "int", p["i"]).when(p["t"] == "double", p["d"].cast("bigint")), F.lit(default))


def renderable(props: Column, zoom) -> Column:
    """Whether a feature shows at this zoom: @zoom:min to @zoom:max, numbers only, doubles cut to integers."""
    z = F.col(zoom) if isinstance(zoom, str) else zoom if isinstance(zoom, Column) else F.lit(zoom)
    return z.between(F.coalesce(_zoom_of(props, "@zoom:min", MIN_ZOOM), F.lit(MIN_ZOOM)), F.coalesce(_zoom_of(props, "@zoom:max", MAX_ZOOM), F.lit(MAX_ZOOM)))


def layer_name(props: Column, default: str | None = "default") -> Column:
    """@layer if it is text, else the default; null drops a feature."""
    p = props["@layer"]
    return F.coalesce(F.when(p["t"] == "string", p["s"]), F.lit(default))


def tile_rows(features: DataFrame, zooms: list[int], default_layer: str | None = "default", geom: str = "geom", props: str = "props") -> DataFrame:
    """``z, x, y, layer`` and all columns of ``features``: a row per zoom and covered tile.

    Features without a vertex, not renderable at the zoom or without a layer give
    none. The zoom test comes before the tiles are spelled out, column by column, so
    no row ever holds all its tiles. A column ``_within`` (struct z, x, y), if there is
    one, keeps only tiles inside that tile.
    """
    zoom_list = F.array(*[F.lit(z) for z in sorted(set(zooms))]).cast("array<int>")
    keep = [c for c in features.columns if c not in ("_within", "_zooms")]
    out = features.withColumn("_box", g.geom_bbox(F.col(geom))).where("_box is not null").withColumn("layer", layer_name(F.col(props), default_layer))
    out = out.where(F.col("layer").isNotNull() & (F.col("layer") != ""))
    if "_zooms" in features.columns:  # a feature that was cut up shows each of its forms at some of the zooms
        zoom_list = F.coalesce(F.col("_zooms"), zoom_list)
    out = out.withColumn("z", F.explode(zoom_list)).where(renderable(F.col(props), "z"))
    x0, x1 = tiles.tile_x(F.col("_box.minx"), F.col("z")), tiles.tile_x(F.col("_box.maxx"), F.col("z"))
    y0, y1 = tiles.tile_y(F.col("_box.maxy"), F.col("z")), tiles.tile_y(F.col("_box.miny"), F.col("z"))
    if "_within" in features.columns:
        side = F.pow(F.lit(2.0), F.col("z") - F.col("_within.z")).cast("int")
        low = lambda v, n: F.greatest(v, F.coalesce(F.col(f"_within.{n}") * side, v))
        high = lambda v, n: F.least(v, F.coalesce((F.col(f"_within.{n}") + 1) * side - 1, v))
        out = out.where(F.col("_within").isNull() | (F.col("_within.z") <= F.col("z")))
        x0, x1, y0, y1 = low(x0, "x"), high(x1, "x"), low(y0, "y"), high(y1, "y")
    out = out.select(*keep, "layer", "z", x0.alias("_x0"), x1.alias("_x1"), y0.alias("_y0"), y1.alias("_y1")).where("_x0 <= _x1 and _y0 <= _y1")
    out = out.withColumn("x", F.explode(F.sequence("_x0", "_x1"))).withColumn("y", F.explode(F.sequence("_y0", "_y1")))
    return out.select("z", "x", "y", "layer", *keep)


#: Tiles that one feature may cover at the highest zoom before it is cut up first, and zoom levels between two cuts.
MAX_COVER, CUT_STEP = 1024, 3


def cut_large(features: DataFrame, zooms: list[int], geom: str = "geom") -> DataFrame:
    """Features with a column ``_within``: those that cover very many tiles are cut along coarser tiles, level by level, and spread.

    A part is looked up only in tiles inside the one it was cut to, so clipping a
    large shape at a high zoom costs its vertices per coarse tile and not per tile.
    Zooms below the first cut take the whole feature. Nothing is done if no feature
    is that large.
    """
    highest = max(zooms)
    box = g.geom_bbox(F.col(geom))
    cover = tiles.coverage_size(box["minx"], box["miny"], box["maxx"], box["maxy"], F.lit(highest))
    none = F.lit(None).cast("struct<z:int,x:int,y:int>")
    most = features.agg(F.max(cover)).first()[0]
    if most is None or most <= MAX_COVER:
        return features.withColumn("_within", none)
    ship(features.sparkSession)
    small = features.where(~F.coalesce(cover > MAX_COVER, F.lit(False))).withColumn("_within", none).withColumn("_zooms", F.lit(None).cast("array<int>"))
    parts = features.where(cover > MAX_COVER).withColumn("_within", none)
    out, before = small, -1
    for level in [*range(CUT_STEP, highest, CUT_STEP), highest + 1]:
        here = [z for z in set(zooms) if before <= z < level]
        before = level
        if here:
            out = out.unionByName(parts.withColumn("_zooms", F.array(*[F.lit(z) for z in sorted(here)]).cast("array<int>")))
        if level > highest:
            break
        b = g.geom_bbox(F.col(geom))
        x0, x1 = tiles.tile_x(b["minx"], F.lit(level)), tiles.tile_x(b["maxx"], F.lit(level))
        y0, y1 = tiles.tile_y(b["maxy"], F.lit(level)), tiles.tile_y(b["miny"], F.lit(level))
        side = F.when(F.col("_within").isNotNull(), F.pow(F.lit(2.0), level - F.col("_within.z")).cast("int"))
        w = lambda n: F.col(f"_within.{n}") * side
        x0, x1 = F.greatest(x0, w("x")), F.least(x1, w("x") + side - 1)
        y0, y1 = F.greatest(y0, w("y")), F.least(y1, w("y") + side - 1)
        cut = parts.withColumn("_x0", x0).withColumn("_x1", x1).withColumn("_y0", y0).withColumn("_y1", y1).where("_x0 <= _x1 and _y0 <= _y1")
        cut = cut.withColumn("_x", F.explode(F.sequence("_x0", "_x1"))).withColumn("_y", F.explode(F.sequence("_y0", "_y1")))
        cut = cut.repartition("_x", "_y").withColumn("_b", tiles.tile_bbox("_x", "_y", F.lit(level)))
        # edges are straight in Mercator coordinates, so they are cut there
        tile = g.bbox(F.col("_b.minx"), tiles.mercator_y(F.col("_b.miny")), F.col("_b.maxx"), tiles.mercator_y(F.col("_b.maxy")))
        flat = F.struct(F.col(geom)["typ"].alias("typ"), g.project(F.col(geom)["rings"], lambda p: point(p["x"], tiles.mercator_y(p["y"]))).alias("rings"))
        cut = cut.withColumn(geom, F.explode(shapes.clip(flat, tile)))
        cut = cut.withColumn(geom, F.struct(F.col(geom)["typ"].alias("typ"), g.project(F.col(geom)["rings"], lambda p: point(p["x"], tiles.latitude(p["y"]))).alias("rings")))
        within = F.struct(F.lit(level).alias("z"), F.col("_x").alias("x"), F.col("_y").alias("y"))
        parts = cut.withColumn("_within", within).select(*features.columns, "_within")
    return out


def tile_parts(rows: DataFrame, geom: str = "geom") -> DataFrame:
    """The rows with their geometry projected to the tile's grid and clipped to it; parts outside vanish, several parts are several rows."""
    ship(rows.sparkSession)
    box = rows.withColumn("_b", tiles.tile_bbox("x", "y", "z"))
    b = F.col("_b")
    projected = g.project(F.col(geom)["rings"], lambda p: tiles.tile_point(p["x"], p["y"], b["minx"], b["miny"], b["maxx"], b["maxy"]))
    out = box.withColumn(geom, F.struct(F.col(geom)["typ"].alias("typ"), projected.alias("rings")))
    grid = g.bbox(0.0, 0.0, float(tiles.EXTENT), float(tiles.EXTENT))
    # points need no clipping, just a test; they go to the clipper as null
    is_point, p = F.col(geom)["typ"] == 1, F.get(F.get(F.col(geom)["rings"], F.lit(0)), F.lit(0))
    none = F.array().cast(f"array<{GEOM_DDL}>")
    inside = F.when(g.in_bbox(p["x"], p["y"], grid), F.array(F.col(geom).cast(GEOM_DDL))).otherwise(none)
    parts = F.when(is_point, inside).otherwise(shapes.clip(F.when(~is_point, F.col(geom).cast(GEOM_DDL)), grid))
    return out.withColumn(geom, F.explode(parts)).drop("_b")


def merged_parts(parts: DataFrame, geom: str = "geom", props: str = "props") -> DataFrame:
    """Lines of one tile, layer and exactly equal properties joined end to start; other geometries as they are. ``z, x, y, layer, props, geom``."""
    keep = ["z", "x", "y", "layer"]
    lines = parts.where(F.col(geom)["typ"] == 2).withColumn("_k", props_key(F.col(props)))
    merged = lines.groupBy(*keep, "_k").agg(F.first(props).alias(props), F.array_sort(F.collect_list(F.get(F.col(geom)["rings"], F.lit(0)))).alias("lines"))
    merged = merged.withColumn("line", F.explode(shapes.merged_lines(F.col("lines"))))
    merged = merged.select(*keep, props, F.struct(F.lit(2).alias("typ"), F.array("line").alias("rings")).alias(geom))
    rest = parts.where(F.col(geom)["typ"] != 2).select(*keep, props, geom)
    return rest.unionByName(merged)


def _encode(frame: pd.DataFrame) -> pd.DataFrame:
    from tilewright.kernels.mvt import encode_tile

    layers: dict[str, list] = {}
    for layer, typ, commands, props in zip(frame["layer"], frame["typ"], frame["commands"], frame["props"], strict=True):
        plain = {k: _plain(v) for k, v in (props.items() if isinstance(props, dict) else props)}
        layers.setdefault(layer, []).append((int(typ), [int(c) for c in commands], plain))
    for features in layers.values():
        features.sort(key=lambda f: (f[0], f[1], sorted((k, str(v)) for k, v in f[2].items())))
    first = frame.iloc[0]
    return pd.DataFrame({"z": [first["z"]], "x": [first["x"]], "y": [first["y"]], "data": [encode_tile(layers)]})


def _plain(p):
    if p is None:
        return None
    slot = {"string": "s", "int": "i", "double": "d", "bool": "b"}.get(p["t"])
    value = p[slot] if slot else None
    if value is None or (isinstance(value, float) and value != value and slot != "d"):
        return None
    return {"i": int, "d": float, "b": bool}.get(slot, str)(value)


def vector_tiles(features: DataFrame, zooms: list[int], default_layer: str | None = "default", merge: bool = True) -> DataFrame:
    """``z, x, y, data``: a binary vector tile for every tile with something in it.

    Projection is done in the JVM, clipping and commands in Arrow batches before the
    only shuffle of whole features (lines first meet their tile and properties to be
    merged); a tile's task gets finished commands and only writes dictionaries. Rows
    of a tile are sorted, so equal input gives equal bytes.
    """
    parts = tile_parts(tile_rows(cut_large(features.select("geom", "props"), zooms), zooms, default_layer))
    if merge:
        parts = merged_parts(parts)
    coded = parts.select("z", "x", "y", "layer", "props", F.col("geom")["typ"].alias("typ"), shapes.tile_commands(F.col("geom")).alias("commands"))
    return coded.groupBy("z", "x", "y").applyInPandas(_encode, "z int, x int, y int, data binary")


def geojson_tiles(features: DataFrame, zooms: list[int], default_layer: str | None = "default") -> DataFrame:
    """``z, x, y, data``: per tile a feature collection of the whole features, neither clipped nor projected, @ keys kept."""
    rows = tile_rows(features.select("geom", "props"), zooms, default_layer)
    text = rows.select("z", "x", "y", feature_json(F.col("geom"), F.col("props")).alias("f")).groupBy("z", "x", "y").agg(F.array_sort(F.collect_list("f")).alias("f"))
    return text.select("z", "x", "y", F.encode(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("f", ","), F.lit("]}")), "UTF-8").alias("data"))


def write_tiles(tile_data: DataFrame, base: str, extension: str, compress: bool = False) -> None:
    """One file ``base/z/x/y.extension`` per tile, on any file system that pyarrow knows (also object stores).

    Every file is written under another name and then moved, so a task that runs
    twice or dies leaves no half tile.
    """
    ship(tile_data.sparkSession)

    def save(rows: Iterator) -> None:
        where, root = file_system(base)
        for r in rows:
            folder = posixpath.join(root, str(r["z"]), str(r["x"]))
            where.create_dir(folder, recursive=True)
            data = gzip.compress(bytes(r["data"]), mtime=0) if compress else bytes(r["data"])
            temporary = posixpath.join(folder, f".{r['y']}.{uuid.uuid4().hex}")
            with where.open_output_stream(temporary) as f:
                f.write(data)
            where.move(temporary, posixpath.join(folder, f"{r['y']}.{extension}"))

    tile_data.select("z", "x", "y", "data").foreachPartition(save)
