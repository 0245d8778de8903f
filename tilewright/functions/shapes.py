"""Arrow-batched functions for geometry that Column expressions cannot express, and the binary codecs.

Vertices travel as flat coordinate arrays with offsets. A null geometry gives a
null result; vertices with a null coordinate are passed over.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.kernels import geometry as k
from tilewright.kernels import mvt, wkb
from tilewright.types import GEOM_DDL, RINGS_DDL

Rings = list[list[tuple[float, float]]]


def unpack_rings(rings: pa.Array) -> list[Rings | None]:
    """Python rings of an array of lists of lines."""
    n = pc.list_value_length(rings).to_pylist()
    lines = rings.flatten()
    m = pc.fill_null(pc.list_value_length(lines), 0).to_pylist()
    xs, ys = (v.to_pylist() for v in lines.flatten().flatten())
    vertices = list(zip(xs, ys, strict=True))
    if pa.types.is_null(lines.type):
        return [None if c is None else [] for c in n]
    holes = None in xs or None in ys
    flat, at = [], 0
    for size in m:
        line = vertices[at : at + size]
        flat.append([v for v in line if None not in v] if holes else line)
        at += size
    out, at = [], 0
    for count in n:
        out.append(None if count is None else flat[at : at + count])
        at += count or 0
    return out


def unpack(geoms: pa.Array) -> list[tuple[int, Rings] | None]:
    typ, rings = geoms.flatten()
    return [None if t is None or r is None else (t, r) for t, r in zip(typ.to_pylist(), unpack_rings(rings), strict=True)]


def _offsets(sizes) -> pa.Array:
    return pa.array(list(accumulate(sizes, initial=0)), pa.int32())


def pack_rings(rows: list[Rings | None]) -> pa.Array:
    lines = [line for r in rows if r is not None for line in r]
    v = np.array([p for line in lines for p in line], np.float64).reshape(-1, 2)
    vertices = pa.StructArray.from_arrays([pa.array(v[:, 0]), pa.array(v[:, 1])], names=["x", "y"])
    inner = pa.ListArray.from_arrays(_offsets(map(len, lines)), vertices)
    mask = pa.array([r is None for r in rows]) if None in rows else None
    return pa.ListArray.from_arrays(_offsets(len(r or []) for r in rows), inner, mask=mask)


def pack(rows: list[tuple[int, Rings] | None]) -> pa.Array:
    mask = pa.array([r is None for r in rows]) if None in rows else None
    typ = pa.array([None if r is None else r[0] for r in rows], pa.int32())
    return pa.StructArray.from_arrays([typ, pack_rings([None if r is None else r[1] for r in rows])], names=["typ", "rings"], mask=mask)


def _reshape(f):
    """f: (typ, rings) to rings; the type stays."""
    return F.arrow_udf(lambda geoms: pack([None if r is None else (r[0], f(*r)) for r in unpack(geoms)]), GEOM_DDL)


def _measure(f, kind: str, arrow: pa.DataType):
    return F.arrow_udf(lambda geoms: pa.array([None if r is None else f(*r) for r in unpack(geoms)], arrow), kind)


def simplify(g: Column, tolerance: float) -> Column:
    """Lines only; points and polygons come back as they are."""
    return _reshape(lambda t, r: [k.simplify(line, tolerance) for line in r] if t == 2 else r)(g)


def udf_of(name: str):
    """The function of one column as a user-defined function that can be registered."""
    if name == "fix_winding":
        return _reshape(lambda t, r: k.fix_winding(r) if t == 3 else r)
    if name == "valid_topology":
        return _measure(lambda t, r: t != 3 or k.valid_topology(r), "boolean", pa.bool_())
    if name == "to_wkb":
        return _measure(wkb.wkb_encode, "binary", pa.binary())
    if name == "tile_commands":
        return _measure(mvt.geometry_commands, "array<bigint>", pa.list_(pa.int64()))
    if name == "from_wkb":
        return F.arrow_udf(lambda d: pack([None if x is None else wkb.wkb_decode(x) for x in d.to_pylist()]), GEOM_DDL)
    if name == "merged_lines":
        return F.arrow_udf(lambda rows: pack_rings([None if r is None else k.merge_lines([line for line in r if line]) for r in unpack_rings(rows)]), RINGS_DDL)
    raise ValueError(name)


def fix_winding(g: Column) -> Column:
    """Polygons with counter-clockwise outer rings and clockwise holes (y upwards)."""
    return udf_of("fix_winding")(g)


def valid_topology(g: Column) -> Column:
    """Whether no ring of a polygon crosses itself; other types always pass."""
    return udf_of("valid_topology")(g)


def clip(g: Column, box: Column) -> Column:
    """Array of geometries of the same type: what of the geometry lies in the closed box. A null geometry or box gives an empty array."""

    def run(geoms: pa.Array, boxes: pa.Array) -> pa.Array:
        rows = np.flatnonzero(~beside(geoms, boxes))
        out, sizes = [], np.zeros(len(geoms), np.int64)
        for i, r, b in zip(rows.tolist(), unpack(geoms.take(pa.array(rows))), boxes.take(pa.array(rows)).to_pylist(), strict=True):
            parts = [] if r is None or b is None else clip_rings(*r, (b["minx"], b["miny"], b["maxx"], b["maxy"]))
            out += [(r[0], p) for p in parts]
            sizes[i] = len(parts)
        return pa.ListArray.from_arrays(_offsets(sizes.tolist()), pack(out))

    return F.arrow_udf(run, f"array<{GEOM_DDL}>")(g, box)


def beside(geoms: pa.Array, boxes: pa.Array) -> np.ndarray:
    """Rows whose vertices all lie beyond one side of their box; a row with a coordinate that is no number is none."""
    _, rings = geoms.flatten()
    lines = rings.flatten()
    if pa.types.is_null(lines.type) or not len(lines):
        return np.zeros(len(geoms), bool)
    lengths = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    size = np.bincount(np.repeat(np.arange(len(geoms)), lengths(rings)), weights=lengths(lines), minlength=len(geoms)).astype(np.int64)
    some = np.flatnonzero(size)
    out = np.zeros(len(geoms), bool)
    if not len(some):
        return out
    first = (np.cumsum(size) - size)[some]
    low_x, low_y, high_x, high_y = (np.asarray(v.to_numpy(zero_copy_only=False), np.float64)[some] for v in boxes.flatten())
    for values, low, high in zip(lines.flatten().flatten(), (low_x, low_y), (high_x, high_y), strict=True):
        v = np.asarray(values.to_numpy(zero_copy_only=False), np.float64)
        out[some] |= (np.maximum.reduceat(v, first) < low) | (np.minimum.reduceat(v, first) > high)
    return out


def clip_rings(typ: int, rings: Rings, box) -> list[Rings]:
    """Parts, each as rings."""
    if typ == 1:
        return [rings] if rings and rings[0] and box[0] <= rings[0][0][0] <= box[2] and box[1] <= rings[0][0][1] <= box[3] else []
    if typ == 2:
        return [[line] for ring in rings for line in k.clip_line(ring, box)]
    return k.clip_polygon(rings, box) if typ == 3 else []


def to_wkb(g: Column) -> Column:
    return udf_of("to_wkb")(g)


def to_twkb(g: Column, precision: int = 0) -> Column:
    """Points and lines with so many decimals."""
    return _measure(lambda t, r: wkb.twkb_encode(t, r[0], precision), "binary", pa.binary())(g)


def from_wkb(data: Column) -> Column:
    return udf_of("from_wkb")(data)


def from_twkb(data: Column) -> Column:
    def one(d: bytes) -> tuple[int, Rings]:
        t, line = wkb.twkb_decode(d)
        return t, [line]

    return F.arrow_udf(lambda d: pack([None if x is None else one(x) for x in d.to_pylist()]), GEOM_DDL)(data)


def tile_commands(g: Column) -> Column:
    """Command integers of a geometry in tile coordinates."""
    return udf_of("tile_commands")(g)


def merged_lines(lines: Column) -> Column:
    """Array of lines with end-to-start neighbours joined."""
    return udf_of("merged_lines")(lines)
