"""Well-known binary (little-endian, 2-D points, lines and polygons) and its tiny variant."""

from __future__ import annotations

import struct

from tilewright.kernels.wire import read_varint, unzigzag, varint, zigzag


def wkb_encode(typ: int, rings: list[list[tuple[float, float]]]) -> bytes:
    """Polygon rings are closed on the way out. A geometry without a vertex is an error."""
    if not rings or any(not r for r in rings):
        raise ValueError("empty geometry")
    head = struct.pack("<BI", 1, typ)
    flat = lambda r: struct.pack(f"<{2 * len(r)}d", *(v for p in r for v in p))
    if typ == 1:
        return head + flat(rings[0][:1])
    if typ == 2:
        return head + struct.pack("<I", len(rings[0])) + flat(rings[0])
    if typ == 3:
        return head + struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(r) + 1) + flat([*r, r[0]]) for r in rings)
    raise ValueError(f"unknown geometry type {typ}")


def wkb_decode(data: bytes) -> tuple[int, list[list[tuple[float, float]]]]:
    """Polygon rings lose their last vertex. Big-endian, other types, no points or rings and short data are errors."""
    if len(data) < 5 or data[0] != 1:
        raise ValueError("not little-endian binary")
    (typ,) = struct.unpack_from("<I", data, 1)
    at = 5

    def count() -> int:
        nonlocal at
        if at + 4 > len(data):
            raise ValueError("data ends early")
        (n,) = struct.unpack_from("<I", data, at)
        at += 4
        if not n:
            raise ValueError("no points or rings")
        return n

    def points(n: int) -> list[tuple[float, float]]:
        nonlocal at
        if at + 16 * n > len(data):
            raise ValueError("data ends early")
        v = struct.unpack_from(f"<{2 * n}d", data, at)
        at += 16 * n
        return list(zip(v[::2], v[1::2], strict=True))

    if typ == 1:
        return typ, [points(1)]
    if typ == 2:
        return typ, [points(count())]
    if typ == 3:
        return typ, [points(count())[:-1] for _ in range(count())]
    raise ValueError(f"unknown geometry type {typ}")


def twkb_encode(typ: int, line: list[tuple[float, float]], precision: int = 0) -> bytes:
    """A point or a line as zig-zag differences of coordinates times 10^precision."""
    if typ not in (1, 2) or not line:
        raise ValueError("only points and lines")
    out = bytes([zigzag(precision) << 4 | typ, 0])
    if typ == 2:
        out += varint(len(line))
    last = (0, 0)
    for p in line:
        now = tuple(round(v * 10**precision) for v in p)
        out += b"".join(varint(zigzag(a - b)) for a, b in zip(now, last, strict=True))
        last = now
    return out


def twkb_decode(data: bytes) -> tuple[int, list[tuple[float, float]]]:
    """Inverse of :func:`twkb_encode`; the second byte's flags must be unset."""
    if len(data) < 2:
        raise ValueError("data ends early")
    typ, precision = data[0] & 15, unzigzag(data[0] >> 4)
    if data[1]:
        raise ValueError("boxes, sizes, ids and further dimensions are not supported")
    if typ not in (1, 2):
        raise ValueError(f"unknown geometry type {typ}")
    at, n = 2, 1
    if typ == 2:
        n, at = read_varint(data, at)
    out, last = [], [0, 0]
    for _ in range(n):
        for i in (0, 1):
            v, at = read_varint(data, at)
            last[i] += unzigzag(v)
        out.append((last[0] / 10**precision, last[1] / 10**precision))
    return typ, out
