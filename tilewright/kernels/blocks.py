"""The block-structured binary feature format: header, blocks, features, tags."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from tilewright.kernels.wire import chunk, fields, number
from tilewright.kernels.wkb import wkb_decode, wkb_encode

# Cookie and version of a file, kinds of tag value.
COOKIE, FILE_VERSION = b"SPAT", 0
TAG_STRING, TAG_INT, TAG_DOUBLE = 0, 1, 2
FEATURES_PER_BLOCK = 1000
HEAD = struct.Struct("<IHBB")


def header() -> bytes:
    return COOKIE + struct.pack("<I", FILE_VERSION)


def check_header(data: bytes) -> int:
    """The version; an error for another cookie, short data or a version above 0."""
    if len(data) < 8 or data[:4] != COOKIE:
        raise ValueError("not a feature block file")
    (version,) = struct.unpack_from("<I", data, 4)
    if version > FILE_VERSION:
        raise ValueError(f"unknown version {version}")
    return version


def read_head(data: bytes) -> int:
    """Length of a block's body; an error for compression, another kind of message or short data."""
    if len(data) < HEAD.size:
        raise ValueError("block header ends early")
    size, _, compression, kind = HEAD.unpack(data[: HEAD.size])
    if compression or kind:
        raise ValueError("compressed or unknown block")
    return size


def tag(key: str, prop: tuple) -> bytes:
    """A tag of a typed property (t, s, i, d, b); null becomes an empty text, a bool is an error."""
    t, s, i, d, _ = prop
    if t == "string":
        kind, value = TAG_STRING, (s or "").encode()
    elif t == "int":
        kind, value = TAG_INT, struct.pack("<q", i)
    elif t == "double":
        kind, value = TAG_DOUBLE, struct.pack("<d", d)
    elif t == "null":
        kind, value = TAG_STRING, b""
    else:
        raise ValueError(f"properties of type {t} cannot be stored")
    return chunk(1, key.encode()) + chunk(2, value) + (number(3, kind) if kind else b"")


def read_tag(data: bytes) -> tuple[str, tuple]:
    got = {f: v for f, _, v in fields(data)}
    value, kind = got.get(2, b""), got.get(3, 0)
    key = got.get(1, b"").decode()
    if kind == TAG_STRING:
        return key, ("string", value.decode(), None, None, None)
    if kind == TAG_INT:
        return key, ("int", None, struct.unpack("<q", value)[0], None, None)
    if kind == TAG_DOUBLE:
        return key, ("double", None, None, struct.unpack("<d", value)[0], None)
    raise ValueError(f"unknown kind of value {kind}")


def block(features: list[tuple], srid: str | None = None) -> bytes:
    """A block of (typ, rings, props) features; the srid goes to the block's meta tags."""
    meta = chunk(1, chunk(1, tag("@srid", ("string", srid, None, None, None)))) if srid else b""
    body = meta + b"".join(
        chunk(2, chunk(3, wkb_encode(typ, rings)) + b"".join(chunk(8, tag(k, v)) for k, v in sorted(props.items()))) for typ, rings, props in features
    )
    return HEAD.pack(len(body), 0, 0, 0) + body


def read_body(body: bytes) -> Iterator[tuple[int, list, dict, str | None]]:
    """(typ, rings, props, srid) of every feature of a block."""
    srid = None
    for field, _, value in fields(body):
        if field == 1:
            for f, _, v in fields(value):
                if f == 1:
                    key, p = read_tag(v)
                    srid = p[1] if key == "@srid" else srid
        elif field == 2:
            geometry, props = b"", {}
            for f, _, v in fields(value):
                if f == 3:
                    geometry = v
                elif f == 8:
                    key, p = read_tag(v)
                    props[key] = p
            typ, rings = wkb_decode(geometry)
            yield typ, rings, props, srid


def read_file(data: bytes) -> Iterator[tuple[int, list, dict, str | None]]:
    check_header(data)
    at = 8
    while at < len(data):
        size = read_head(data[at : at + HEAD.size])
        at += HEAD.size
        if at + size > len(data):
            raise ValueError("block ends early")
        yield from read_body(data[at : at + size])
        at += size
