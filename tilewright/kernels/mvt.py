"""Vector tiles (version 2): commands, dictionaries and layers; and a reader to check them."""

from __future__ import annotations

import struct

from tilewright.kernels.wire import chunk, fields, number, packed, unzigzag, varint, varints, zigzag

EXTENT, VERSION = 4096, 2
MOVE_TO, LINE_TO, CLOSE_PATH = 1, 2, 7
#: Value message fields by property type.
STRING, DOUBLE, SINT, BOOL = 1, 3, 6, 7


def command(code: int, count: int) -> int:
    return code & 7 | count << 3


def split_command(n: int) -> tuple[int, int]:
    return n & 7, n >> 3


def steps(line, cursor: list[int]) -> list[int]:
    """Zig-zag differences of the vertices, cut to integers; moves the cursor."""
    out = []
    for p in line:
        for i in (0, 1):
            v = int(p[i])
            out.append(zigzag(v - cursor[i]))
            cursor[i] = v
    return out


def geometry_commands(typ: int, rings) -> list[int]:
    """Command integers of one point, line or polygon in tile coordinates; the cursor goes on from ring to ring."""
    cursor, out = [0, 0], []
    for ring in rings:
        if not len(ring):
            continue
        out += [command(MOVE_TO, 1), *steps(ring[:1], cursor)]
        if typ > 1 and len(ring) > 1:
            out += [command(LINE_TO, len(ring) - 1), *steps(ring[1:], cursor)]
        if typ == 3:
            out.append(command(CLOSE_PATH, 1))
    return out


def encode_value(value) -> bytes:
    if isinstance(value, bool):
        return number(BOOL, int(value))
    if isinstance(value, int):
        return number(SINT, zigzag(value))
    if isinstance(value, float):
        return varint(DOUBLE << 3 | 1) + struct.pack("<d", value)
    return chunk(STRING, str(value).encode())


def encode_layer(name: str, features: list[tuple[int, list[int], dict]]) -> bytes:
    """A layer of (type, commands, properties); keys starting with @ stay out, dictionaries go by first use of sorted keys."""
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    body = chunk(1, name.encode())
    for typ, commands, props in features:
        tags = []
        for k in sorted(props):
            if k and not k.startswith("@") and props[k] is not None:
                tags += [keys.setdefault(k, len(keys)), values.setdefault(encode_value(props[k]), len(values))]
        body += chunk(2, (packed(2, tags) if tags else b"") + number(3, typ) + packed(4, commands))
    body += b"".join(chunk(3, k.encode()) for k in keys) + b"".join(chunk(4, v) for v in values)
    return body + number(5, EXTENT) + number(15, VERSION)


def encode_tile(layers: dict[str, list[tuple[int, list[int], dict]]]) -> bytes:
    """Layers by name; those without features are left out."""
    return b"".join(chunk(3, encode_layer(name, layers[name])) for name in sorted(layers) if layers[name])


def _decode_value(data: bytes):
    for field, _, v in fields(data):
        if field == STRING:
            return v.decode()
        if field == 2:
            return struct.unpack("<f", v)[0]
        if field == DOUBLE:
            return struct.unpack("<d", v)[0]
        if field == SINT:
            return unzigzag(v)
        if field == BOOL:
            return bool(v)
        return v
    return None


def decode_geometry(commands: list[int]) -> list[list[tuple[int, int]]]:
    """Rings, lines or points of command integers."""
    out, cursor, at = [], [0, 0], 0
    while at < len(commands):
        code, count = split_command(commands[at])
        at += 1
        if code == CLOSE_PATH:
            continue
        for _ in range(count):
            cursor = [cursor[i] + unzigzag(commands[at + i]) for i in (0, 1)]
            at += 2
            if code == MOVE_TO:
                out.append([])
            out[-1].append(tuple(cursor))
    return out


def decode_tile(data: bytes) -> dict[str, list[tuple[int, list, dict]]]:
    """Layer name to (type, rings, properties)."""
    out = {}
    for field, _, layer in fields(data):
        if field != 3:
            continue
        name, raw, keys, values = "", [], [], []
        for f, _, v in fields(layer):
            if f == 1:
                name = v.decode()
            elif f == 2:
                raw.append(v)
            elif f == 3:
                keys.append(v.decode())
            elif f == 4:
                values.append(_decode_value(v))
        out[name] = []
        for feature in raw:
            got = {f: v for f, _, v in fields(feature)}
            tags = varints(got.get(2, b""))
            props = {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)}
            out[name].append((got.get(3, 0), decode_geometry(varints(got.get(4, b""))), props))
    return out
