"""Protocol-buffer wire format: just what the binary formats here need."""

from __future__ import annotations

from collections.abc import Iterator


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> int:
    return (n << 1) ^ (n >> 63)


def unzigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("broken varint")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def number(field: int, n: int) -> bytes:
    return varint(field << 3) + varint(n)


def chunk(field: int, data: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(data)) + data


def packed(field: int, values) -> bytes:
    return chunk(field, b"".join(map(varint, values)))


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a message: an int, or bytes for the fixed and length-delimited types."""
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = read_varint(data, at)
        else:
            if kind == 2:
                size, at = read_varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"unknown wire type {kind}")
            if at + size > len(data):
                raise ValueError("message ends early")
            value, at = data[at : at + size], at + size
        yield key >> 3, kind, value


def varints(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = read_varint(data, at)
        out.append(v)
    return out
