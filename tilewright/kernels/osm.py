"""Blobs of OpenStreetMap binary extracts: nodes, ways and relations."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from tilewright.kernels.wire import fields, unzigzag, varints

#: Member types by number.
MEMBER_TYPES = ("node", "way", "relation")


def blob_data(blob: bytes) -> bytes:
    for field, _, v in fields(blob):
        if field == 1:
            return v
        if field == 3:
            return zlib.decompress(v)
    raise ValueError("blob with an unknown compression")


def blob_header(data: bytes) -> tuple[str, int]:
    """(type, size of the blob that follows)."""
    got = {f: v for f, _, v in fields(data)}
    return got[1].decode(), got[3]


def _deltas(data: bytes) -> list[int]:
    out, total = [], 0
    for v in varints(data):
        total += unzigzag(v)
        out.append(total)
    return out


def elements(block: bytes, kind: str) -> Iterator[tuple]:
    """Elements of one kind of a primitive block: node (id, lat, lon, tags), way (id, node_ids, tags), relation (id, members, tags)."""
    strings: list[str] = []
    groups, granularity, lat0, lon0 = [], 100, 0, 0
    for f, _, v in fields(block):
        if f == 1:
            strings = [s.decode("utf-8", "replace") for n, _, s in fields(v) if n == 1]
        elif f == 2:
            groups.append(v)
        elif f == 17:
            granularity = v
        elif f == 19:
            lat0 = v if v < 1 << 63 else v - (1 << 64)
        elif f == 20:
            lon0 = v if v < 1 << 63 else v - (1 << 64)
    degrees = lambda v, start: (start + granularity * v) * 1e-9

    def tags(got: dict) -> dict[str, str]:
        return {strings[a]: strings[b] for a, b in zip(varints(got.get(2, b"")), varints(got.get(3, b"")), strict=True)}

    for group in groups:
        for f, _, v in fields(group):
            if f == 1 and kind == "node":
                got = dict((n, x) for n, _, x in fields(v))
                yield unzigzag(got[1]), degrees(unzigzag(got[8]), lat0), degrees(unzigzag(got[9]), lon0), tags(got)
            elif f == 2 and kind == "node":
                got = dict((n, x) for n, _, x in fields(v))
                pairs, at = varints(got.get(10, b"")), 0
                for i, lat, lon in zip(_deltas(got[1]), _deltas(got[8]), _deltas(got[9]), strict=True):
                    own: dict[str, str] = {}
                    while at < len(pairs) and pairs[at]:
                        own[strings[pairs[at]]] = strings[pairs[at + 1]]
                        at += 2
                    at += 1
                    yield i, degrees(lat, lat0), degrees(lon, lon0), own
            elif f == 3 and kind == "way":
                got = dict((n, x) for n, _, x in fields(v))
                yield got[1], _deltas(got.get(8, b"")), tags(got)
            elif f == 4 and kind == "relation":
                got = dict((n, x) for n, _, x in fields(v))
                roles, kinds = varints(got.get(8, b"")), varints(got.get(10, b""))
                members = [(i, MEMBER_TYPES[t], strings[r]) for i, t, r in zip(_deltas(got.get(9, b"")), kinds, roles, strict=True)]
                yield got[1], members, tags(got)
