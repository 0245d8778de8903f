import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.kernels import blocks, geometry, mvt, osm, repair, wire, wkb

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]


def area(parts):
    return sum(geometry.signed_area2(r) for p in parts for r in p)


def test_simplify():
    line = [(0, 0), (2.5, 0.5), (5, 0)]
    assert geometry.simplify(line, 1) == [(0, 0), (5, 0)]
    assert geometry.simplify(line, 0.2) == line
    assert geometry.simplify(line[:2], 9) == line[:2]


def test_line_clip():
    clip = geometry.clip_line
    assert clip([(1, 1), (3, 3), (5, 1)], (1, 1, 5, 2)) == [[(1, 1), (2, 2)], [(4, 2), (5, 1)]]
    assert clip([(1, 1), (1, 2), (1, 5)], (0, 0, 3, 3)) == [[(1, 1), (1, 2), (1, 3)]]
    assert clip([*SQUARE, SQUARE[0]], (0, 0, 0.5, 1)) == [[(0, 0), (0.5, 0)], [(0.5, 1), (0, 1), (0, 0)]]
    assert clip([(5, 5), (6, 6)], (0, 0, 1, 1)) == [] == clip([], (0, 0, 1, 1))


def test_polygon_clip():
    (part,) = geometry.clip_polygon([[(0, 0), (3, 0), (0, 3)]], (1, 1, 2, 2))
    assert set(part[0]) == {(1, 1), (1, 2), (2, 1)}
    assert geometry.clip_polygon([SQUARE], (2, 2, 3, 3)) == []
    assert area(geometry.clip_polygon([SQUARE], (-1, -1, 2, 2))) == 2
    assert area(geometry.clip_polygon([[(-9, -9), (9, -9), (9, 9), (-9, 9)]], (0, 0, 1, 1))) == 2
    u_shape = [(0, 0), (5, 0), (5, 5), (4, 5), (4, 1), (1, 1), (1, 5), (0, 5)]
    parts = geometry.clip_polygon([u_shape], (-1, 2, 6, 4))
    assert len(parts) == 2 and area(parts) == 2 * 2 * 2
    hole = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)]
    big = [(0, 0), (6, 0), (6, 6), (0, 6)]
    assert area(geometry.clip_polygon([big, hole], (1, 1, 3, 3))) == 2 * (4 - 1)
    assert geometry.clip_polygon([big, hole], (2.5, 2.5, 3.5, 3.5)) == []


def test_holes_at_the_border():
    clip = geometry.clip_polygon
    outer, hole = [(-10, -10), (10, -10), (10, 10), (-10, 10)], [(-5, -5), (5, -5), (5, 5), (-5, 5)]
    (part,) = clip([outer, hole], (-5, -5, 10, 5))
    assert len(part) == 1 and set(part[0]) == {(5, -5), (10, -5), (10, 5), (5, 5)}
    assert clip([outer, hole], (-5, -5, 5, 5)) == []
    (part,) = clip([outer, hole], (-5, -9, 9, 9))
    assert len(part) == 1 and area([part]) == 2 * (14 * 18 - 100)
    # a hole that touches two sides cuts what is left in two
    diamond = [(0, -5), (5, 0), (0, 5), (-5, 0)]
    parts = clip([outer, diamond], (-5, -9, 5, 9))
    assert len(parts) == 2 and all(len(p) == 1 for p in parts) and area(parts) == 2 * (10 * 18 - 50)
    # one that touches in one point stays a hole
    (part,) = clip([outer, diamond], (-5, -9, 9, 9))
    assert len(part) == 2 and area([part]) == 2 * (14 * 18 - 50)


def test_rings_that_cross_are_kept():
    a, b = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (-1.0, 6.0), (-1.0, -1.0)]
    for rings in ([a, b], [b, a], [[(3.0, 3.0), (9.0, 3.0), (9.0, 9.0), (3.0, 9.0)], [(4.0, 4.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0)]]):
        assert sorted(p for part in geometry.shells(rings) for q in part for p in q) == sorted(rings[0] + rings[1])


def test_vertices_at_the_border_against_points():
    """Rings with vertices of a small grid, so that many lie on the border: every point is inside as before."""
    r = random.Random(8)
    for _ in range(3000):
        ring = [(r.randrange(7), r.randrange(7)) for _ in range(r.randrange(3, 6))]
        ring = [(float(x), float(y)) for x, y in ring]
        if not geometry.valid_topology([ring]) or len(set(ring)) < len(ring) or geometry.signed_area2(ring) == 0:
            continue
        box = (1.0, 2.0, 5.0, 6.0)
        parts = geometry.clip_polygon([[(-9.0, -9.0), (20.0, -9.0), (20.0, 20.0), (-9.0, 20.0)], ring], box), geometry.clip_polygon([ring], box)
        for x, y in [(1 + 4 * (i + 0.37) / 8, 2 + 4 * (j + 0.41) / 8) for i in range(8) for j in range(8)]:
            inside = geometry.in_ring((x, y), ring)
            assert sum(geometry.in_ring((x, y), q) for p in parts[1] for q in p) % 2 == inside, (ring, x, y)
            assert sum(geometry.in_ring((x, y), q) for p in parts[0] for q in p) % 2 == (not inside), (ring, x, y)


def star(n, seed):
    r = random.Random(seed)
    return [(math.cos(2 * math.pi * i / n) * (s := r.uniform(0.2, 2)), math.sin(2 * math.pi * i / n) * s) for i in range(n)]


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 25), st.integers(0, 10**6), st.floats(0.2, 1.5), st.floats(-1, 1), st.booleans())
def test_clipping_keeps_the_area(n, seed, h, shift, with_hole):
    rings = [star(n, seed)]
    if with_hole:
        rings.append([(x * 0.05, y * 0.05) for x, y in star(n, seed + 1)][::-1])
    total = 0.0
    k = int(4 / h) + 2
    for i in range(-k, k):
        for j in range(-k, k):
            x, y = shift + i * h, shift + j * h
            for part in geometry.clip_polygon(rings, (x, y, x + h, y + h)):
                for ring in part:
                    assert all(x <= px <= x + h and y <= py <= y + h for px, py in ring)
                total += area([part])
    assert total == pytest.approx(sum(geometry.signed_area2(r) for p in geometry.shells(rings) for r in p), abs=1e-8)


def test_winding_topology_merge():
    assert geometry.fix_winding([SQUARE[::-1]]) == [SQUARE]
    hole = [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8)]
    assert geometry.fix_winding([SQUARE, hole]) == [SQUARE, hole[::-1]]
    assert geometry.valid_topology([[(3, 4), (2, 9), (1, 4)]])
    assert not geometry.valid_topology([[(0, 0), (1, 1), (1, 0), (0, 1)]])
    assert geometry.merge_lines([[(1, 2), (5, 6)], [(5, 6), (7, 8)], [(0, 0), (1, 2)]]) == [[(0, 0), (1, 2), (5, 6), (7, 8)]]
    assert geometry.merge_lines([[(0, 0), (1, 1)], [(1, 1), (0, 0)]]) == [[(0, 0), (1, 1), (0, 0)]]
    assert geometry.merge_lines([]) == []


def test_well_known_binary():
    for typ, rings in ((1, [[(1.5, -2.0)]]), (2, [[(0.0, 0.0), (3.0, 4.0)]]), (3, [SQUARE, SQUARE[::-1]])):
        assert wkb.wkb_decode(wkb.wkb_encode(typ, rings)) == (typ, rings)
    for bad in ("010300000030303000000000003030303030303030", "0101000000", "00", ""):
        with pytest.raises(ValueError):
            wkb.wkb_decode(bytes.fromhex(bad))
    with pytest.raises(ValueError):
        wkb.wkb_encode(3, [[]])
    assert wkb.twkb_decode(bytes.fromhex("01000204")) == (1, [(1.0, 2.0)])
    assert wkb.twkb_decode(bytes.fromhex("02000202020808")) == (2, [(1.0, 1.0), (5.0, 5.0)])
    assert wkb.twkb_encode(2, [(1, 1), (5, 5)]).hex() == "02000202020808"
    line = [(1.25, -3.5), (0.1, 7.77), (-180.0, 89.99)]
    assert wkb.twkb_decode(wkb.twkb_encode(2, line, 2)) == (2, [(1.25, -3.5), (0.1, 7.77), (-180.0, 89.99)])


def test_vector_tile():
    assert mvt.geometry_commands(1, [[(1, 1)]]) == [9, 2, 2]
    assert mvt.geometry_commands(1, [[(25, 17)]]) == [9, 50, 34]
    ring = [(0.9, 0), (10.2, 0), (10, 10)]
    commands = mvt.geometry_commands(3, [ring])
    assert mvt.decode_geometry(commands) == [[(0, 0), (10, 0), (10, 10)]]
    tile = mvt.encode_tile({"b": [(1, [9, 50, 34], {"n": 3, "s": "é", "d": 0.5, "ok": True, "@x": 1, "none": None})], "a": [(3, commands, {})], "c": []})
    got = mvt.decode_tile(tile)
    assert list(got) == ["a", "b"]
    assert got["b"] == [(1, [[(25, 17)]], {"n": 3, "s": "é", "d": 0.5, "ok": True})]
    assert mvt.encode_tile({}) == b""


def test_feature_blocks():
    assert blocks.header().hex() == "5350415400000000"
    for bad in (b"", b"SPAT", b"XXXX\0\0\0\0", b"SPAT\1\0\0\0"):
        with pytest.raises(ValueError):
            blocks.check_header(bad)
    props = {"a": ("string", "é", None, None, None), "i": ("int", None, -5, None, None), "d": ("double", None, None, 0.5, None)}
    data = blocks.header() + blocks.block([(1, [[(1.0, 2.0)]], props)], "4326") + blocks.block([], None)
    assert list(blocks.read_file(data)) == [(1, [[(1.0, 2.0)]], props, "4326")]
    assert list(blocks.read_file(blocks.header())) == []
    with pytest.raises(ValueError):
        list(blocks.read_file(data[:-20]))
    with pytest.raises(ValueError):
        blocks.tag("b", ("bool", None, None, None, True))


@given(st.integers(-(2**62), 2**62))
def test_numbers_on_the_wire(n):
    data = wire.varint(wire.zigzag(n))
    value, at = wire.read_varint(data, 0)
    assert wire.unzigzag(value) == n and at == len(data)


def dense_block():
    """A primitive block with two dense nodes, a way and a relation."""
    strings = ["", "highway", "primary", "outer"]
    table = wire.chunk(1, b"".join(wire.chunk(1, s.encode()) for s in strings))
    z = wire.zigzag
    dense = wire.packed(1, [z(10), z(1)]) + wire.packed(8, [z(500000000), z(10)]) + wire.packed(9, [z(-100000000), z(20)]) + wire.packed(10, [1, 2, 0, 0])
    way = wire.number(1, 7) + wire.packed(2, [1]) + wire.packed(3, [2]) + wire.packed(8, [z(10), z(1)])
    relation = wire.number(1, 9) + wire.packed(8, [3]) + wire.packed(9, [z(7)]) + wire.packed(10, [1])
    return table + wire.chunk(2, wire.chunk(2, dense)) + wire.chunk(2, wire.chunk(3, way)) + wire.chunk(2, wire.chunk(4, relation))


def test_extract_elements():
    nodes = list(osm.elements(dense_block(), "node"))
    assert [n[0] for n in nodes] == [10, 11] and nodes[0][1] == pytest.approx(50) and nodes[1][2] == pytest.approx(-9.999998)
    assert nodes[0][3] == {"highway": "primary"} and nodes[1][3] == {}
    assert list(osm.elements(dense_block(), "way")) == [(7, [10, 11], {"highway": "primary"})]
    assert list(osm.elements(dense_block(), "relation")) == [(9, [(7, "way", "outer")], {})]


CHECKS, NAMES = {4: 90.0, 5: 180.0}, {4: "latitude", 5: "longitude"}


def line(**change):
    f = [str(i) for i in range(19)]
    for k, v in change.items():
        f[int(k[1:])] = v
    return "\t".join(f)


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (line(), None),
        ("", "column_count"),
        (line() + "\tx", "column_count"),
        ("\t".join("abc"), "column_count"),
        (line(f3='"a\tb ""c"""'), None),
        (line(f3='a"b'), "quoting"),
        (line(f3='"a'), "quoting"),
        (line(f3='"a"b'), "quoting"),
        (line(f3='""'), None),
        (line(f4="x"), "latitude"),
        (line(f4="91"), "latitude"),
        (line(f4="-9e1", f5="1.8e+2"), None),
        (line(f4="1.", f5="y"), "latitude"),
        (line(f5="180.01"), "longitude"),
        (line(f5=" 1"), "longitude"),
        (line(f5="１"), "longitude"),
        (line(f4='"45.5"'), None),
        (line(f3='"a', f4="x") + "\t1", "quoting"),
        ("x" * 200_000, "column_count"),
        ('"' * 30_001, "quoting"),
    ],
)
def test_line_repair(text, reason):
    fields, said, edits = repair.parse(text, 19, CHECKS, NAMES)
    assert said == reason
    assert (fields is None) == (reason is not None) == bool(edits)


def plain_reason(text):
    """The same by a scan: state of the quoting, then counts, then types."""
    fields, i, n = [], 0, len(text)
    while True:
        if i < n and text[i] == '"':
            i, out = i + 1, ""
            while True:
                if i >= n:
                    return "quoting"
                if text[i] == '"':
                    if i + 1 < n and text[i + 1] == '"':
                        out, i = out + '"', i + 2
                        continue
                    i += 1
                    break
                out, i = out + text[i], i + 1
            if i < n and text[i] != "\t":
                return "quoting"
        else:
            j = text.find("\t", i)
            j = n if j < 0 else j
            out, i = text[i:j], j
            if '"' in out:
                return "quoting"
        fields.append(out)
        if i >= n:
            break
        i += 1
    if len(fields) != 3:
        return "column_count"
    return None if repair.in_range(fields[1], 90) else "latitude"


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='"\t1a', max_size=12))
def test_repair_against_a_scan(text):
    assert repair.parse(text, 3, {1: 90.0}, {1: "latitude"})[1] == plain_reason(text)


def split_plainly(text):
    """Fields of a line, None if its quoting is not valid."""
    fields, i, n = [], 0, len(text)
    while True:
        out = ""
        if i < n and text[i] == '"':
            i += 1
            while True:
                if i >= n:
                    return None
                if text[i] != '"':
                    out, i = out + text[i], i + 1
                elif text[i : i + 2] == '""':
                    out, i = out + '"', i + 2
                else:
                    i += 1
                    break
            if i < n and text[i] != "\t":
                return None
        else:
            while i < n and text[i] != "\t":
                if text[i] == '"':
                    return None
                out, i = out + text[i], i + 1
        fields.append(out)
        if i >= n:
            return fields
        i += 1


def brute_repair(text, width, checks):
    """Every set of quote edits, then every set of delimiter edits."""
    lines, q = {text}, 0
    while not any(split_plainly(x) for x in lines):
        lines = {y for x in lines for i in range(len(x) + 1) for y in [x[:i] + '"' + x[i:], *([x[:i] + x[i + 1 :]] if x[i : i + 1] == '"' else [])]}
        q += 1
    wrong = lambda c, v: int(c in checks and not repair.in_range(v, checks[c]))
    best = None
    for x in lines:
        fields = split_plainly(x)
        todo = [(0, 0, 0, 0)] if fields else []  # fields read, columns made, edits, wrong columns
        while todo:
            i, j, d, t = todo.pop()
            if best and (d, t) > best:
                continue
            if i == len(fields) and j == width:
                best = min(best or (d, t), (d, t))
            if j < width:
                todo.append((i, j + 1, d + 1, t + wrong(j, "")))
                for k in range(i + 1, len(fields) + 1):
                    todo.append((k, j + 1, d + k - i - 1, t + wrong(j, "".join(fields[i:k]))))
    return q, *best


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='"\t1a', max_size=7), st.integers(1, 3))
def test_repair_is_the_cheapest(text, width):
    for checks in ({}, {min(1, width - 1): 90.0}):
        q, d, t, edits = repair.repair(text, width, checks)
        assert (q, d, t) == brute_repair(text, width, checks)
        assert (sum("quote" in e for e, _ in edits), sum("delimiter" in e for e, _ in edits)) == (q, d)


@pytest.mark.parametrize(
    ("text", "width", "edits"),
    [('"a\tb\tc', 1, ["insert_quote @6"]), ('"a\tb\tc', 2, ["insert_quote @4"]), ('"a\tb"x\tc', 2, ["delete_quote @4", "insert_quote @6"]), ('x\ta\tb"\tc', 4, ["delete_quote @5"]), ('x\ta\tb"\tc', 3, ["insert_quote @2"])],
)
def test_quote_edits_mind_the_columns(text, width, edits):
    q, d, t, _ = repair.repair(text, width, {})
    assert d == 0 and q <= len(edits)
    assert repair.parse(text, width, {}, {})[2].count("@") == q


def test_all_edits_are_shown():
    said = repair.parse("\t" * 60, 1, {}, {})[2]
    assert said.count("delete_delimiter") == 60
    assert repair.repair("a\t" * 20_000, 19, {})[1] == 19_982
