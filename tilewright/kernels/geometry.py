"""Geometry that needs loops: simplification, clipping, winding and merging.

A line is a list of (x, y) tuples; a polygon is a list of rings without their
closing vertex.
"""

from __future__ import annotations

import math

Point = tuple[float, float]
Line = list[Point]
Box = tuple[float, float, float, float]


def signed_area2(ring: Line) -> float:
    """Twice the area, positive for counter-clockwise rings with y upwards."""
    return sum(ring[i - 1][0] * ring[i][1] - ring[i][0] * ring[i - 1][1] for i in range(len(ring)))


def segment_distance(a: Point, b: Point, p: Point) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = 0.0 if n == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def simplify(line: Line, tolerance: float) -> Line:
    """Vertices further than ``tolerance`` from the chord of their stretch stay; of equal distances the first splits."""
    if len(line) < 3:
        return line
    keep = {0, len(line) - 1}
    todo = [(0, len(line) - 1)]
    while todo:
        lo, hi = todo.pop()
        far, at = 0.0, -1
        for i in range(lo + 1, hi):
            d = segment_distance(line[lo], line[hi], line[i])
            if d > far:
                far, at = d, i
        if at >= 0 and far > tolerance:
            keep.add(at)
            todo += [(lo, at), (at, hi)]
    return [line[i] for i in sorted(keep)]


def round8(v: float) -> float:
    """To 8 decimals, halves away from zero."""
    if abs(v) >= 4e7:
        return v
    return (math.ceil(v * 1e8 - 0.5) if v < 0 else math.floor(v * 1e8 + 0.5)) / 1e8


def crossing(s: tuple[Point, Point], t: tuple[Point, Point]) -> Point | None:
    """Common point of two segments, rounded to 8 decimals; None for parallels."""
    (ax, ay), (bx, by) = s
    (cx, cy), (dx, dy) = t
    det = (ay - by) * (dx - cx) - (bx - ax) * (cy - dy)
    if det == 0:
        return None
    m, n = bx * ay - ax * by, dx * cy - cx * dy
    x, y = round8((m * (dx - cx) - (bx - ax) * n) / det), round8(((ay - by) * n - m * (cy - dy)) / det)
    for (x1, y1), (x2, y2) in (s, t):
        x1, x2, y1, y2 = round8(x1), round8(x2), round8(y1), round8(y2)
        if not (min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)):
            return None
    return x, y


def valid_topology(rings: list[Line]) -> bool:
    """No edge of a ring meets another of it but at its own ends. Edges are swept from west to east."""
    for ring in rings:
        edges = sorted((min(a[0], b[0]), max(a[0], b[0]), (a, b)) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
        active: list[tuple[float, tuple[Point, Point]]] = []
        for west, east, edge in edges:
            active = [o for o in active if o[0] >= west - 1e-8]
            for _, other in active:
                hit = crossing(edge, other)
                if hit and any(hit not in [(round8(x), round8(y)) for x, y in e] for e in (edge, other)):
                    return False
            active.append((east, edge))
    return True


def in_ring(p: Point, ring: Line) -> bool:
    inside = False
    x, y = p
    for i in range(len(ring)):
        (x1, y1), (x2, y2) = ring[i - 1], ring[i]
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def fix_winding(rings: list[Line]) -> list[Line]:
    """Outer rings get a positive :func:`signed_area2`, holes a negative one.

    The first ring is outer; another is a hole if an odd number of the other
    rings holds its first vertex.
    """
    out = []
    for n, ring in enumerate(rings):
        hole = n > 0 and bool(ring) and sum(in_ring(ring[0], other) for m, other in enumerate(rings) if m != n) % 2 == 1
        out.append(ring[::-1] if ring and (signed_area2(ring) > 0) == hole and signed_area2(ring) != 0 else ring)
    return out


def clip_segment(a: Point, b: Point, box: Box) -> tuple[Point, Point] | None:
    """Part in the closed box with ends set exactly on the border; None without one or for a single point."""
    t0, t1 = 0.0, 1.0
    d = (b[0] - a[0], b[1] - a[1])
    enter: tuple[int, float] | None = None
    leave: tuple[int, float] | None = None
    for axis in (0, 1):
        low, high = box[axis], box[axis + 2]
        if d[axis] == 0:
            if not low <= a[axis] <= high:
                return None
            continue
        near, far = (low, high) if d[axis] > 0 else (high, low)
        t = (near - a[axis]) / d[axis]
        if t > t0:
            t0, enter = t, (axis, near)
        t = (far - a[axis]) / d[axis]
        if t < t1:
            t1, leave = t, (axis, far)
    if t0 >= t1:
        return None

    def at(t: float, side: tuple[int, float] | None, end: Point) -> Point:
        if side is None:  # inside but for rounding
            return min(max(end[0], box[0]), box[2]), min(max(end[1], box[1]), box[3])
        p = [min(max(a[i] + t * d[i], box[i]), box[i + 2]) for i in (0, 1)]
        p[side[0]] = side[1]
        return p[0], p[1]

    p, q = at(t0, enter, a), at(t1, leave, b)
    return None if p == q else (p, q)


def clip_line(line: Line, box: Box) -> list[Line]:
    """Parts of the line in the closed box."""
    out: list[Line] = []
    for a, b in zip(line, line[1:], strict=False):
        part = clip_segment(a, b, box)
        if part is None:
            continue
        if out and out[-1][-1] == part[0]:
            out[-1].append(part[1])
        else:
            out.append([part[0], part[1]])
    return out


def _inside(line: Line, box: Box) -> bool:
    return all(box[0] <= x <= box[2] and box[1] <= y <= box[3] for x, y in line)


def _place(p: Point, box: Box) -> float:
    """Way of a border point along the border, counter-clockwise from the south-west corner."""
    w, h = box[2] - box[0], box[3] - box[1]
    if p[1] == box[1]:
        return p[0] - box[0]
    if p[0] == box[2]:
        return w + p[1] - box[1]
    if p[1] == box[3]:
        return w + h + box[2] - p[0]
    return 2 * w + h + box[3] - p[1]


def _along(a: Point, b: Point, box: Box) -> bool:
    """Whether both lie on one side of the border."""
    return any(a[i] == b[i] == box[j] for i, j in ((0, 0), (0, 2), (1, 1), (1, 3)))


def _on_border(p: Point, box: Box) -> bool:
    return p[0] in (box[0], box[2]) or p[1] in (box[1], box[3])


def _heading(p: Point, box: Box) -> Point:
    """Direction of the border, counter-clockwise, behind a border point."""
    if p[1] == box[1] and p[0] < box[2]:
        return 1.0, 0.0
    if p[0] == box[2] and p[1] < box[3]:
        return 0.0, 1.0
    return (-1.0, 0.0) if p[1] == box[3] and p[0] > box[0] else (0.0, -1.0)


def _turn(before: Point, at: Point, heading: Point) -> float:
    """Angle to the left between the way that comes from ``before`` and the heading behind ``at``."""
    dx, dy = at[0] - before[0], at[1] - before[1]
    return math.atan2(dx * heading[1] - dy * heading[0], dx * heading[0] + dy * heading[1])


def _chains(ring: Line, box: Box) -> list[Line] | None:
    """Stretches of the ring inside the box, from border to border; None if the whole ring is inside and touches the border in one point at most."""
    if _inside(ring, box) and sum(_on_border(p, box) for p in ring) < 2:
        return None
    chains: list[Line] = []
    for i in range(len(ring)):
        part = clip_segment(ring[i - 1], ring[i], box)
        if part is None or _along(*part, box):
            continue
        if chains and chains[-1][-1] == part[0] and not _on_border(part[0], box):
            chains[-1].append(part[1])
        else:
            chains.append(list(part))
    if len(chains) > 1 and chains[-1][-1] == chains[0][0] and not _on_border(chains[0][0], box):
        chains[0] = chains.pop() + chains[0][1:]
    return chains


def shells(rings: list[Line]) -> list[list[Line]]:
    """Rings of the even-odd rule as polygons with holes: a ring in an odd number of others is a hole of the innermost one.

    Repeated vertices and rings of fewer than three are left out; outer rings come
    out counter-clockwise (y upwards), holes clockwise.
    """
    rings = [[p for i, p in enumerate(r) if i == 0 or p != r[i - 1]] for r in rings]
    rings = [r[:-1] if len(r) > 1 and r[0] == r[-1] else r for r in rings]
    rings = [r for r in rings if len(r) > 2]
    around = [[m for m, other in enumerate(rings) if m != n and in_ring(r[0], other)] for n, r in enumerate(rings)]
    out = {n: [r if signed_area2(r) > 0 else r[::-1]] for n, r in enumerate(rings) if len(around[n]) % 2 == 0}
    for n, r in enumerate(rings):
        owners = [m for m in around[n] if m in out]
        if n not in out and out:  # rings that cross may have no owner; a hole of the first polygon keeps their parity
            out[max(owners, key=lambda m: len(around[m])) if owners else min(out)].append(r if signed_area2(r) < 0 else r[::-1])
        elif n not in out:
            out[n] = [r if signed_area2(r) > 0 else r[::-1]]
    return list(out.values())


def clip_polygon(rings: list[Line], box: Box) -> list[list[Line]]:
    """Polygon (even-odd rule) and box in common, as polygons: first ring outer (counter-clockwise, y upwards), others holes (clockwise)."""
    out = []
    for polygon in shells(rings):
        parts = _clip_simple(polygon, box)
        if len(parts) != 1 or parts[0] is not polygon:
            cut = [q for ring in polygon if (q := _halfplanes(ring, box))]
            area = sum(map(signed_area2, cut))
            if abs(sum(signed_area2(r) for part in parts for r in part) - area) > 1e-9 * (box[2] - box[0]) * (box[3] - box[1]):
                parts = [cut] if cut else []  # rings that cross themselves or each other
        out += parts
    return out


def _halfplanes(ring: Line, box: Box) -> Line:
    """Ring cut at one side of the box after the other. Keeps the signed area of any ring, but joins separate parts along the border."""
    for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        cut: Line = []
        for i in range(len(ring)):
            a, b = ring[i - 1], ring[i]
            a_in, b_in = (a[axis] - limit) * sign >= 0, (b[axis] - limit) * sign >= 0
            if a_in != b_in:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                other = a[1 - axis] + t * (b[1 - axis] - a[1 - axis])
                cut.append((limit, other) if axis == 0 else (other, limit))
            if b_in:
                cut.append(b)
        ring = [p for i, p in enumerate(cut) if p != cut[i - 1]]
    ring = [(min(max(x, box[0]), box[2]), min(max(y, box[1]), box[3])) for x, y in ring]  # rounding of cut points
    return ring if len(ring) > 2 else []


def _clip_simple(rings: list[Line], box: Box) -> list[list[Line]]:
    """The same for one outer ring and its holes.

    Stretches of rings inside the box are joined along its border, always
    counter-clockwise from where one leaves to where the next enters, so concave
    shapes fall into separate parts without bridges and holes that the border cuts
    become part of the outline.
    """
    if _inside(rings[0], box):
        return [rings]
    middle = ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)
    corners = [(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3])]
    chains: list[Line] = []
    holes: list[Line] = []
    outer = _chains(rings[0], box) or []
    chains += outer
    if not outer and not in_ring(middle, rings[0]):
        return []
    for ring in rings[1:]:
        cut = _chains(ring, box)
        if cut is None:
            holes.append(ring)
        elif cut:
            chains += cut
        elif in_ring(middle, ring):
            return []
    outlines: list[Line] = []
    if not chains:
        outlines.append(corners)
    around = 2 * (box[2] - box[0] + box[3] - box[1])
    starts = [_place(ch[0], box) for ch in chains]
    stops = [_place(ch[-1], box) for ch in chains]
    left = set(range(len(chains)))
    while left:
        first = k = min(left)
        shell: Line = []
        while k in left:
            left.discard(k)
            shell += chains[k]
            ways = []
            for j in left | {first}:
                way = (starts[j] - stops[k]) % around
                if way == 0 and _turn(chains[k][-2], chains[k][-1], _heading(chains[k][-1], box)) > _turn(chains[k][-2], chains[k][-1], (chains[j][1][0] - chains[j][0][0], chains[j][1][1] - chains[j][0][1])):
                    way = around  # what is to the left lies along the border
                ways.append((way, j))
            way, j = min(ways)
            shell += [p for _, p in sorted(((_place(p, box) - stops[k]) % around, p) for p in corners) if 0 < (_place(p, box) - stops[k]) % around < way]
            k = j
        shell = [p for i, p in enumerate(shell) if p != shell[i - 1]]
        if len(shell) > 2 and signed_area2(shell) != 0:
            outlines.append(shell)
    out = [[s] for s in outlines]
    for h in holes:
        inner = next((p for p in h if not _on_border(p, box)), h[0])
        for polygon in out:
            if len(out) == 1 or in_ring(inner, polygon[0]):
                polygon.append(h)
                break
    return out


def merge_lines(lines: list[Line]) -> list[Line]:
    """Lines joined end to start wherever an end equals a start exactly; in input order, never reversed.

    Each line is taken up once; chains are followed with an index of starts, so
    the work is linear in the vertices.
    """
    by_start: dict[Point, list[int]] = {}
    for i in reversed(range(len(lines))):
        by_start.setdefault(lines[i][0], []).append(i)
    ends = {line[-1] for line in lines}
    used = [False] * len(lines)
    out: list[tuple[int, Line]] = []

    def follow(i: int) -> None:
        used[i], at = True, i
        line = list(lines[i])
        while True:
            nexts = by_start.get(line[-1], [])
            while nexts and used[nexts[-1]]:
                nexts.pop()
            if not nexts:
                break
            j = nexts.pop()
            used[j] = True
            at = min(at, j)
            line += lines[j][1:]
        out.append((at, line))

    for i, line in enumerate(lines):
        if not used[i] and line[0] not in ends:
            follow(i)
    for i in range(len(lines)):
        if not used[i]:
            follow(i)
    return [line for _, line in sorted(out, key=lambda x: x[0])]
