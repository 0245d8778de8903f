"""Cheapest repair of a delimited line by dynamic programming.

A parse reads the line once, left to right, through four states: at the start
of a field, in a plain field, in a quoted field, after a closing quote. A cell is a
state and the number of columns behind it. Edits delete or insert a quote or a
delimiter. Costs are compared first by quote edits, then by delimiter edits, then
by columns of a wrong type; a parse without cost is a valid line, otherwise the first
kind of cost is the reason. A delimiter edit stands between two fields and leaves the
quoting of the rest as it was, so it never stands in for a quote edit: a deleted delimiter
joins two fields to one column, an inserted one puts an empty column before a field.
"""

from __future__ import annotations

import re

START, JOIN, PLAIN, QUOTED, CLOSED = range(5)
NUMBER = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\Z")
#: What a number may begin with.
BEGUN = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?(?:(?<=[0-9])[eE](?:[+-]?[0-9]*))?)?\Z")
#: Valid quoting.
VALID = re.compile(r'(?s)(?:"(?:[^"]|"")*"|[^\t"]*)(?:\t(?:"(?:[^"]|"")*"|[^\t"]*))*')
REASONS = ("quoting", "column_count", "latitude", "longitude")
#: The state behind a quote that is read or inserted; a plain field takes none.
QUOTE = {START: QUOTED, JOIN: QUOTED, QUOTED: CLOSED, CLOSED: QUOTED}
MANY = 1 << 60


def in_range(text: str | None, limit: float) -> bool:
    return bool(text is not None and NUMBER.match(text) and abs(float(text)) <= limit)


def _tokens(line: str) -> list[tuple[str, int, int]]:
    """The line as runs of other characters, single tabs and single quotes: (kind, from, to)."""
    return [(m.group()[0] if m.group()[0] in '\t"' else "x", m.start(), m.end()) for m in re.finditer(r'\t|"|[^\t"]+', line)]


def split_valid(line: str) -> list[str]:
    """Fields of a line whose quoting is valid."""
    fields = []
    for m in re.finditer(r'(?:\A|\t)(?:"((?:[^"]|"")*)"(?=\t|\Z)|([^\t"]*))', line):
        fields.append(m.group(1).replace('""', '"') if m.group(1) is not None else m.group(2))
    return fields


def _quote_costs(tokens: list[tuple[str, int, int]]) -> list[list[int]]:
    """Fewest quote edits from each token and state to the end of the line, an edit in front of the token included."""
    rest = [0, 0, 0, 1, 0]
    out = [rest]
    for kind, _, _ in reversed(tokens):
        read = [MANY] * 5
        for state in range(5):
            if kind == '"':
                read[state] = min(1 + rest[state], rest[QUOTE[state]] if state in QUOTE else MANY)
            elif kind == "\t":
                read[state] = rest[QUOTED if state == QUOTED else START]
            elif state != CLOSED:
                read[state] = rest[QUOTED if state == QUOTED else PLAIN]
        rest = [min(read[s], 1 + read[QUOTE[s]] if s in QUOTE else MANY) for s in range(5)]
        out.append(rest)
    return out[::-1]


class _Cells:
    """The best parses of each state and column. The least quote and delimiter cost of a cell counts alone, as what follows
    costs all the same; ties are kept apart by the text of a checked column while it can become a number."""

    def __init__(self, checks: dict[int, float], bound: list[int], quotes: int, delimiters: int) -> None:
        self.checks, self.bound, self.most = checks, bound, (quotes, delimiters)
        self.best: dict[tuple[int, int], tuple[tuple[int, int], dict]] = {}

    def put(self, state: int, column: int, text: str | None, q: int, d: int, wrong: int, trace) -> None:
        if q + self.bound[state] > self.most[0] or d > self.most[1]:
            return
        if column not in self.checks:
            text = ""
        elif text is not None and not BEGUN.match(text):
            text = None
        cost, texts = self.best.setdefault((state, column), ((q, d), {}))
        if (q, d) < cost:
            texts = {}
            self.best[state, column] = ((q, d), texts)
        elif (q, d) > cost:
            return
        if text not in texts or wrong < texts[text][0]:
            texts[text] = (wrong, trace)

    def all(self) -> list[tuple]:
        return [(state, column, text, q, d, wrong, trace) for (state, column), ((q, d), texts) in self.best.items() for text, (wrong, trace) in texts.items()]


def _joined(text: str | None, more: str) -> str | None:
    return None if text is None else text + more


def _fit(line: str, tokens: list, costs: list[list[int]], width: int, checks: dict[int, float], most: int):
    """Cheapest (delimiter edits, wrong columns, trace) with the fewest quote edits and at most so many delimiter edits; None without one."""
    def wrong(column: int, text: str | None) -> int:
        return int(column in checks and not in_range(text, checks[column]))

    cells = _Cells(checks, costs[0], costs[0][START], most)
    cells.put(START, 0, "", 0, 0, 0, None)
    for i, (kind, at, to) in enumerate([*tokens, ("end", len(line), len(line))]):
        # an edit in front of the token: empty columns before a field, then one quote
        for state, column, text, q, d, t, trace in cells.all():
            while state == START and column + 1 < width and d < most:
                t, d, trace = t + wrong(column, ""), d + 1, (("insert_delimiter", at), trace)
                column += 1
                cells.put(START, column, "", q, d, t, trace)
        ready = cells.all()
        ready += [(QUOTE[s], c, _joined(x, '"' * (s == CLOSED)), q + 1, d, t, (("insert_quote", at), trace)) for s, c, x, q, d, t, trace in ready if s in QUOTE]
        if kind == "end":
            ends = []
            for state, column, text, q, d, t, trace in ready:
                extra = width - 1 - column
                if state == QUOTED or q > costs[0][START] or d + extra > most:
                    continue
                t += wrong(column, text)
                for c in range(column + 1, width):
                    t, trace = t + wrong(c, ""), (("insert_delimiter", at), trace)
                ends.append((d + extra, t, trace))
            return min(ends, key=lambda e: e[:2], default=None)
        cells = _Cells(checks, costs[i + 1], costs[0][START], most)
        part = line[at:to]
        for state, column, text, q, d, t, trace in ready:
            if kind == '"':
                cells.put(state, column, text, q + 1, d, t, (("delete_quote", at), trace))
                if state in QUOTE:
                    cells.put(QUOTE[state], column, _joined(text, '"' * (state == CLOSED)), q, d, t, trace)
            elif state == QUOTED:
                cells.put(QUOTED, column, _joined(text, part), q, d, t, trace)
            elif kind == "\t":
                if column + 1 < width:
                    cells.put(START, column + 1, "", q, d, t + wrong(column, text), trace)
                cells.put(JOIN, column, text, q, d + 1, t, (("delete_delimiter", at), trace))
            elif state != CLOSED:
                cells.put(PLAIN, column, _joined(text, part), q, d, t, trace)
    return None


def repair(line: str, width: int, checks: dict[int, float]) -> tuple[int, int, int, list[tuple[str, int]]]:
    """Least cost (quote edits, delimiter edits, columns of a wrong type) that gives ``width`` columns, and its edits by position.

    ``checks``: column to largest absolute value. The fewest quote edits come from a pass
    over the states alone; with them the bound on delimiter edits is doubled until a parse fits.
    """
    tokens = _tokens(line)
    costs = _quote_costs(tokens)
    # valid quoting leaves the fields as they are, so their number tells the delimiter edits
    most, found = 0 if costs[0][START] else abs(len(split_valid(line)) - width), None
    while found is None:
        found = _fit(line, tokens, costs, width, checks, most)
        most = 2 * most + 1
    delimiters, wrong, trace = found
    edits = []
    while trace:
        edits.append(trace[0])
        trace = trace[1]
    return costs[0][START], delimiters, wrong, edits[::-1]


def parse(line: str, width: int, checks: dict[int, float], names: dict[int, str]) -> tuple[list[str] | None, str | None, str | None]:
    """(fields, reason, edits): fields of a zero-cost line, else the reason and all edits of the cheapest repair as text."""
    fields = split_valid(line) if VALID.fullmatch(line) else None
    if fields is None or len(fields) != width:
        quotes, delimiters, wrong, edits = repair(line, width, checks)
        said = [f"{op} @{at}" for op, at in edits] + ([f"{wrong} of a wrong type"] if wrong else [])
        return None, REASONS[0] if quotes else REASONS[1], ", ".join(said)
    bad = [names[c] for c, limit in checks.items() if not in_range(fields[c], limit)]
    return (None, bad[0], ", ".join(f"type {n}" for n in bad)) if bad else (fields, None, None)
