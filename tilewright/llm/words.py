"""Words of a text, and bounded slices of Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

COMMAND = re.compile(r"\\[A-Za-z]+")
#: Letters and numbers (categories L and N) are exactly what is alphanumeric to Python.
WORD = re.compile(r"[^\W_]+")
#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 8_000_000


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters and numbers; a backslash command counts as a space. Null has none."""
    if not text:
        return []
    return WORD.findall(COMMAND.sub(" ", text).lower())


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of about ``most`` bytes of a text column; one row is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
