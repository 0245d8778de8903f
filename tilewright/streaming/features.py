"""Feature streams: stateless transformations of files as they arrive, and sinks for their batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tilewright.operators import mapping
from tilewright.sources.formats import write_features


def converted(stream: DataFrame, rules: list[mapping.Rule]) -> DataFrame:
    """The rules on a stream; no state is kept."""
    return mapping.apply_rules(stream, rules)


def write_batches(stream: DataFrame, path: str, checkpoint: str, kind: str = "featureblocks", once: bool = True) -> StreamingQuery:
    """Each micro-batch to its own folder ``path/batch=N``, so a batch that is repeated after a failure replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        write_features(batch, f"{path}/batch={number}", kind)

    return each_batch(stream, checkpoint, save, once)


def each_batch(stream: DataFrame, checkpoint: str, save: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
