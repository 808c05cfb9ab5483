"""Structured Streaming: requests mapped as they come, each once, and a breaker for failing sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.breaker import breakers
from ..sources.versions import VersionedTable


def once(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """A stream without rows that repeat a key within the watermark's delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All rows there are now, appended as Parquet; started again with the same checkpoint it goes on where it ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def breaker(stream: DataFrame, table: VersionedTable, checkpoint: str, *, name: str = "breaker", group: str = "source", ord_: str = "ord", **limits) -> StreamingQuery:
    """Keeps the breakers of a stream's sources in a versioned table: every batch's runs are scanned as breakers() does, compose with the state so far, and replace the rows of its
    sources. A batch that comes again changes nothing. Within a source, later batches have later rows."""

    def write(to: VersionedTable, rows: DataFrame, options: dict) -> None:
        before = to.read(options["since"]) if options["since"] else None
        to.upsert(breakers(rows, group=group, ord_=ord_, before=before, **limits), group, **options)

    return stream.writeStream.foreachBatch(table.each_batch(name, write)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
