"""Structured Streaming counterparts of the keyed tables: each micro-batch replaces what it covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimweave.sources.tables import new_content


def latest_by_key(arrivals: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """A stream's latest row of every key, for update mode; late rows beyond the watermark are dropped."""
    return arrivals.withWatermark(time, delay).groupBy(key).agg(F.max_by(F.struct(*arrivals.columns), F.struct(F.col(time), *[c for c in arrivals.columns if c != time])).alias("row")).select("row.*")


def merged_stream(arrivals: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Merges every micro-batch into a table by the function that batch jobs use; replays give the same table."""

    def each(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            write(merge(read(), batch))

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_intake(arrivals: DataFrame, known: Callable[[], DataFrame], parse: Callable[[DataFrame], DataFrame], append: Callable[[DataFrame], None], checkpoint: str, version: int, text: str = "text") -> StreamingQuery:
    """Parses every arriving text whose content this extractor version has not parsed, and appends it with its sha256 and version.

    The hash decides, so that a batch that is run again after a failure, a repeated file and two equal texts of one batch
    add nothing. known() is read anew in each micro-batch and holds sha256 and version.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        fresh = new_content(batch, known(), text, version).dropDuplicates(["sha256"])
        if not fresh.isEmpty():
            append(parse(fresh).withColumn("version", F.lit(version)))

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
