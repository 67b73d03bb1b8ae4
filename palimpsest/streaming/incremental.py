"""Replacing values, and expiry, over streams.

Replacing and restoring look at one text at a time, so a stream goes through the
same expressions as a table.  Repeated deliveries are dropped within a
watermark, and jobs expire by the same rule as in a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators import redact


def redacted_stream(docs: DataFrame, entities: list[dict], text: str = "text", key: str | None = None, at: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """A stream of texts, redacted; with ``key`` and ``at``, a key that comes again within ``delay`` is dropped."""
    if key and at:
        docs = docs.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
    return redact.redact(docs, entities, text)


def last_activity(log: DataFrame, key: str = "job_id", at: str = "at", delay: str = "10 minutes", gap: str = "240 minutes") -> DataFrame:
    """(key, started, expires): sessions of a job's log that end ``gap`` after its last entry, as they expire."""
    window = F.session_window(F.col(at), gap)
    rows = log.withWatermark(at, delay).groupBy(key, window.alias("w")).agg(F.count("*").alias("events"))
    return rows.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "events")


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, to Parquet, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
