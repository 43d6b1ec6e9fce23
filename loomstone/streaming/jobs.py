"""Structured Streaming jobs whose results equal the batch operators' over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import commits
from ..operators.catalog import upserted
from ..sources import sinks


def redacted_history(rows: DataFrame) -> DataFrame:
    """History rows with secrets gone from the query and from the request's JSON; batch or stream."""
    return rows.withColumns({"query": T.redact(F.col("query")), "request_json": T.redact_json(F.col("request_json"))})


def history_stream(rows: DataFrame, target: str, checkpoint: str, retention: str = "90 days") -> StreamingQuery:
    """Append redacted history, each request_id once; the retention period bounds the state."""
    unique = redacted_history(rows).withWatermark("executed_at", retention).dropDuplicatesWithinWatermark(["request_id"])
    return unique.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def kept_history_stream(rows: DataFrame, base: str, checkpoint: str, days: int = 90) -> StreamingQuery:
    """Redacted history in the store under base, by day, each request_id once; a batch that appends also drops what is past its days."""

    def apply(batch: DataFrame, number: int) -> None:
        commits.append_history(sinks.Store(batch.sparkSession, base), redacted_history(batch), days, ("history", number))

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def version_stream(observations: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """Observed versions, each row with its sections (array of ordinal, heading, content), committed batch by batch to the store under base.

    A batch is one commit of versions, sections and pointers; where it fails, readers see what was before, and its replay is
    recognised by its number.
    """

    def apply(batch: DataFrame, number: int) -> None:
        sections = batch.select("document_id", "content_hash", F.inline("sections"))
        once = sections.dropDuplicates(["document_id", "content_hash", "ordinal"])
        commits.commit(sinks.Store(batch.sparkSession, base), batch.drop("sections"), once, ("versions", number))

    return observations.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_activity(rows: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Requests per tool and event-time window; what comes later than the watermark is left out."""
    return rows.withWatermark("executed_at", late).groupBy(F.window("executed_at", width).alias("w"), "tool").agg(F.count("*").alias("requests"), F.avg("duration_ms").alias("mean_ms")).select(F.col("w.start").alias("start"), "tool", "requests", "mean_ms")


def catalog_stream(observations: DataFrame, base: str, checkpoint: str, key: list[str], keep: list[str], order: str) -> StreamingQuery:
    """Apply observations to the snapshot under base, a published snapshot per batch; a batch applied twice changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        rest = [c for c in batch.columns if c not in key]
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*key, "r.*")
        sinks.publish(upserted(sinks.current(batch.sparkSession, base), last, key, keep), base)

    return observations.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
