"""Trace roll-up and memory over streams: the batch roll-ups, carried on as records come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(steps: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, action, n, total of steps (ts, action, value) in tumbling windows; a batch or a stream.

    A stream keeps one row a window and action until the watermark passes, so its state is bounded.
    """
    events = steps.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if steps.isStreaming else steps
    told = events.groupBy(F.window("ts", width).alias("w"), "action").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return told.select(F.col("w.start").alias("window_start"), "action", "n", "total")


def run_rollup(steps: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends closed windows as Parquet below ``path``; started again after a loss it goes on from ``checkpoint``."""
    return windowed(steps, **options).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_trace(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends records as JSON lines, each once."""
    return records.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_entries(entries: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """Entries (category, value) that the memory does not know: blanks and repeats left out.

    Failure reasons are remembered each time.
    """
    kept = entries.where(F.trim(F.coalesce("value", F.lit(""))) != "")
    reasons = F.coalesce(F.col("category") == "failure_reasons", F.lit(False))
    others = [c for c in kept.columns if c not in ("category", "value")]
    first = kept.where(~reasons).groupBy("category", "value").agg(F.min_by(F.struct(*others), order).alias("_o")).select("category", "value", *[F.col(f"_o.{c}").alias(c) for c in others])
    return first.join(known.select("category", "value"), ["category", "value"], "left_anti").select(*kept.columns).unionByName(kept.where(reasons))


def remember(batch: DataFrame, batch_id: int, path: str, order: str, known: DataFrame | None = None) -> None:
    """For foreachBatch: writes a batch's new entries to its own folder, so a batch done again replaces itself.

    ``known``: the memory before the stream, if any.
    """
    session = batch.sparkSession
    before = batch.limit(0) if known is None else known.select(*batch.columns)
    if batch_id > 0:
        held = session.read.parquet(path).where(F.col("batch") < batch_id)
        before = before.unionByName(held.select(*batch.columns))
    new_entries(batch, before, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
