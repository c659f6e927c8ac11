"""Incremental runs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout


def stream_items(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, format: str = "parquet") -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def progress(items: DataFrame, by: str, value: str, name: str, checkpoint: str) -> StreamingQuery:
    """Running counts and sums into the memory table `name`, updated with each micro-batch."""
    counts = items.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_incrementally(items: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "custom_id", done: DataFrame | None = None) -> StreamingQuery:
    """Writes work(new items) to the folder `out`, a subfolder for each micro-batch, which a repeated one replaces.

    Keys seen before in the stream are kept as state, so `out` is never read again;
    those of `done` (earlier runs, key column read only) are skipped too.
    """
    fresh = items.dropDuplicates([key])
    if done is not None:
        fresh = fresh.join(done.select(key).distinct(), key, "left_anti")
    return fresh.writeStream.foreachBatch(lambda batch, n: work(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class TooManyErrors(RuntimeError):
    """A run was stopped by its error policy."""


def run_with_policy(items: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, policy: str = "continue", most: int = 1) -> StreamingQuery:
    """run_incrementally() without keys, whose results have a status: `continue` writes errors as rows, `stop` ends the stream at the first, `stop_after_n` at the `most`-th.

    Errors are counted over the micro-batches of this run; the one that goes too far is written before the stream ends.
    """
    limit = {"continue": None, "stop": 1, "stop_after_n": most}[policy]
    seen = {"errors": 0}

    def each(batch: DataFrame, n: int) -> None:
        path = f"{out}/batch={n}"
        work(batch).write.mode("overwrite").parquet(path)
        if limit is not None:
            seen["errors"] += batch.sparkSession.read.parquet(path).where("status = 'error'").count()
            if seen["errors"] >= limit:
                raise TooManyErrors(f"{seen['errors']} errors")

    return items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_cost(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An extension: cost by event-time window, late events within the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def write_snapshots(totals: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A running aggregate: each micro-batch replaces the folder `out` by all its rows."""
    return totals.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_first(items: DataFrame, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Appends one row of each combination of the keys; those seen before are kept as state."""
    return items.dropDuplicates(keys).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_of_key(entries: DataFrame, key: str, seq: str, most: int) -> DataFrame:
    """(key, seqs): the newest `most` entries of each key, told again after each micro-batch that changes them. A key's state is these entries only."""

    def step(k, frames, state):
        held = list(state.get[0]) if state.exists else []
        for f in frames:
            held = sorted({*held, *f[seq].nlargest(most).tolist()})[-most:]
        state.update((held,))
        yield pd.DataFrame({key: [k[0]], "seqs": [held]})

    kind = entries.schema[key].dataType.simpleString()
    return entries.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seqs array<bigint>", "seqs array<bigint>", "update", GroupStateTimeout.NoTimeout)


def write_changes(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends what each micro-batch changed, with its number in `batch`; a repeated micro-batch tells the same again."""
    return changes.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
