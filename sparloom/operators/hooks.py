"""Progress of runs from observed metrics: what a job counted while it ran, without a second pass."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def observed(rows: DataFrame, metrics: dict[str, Column], sink: Callable[[DataFrame], None]) -> DataFrame:
    """One row of metrics (aggregates by name) that were counted while sink wrote the rows; sink runs one action."""
    watch = Observation()
    sink(rows.observe(watch, *[m.alias(n) for n, m in metrics.items()]))
    kinds = rows.select(*[m.alias(n) for n, m in metrics.items()]).schema
    return rows.sparkSession.createDataFrame([tuple(watch.get[f.name] for f in kinds)], kinds)


def run_metrics(status: str = "status") -> dict[str, Column]:
    """What a batch runner tells of its items: all, done, failed."""
    return {"n_items": F.count(F.lit(1)), "n_done": F.count_if(F.col(status) == "ok"), "n_failed": F.count_if(F.col(status) == "error")}


class Hooks(StreamingQueryListener):
    """Calls before(name), progress(name, batch, metrics) for each micro-batch that has observed metrics under `metrics`, and after(name, error).

    A hook that raises doesn't stop the stream: its error is kept in `failures`.
    """

    def __init__(self, metrics: str = "progress", before: Callable | None = None, progress: Callable | None = None, after: Callable | None = None):
        self.metrics, self.before, self.progress, self.after = metrics, before, progress, after
        self.names: dict[str, str] = {}
        self.failures: list[str] = []

    def _call(self, hook: Callable | None, *args) -> None:
        try:
            if hook:
                hook(*args)
        except Exception as e:  # noqa: BLE001 - a hook of any kind
            self.failures.append(f"{type(e).__name__}: {e}")

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.names[str(event.id)] = event.name
        self._call(self.before, event.name)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        found = event.progress.observedMetrics.get(self.metrics)
        if found is not None:
            self._call(self.progress, event.progress.name, event.progress.batchId, found.asDict())

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._call(self.after, self.names.get(str(event.id)), event.exception)


def watched_stream(items: DataFrame, out: str, checkpoint: str, hooks: Hooks, name: str, status: str = "status") -> StreamingQuery:
    """Writes items to `out` as they come, with hooks told of each micro-batch; ends when all that was there is done.

    The hooks stay with the session until removeListener() takes them out.
    """
    spark: SparkSession = items.sparkSession
    spark.streams.addListener(hooks)
    rows = items.observe(hooks.metrics, *[m.alias(n) for n, m in run_metrics(status).items()])
    return rows.writeStream.queryName(name).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settle(spark: SparkSession, hooks: Hooks, ready: Callable[[], bool], seconds: float = 30.0) -> None:
    """Waits until the listener's thread, which is told of progress a little later, has said what `ready` asks for, then takes the hooks out."""
    end = time.monotonic() + seconds
    while not ready() and time.monotonic() < end:
        time.sleep(0.05)
    spark.streams.removeListener(hooks)
