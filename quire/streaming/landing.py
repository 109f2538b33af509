"""Results of batches that land once, in several tables, and what a running stream tells of itself.

A batch of a stream may run twice: its process can die between two writes, or before the batch is noted as done.
Each table therefore has a folder a batch, written anew as a whole, and a ledger names the batches whose tables
are all there.  Readers take what the ledger names, so they see every batch whole or not at all.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

LEDGER = "ledger"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Landing:
    """A foreachBatch function that writes each batch to several tables under folder.

    sinks: name of a table -> what of a batch goes there.  A batch that the ledger names is left alone, so running it
    again changes nothing; one that broke off is written over.
    """

    def __init__(self, spark: SparkSession, folder: str, sinks: Mapping[str, Callable[[DataFrame], DataFrame]]):
        if LEDGER in sinks:
            raise ValueError(f"{LEDGER} is the ledger's own name")
        self.spark, self.folder, self.sinks = spark, folder.rstrip("/"), dict(sinks)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if _exists(self.spark, f"{self.folder}/{LEDGER}/batch={batch_id}/_SUCCESS"):
            return
        batch = batch.persist()  # made once, whatever the number of tables
        try:
            for name, pick in self.sinks.items():
                pick(batch).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")
            noted = self.spark.range(1).select(F.current_timestamp().alias("at")).coalesce(1)
            noted.write.mode("overwrite").parquet(f"{self.folder}/{LEDGER}/batch={batch_id}")
        finally:
            batch.unpersist()

    def table(self, name: str) -> DataFrame:
        """All rows that have landed in a table, with batch."""
        return landed(self.spark, self.folder, name)


def landed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All rows of a table, with batch, of batches that the ledger names."""
    done = spark.read.option("basePath", f"{folder}/{LEDGER}").parquet(f"{folder}/{LEDGER}").select("batch").distinct()
    rows = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    return rows.join(done, "batch", "left_semi")


def started(stream: DataFrame, landing: Landing, checkpoint: str, mode: str = "update", once: bool = True, every: str = "1 second") -> StreamingQuery:
    """Run a stream into a landing: over what is there now, or on and on."""
    w = stream.writeStream.foreachBatch(landing).outputMode(mode).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def drained(query: StreamingQuery, wait_s: float = 60) -> None:
    """Stop a stream behind its running batch.  Should the wait not do, the batch is cut off and runs again at the next start."""
    until = time.time() + wait_s
    while query.isActive and query.status["isTriggerActive"] and time.time() < until:
        time.sleep(0.05)
    query.stop()


STATES = ("queued", "running", "done", "failed")


def changes(status: Column, before: Column, is_job: Column) -> list[Column]:
    """By how much the number of jobs of each status changes over a batch's job rows, and the last event that they tell of."""
    one = lambda c, s: F.count_if(is_job & (c == s))
    return [(one(status, s) - one(before, s)).alias(s) for s in STATES] + [F.max(F.col("version")).alias("upto")]


def observed(view: DataFrame, name: str = "backlog") -> DataFrame:
    """view, telling its listeners how each batch changes the backlog."""
    return view.observe(name, *changes(F.col("status"), F.col("before"), F.col("kind") == "job"))


class Backlog(StreamingQueryListener):
    """Jobs by status after each batch, as a running stream reports them: batches[id] = (status -> jobs, last event)."""

    def __init__(self, name: str = "backlog", begin: Mapping[str, int] | None = None):
        self.name = name
        self.now = dict.fromkeys(STATES, 0) | dict(begin or {})
        self.batches: dict[int, tuple[dict[str, int], int | None]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        row = p.observedMetrics.get(self.name)
        if row is None or p.batchId in self.batches or row["upto"] is None:
            return
        self.now = {s: n + row[s] for s, n in self.now.items()}
        self.batches[p.batchId] = dict(self.now), row["upto"] // 2

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
