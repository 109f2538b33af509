"""The job stream as Structured Streaming: windowed counts, first sightings, and job state with deliveries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.lifecycle import EVENT_TYPES
from quire.shipping import ship

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str, files_a_batch: int = 16) -> DataFrame:
    """The events table as a stream; a bounded number of files a batch is the back pressure."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their value by type and window; late ones count until the watermark has passed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a job: its events without a pause of `gap`."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n")


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, started, retries, pages = state.get if state.exists else ("new", 0, 0, 0)
    events = pd.concat(list(frames)).sort_values("event_id")
    for kind in events["event_type"].map(EVENT_TYPES):
        if kind == "job.queued":
            status = "queued"
        elif kind == "job.started":
            status, started = "running", started + 1
        elif kind == "job.retry":
            status, retries, pages = "queued", retries + 1, 0
        elif kind == "job.done":
            status = "done"
        elif kind == "page.stage":
            pages += 1
    state.update((status, started, retries, pages))
    yield pd.DataFrame({"job": [key[0]], "status": [status], "deliveries": [started], "retries": [retries], "pages": [pages]})


def job_states(events: DataFrame) -> DataFrame:
    """Every job's status after each batch that touches it; pages start over at a retry."""
    ship(events.sparkSession)
    return events.groupBy("user_id").applyInPandasWithState(_advance, "job long, status string, deliveries long, retries long, pages long", "status string, deliveries long, retries long, pages long", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into an in-memory table: for tests and small looks."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
