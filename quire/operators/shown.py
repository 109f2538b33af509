"""Numbers as people are shown them, and metrics as an endpoint gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the histogram of durations.
BOUNDS = (10, 25, 50, 75)


def _fixed(value: Column, digits: int) -> Column:
    """value with so many decimals; a half of its shortest decimal form goes up."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


def ms(v: Column) -> Column:
    """Milliseconds, or seconds from 1,000 on, with one decimal below ten seconds; '-' for null."""
    seconds = F.when(v < 10_000, _fixed(v / 1000, 1)).otherwise(_fixed(v / 1000, 0))
    return F.when(v.isNull(), "-").when(v < 1000, F.concat(F.round(v).cast("long").cast("string"), F.lit(" ms"))).otherwise(F.concat(seconds, F.lit(" s")))


def usd(v: Column) -> Column:
    return F.when(v.isNull(), "-").when(v == 0, "$0").when(v < 0.0001, "<$0.0001").when(v < 0.01, F.concat(F.lit("$"), _fixed(v, 4))).otherwise(F.concat(F.lit("$"), _fixed(v, 3)))


def size(v: Column) -> Column:
    """Bytes; '' for null."""
    kb = F.concat(F.floor(v / 1024 + 0.5).cast("string"), F.lit(" KB"))
    return F.when(v.isNull(), "").when(v < 1024, F.concat(v.cast("string"), F.lit(" B"))).when(v < 1024 * 1024, kb).otherwise(F.concat(_fixed(v / 1024 / 1024, 1), F.lit(" MB")))


def exposition(events: DataFrame, bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """metric, value: ended jobs by result, jobs running, and a cumulative histogram of durations, in one pass."""
    is_type = lambda t: F.col("type") == t
    done, retry, start = (F.count_if(is_type(t)) for t in ("job.done", "job.retry", "job.started"))
    made = {'jobs_total{result="done"}': done, 'jobs_total{result="error"}': retry, "jobs_running": start - done - retry, "job_ms_sum": F.coalesce(F.sum("ms"), F.lit(0)), "job_ms_count": F.count("ms")}
    made |= {f'job_ms_bucket{{le="{b}"}}': F.count_if(F.col("ms") <= b) for b in bounds} | {'job_ms_bucket{le="+Inf"}': F.count("ms")}
    one = events.agg(*[c.cast("long").alias(f"m{i}") for i, c in enumerate(made.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"m{i}").alias("value")) for i, name in enumerate(made)])).alias("m")).select("m.*")
