"""Jobs and their events in batch form: states, deliveries, waits, occupancy, the pipeline graph.

`events` stands for the job stream: a job is a user, event types are mapped to job events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_TYPES = {"signup": "job.queued", "view": "job.started", "click": "page.stage", "error": "job.retry", "purchase": "job.done"}
#: Edges of the routing pipeline.  Fixed values.
EDGES = [("intake", "probes"), ("probes", "ocr"), ("probes", "vision"), ("probes", "evidence"), ("ocr", "evidence"), ("vision", "evidence"), ("evidence", "answers"), ("answers", "policy"), ("policy", "L1"), ("policy", "L2"), ("policy", "L3"), ("policy", "L4"), ("policy", "L5"), ("policy", "LH"), ("policy", "LQ"), ("intake", "L0"), ("intake", "LQ")]


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, job, type, ms."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv]), F.col("event_type"))
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job"), F.coalesce(kind, F.lit("other")).alias("type"), F.get_json_object("props", "$.k").cast("long").alias("ms"))


def states(events: DataFrame) -> DataFrame:
    """Latest status, retries, and pages since the last retry of each job; partial aggregates before one shuffle."""
    status = F.when(F.col("type") == "job.queued", "queued").when(F.col("type") == "job.started", "running").when(F.col("type") == "job.retry", "queued").when(F.col("type") == "job.done", "done")
    s = events.withColumn("status", status)
    last = s.groupBy("job").agg(
        F.max_by(F.col("status"), F.when(F.col("status").isNotNull(), F.col("id"))).alias("status"),
        F.count_if(F.col("type") == "job.retry").alias("retries"),
        F.coalesce(F.max(F.when(F.col("type") == "job.retry", F.col("id"))), F.lit(-1)).alias("retry_id"),
        F.min("id").alias("first_id"),
    )
    pages = s.filter("type = 'page.stage'").join(last.select("job", "retry_id"), "job").filter("id > retry_id").groupBy("job").agg(F.count("*").alias("pages"))
    return last.join(pages, "job", "left").select("job", "status", "retries", F.coalesce("pages", F.lit(0)).alias("pages"), "first_id")


def deliveries(events: DataFrame, most: int = 3) -> DataFrame:
    """Deliveries (starts) of each job in order, and whether each is beyond the limit."""
    w = Window.partitionBy("job").orderBy("id")
    return events.filter("type = 'job.started'").withColumn("delivery", F.row_number().over(w)).select("id", "job", "delivery", (F.col("delivery") > most).alias("dead"))


def reclaims(events: DataFrame, idle_s: int = 120) -> DataFrame:
    """Events of a job that come more than idle_s seconds after its last one."""
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(Window.partitionBy("job").orderBy("id"))
    return events.withColumn("gap_us", gap).filter(F.col("gap_us") > idle_s * 1_000_000).select("id", "job", "gap_us")


def newest_jobs(job_states: DataFrame, n: int = 500) -> DataFrame:
    return job_states.orderBy(F.desc("first_id")).limit(n)


def recent_medians(events: DataFrame, n: int = 256) -> DataFrame:
    """Median duration of the last n events of each type."""
    w = Window.partitionBy("type").orderBy(F.desc("id"))
    last = events.filter("ms is not null").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)
    return last.groupBy("type").agg(F.median("ms").alias("median_ms"), F.count("*").alias("n"))


def spend_cap(calls: DataFrame, cap: int, reserve: int) -> DataFrame:
    """Calls (id, job, ms as cost) made before a job's spend would come within the reserve of its cap."""
    w = Window.partitionBy("job").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return calls.filter("ms is not null").withColumn("spent", F.coalesce(F.sum("ms").over(w), F.lit(0))).filter(F.col("spent") <= cap - reserve).select("id", "job", "spent")


def spend_ledger(calls: DataFrame, cap: int, first: int = 20, margin: float = 1.5) -> DataFrame:
    """id, job, spent of calls (id, job, ms as cost) that a job's ledger lets through.

    Before a call what is spent and the dearest call so far, with a margin (`first` before any), must stay within the cap;
    both only grow, so the first call that is refused is the last.
    """
    w = Window.partitionBy("job").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    c = calls.filter("ms is not null").withColumns({"spent": F.coalesce(F.sum("ms").over(w), F.lit(0)), "dearest": F.greatest(F.coalesce(F.max("ms").over(w) * margin, F.lit(0.0)), F.lit(float(first)))})
    return c.filter(F.col("spent") + F.col("dearest") <= cap).select("id", "job", "spent")


def merged(replays: list[tuple[DataFrame, int]]) -> DataFrame:
    """Replays (job, id, at) begun at different times as one: at counts from the first one's beginning."""
    out = None
    for events, begin in replays:
        moved = events.select("job", "id", (F.col("at") + begin).alias("at"))
        out = moved if out is None else out.unionByName(moved)
    return out.orderBy("at", "job", "id")


def shortest_paths(spark: SparkSession, start: str = "intake", depth: int = 10) -> DataFrame:
    """node, hops, path from the start over the pipeline's 17 edges, the first in order of names on a tie."""
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    edges.createOrReplaceTempView("quire_edges")
    walked = spark.sql(f"""
        WITH RECURSIVE w(node, hops, path) AS (
            SELECT '{start}', 0, '{start}' UNION ALL
            SELECT e.dst, w.hops + 1, w.path || '>' || e.dst FROM w JOIN quire_edges e ON e.src = w.node WHERE w.hops < {depth})
        SELECT node, min(struct(hops, path)) AS best FROM w GROUP BY node""")
    return walked.select("node", "best.hops", "best.path")


def landed(moves: DataFrame) -> DataFrame:
    """lane, n: pages by the lane they were last seen in (moves: id, page, lane), so that a move leaves its old lane."""
    last = moves.groupBy("page").agg(F.max_by("lane", "id").alias("lane"))
    return last.groupBy("lane").agg(F.count("*").alias("n"))


def heat(events: DataFrame, now: Column, decay_s: float = 1.4) -> DataFrame:
    """type, heat: 1 when an event has just come, falling off exponentially since the last."""
    last = events.groupBy("type").agg(F.max("ts").alias("at"))
    return last.select("type", F.exp((F.unix_micros("at") - F.unix_micros(now)) / 1_000_000 / decay_s).alias("heat"))


def newest_events(events: DataFrame, n: int = 20_000) -> DataFrame:
    """The log's newest n events, which is what it keeps."""
    return events.orderBy(F.desc("id")).limit(n)


def backlog(job_states: DataFrame) -> DataFrame:
    """status, n."""
    return job_states.groupBy("status").agg(F.count("*").alias("n"))


def buckets(value: Column, bounds: tuple[float, ...]) -> list[Column]:
    """Counts of a histogram whose buckets hold all values up to their bound, the last one everything."""
    return [F.count_if(value <= b).alias(f"le_{b:g}") for b in bounds] + [F.count(value).alias("le_inf")]


#: Milliseconds between the starts of pages when a manifest is played again, and after the last page.  Fixed values.
PAGE_STAGGER_MS, DONE_AFTER_MS = 140, 40
STAGES = ("probe", "ocr", "vision", "answers")


def timeline(routes: DataFrame) -> DataFrame:
    """Bars of each page's stages: stage, begin, share of the total in percent (begin_pct, width_pct, 0.6 at least).

    routes: keys and probe, ocr, vision, answers, total in ms, null for a stage that didn't run.
    Reading by OCR and by vision is parallel; answers end with the total.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = F.greatest(zero("total"), zero("probe") + F.greatest(zero("ocr"), zero("vision")) + zero("answers"), F.lit(1))
    begin = {"probe": F.lit(0), "ocr": zero("probe"), "vision": zero("probe"), "answers": F.col("whole") - zero("answers")}
    keys = [c for c in routes.columns if c not in (*STAGES, "total", "ocr_failed")]
    bars = F.array(*[F.struct(F.lit(k).alias("stage"), begin[k].cast("long").alias("begin"), F.col(k).cast("long").alias("length")) for k in STAGES])
    r = routes.withColumn("whole", total).select(*keys, "whole", F.explode(bars).alias("bar")).filter("bar.length is not null")
    return r.select(*keys, "bar.stage", "bar.begin", (F.col("bar.begin") / F.col("whole") * 100).alias("begin_pct"), F.greatest(F.lit(0.6), F.col("bar.length") / F.col("whole") * 100).alias("width_pct"))


def replayed(routes: DataFrame) -> DataFrame:
    """Events doc_id, page, stage, state, at that a stored manifest is played with; page -1 for the document's own.

    routes: doc_id, page, ocr_failed and the columns of timeline().  A page that wasn't probed has its
    decision alone; one that wasn't read skips OCR and vision.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    start = F.col("page") * PAGE_STAGGER_MS
    probed, read = start + zero("probe"), F.col("ocr").isNotNull() | F.col("vision").isNotNull()
    asked = F.greatest(probed + F.greatest(zero("ocr"), zero("vision")), start + zero("total") - zero("answers"))
    was = F.col("probe").isNotNull()
    has = lambda c: was & F.col(c).isNotNull()
    failed = was & read & F.col("ocr").isNull() & F.col("ocr_failed")
    end = F.when(has("answers"), F.greatest(start + zero("total"), asked + F.col("answers"))).otherwise(start + zero("total"))
    event = lambda when, stage, state, at: F.when(when, F.struct(F.lit(stage).alias("stage"), F.lit(state).alias("state"), at.cast("long").alias("at")))
    out = [
        event(was, "probe", "start", start),
        event(was, "probe", "done", probed),
        event(has("ocr"), "ocr", "start", probed),
        event(has("ocr"), "ocr", "done", probed + zero("ocr")),
        event(failed, "ocr", "start", probed),
        event(failed, "ocr", "fail", probed),
        event(was & F.col("ocr").isNull() & ~failed, "ocr", "skip", probed),
        event(was & read, "vision", "start", probed),
        event(has("vision"), "vision", "done", probed + zero("vision")),
        event(was & read & F.col("vision").isNull(), "vision", "fail", probed),
        event(was & ~read, "vision", "skip", probed),
        event(has("answers"), "answers", "start", asked),
        event(has("answers"), "answers", "done", asked + zero("answers")),
        event(F.lit(True), "policy", "done", end),
    ]
    per_page = routes.select("doc_id", "page", F.explode(F.array_compact(F.array(*out))).alias("e")).select("doc_id", "page", "e.stage", "e.state", "e.at")
    docs = per_page.groupBy("doc_id").agg(F.max(F.when(F.col("stage") == "policy", F.col("at"))).alias("end"))
    own = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("start").alias("state"), F.lit(0).cast("long").alias("at")), F.struct(F.lit("done").alias("state"), (F.col("end") + DONE_AFTER_MS).alias("at")))).alias("e"))
    return per_page.unionByName(own.select("doc_id", F.lit(-1).alias("page"), F.lit("doc").alias("stage"), "e.state", "e.at"))


def recorded(events: DataFrame) -> DataFrame:
    """Events (id, job, name, type) of the newest finished job of each name."""
    done = events.filter("type = 'job.done'").select("job").distinct()
    newest = events.filter("type = 'job.queued'").join(done, "job", "left_semi").groupBy("name").agg(F.max_by("job", "id").alias("job"))
    return events.join(newest.select("job").distinct(), "job", "left_semi")


def live(events: DataFrame, now: Column, skew_us: int = 0, window_s: int = 5) -> DataFrame:
    """type, live, past: events younger than the window by a clock set right by its skew, and others."""
    age = F.unix_micros(now) + skew_us - F.unix_micros("ts")
    return events.groupBy("type").agg(F.count_if(age < window_s * 1_000_000).alias("live"), F.count_if(age >= window_s * 1_000_000).alias("past"))
