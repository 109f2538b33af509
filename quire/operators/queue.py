"""The job queue and the live view in batch form: attempts, deliveries, hashes of jobs, page states, running totals.

`events` are job events (id, ts, job, type, ms) as lifecycle.job_events gives them; a done event may have `failed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Attempts at a job, how long a finished job is remembered, and limits of queue, stream and viewers.  Fixed values.
MOST_DELIVERIES, REMEMBER_S, MOST_BACKLOG, KEPT_EVENTS, BUFFERED, RECENT_JOBS = 3, 7 * 24 * 3600, 1000, 20_000, 2000, 500
#: Documents a worker is meant to have, and those in flight per replica.  Fixed values.
PER_WORKER = 32
STATUS = {"job.queued": "queued", "job.started": "running", "job.retry": "queued", "job.done": "done"}
#: Ids that one range of a running total should hold.
RANGE = 1 << 16


def status_of(kind: Column, failed: Column) -> Column:
    named = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), kind)
    return F.when(failed, "failed").otherwise(named)


def running(rows: DataFrame, by: str, value: str, name: str, largest: bool = False, size: int = RANGE) -> DataFrame:
    """rows (with id) and `name`: the sum (or largest) of value up to each row of its `by`, in order of id.

    Ids are cut into ranges; these are summed up first, so that even a single key's rows are dealt over many tasks.
    """
    take = F.max if largest else F.sum
    r = rows.withColumn("_range", F.floor(F.col("id") / size))
    ranges = r.groupBy(by, "_range").agg(take(value).alias("_own"))
    before = take("_own").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(by, "_range", before.alias("_before"))
    inside = take(value).over(Window.partitionBy(by, "_range").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = r.withColumn("_inside", inside).join(ranges, [by, "_range"])
    whole = F.greatest("_inside", "_before") if largest else F.col("_inside") + F.coalesce("_before", F.lit(0))
    return joined.withColumn(name, whole).drop("_range", "_inside", "_before")


def slots(calls: DataFrame, interval_us: int, key: str = "type", size: int = RANGE) -> DataFrame:
    """id, key, wait_us: how long each call (id in order of ts) waits for its slot, one an interval for each key.

    start_i = max(t_i, start_{i-1} + interval) is the largest t_j - j * interval so far, plus i * interval.
    """
    c = running(calls.select("id", key, F.unix_micros("ts").alias("t"), F.lit(1).cast("long").alias("one")), key, "one", "i", size=size)
    c = running(c.withColumn("lead", F.col("t") - F.col("i") * interval_us), key, "lead", "most", largest=True, size=size)
    return c.select("id", key, (F.col("most") + F.col("i") * interval_us - F.col("t")).alias("wait_us"))


def occupancy(events: DataFrame, nodes: int = 8, size: int = RANGE) -> DataFrame:
    """Jobs that run after each start or end, by node (job modulo nodes)."""
    step = F.when(F.col("type") == "job.started", 1).when(F.col("type").isin("job.done", "job.retry"), -1)
    e = events.select("id", (F.col("job") % nodes).alias("node"), step.cast("long").alias("step")).filter("step is not null")
    return running(e, "node", "step", "docked", size=size).select("id", "node", "docked")


def _statuses(events: DataFrame) -> DataFrame:
    s = events.withColumn("status", status_of(F.col("type"), F.col("failed"))).filter("status is not null")
    before = Window.partitionBy("job").orderBy("id")
    return s.withColumns({"before": F.lag("status").over(before), "before_type": F.lag("type").over(before), "before_ms": F.lag("ms").over(before)})


def enqueued(events: DataFrame) -> DataFrame:
    """id, job, accepted: a job is queued unless it is known; one that failed starts over with no deliveries."""
    return _statuses(events).filter("type = 'job.queued'").select("id", "job", (F.col("before").isNull() | (F.col("before") == "failed")).alias("accepted"))


def dead_letters(events: DataFrame, most: int = MOST_DELIVERIES) -> DataFrame:
    """job, message, error of the delivery beyond the limit; the error is what the last attempt left, or that its worker was lost."""
    s = _statuses(events)
    nth = F.row_number().over(Window.partitionBy("job").orderBy("id"))
    left = F.when(F.col("before_type") == "job.retry", F.concat(F.lit("took "), F.col("before_ms").cast("string"))).otherwise("worker lost")
    d = s.filter("type = 'job.started'").withColumn("nth", nth).filter(F.col("nth") == most + 1)
    return d.select("job", F.col("id").alias("message"), F.concat(F.lit(f"gave up after {most} deliveries: "), left).alias("error"))


def idle(events: DataFrame, limit_s: int) -> DataFrame:
    """job, idle_us, reclaim of jobs in flight: time since their last start or heartbeat (a page's stage) at the end of the log."""
    now = events.agg(F.max(F.unix_micros("ts")).alias("now"))
    beat = F.max(F.when(F.col("type").isin("job.started", "page.stage"), F.unix_micros("ts")))
    last = F.max_by("type", F.when(F.col("type").isin("job.started", "job.done", "job.retry"), F.col("id")))
    jobs = events.groupBy("job").agg(beat.alias("beat"), last.alias("last")).filter("last = 'job.started'")
    return jobs.join(F.broadcast(now)).select("job", (F.col("now") - F.col("beat")).alias("idle_us"), (F.col("now") - F.col("beat") > limit_s * 1_000_000).alias("reclaim"))  # now is one row


def unacked(events: DataFrame) -> DataFrame:
    """job, message: deliveries whose job hasn't ended since; acknowledging deletes them."""
    last = events.groupBy("job").agg(F.max(F.when(F.col("type") == "job.started", F.col("id"))).alias("message"), F.max(F.when(F.col("type") == "job.done", F.col("id"))).alias("done"))
    return last.filter("message is not null and (done is null or done < message)").select("job", "message")


def hashes(events: DataFrame) -> DataFrame:
    """job, status, error, expires (microseconds): a job's hash; an error lasts until the next status, finished jobs are remembered for a while."""
    at = F.struct("id", "status", "type", "ms", F.unix_micros("ts").alias("at"))
    last = events.withColumn("status", status_of(F.col("type"), F.col("failed"))).filter("status is not null").groupBy("job").agg(F.max(at).alias("l"))
    error = F.when((F.col("l.type") == "job.retry") | (F.col("l.status") == "failed"), F.concat(F.lit("took "), F.coalesce(F.col("l.ms").cast("string"), F.lit("?"))))
    return last.select("job", "l.status", error.alias("error"), F.when(F.col("l.status").isin("done", "failed"), F.col("l.at") + REMEMBER_S * 1_000_000).alias("expires"))


def admitted(events: DataFrame, most: int = MOST_BACKLOG, size: int = RANGE) -> DataFrame:
    """id, backlog, admitted of each submission: jobs queued and not started before it against the limit."""
    step = F.when(F.col("type") == "job.queued", 1).when(F.col("type") == "job.started", -1).otherwise(0).cast("long")
    e = running(events.select("id", "type", step.alias("step"), F.lit(0).alias("all")), "all", "step", "upto", size=size).filter("type = 'job.queued'")
    return e.select("id", (F.col("upto") - 1).alias("backlog"), (F.col("upto") - 1 <= most).alias("admitted"))


def looked_up(index: DataFrame, live: DataFrame) -> DataFrame:
    """job, status, found: the durable index (job) for finished and unknown jobs, else the live hash (job, status)."""
    both = index.select("job", F.lit(True).alias("kept")).join(live.select("job", "status"), "job", "full")
    durable = F.col("kept").isNotNull() & (F.col("status").isNull() | (F.col("status") == "done"))
    return both.select("job", F.when(durable, "done").otherwise(F.col("status")).alias("status"), F.when(durable, "index").otherwise("live").alias("found"))


def replicas(job_hashes: DataFrame, per_worker: int = PER_WORKER, least: int = 0, most: int = 6) -> DataFrame:
    """unfinished, pending, replicas: workers wanted by unfinished documents and by those in flight."""
    n = job_hashes.agg(F.count_if(F.col("status").isin("queued", "running")).alias("unfinished"), F.count_if(F.col("status") == "running").alias("pending"))
    return n.withColumn("replicas", F.greatest(F.lit(least), F.least(F.lit(most), F.greatest(F.ceil(F.col("unfinished") / per_worker), F.ceil(F.col("pending") / per_worker)))).cast("int"))


def smoke(job_hashes: DataFrame, dead: DataFrame, occupied: DataFrame) -> DataFrame:
    """What a run is asserted on: jobs, those done, dead letters, most jobs at once on a node, and whether all is well."""
    n = job_hashes.agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "done").alias("done"))
    more = n.join(F.broadcast(dead.agg(F.count("*").alias("dead")))).join(F.broadcast(occupied.agg(F.max("docked").alias("peak"))))  # one row each
    return more.withColumn("well", (F.col("jobs") == F.col("done")) & (F.col("dead") == 0))


def outcomes(events: DataFrame) -> DataFrame:
    """id, job, outcome of each start: done, failed, retry, or lost where the job starts again or nothing follows."""
    s = events.withColumn("status", status_of(F.col("type"), F.col("failed"))).filter("status is not null and type <> 'job.queued'")
    following = F.lead(F.when(F.col("type") == "job.done", F.col("status")).when(F.col("type") == "job.retry", "retry").otherwise("lost")).over(Window.partitionBy("job").orderBy("id"))
    return s.withColumn("outcome", F.coalesce(following, F.lit("lost"))).filter("type = 'job.started'").select("id", "job", "outcome")


# The event stream and what is folded from it.


def stream_id(ts: Column, seq: Column) -> Column:
    """Ids of a stream: milliseconds and a sequence number."""
    return F.concat_ws("-", F.unix_millis(ts), seq)


def after(a: Column, b: str) -> Column:
    """Whether stream id a comes behind b: by milliseconds, then by number, never as text."""
    ms, seq = (int(x) for x in b.split("-"))
    at = F.split(a, "-")
    return F.struct(at[0].cast("long").alias("ms"), at[1].cast("long").alias("seq")) > F.struct(F.lit(ms).cast("long").alias("ms"), F.lit(seq).cast("long").alias("seq"))


def tail(events: DataFrame, last: int) -> DataFrame:
    """The last events, oldest first, by a top-k that no task needs all events for."""
    return events.orderBy(F.desc("id")).limit(last).orderBy("id")


def frames(events: DataFrame) -> Column:
    """Server-sent frames of events (stream_id, type, data); null data is a keepalive."""
    return F.when(F.col("data").isNull(), F.lit(": keepalive\n\n")).otherwise(F.concat(F.lit("id: "), "stream_id", F.lit("\nevent: "), "type", F.lit("\ndata: "), "data", F.lit("\n\n")))


def slow_viewers(sent: DataFrame, read: DataFrame, most: int = BUFFERED) -> DataFrame:
    """viewer, waiting, dropped: events sent (viewer, id) beyond what a viewer has read (viewer, upto)."""
    w = sent.join(read, "viewer", "left").groupBy("viewer").agg(F.count_if(F.col("id") > F.coalesce("upto", F.lit(-1))).alias("waiting"))
    return w.withColumn("dropped", F.col("waiting") > most)


def page_states(stages: DataFrame, docs: DataFrame, retries: DataFrame) -> DataFrame:
    """doc, page, a column for each stage's last state and milliseconds, evidence: pages folded from their events.

    stages: id, job, doc, page, stage, state, ms, evidence; docs: doc, job, announced (id); retries: job, id.  Events of a
    document that isn't announced yet are ignored, and a retry of its job starts its pages over.  Facts come with done
    events alone: a probe's evidence replaces what there was (even by nothing), later stages' only where they have some.
    """
    start = retries.groupBy("job").agg(F.max("id").alias("retried"))
    known = docs.join(start, "job", "left").select("doc", F.greatest("announced", F.coalesce("retried", F.lit(-1))).alias("since"))
    e = stages.join(known, "doc").filter(F.col("id") > F.col("since"))
    done = F.col("state") == "done"
    names = ("probe", "ocr", "vision", "jev", "policy")
    of = lambda s: F.col("stage") == s
    last = [F.max_by("state", F.when(of(s), F.col("id"))).alias(s) for s in names]
    ms = [F.max_by("ms", F.when(of(s) & done & F.col("ms").isNotNull(), F.col("id"))).alias(f"{s}_ms") for s in names]
    shown = F.max(F.when(done & (of("probe") | (F.col("stage").isin("jev", "policy") & F.col("evidence").isNotNull())), F.struct("id", "evidence")))
    return e.groupBy("doc", "page").agg(*last, *ms, shown["evidence"].alias("evidence"))


def filled(pages: DataFrame) -> DataFrame:
    """doc, page for all pages up to each document's last one, blank where nothing is known of a page."""
    upto = pages.groupBy("doc").agg(F.max("page").alias("last"))
    return upto.select("doc", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("page")).join(pages.select("doc", "page", F.lit(True).alias("known")), ["doc", "page"], "left").select("doc", "page", F.coalesce("known", F.lit(False)).alias("known"))


def forgotten(docs: DataFrame, first_seen: DataFrame, keep: int = RECENT_JOBS) -> DataFrame:
    """doc, job of documents that stay when only the newest jobs (job, first_id) are kept; a document is its last announcer's."""
    owner = docs.groupBy("doc").agg(F.max_by("job", "announced").alias("job"))
    newest = first_seen.orderBy(F.desc("first_id")).limit(keep).select("job")
    return owner.join(newest, "job", "left_semi").select("doc", "job")


def shown_segments(finished: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, start, stop, lane: segments of finished documents, else a run for each page that has a lane."""
    open_ = pages.join(finished.select("doc").distinct(), "doc", "left_anti").filter("lane is not null")
    return finished.unionByName(open_.select("doc", F.col("page").alias("start"), F.col("page").alias("stop"), "lane"))
