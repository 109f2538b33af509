"""Named queries on the job queue, the event stream and the live view's state, with their SQL; a job is a user of `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import lifecycle, queue

Spark = SparkSession
#: Small ranges, so that the tables at hand have several.
RANGE = 1000


def _events(spark: Spark, d: str) -> DataFrame:
    """Job events; every fourth end is a failure."""
    return lifecycle.job_events(spark, d).withColumn("failed", (F.col("type") == "job.done") & (F.col("id") % 4 == 0))


def gcra_waits(spark: Spark, d: str) -> DataFrame:
    return queue.slots(_events(spark, d), 1_300_000_000, size=RANGE)


def local_waits(spark: Spark, d: str) -> DataFrame:
    """The same limit in each process (every third event goes to one) by itself."""
    e = _events(spark, d).withColumn("process", F.concat_ws("/", "type", F.col("id") % 3))
    return queue.slots(e, 3_900_000_000, key="process", size=RANGE)


def occupancy(spark: Spark, d: str) -> DataFrame:
    return queue.occupancy(_events(spark, d), size=RANGE)


def enqueue_once(spark: Spark, d: str) -> DataFrame:
    return queue.enqueued(_events(spark, d))


def dead_letter_rows(spark: Spark, d: str) -> DataFrame:
    return queue.dead_letters(_events(spark, d))


def idle_jobs(spark: Spark, d: str) -> DataFrame:
    return queue.idle(_events(spark, d), 36_000)


def unacked_messages(spark: Spark, d: str) -> DataFrame:
    return queue.unacked(_events(spark, d))


def job_hashes(spark: Spark, d: str) -> DataFrame:
    return queue.hashes(_events(spark, d))


def admission(spark: Spark, d: str) -> DataFrame:
    return queue.admitted(_events(spark, d), most=10, size=RANGE)


def job_lookup(spark: Spark, d: str) -> DataFrame:
    """Jobs of even number up to 200 have an index; live hashes of every third job are gone."""
    index = spark.range(0, 201, 2).withColumnRenamed("id", "job")
    return queue.looked_up(index, queue.hashes(_events(spark, d)).filter("job % 3 <> 0"))


def worker_replicas(spark: Spark, d: str) -> DataFrame:
    return queue.replicas(queue.hashes(_events(spark, d)))


def smoke_run(spark: Spark, d: str) -> DataFrame:
    e = _events(spark, d)
    return queue.smoke(queue.hashes(e), queue.dead_letters(e), queue.occupancy(e, size=RANGE))


def start_outcomes(spark: Spark, d: str) -> DataFrame:
    return queue.outcomes(_events(spark, d))


def event_tail(spark: Spark, d: str) -> DataFrame:
    """The last 100 events behind a cursor, by stream ids whose text order isn't theirs."""
    e = _events(spark, d).select("id", queue.stream_id(F.col("ts"), F.col("id") % 13).alias("stream_id"))
    return queue.tail(e.filter(queue.after(F.col("stream_id"), "1704500000000-9")), 100)


def event_frames(spark: Spark, d: str) -> DataFrame:
    """Frames of one job's events, keepalives passing for every job."""
    e = _events(spark, d).withColumns({"stream_id": queue.stream_id(F.col("ts"), F.lit(0)), "data": F.when(F.col("id") % 10 > 0, F.to_json(F.struct("type", "job")))})
    return e.filter("job = 7 or data is null").select("id", queue.frames(e).alias("frame"))


def slow_viewers(spark: Spark, d: str) -> DataFrame:
    """A viewer for each type of event, who has read up to some id."""
    e = _events(spark, d).select(F.col("type").alias("viewer"), "id")
    read = e.groupBy("viewer").agg((F.max("id") / F.length("viewer")).cast("long").alias("upto")).filter("viewer <> 'job.done'")
    return queue.slow_viewers(e, read, most=1200)


def _documents(spark: Spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stage events, documents with the event that announced them, and retries; a job has three documents."""
    e = _events(spark, d)
    doc = F.concat_ws("-", "job", F.col("ms") % 3)
    kind = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    stages = e.filter("type = 'page.stage'").select("id", "job", doc.alias("doc"), (F.col("ms") % 7).cast("int").alias("page"), kind(F.col("id"), "probe", "ocr", "vision", "jev", "policy").alias("stage"), kind(F.floor(F.col("id") / 5), "start", "done", "fail", "done").alias("state"), F.when(F.col("id") % 3 > 0, F.col("ms")).alias("ms"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("e"), F.col("id"))).alias("evidence"))
    docs = e.filter("type = 'job.queued'").groupBy(doc.alias("doc"), "job").agg(F.min("id").alias("announced"))
    return stages, docs, e.filter("type = 'job.retry'").select("job", "id")


def page_states(spark: Spark, d: str) -> DataFrame:
    return queue.page_states(*_documents(spark, d))


def page_fill(spark: Spark, d: str) -> DataFrame:
    return queue.filled(queue.page_states(*_documents(spark, d)))


def kept_documents(spark: Spark, d: str) -> DataFrame:
    _, docs, _ = _documents(spark, d)
    return queue.forgotten(docs, _events(spark, d).groupBy("job").agg(F.min("id").alias("first_id")), keep=40)


def segment_view(spark: Spark, d: str) -> DataFrame:
    """Documents whose job ended have segments of two pages; others a run for each page with a decided lane."""
    pages = queue.page_states(*_documents(spark, d)).withColumn("lane", F.when(F.col("policy") == "done", F.concat(F.lit("L"), F.col("page") % 5 + 1)))
    ended = _events(spark, d).filter("type = 'job.done'").select("job").distinct()
    finished = pages.withColumn("job", F.split("doc", "-")[0].cast("long")).join(ended, "job", "left_semi").groupBy("doc", (F.floor(F.col("page") / 2) * 2).cast("int").alias("start")).agg(F.max("page").alias("stop"), F.max("lane").alias("lane"))
    return queue.shown_segments(finished.select("doc", "start", "stop", "lane"), pages.select("doc", "page", "lane"))


def cached_events(spark: Spark, d: str) -> DataFrame:
    """What a job reports of documents routed before (every third): that they are there and done, nothing of their pages."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (F.col("doc_id") % 3 == 0).alias("cached"))
    stages = F.when(F.col("cached"), F.array(F.lit("doc"), F.lit("doc.done"))).otherwise(F.array(*map(F.lit, ("doc", "page.stage", "doc.done"))))
    return docs.select("doc_id", F.explode(stages).alias("event"))


QUERIES = {f.__name__: f for f in (gcra_waits, local_waits, occupancy, enqueue_once, dead_letter_rows, idle_jobs, unacked_messages, job_hashes, admission, job_lookup, worker_replicas, smoke_run, start_outcomes, event_tail, event_frames, slow_viewers, page_states, page_fill, kept_documents, segment_view, cached_events)}


def oracles(events_sql: str) -> dict[str, str]:
    ev = events_sql + """, f AS (SELECT *, type = 'job.done' AND id % 4 = 0 AS failed FROM e), s AS (SELECT *, CASE WHEN failed THEN 'failed' WHEN type = 'job.queued' THEN 'queued' WHEN type = 'job.started' THEN 'running' WHEN type = 'job.retry' THEN 'queued' WHEN type = 'job.done' THEN 'done' END AS status FROM f),
        st AS (SELECT *, lag(status) OVER w AS before, lag(type) OVER w AS before_type, lag(ms) OVER w AS before_ms FROM s WHERE status IS NOT NULL WINDOW w AS (PARTITION BY job ORDER BY id))"""
    hashes = ev + """, h AS (SELECT job, arg_max(status, id) AS status, arg_max(type, id) AS type, arg_max(coalesce(ms::VARCHAR, '?'), id) AS ms, arg_max(epoch_us(ts), id) AS ended FROM s WHERE status IS NOT NULL GROUP BY job),
        hh AS (SELECT job, status, CASE WHEN type = 'job.retry' OR status = 'failed' THEN 'took ' || ms END AS error, CASE WHEN status IN ('done', 'failed') THEN ended + 604800000000 END AS expires FROM h)"""
    waits = lambda key, interval: f"""r AS (SELECT id, {key} AS k, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY id) AS i FROM e) SELECT id, k AS {{}}, max(t - i * {interval}) OVER (PARTITION BY k ORDER BY i) + i * {interval} - t AS wait_us FROM r"""
    dead = """SELECT job, id AS message, 'gave up after 3 deliveries: ' || CASE WHEN before_type = 'job.retry' THEN 'took ' || before_ms ELSE 'worker lost' END AS error FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY id) AS n FROM st WHERE type = 'job.started') WHERE n = 4"""
    docked = "SELECT id, job % 8 AS node, sum(step) OVER (PARTITION BY job % 8 ORDER BY id)::BIGINT AS docked FROM (SELECT *, CASE WHEN type = 'job.started' THEN 1 WHEN type IN ('job.done', 'job.retry') THEN -1 END AS step FROM e) WHERE step IS NOT NULL"
    stages = ["probe", "ocr", "vision", "jev", "policy"]
    pages = ev + f""", pe AS (SELECT id, job, job || '-' || ms % 3 AS doc, (ms % 7)::INT AS page, {stages}[id % 5 + 1] AS stage, ['start', 'done', 'fail', 'done'][id // 5 % 4 + 1] AS state, CASE WHEN id % 3 > 0 THEN ms END AS ms, CASE WHEN id % 4 > 0 THEN 'e' || id END AS evidence FROM e WHERE type = 'page.stage'),
        an AS (SELECT job || '-' || ms % 3 AS doc, job, min(id) AS announced FROM e WHERE type = 'job.queued' GROUP BY ALL), re AS (SELECT job, max(id) AS retried FROM e WHERE type = 'job.retry' GROUP BY job),
        pk AS (SELECT pe.* FROM pe JOIN an USING (doc) LEFT JOIN re ON re.job = an.job WHERE pe.id > greatest(announced, coalesce(retried, -1))),
        ps AS (SELECT doc, page, {', '.join(f"arg_max(state, id) FILTER (stage = '{s}') AS {s}, arg_max(ms, id) FILTER (stage = '{s}' AND state = 'done' AND ms IS NOT NULL) AS {s}_ms" for s in stages)},
            nullif(arg_max(coalesce(evidence, ''), id) FILTER (state = 'done' AND (stage = 'probe' OR (stage IN ('jev', 'policy') AND evidence IS NOT NULL))), '') AS evidence FROM pk GROUP BY doc, page)"""
    return {
        "gcra_waits": f"WITH {events_sql}, {waits('type', 1300000000).format('type')}",
        "local_waits": f"WITH {events_sql}, {waits("type || '/' || id % 3", 3900000000).format('process')}",
        "occupancy": f"WITH {events_sql} {docked}",
        "enqueue_once": f"WITH {ev} SELECT id, job, before IS NULL OR before = 'failed' AS accepted FROM st WHERE type = 'job.queued'",
        "dead_letter_rows": f"WITH {ev} {dead}",
        "idle_jobs": f"""WITH {ev}, n AS (SELECT max(epoch_us(ts)) AS now FROM e), j AS (SELECT job, max(epoch_us(ts)) FILTER (type IN ('job.started', 'page.stage')) AS beat, arg_max(type, id) FILTER (type IN ('job.started', 'job.done', 'job.retry')) AS last FROM e GROUP BY job)
            SELECT job, now - beat AS idle_us, now - beat > 36000000000 AS reclaim FROM j, n WHERE last = 'job.started'""",
        "unacked_messages": f"WITH {ev}, l AS (SELECT job, max(id) FILTER (type = 'job.started') AS message, max(id) FILTER (type = 'job.done') AS done FROM e GROUP BY job) SELECT job, message FROM l WHERE message IS NOT NULL AND coalesce(done, -1) < message",
        "job_hashes": f"WITH {hashes} SELECT * FROM hh",
        "admission": f"WITH {ev}, u AS (SELECT id, type, sum(CASE type WHEN 'job.queued' THEN 1 WHEN 'job.started' THEN -1 ELSE 0 END) OVER (ORDER BY id)::BIGINT - 1 AS backlog FROM e) SELECT id, backlog, backlog <= 10 AS admitted FROM u WHERE type = 'job.queued'",
        "job_lookup": f"""WITH {hashes}, i AS (SELECT unnest(range(0, 201, 2)) AS job), l AS (SELECT job, status FROM hh WHERE job % 3 <> 0)
            SELECT coalesce(i.job, l.job) AS job, CASE WHEN i.job IS NOT NULL AND (status IS NULL OR status = 'done') THEN 'done' ELSE status END AS status, CASE WHEN i.job IS NOT NULL AND (status IS NULL OR status = 'done') THEN 'index' ELSE 'live' END AS found FROM i FULL JOIN l ON i.job = l.job""",
        "worker_replicas": f"WITH {hashes}, n AS (SELECT count(*) FILTER (status IN ('queued', 'running')) AS unfinished, count(*) FILTER (status = 'running') AS pending FROM hh) SELECT unfinished, pending, least(6, greatest(ceil(unfinished / 32), ceil(pending / 32)))::INT AS replicas FROM n",
        "smoke_run": f"WITH {hashes}, d AS ({dead}), o AS ({docked}) SELECT count(*) AS jobs, count(*) FILTER (status = 'done') AS done, (SELECT count(*) FROM d) AS dead, (SELECT max(docked) FROM o) AS peak, count(*) = count(*) FILTER (status = 'done') AND (SELECT count(*) FROM d) = 0 AS well FROM hh",
        "start_outcomes": f"WITH {ev}, o AS (SELECT id, job, type, lead(CASE type WHEN 'job.done' THEN status WHEN 'job.retry' THEN 'retry' ELSE 'lost' END) OVER (PARTITION BY job ORDER BY id) AS outcome FROM s WHERE status IS NOT NULL AND type <> 'job.queued') SELECT id, job, coalesce(outcome, 'lost') AS outcome FROM o WHERE type = 'job.started'",
        "event_tail": f"WITH {events_sql} SELECT id, (epoch_us(ts) // 1000) || '-' || id % 13 AS stream_id FROM e WHERE epoch_us(ts) // 1000 > 1704500000000 OR (epoch_us(ts) // 1000 = 1704500000000 AND id % 13 > 9) ORDER BY id DESC LIMIT 100",
        "event_frames": f"""WITH {events_sql} SELECT id, CASE WHEN id % 10 = 0 THEN ': keepalive' || chr(10) || chr(10) ELSE 'id: ' || (epoch_us(ts) // 1000) || '-0' || chr(10) || 'event: ' || type || chr(10) || 'data: {{"type":"' || type || '","job":' || job || '}}' || chr(10) || chr(10) END AS frame FROM e WHERE job = 7 OR id % 10 = 0""",
        "slow_viewers": f"WITH {events_sql}, r AS (SELECT type, trunc(max(id) / length(type))::BIGINT AS upto FROM e WHERE type <> 'job.done' GROUP BY type) SELECT e.type AS viewer, count(*) FILTER (id > coalesce(upto, -1)) AS waiting, count(*) FILTER (id > coalesce(upto, -1)) > 1200 AS dropped FROM e LEFT JOIN r USING (type) GROUP BY e.type",
        "page_states": f"WITH {pages} SELECT * FROM ps",
        "page_fill": f"WITH {pages}, u AS (SELECT doc, max(page) AS last FROM ps GROUP BY doc), a AS (SELECT doc, unnest(range(0, last + 1))::INT AS page FROM u) SELECT a.doc, a.page, ps.doc IS NOT NULL AS known FROM a LEFT JOIN ps ON a.doc = ps.doc AND a.page = ps.page",
        "kept_documents": f"WITH {pages}, nj AS (SELECT job FROM e GROUP BY job ORDER BY min(id) DESC LIMIT 40) SELECT doc, arg_max(job, announced) AS job FROM an GROUP BY doc HAVING arg_max(job, announced) IN (SELECT job FROM nj)",
        "segment_view": f"""WITH {pages}, pl AS (SELECT doc, page, CASE WHEN policy = 'done' THEN 'L' || page % 5 + 1 END AS lane, split_part(doc, '-', 1)::BIGINT IN (SELECT job FROM e WHERE type = 'job.done') AS ended FROM ps)
            SELECT doc, (page // 2 * 2)::INT AS start, max(page) AS stop, max(lane) AS lane FROM pl WHERE ended GROUP BY ALL UNION ALL SELECT doc, page, page, lane FROM pl WHERE NOT ended AND lane IS NOT NULL""",
        "cached_events": "SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN ['doc', 'doc.done'] ELSE ['doc', 'page.stage', 'doc.done'] END) AS event FROM documents",
    }
