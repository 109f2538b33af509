"""Streams that are killed, stopped and begun again: what lands, what is remembered, and what their state holds."""

import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quire.plans import live as plans
from quire.sources import log
from quire.streaming import landing, live

DATA = "/root/testdata/sf0.001"


def numbers(spark, folder, batches=3):
    for i in range(batches):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.01)
    return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_batch_killed_between_sinks_lands_once(spark, tmp_path):
    stream = numbers(spark, f"{tmp_path}/in")
    deaths = iter([1])

    def odd(batch):
        if batch.filter("id = 15").count() and next(deaths, None):
            raise RuntimeError("killed")
        return batch.filter("id % 2 = 1")

    to = landing.Landing(spark, f"{tmp_path}/out", {"all": lambda b: b, "odd": odd})
    with pytest.raises(StreamingQueryException):
        landing.started(stream, to, f"{tmp_path}/c", "append").awaitTermination()
    assert to.table("all").count() == 10 < spark.read.parquet(f"{tmp_path}/out/all").count()  # what broke off isn't seen
    landing.started(stream, to, f"{tmp_path}/c", "append").awaitTermination()
    assert sorted(r.id for r in to.table("all").collect()) == list(range(30)) and sorted(r.id for r in to.table("odd").collect()) == list(range(1, 30, 2))
    to(spark.range(100, 110), 1)  # a batch that has landed is left alone
    assert to.table("all").agg(F.max("id")).first()[0] == 29
    with pytest.raises(ValueError):
        landing.Landing(spark, f"{tmp_path}/out", {landing.LEDGER: lambda b: b})


def test_drain_and_go_on(spark, tmp_path):
    stream = numbers(spark, f"{tmp_path}/in", 6)
    to = landing.Landing(spark, f"{tmp_path}/out", {"all": lambda b: b})
    query = landing.started(stream, to, f"{tmp_path}/c", "append", once=False, every="0 seconds")
    until = time.time() + 60
    while query.lastProgress is None and time.time() < until:
        time.sleep(0.02)
    landing.drained(query)
    assert not query.isActive and 0 < to.table("all").count() <= 60
    landing.started(stream, to, f"{tmp_path}/c", "append").awaitTermination()
    assert sorted(r.id for r in to.table("all").collect()) == list(range(60))


def events(rows):
    """(id, second, job, type, doc, page, stage, state, evidence) as rows of EVENT."""
    return [(i, s, s * 1000, job, kind, 5, False, doc, page, stage, state, evidence) for i, s, job, kind, doc, page, stage, state, evidence in rows]


COLUMNS = live.EVENT.replace("ts timestamp", "ts long")


def instalment(spark, folder, rows):
    spark.createDataFrame(events(rows), COLUMNS).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(live.EVENT).parquet(folder)


def test_pages_over_restarts_with_orphans_retries_and_repeats(spark, tmp_path):
    e = lambda i, s, kind, doc=None, page=None, stage=None, state=None, evidence=None: (i, s, 1, kind, doc, page, stage, state, evidence)
    to = landing.Landing(spark, f"{tmp_path}/out", {"view": lambda b: b})
    now = lambda: {(r.doc, r.page): (r.probe, r.probe_ms, r.evidence) for r in live.pages_now(to.table("view")).collect()}

    def run(rows):
        landing.started(live.viewed(instalment(spark, f"{tmp_path}/in", rows), remember_s=1000), to, f"{tmp_path}/c").awaitTermination()

    run([e(0, 1, "page.stage", "d", 0, "probe", "done", "orphan"), e(1, 2, "job.queued", "d"), e(2, 3, "job.started"), e(3, 4, "page.stage", "d", 0, "probe", "done", "x"), e(4, 5, "page.stage", "d", 2, "probe", "start")])
    assert now() == {("d", 0): ("done", 5, "x"), ("d", 2): ("start", None, None)}
    # an event that is delivered again, and a late announcement of what is known, change nothing; jev without evidence keeps it
    run([e(3, 4, "page.stage", "d", 0, "probe", "fail", "again"), e(5, 6, "job.queued", "d"), e(6, 7, "page.stage", "d", 0, "jev", "done", None)])
    assert now() == {("d", 0): ("done", 5, "x"), ("d", 2): ("start", None, None)}
    run([e(7, 8, "job.retry"), e(8, 9, "page.stage", "d", 1, "probe", "done", None)])
    assert now() == {("d", 1): ("done", 5, None)}
    assert [tuple(r) for r in live.jobs_now(to.table("view")).collect()] == [(1, "queued", 1, 1)]
    # the job ends and is forgotten 1000 s later, when another job's event tells the time
    run([e(9, 10, "job.done"), (10, 5000, 2, "job.queued", "e", None, None, None, None)])
    run([(11, 5001, 2, "job.started", None, None, None, None, None)])
    assert now() == {} and [(r.job, r.pages) for r in to.table("view").filter("kind = 'forgotten'").collect()] == [(1, 1_010_000)]
    state = lambda name: spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", name).load()
    assert state("job").selectExpr("key.job").collect() == [(2,)] and state("pages").count() == 0


def test_known_jobs_expire_by_the_clock(spark, tmp_path):
    to = landing.Landing(spark, f"{tmp_path}/out", {"asked": lambda b: b})
    q = lambda i, job, kind="job.queued": (i, i, job, kind, None, None, None, None, None)

    def run(rows):  # a stream by the clock has no end of its own
        query = landing.started(live.submitted(instalment(spark, f"{tmp_path}/in", rows), remember_s=3), to, f"{tmp_path}/c", once=False, every="0 seconds")
        until = time.time() + 60
        while time.time() < until and not any(p["numInputRows"] for p in query.recentProgress):
            time.sleep(0.1)
        landing.drained(query)

    run([q(0, 1), q(1, 1), q(2, 2), *[q(10 + j, 10 + j) for j in range(20)]])
    time.sleep(3.5)
    run([q(50, 1), q(51, 1)])
    assert {r.id: r.accepted for r in to.table("asked").collect() if r.id < 10 or r.id > 40} == {0: True, 1: False, 2: True, 50: True, 51: False}
    held = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "known").load()
    assert held.count() < 22  # what has expired is gone from the state, not only overlooked


def test_log_from_any_id_on(spark, tmp_path):
    rows = [(1700 + i // 3, i % 3, i % 4, "t", str(i)) for i in range(30)]
    folder = f"{tmp_path}/log"
    log.append(spark.createDataFrame(rows[:20], log.SCHEMA), folder)

    def run(name, **options):
        to = landing.Landing(spark, f"{tmp_path}/{name}", {"all": lambda b: b})
        landing.started(log.stream(spark, folder, **options), to, f"{tmp_path}/{name}-c", "append").awaitTermination()
        return sorted(int(r.data) for r in to.table("all").collect())

    assert run("whole") == list(range(20)) and run("after", after="1703-1") == list(range(11, 20)) and run("last", last="7") == list(range(13, 20))
    log.append(spark.createDataFrame(rows[20:], log.SCHEMA), folder)
    # each goes on behind its last event, history and new events alike
    assert run("whole") == list(range(30)) and run("after", after="1703-1") == list(range(11, 30)) and run("last", last="7") == list(range(13, 30)) and run("late", last="100") == list(range(30))


def test_streams_equal_their_batch_queries(spark):
    """Over three instalments with a fresh start after each."""
    from quire.plans import queries

    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))
    assert same(plans.page_states_live(spark, DATA), queries.QUERIES["page_states"](spark, DATA))
    assert same(plans.dead_letters_live(spark, DATA), queries.QUERIES["dead_letter_rows"](spark, DATA))
    last = {r["status"]: r["n"] for r in queries.QUERIES["job_hashes"](spark, DATA).groupBy("status").agg(F.count("*").alias("n")).collect()}
    told = plans.backlog_live(spark, DATA).orderBy(F.desc("upto")).first()
    assert {s: told[s] for s in landing.STATES if told[s]} == last
