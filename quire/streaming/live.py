"""The live view as a stream: states of jobs and pages, leases with heartbeats, and jobs that are forgotten.

Every job is a key with its own state and timers, so all tasks share the work and nothing is gathered.  Timers
follow the events' own time: what a run gives doesn't depend on when it runs, or on how events are cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.lifecycle import EVENT_TYPES
from quire.operators.queue import MOST_DELIVERIES, REMEMBER_S, STATUS
from quire.shipping import ship

STAGES = ("probe", "ocr", "vision", "jev", "policy")
JOB = "status string, deliveries long, retries long, pages long, last long, ended long"
PAGE = ", ".join(f"{s} string, {s}_ms long" for s in STAGES) + ", evidence string"
EVENT = "id long, ts timestamp, at long, job long, type string, ms long, failed boolean, doc string, page int, stage string, state string, evidence string"
#: What comes out: rows of kind job (status and counts after a batch, and the status before it), page (a page as it is now, or that it
#: is gone) and forgotten.  version orders the rows of a job or page.
VIEW = f"kind string, job long, version long, before string, {JOB.replace(', last long, ended long', '')}, doc string, page int, {PAGE}, gone boolean"
LEASE = "kind string, job long, message long, at_ms long, error string"
_VIEW, _LEASE, _SUBMITTED = (Row(*[x.split()[0] for x in names.split(", ")]) for names in (VIEW, LEASE, "id long, job long, accepted boolean"))
#: How long a job may be without a sign of life.  Fixed value.
IDLE_S = 120


def job_events(events: DataFrame) -> DataFrame:
    """id, ts, at (milliseconds), job, type, ms of rows of the events table."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv]), F.col("event_type"))
    ts = F.col("ts").cast("timestamp")
    return events.select(F.col("event_id").alias("id"), ts.alias("ts"), F.unix_millis(ts).alias("at"), F.col("user_id").alias("job"), F.coalesce(kind, F.lit("other")).alias("type"), F.get_json_object("props", "$.k").cast("long").alias("ms"))


class View(StatefulProcessor):
    """Folds a job's events into its status and the states of its documents' pages.

    Rows: EVENT.  A job.queued event with a doc announces it; stages of documents that aren't announced are
    nobody's and ignored; a retry starts all pages over.  Events up to the last id of a job have been seen and change
    nothing.  A job that ended `remember_s` ago is forgotten with all that belongs to it; None: never, and there are no timers.
    """

    def __init__(self, remember_s: int | None = REMEMBER_S):
        self.remember_ms = None if remember_s is None else remember_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB)
        self.docs = handle.getMapState("docs", "doc string", "announced long")
        self.pages = handle.getMapState("pages", "doc string, page int", PAGE)

    def _timer(self, old: int, new: int) -> int:
        """Move the job's one timer; 0 is none."""
        if old != new:
            if old:
                self.handle.deleteTimer(old)
            if new:
                self.handle.registerTimer(new)
        return new

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        status, deliveries, retries, pages, last, ended = self.job.get() or (None, 0, 0, 0, -1, 0)
        before, timer = status, ended
        touched: dict[tuple[str, int], list | None] = {}
        for e in sorted(rows, key=lambda r: r.id):
            if e.id <= last:
                continue
            if ended and e.at > ended:  # time passed within this batch: the job was forgotten before
                touched |= dict.fromkeys([*self._stored(), *touched])
                yield self._row("forgotten", key, last, at=ended)
                self._forget()
                status, deliveries, retries, pages, ended = None, 0, 0, 0, 0
            last = e.id
            named = STATUS.get(e.type)
            if named:
                status = "failed" if e.failed else named
                deliveries += e.type == "job.started"
                ended = e.at + self.remember_ms if self.remember_ms is not None and status in ("done", "failed") else 0
            if e.type == "job.queued" and e.doc is not None and not self.docs.containsKey((e.doc,)):
                self.docs.updateValue((e.doc,), (e.id,))
            elif e.type == "job.retry":
                retries, pages = retries + 1, 0
                touched |= dict.fromkeys([*self._stored(), *touched])
                self.pages.clear()
            elif e.type == "page.stage":
                pages += 1
                if e.doc is not None and self.docs.containsKey((e.doc,)):
                    at = (e.doc, e.page)
                    page = touched.get(at)
                    if page is None:
                        page = list(self.pages.getValue(at) or (None,) * (2 * len(STAGES) + 1)) if at not in touched else [None] * (2 * len(STAGES) + 1)
                    touched[at] = folded(page, e)
        self._timer(timer, ended)
        self.job.update((status, deliveries, retries, pages, last, ended))
        for at, page in touched.items():
            if page is not None:
                self.pages.updateValue(at, tuple(page))
            yield self._row("page", key, last, doc=at[0], page=at[1], state=page, gone=page is None)
        yield self._row("job", key, last, before=before, status=status, counts=(deliveries, retries, pages))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.job.get()
        if held is None or held[5] != expiredTimerInfo.getExpiryTimeInMs():
            return
        for at in self._stored():
            yield self._row("page", key, held[4], doc=at[0], page=at[1], gone=True, later=True)
        yield self._row("forgotten", key, held[4], before=held[0], at=held[5], later=True)
        self._forget()
        self.job.clear()

    def _stored(self) -> list[tuple[str, int]]:
        return [(k[0], k[1]) for k in self.pages.keys()] if self.pages.exists() else []

    def _forget(self) -> None:
        self.docs.clear()
        self.pages.clear()

    @staticmethod
    def _row(kind: str, key, last: int, before=None, status=None, counts=(None, None, None), doc=None, page=None, state=None, gone=False, at=None, later=False) -> Row:
        return _VIEW(kind, key[0], 2 * last + later, before, status, *(counts if at is None else (None, None, at)), doc, page, *(state or (None,) * (2 * len(STAGES) + 1)), gone)

    def close(self) -> None:
        pass


def folded(page: list, e: Row) -> list:
    """A page after one of its events; facts come with done events, and only a probe's evidence may take evidence away."""
    i = 2 * STAGES.index(e.stage)
    page[i] = e.state
    if e.state == "done":
        if e.ms is not None:
            page[i + 1] = e.ms
        if e.stage == "probe" or e.stage in ("jev", "policy") and e.evidence is not None:
            page[-1] = e.evidence
    return page


class Lease(StatefulProcessor):
    """Watches a job's deliveries: rows of kind lost (no sign of life for idle_s) and dead (a delivery beyond the limit).

    A start takes the lease and a page's stage renews it, each by a timer of its own time; a retry or an end gives it back.
    """

    def __init__(self, idle_s: int = IDLE_S, most: int = MOST_DELIVERIES):
        self.idle_ms, self.most = idle_s * 1000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("lease", "message long, due long, deliveries long, last long, left string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        message, due, deliveries, last, left = self.held.get() or (None, 0, 0, -1, None)
        timer = due
        for e in sorted(rows, key=lambda r: r.id):
            if e.id <= last:
                continue
            last, now = e.id, e.at
            if due and now > due:
                yield _LEASE("lost", key[0], message, due, None)
                due = 0
            if e.type == "job.started":
                deliveries += 1
                message = e.id
                if deliveries == self.most + 1:
                    yield _LEASE("dead", key[0], e.id, now, f"gave up after {self.most} deliveries: {left or 'worker lost'}")
                due = now + self.idle_ms
            elif e.type == "page.stage" and due:
                due = now + self.idle_ms
            elif e.type in ("job.done", "job.retry"):
                due = 0
            if e.type in STATUS:
                left = f"took {e.ms}" if e.type == "job.retry" and e.ms is not None else None
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        self.held.update((message, due, deliveries, last, left))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.held.get()
        if held and held[1] == expiredTimerInfo.getExpiryTimeInMs():
            self.held.update((held[0], 0, held[2], held[3], held[4]))
            yield _LEASE("lost", key[0], held[0], held[1], None)

    def close(self) -> None:
        pass


class Once(StatefulProcessor):
    """Lets a submission through unless its job is known; what is known is forgotten `remember_s` after it was last heard of, by the clock."""

    def __init__(self, remember_s: int = REMEMBER_S):
        self.remember_ms = remember_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "status string", self.remember_ms)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.known.get()
        status = held[0] if held else None
        for e in sorted(rows, key=lambda r: r.id):
            named = STATUS.get(e.type)
            if e.type == "job.queued":
                accepted = status in (None, "failed")
                yield _SUBMITTED(e.id, key[0], accepted)
                named = "queued" if accepted else status
            status = "failed" if e.failed else named or status
        if status is not None:
            self.known.update((status,))

    def close(self) -> None:
        pass


def _grouped(events: DataFrame):
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.groupBy("job")


def viewed(events: DataFrame, remember_s: int | None = REMEMBER_S, late: str = "0 seconds") -> DataFrame:
    """Stream of VIEW rows from a stream of EVENT rows.  of a forgotten row `pages` is the time, in milliseconds, at which it was forgotten.

    remember_s None: no job is forgotten, so no event is too late.
    """
    if remember_s is None:
        return _grouped(events).transformWithState(View(None), VIEW, "update", "none")
    return _grouped(events.withWatermark("ts", late)).transformWithState(View(remember_s), VIEW, "update", "eventtime")


def leased(events: DataFrame, idle_s: int = IDLE_S, most: int = MOST_DELIVERIES, late: str = "0 seconds") -> DataFrame:
    """Stream of LEASE rows."""
    return _grouped(events.withWatermark("ts", late)).transformWithState(Lease(idle_s, most), LEASE, "update", "eventtime")


def submitted(events: DataFrame, remember_s: int = REMEMBER_S) -> DataFrame:
    """Stream of id, job, accepted of each submission.  It follows the clock, so it runs until it is stopped, also where only what is there now is asked for."""
    return _grouped(events).transformWithState(Once(remember_s), "id long, job long, accepted boolean", "update", "processingtime")


def pages_now(view: DataFrame) -> DataFrame:
    """doc, page and PAGE: pages as their newest rows tell, those that are gone left out."""
    columns = [x.split()[0] for x in PAGE.split(", ")]
    newest = view.filter("kind = 'page'").groupBy("doc", "page").agg(F.max_by(F.struct("gone", *columns), "version").alias("p"))
    return newest.filter("not p.gone").select("doc", "page", *[f"p.{c}" for c in columns])


def jobs_now(view: DataFrame) -> DataFrame:
    """job, status, retries, pages as a job's newest rows tell."""
    newest = view.filter("kind = 'job'").groupBy("job").agg(F.max_by(F.struct("status", "retries", "pages"), "version").alias("j"))
    return newest.select("job", "j.*")
