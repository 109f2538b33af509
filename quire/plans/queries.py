"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import evidence, policy, text
from quire.operators import dataset, evaluate, intake, lifecycle, pages, segments

from . import asking, containers, decisions, jobs, language, live, probes, reviews, scores, storage

Spark = SparkSession
_KEYS = ["doc_id", "page"]


def _t(spark: Spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _measured(spark: Spark, d: str) -> DataFrame:
    return pages.measured(pages.layers(pages.explode_pages(pages.documents(spark, d))))


def doc_pages(spark: Spark, d: str) -> DataFrame:
    return pages.explode_pages(pages.documents(spark, d)).select(*_KEYS, F.length("text").alias("n"))


def text_stats(spark: Spark, d: str) -> DataFrame:
    return _measured(spark, d).select(*_KEYS, "chars", "cid_share", "odd_char_share", "short_token_share", "math_share")


def trust_gate(spark: Spark, d: str) -> DataFrame:
    return pages.answered(spark, d).select(*_KEYS, "trusted", (~F.col("trusted") & (F.col("chars") > 0)).alias("needs_ocr"))


def lane_rule_table(spark: Spark, d: str) -> DataFrame:
    return pages.answered(spark, d).select(*_KEYS, "candidate", F.round("path_p", 4).alias("path_p"))


def reasons(spark: Spark, d: str) -> DataFrame:
    return pages.answered(spark, d).select(*_KEYS, F.array_join(policy.Rules(F.col).reasons(), "; ").alias("reasons"))


def modifiers(spark: Spark, d: str) -> DataFrame:
    a = pages.answered(spark, d)
    columns = F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1)
    return a.select(*_KEYS, F.array_join(policy.Rules(F.col).modifiers(F.col("candidate"), columns, F.lit("latin")), ",").alias("modifiers"))


def review_override(spark: Spark, d: str) -> DataFrame:
    return pages.routed(spark, d).select(*_KEYS, "lane", "candidate")


def lane_histogram(spark: Spark, d: str) -> DataFrame:
    """Pages a lane, lanes without a page included."""
    counted = pages.routed(spark, d).groupBy("lane").agg(F.count("*").alias("n"))
    lanes = spark.createDataFrame([(x,) for x in (*policy.RANK, "LH", "LQ")], "lane string")
    return lanes.join(counted, "lane", "left").select("lane", F.coalesce("n", F.lit(0)).alias("n"))


KNOTS = [(0.05, 0.1), (0.2, 0.4), (0.4, 0.4), (0.7, 0.9), (0.95, 1.0)]


def calibrated_lookup(spark: Spark, d: str) -> DataFrame:
    knots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in KNOTS])
    return pages.answered(spark, d).select(*_KEYS, F.round(policy.interpolate(knots, F.col("path_p")), 4).alias("confidence"))


def fixed_routes(spark: Spark, d: str) -> DataFrame:
    files = _t(spark, d, "pages").select("page_id", F.lit("page").alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    p = intake.typed(files)
    kind, reason = F.col("kind"), F.col("quarantine")
    return p.select("page_id", "kind", "mime", intake.fixed_lane(kind, reason).alias("lane"), intake.fixed_reason(kind, reason).alias("reason"))


def describe_text(spark: Spark, d: str) -> DataFrame:
    m = _measured(spark, d)
    unreadable = F.when(F.col("cid_share") > 0.3, "encoding codes").otherwise("")
    reading = evidence.reads(unreadable, F.when(F.col("chars") >= 20, F.lit(0.9)), F.col("lang"))
    said = evidence.describe_text("Embedded text layer", F.col("chars"), reading, F.col("cid_share"), F.col("odd_char_share"), F.col("short_token_share"), F.col("math_share"), F.lit("latin"), unreadable)
    return m.select(*_KEYS, said.alias("said"))


def describe_layout(spark: Spark, d: str) -> DataFrame:
    m = pages.explode_pages(pages.documents(spark, d))
    count = lambda p: F.regexp_count("text", F.lit(p))
    said = evidence.describe_layout(count(r"\|"), count("="), count("!"), F.lit(0.0), F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1))
    return m.select(*_KEYS, said.alias("said"))


def previous_tail(spark: Spark, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("page")
    p = pages.explode_pages(pages.documents(spark, d)).select(*_KEYS, F.right(F.lag("text").over(w), F.lit(600)).alias("tail"))
    return p.filter("tail <> ''").select(*_KEYS, "tail")


def script_histogram(spark: Spark, d: str) -> DataFrame:
    p = pages.explode_pages(pages.documents(spark, d)).select(*_KEYS, F.posexplode(text.script_shares(F.col("text"))).alias("place", "s"))
    return p.select(*_KEYS, "place", "s.script", "s.share")


def dominant_script(spark: Spark, d: str) -> DataFrame:
    """Every eighth document has as many Cyrillic letters put in front as it has Latin ones after, so that order decides."""
    tied = F.when(F.col("doc_id") % 8 == 0, F.concat(F.repeat(F.lit("д"), F.lit(3)), F.lit(" abc"))).otherwise(F.col("text"))
    return pages.explode_pages(pages.documents(spark, d)).select(*_KEYS, text.dominant_script(text.script_shares(tied)).alias("script"))


def agreement_jaccard(spark: Spark, d: str) -> DataFrame:
    """Each page's layer against the next page as the other reading."""
    w = Window.partitionBy("doc_id").orderBy("page")
    p = pages.explode_pages(pages.documents(spark, d)).withColumn("other", F.lead("text").over(w)).filter("other is not null")
    return p.select(*_KEYS, text.agreement(F.col("text"), F.col("other")).alias("agreement"))


def guards(spark: Spark, d: str) -> DataFrame:
    return pages.explode_pages(pages.documents(spark, d)).select(*_KEYS, text.guard(F.col("text")).alias("guard"))


def chunk_fold(spark: Spark, d: str) -> DataFrame:
    return pages.explode_pages(pages.documents(spark, d)).select(*_KEYS, F.posexplode(text.chunks(F.col("text"))).alias("chunk", "text"))


def _routes(spark: Spark, d: str) -> DataFrame:
    r = pages.routed(spark, d)
    mods = policy.Rules(F.col).modifiers(F.col("candidate"), F.lit(1), F.lit("latin"))
    return r.select("doc_id", "page", "lane", "continuation", mods.alias("modifiers"), (F.col("chars").cast("long") * 3).alias("cost_micro"))


def segment_runs(spark: Spark, d: str) -> DataFrame:
    return segments.segments(_routes(spark, d)).select("doc_id", "start", "stop", "lane", F.array_join("modifiers", ",").alias("modifiers"))


def segment_width(spark: Spark, d: str) -> DataFrame:
    return segments.widths(segments.segments(_routes(spark, d))).select("doc_id", "start", F.round("width", 4).alias("width"))


def manifests(spark: Spark, d: str) -> DataFrame:
    m = segments.manifests(_routes(spark, d))
    return m.select("doc_id", F.size("pages").alias("n_pages"), F.size("segments").alias("n_segments"), F.array_join(F.transform("pages", lambda p: p["lane"]), ",").alias("lanes"), "cost_micro")


def manifest_reuse(spark: Spark, d: str) -> DataFrame:
    docs = pages.documents(spark, d).select("doc_id")
    stored = docs.filter("doc_id % 3 = 0").withColumn("route_key", F.when(F.col("doc_id") % 2 == 0, "now").otherwise("old"))
    have, todo = segments.reuse(docs, stored, "now")
    return have.withColumn("route", F.lit(False)).unionByName(todo.withColumn("route", F.lit(True)))


def bomb_predicate(spark: Spark, d: str) -> DataFrame:
    """Orders as archives and their lines as members."""
    m = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("archive"), (F.col("l_extendedprice") * 1000).cast("long").alias("size"), (F.col("l_quantity") * 5000).cast("long").alias("packed"))
    return intake.bombs(m)


def dedup_bytes(spark: Spark, d: str) -> DataFrame:
    return intake.distinct_bytes(pages.documents(spark, d).select(F.coalesce("text", F.lit("")).cast("binary").alias("content")))


def eval_metrics(spark: Spark, d: str) -> DataFrame:
    return evaluate.metrics(pages.cases(spark, d), "grp")


def eval_grouping_sets(spark: Spark, d: str) -> DataFrame:
    return evaluate.grouped(pages.cases(spark, d))


def eval_report(spark: Spark, d: str) -> DataFrame:
    """All metrics at three grains; every source is expected as a group, and so is a split that no case has."""
    expected = _t(spark, d, "documents").filter("source is not null").select(F.lit("group").alias("grain"), F.col("source").alias("value")).distinct()
    return evaluate.at_grains(pages.cases(spark, d), expected.unionByName(expected.limit(1).select(F.lit("split").alias("grain"), F.lit("nowhere").alias("value"))))


def confusion_pivot(spark: Spark, d: str) -> DataFrame:
    return evaluate.confusion(pages.cases(spark, d))


def nearest_rank(spark: Spark, d: str) -> DataFrame:
    return evaluate.latencies(pages.cases(spark, d), "grp")


def wrong_cases(spark: Spark, d: str) -> DataFrame:
    return pages.cases(spark, d).filter(~evaluate.hit("lane")).select(*_KEYS, "lane", F.array_join("gt", "/").alias("gt"))


def route_once_per_file(spark: Spark, d: str) -> DataFrame:
    """Cases of one text routed once and joined back by its digest."""
    docs = pages.documents(spark, d).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("file"))
    once = docs.groupBy("file").agg(F.min("doc_id").alias("routed_as"), F.count("*").alias("cases"))
    return docs.join(once, "file").select("doc_id", "routed_as", "cases")


def isotonic_curves(spark: Spark, d: str) -> DataFrame:
    return evaluate.curves(pages.cases(spark, d))


def calibration_report(spark: Spark, d: str) -> DataFrame:
    return evaluate.outcome(pages.cases(spark, d), evaluate.threshold(2.0))


def selective_accuracy(spark: Spark, d: str) -> DataFrame:
    return evaluate.selective(pages.cases(spark, d), (0.2, 0.4, 0.6, 0.8))


def ece(spark: Spark, d: str) -> DataFrame:
    return evaluate.expected_error(pages.cases(spark, d))


def near_duplicates(spark: Spark, d: str) -> DataFrame:
    """Vectors laid out as pictures of 16 rows of 17, and for some a second picture with one or two cells made bright."""
    rows, columns = dataset.GRID
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    grey = F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), lambda i: F.element_at("embedding", i * 13 % 64 + 1).cast("double"))
    e = e.select("v", grey.alias("grey"))
    cell = (F.col("v") % 272).cast("int")
    bright = F.transform("grey", lambda g, i: F.when((i == cell) | ((F.col("v") % 7 == 0) & (i == (cell + 100) % 272)), F.lit(9.0)).otherwise(g))
    second = e.filter("v % 5 = 0").select((F.col("v") + 100_000).alias("id"), F.when(F.col("v") % 3 == 0, F.col("v")).otherwise(F.col("v") + 100_000).alias("doc"), bright.alias("grey"))
    both = e.select(F.col("v").alias("id"), F.col("v").alias("doc"), "grey").unionByName(second)
    return dataset.near_pairs(both.select("id", "doc", dataset.difference_hash(F.col("grey")).alias("h")))


def _sources(spark: Spark, d: str) -> DataFrame:
    """Attributions as both sets write them, made from the documents' ids and sources."""
    i = F.col("doc_id").cast("string")
    written = [F.concat(F.lit("olmOCR-Bench, file bench_data/pdfs/"), "source", F.lit("-"), i, F.lit(".pdf, CC")), F.concat(F.lit("Berzerker/gnhk_ocr_dataset train row_idx="), i), F.concat(F.lit("PureDocBench page_id="), i, F.lit(" v1")), F.concat(F.lit("https://example.org/"), i)]
    return pages.documents(spark, d).select(F.col("doc_id").alias("key"), F.element_at(F.array(*written), (F.col("doc_id") % 4 + 1).cast("int")).alias("source"))


def disjoint_check(spark: Spark, d: str) -> DataFrame:
    """Pages of the new set whose source page the old set (every third document, named anew) has."""
    s = _sources(spark, d)
    return dataset.overlapping(s, s.filter("key % 3 = 0").select(F.concat(F.lit("taken from "), "source").alias("source")))


def _opinions(spark: Spark, d: str) -> DataFrame:
    """Three labellers' codes for each labelled document, made from its labels and id."""
    l = _t(spark, d, "labels").select("doc_id", "quality")
    code = lambda k: F.element_at(F.array(*map(F.lit, ("simple", "complex", "borderline", "unusable", "simple"))), ((F.col("doc_id") * k + F.col("quality")) % 5 + 1).cast("int"))
    each = F.array(F.struct(F.lit("a").alias("labeller"), code(3).alias("code")), F.struct(F.lit("b").alias("labeller"), code(7).alias("code")), F.struct(F.lit("c").alias("labeller"), F.when(F.col("doc_id") % 2 == 0, code(11)).alias("code")))
    return l.select(F.col("doc_id").alias("key"), F.lit("layout").alias("rubric"), F.explode(each).alias("o")).select("key", "rubric", "o.labeller", "o.code").filter("code is not null")


def label_verdicts(spark: Spark, d: str) -> DataFrame:
    return dataset.verdicts(_opinions(spark, d)).select("key", "state", F.array_join("lanes", "/").alias("lanes"))


def contradictions(spark: Spark, d: str) -> DataFrame:
    prior = F.when(F.col("key") % 2 == 0, "L1").otherwise("L2")
    v = dataset.verdicts(_opinions(spark, d)).filter("state = 'final'").withColumn("prior", prior)
    return v.filter(~F.array_contains("lanes", F.col("prior"))).select("key", "prior", F.array_join("lanes", "/").alias("lanes"))


def conflict_append(spark: Spark, d: str) -> DataFrame:
    o = _opinions(spark, d)
    new = o.withColumn("code", F.when(F.col("key") % 5 == 0, "complex").otherwise(F.col("code")))
    add, clash = dataset.append_opinions(o.filter("key % 3 <> 0"), new)
    return add.withColumn("what", F.lit("append")).unionByName(clash.drop("old").withColumn("what", F.lit("conflict"))).groupBy("what", "labeller").agg(F.count("*").alias("n"))


def _strata(spark: Spark, d: str) -> DataFrame:
    c = pages.documents(spark, d).select("doc_id", "source", F.coalesce("n_chars", F.lit(0)).alias("n_chars")).join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return c.select("doc_id", F.concat_ws(" ", "source", F.col("quality").cast("string")).alias("stratum"), F.ceil((F.col("n_chars") + 1) / 1200).cast("long").alias("weight"), F.when(F.col("doc_id") % 10 == 0, "tune").otherwise("").alias("fixed"))


def sticky_split(spark: Spark, d: str) -> DataFrame:
    return dataset.sticky_split(_strata(spark, d))


def stratified_round_robin(spark: Spark, d: str) -> DataFrame:
    return dataset.round_robin(_strata(spark, d), "stratum", 50).select("doc_id", "stratum", "turn")


def cross_tab(spark: Spark, d: str) -> DataFrame:
    v = dataset.verdicts(_opinions(spark, d)).withColumn("part", (F.col("key") % 4).cast("long"))
    return v.groupBy("part").pivot("state", ["final", "needs_c", "drop"]).count().na.fill(0)


def axis_scores(spark: Spark, d: str) -> DataFrame:
    """Right answers by axis and system (a split stands for a system), and their mean."""
    c = pages.cases(spark, d).filter("split is not null")
    trust = (F.col("text_layer_trustworthy") >= 0.5) == F.array_contains("gt", "L1")
    table = F.when(F.col("doc_id") % 6 != 0, (F.col("has_table") >= 0.5) == F.array_contains("gt", "L2"))
    a = c.groupBy(F.col("split").alias("name")).agg(F.avg(evaluate.hit("candidate").cast("int")).alias("lane"), F.avg(trust.cast("int")).alias("trust"), F.avg(table.cast("int")).alias("table_"))
    return a.select("name", *[F.round(k, 6).alias(k) for k in ("lane", "trust", "table_")], F.round((F.col("lane") + F.col("trust") + F.col("table_")) / 3, 6).alias("composite"))


def shared_core(spark: Spark, d: str) -> DataFrame:
    """Event types as systems and hours as pages."""
    e = _t(spark, d, "events").select(F.col("event_type").alias("name"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600).cast("long").alias("page"))
    return evaluate.shared_core(e)


def pareto(spark: Spark, d: str) -> DataFrame:
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("score"), F.col("p_retailprice").alias("cost"))
    return evaluate.pareto(p)


def run_agreement(spark: Spark, d: str) -> DataFrame:
    a = pages.answered(spark, d).select(*_KEYS, F.col("candidate").alias("lane"), F.col("path_p").alias("p"))
    b = pages.routed(spark, d).select(*_KEYS, "lane", (F.col("path_p") * 0.9).alias("p"))
    return evaluate.run_agreement(a, b)


def bootstrap(spark: Spark, d: str) -> DataFrame:
    c = pages.cases(spark, d)
    return evaluate.bootstrap(c.select(evaluate.hit("candidate").cast("int").alias("ok")), "ok")


def job_state(spark: Spark, d: str) -> DataFrame:
    return lifecycle.states(lifecycle.job_events(spark, d)).select("job", "status", "retries", "pages")


def dead_letters(spark: Spark, d: str) -> DataFrame:
    return lifecycle.deliveries(lifecycle.job_events(spark, d)).filter("dead").select("id", "job", "delivery")


def reclaims(spark: Spark, d: str) -> DataFrame:
    return lifecycle.reclaims(lifecycle.job_events(spark, d), idle_s=36_000)


def newest_jobs(spark: Spark, d: str) -> DataFrame:
    return lifecycle.newest_jobs(lifecycle.states(lifecycle.job_events(spark, d)), 50).select("job", "first_id")


def recent_medians(spark: Spark, d: str) -> DataFrame:
    return lifecycle.recent_medians(lifecycle.job_events(spark, d))


def spend_cap(spark: Spark, d: str) -> DataFrame:
    return lifecycle.spend_cap(lifecycle.job_events(spark, d), cap=1500, reserve=100)


def shortest_path(spark: Spark, d: str) -> DataFrame:
    return lifecycle.shortest_paths(spark)


def answers_cache(spark: Spark, d: str) -> DataFrame:
    """Requests by digest of their text: those answered before, and one call for each new digest."""
    r = pages.explode_pages(pages.documents(spark, d)).select(*_KEYS, F.sha2("text", 256).alias("digest"))
    cache = r.filter("doc_id % 4 = 0").select("digest").distinct()
    hits = r.join(cache, "digest", "left_semi").agg(F.count("*").alias("n")).withColumn("what", F.lit("hit"))
    misses = r.join(cache, "digest", "left_anti")
    return hits.unionByName(misses.agg(F.count("*").alias("n")).withColumn("what", F.lit("miss"))).unionByName(misses.agg(F.count_distinct("digest").alias("n")).withColumn("what", F.lit("call")))


def daily_events(spark: Spark, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {f.__name__: f for f in (doc_pages, text_stats, trust_gate, lane_rule_table, reasons, modifiers, review_override, lane_histogram, calibrated_lookup, fixed_routes, describe_text, describe_layout, previous_tail, script_histogram, dominant_script, agreement_jaccard, guards, chunk_fold, segment_runs, segment_width, manifests, manifest_reuse, bomb_predicate, dedup_bytes, eval_metrics, eval_grouping_sets, eval_report, confusion_pivot, nearest_rank, wrong_cases, route_once_per_file, isotonic_curves, calibration_report, selective_accuracy, ece, near_duplicates, disjoint_check, label_verdicts, contradictions, conflict_append, sticky_split, stratified_round_robin, cross_tab, axis_scores, shared_core, pareto, run_agreement, bootstrap, job_state, dead_letters, reclaims, newest_jobs, recent_medians, spend_cap, shortest_path, answers_cache, daily_events)}
QUERIES |= probes.QUERIES | reviews.QUERIES | language.QUERIES | containers.QUERIES | decisions.QUERIES | jobs.QUERIES | live.QUERIES | asking.QUERIES | scores.QUERIES | storage.QUERIES
