"""Named queries on evidence shown to people, replays, scores of systems and the building of case sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import evidence, policy
from quire.operators import dataset, evaluate, lifecycle, pages, scoring

Spark = SparkSession
_KEYS = ["doc_id", "page"]
#: Question groups of the answers shown.
GROUPS = {"mostly_handwritten": "routing", "text_layer_trustworthy": "routing", "complex_layout": "routing", "heavily_degraded": "routing", "has_table": "modifier", "has_math": "modifier", "has_code": "modifier", "continuation": "continuation"}
BASIS = {"evidence": 1, "policy": 1, "questions": 8, "batch": 4}
ROUTE = {"answers": policy.digest_of(BASIS), "calibration": None, "review": 0.35}


def _pick(key: Column, *values: str | None) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _id() -> Column:
    return F.concat_ws("-", "doc_id", "page").alias("id")


def _labels(spark: Spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic")


def _timings(spark: Spark, d: str) -> DataFrame:
    """Pages with stage times made from their numbers."""
    i, p = F.col("doc_id"), F.col("page")
    probe = F.when(i % 11 != 0, 20 + (i * 3 + p) % 50)
    made = {"probe": probe, "ocr": F.when((i % 11 != 0) & ((i + p) % 3 == 0), 200 + i % 90), "vision": F.when((i % 11 != 0) & ((i + p) % 4 == 0), 300 + p % 70), "answers": F.when(i % 13 != 0, 100 + i * 7 % 200), "total": (i * 31 + p * 17) % 900, "ocr_failed": (i + p) % 5 == 0}
    return pages.explode_pages(pages.documents(spark, d)).select(*_KEYS, *[c.alias(k) for k, c in made.items()])


def evidence_sentences(spark: Spark, d: str) -> DataFrame:
    from .queries import describe_text

    said = describe_text(spark, d).select(*_KEYS, F.posexplode(evidence.sentences(F.concat("said", F.lit(" Vision check: none. e.g. this. Page 2 follows.")))).alias("pos", "s"))
    return said.select(*_KEYS, "pos", "s.topic", "s.text")


def vision_sentence(spark: Spark, d: str) -> DataFrame:
    i = F.col("doc_id")
    defects = F.filter(F.array(*[F.when(i % m == 0, F.lit(k)) for k, m in zip(evidence.DEFECTS, (2, 3, 4, 5, 7), strict=True)]), lambda x: x.isNotNull())
    content = F.filter(F.array(*[F.when(i % m == 1, F.lit(k)) for k, m in zip(evidence.CONTENT, (2, 3, 4, 5, 6, 7), strict=True)]), lambda x: x.isNotNull())
    said = evidence.describe_vision(_pick(i, *evidence.CAPTURE, "plotter", None), _pick(F.floor(i / 2), *evidence.LEGIBILITY, "odd"), _pick(F.floor(i / 3), *evidence.HANDWRITING), defects, content, F.lit("latin"))
    return _labels(spark, d).select("doc_id", said.alias("said"))


def stage_timeline(spark: Spark, d: str) -> DataFrame:
    t = lifecycle.timeline(_timings(spark, d))
    return t.select(*_KEYS, "stage", "begin", F.round("begin_pct", 6).alias("begin_pct"), F.round("width_pct", 6).alias("width_pct"))


def replay_events(spark: Spark, d: str) -> DataFrame:
    return lifecycle.replayed(_timings(spark, d))


def finished_recordings(spark: Spark, d: str) -> DataFrame:
    e = lifecycle.job_events(spark, d).withColumn("name", (F.col("job") % 20).cast("string"))
    return lifecycle.recorded(e).select("id", "job")


def live_or_past(spark: Spark, d: str) -> DataFrame:
    return lifecycle.live(lifecycle.job_events(spark, d), F.timestamp_seconds(F.lit(1706572800)), skew_us=-2_000_000, window_s=86400)


def route_summary(spark: Spark, d: str) -> DataFrame:
    c = pages.cases(spark, d)
    return c.agg(F.count_distinct("doc_id").alias("docs"), F.count("lane").alias("pages"), F.sum("cost_micro").alias("cost_micro"), F.percentile("latency_ms", 0.5).alias("p50"))


def answer_groups(spark: Spark, d: str) -> DataFrame:
    """Answers by the group of their question; the questions are a dimension of bounded size."""
    asked = F.explode(F.create_map(*[x for k in GROUPS for x in (F.lit(k), F.col(k))])).alias("question", "p")
    of = spark.createDataFrame(list(GROUPS.items()), "question string, grp string")
    a = pages.answered(spark, d).select("doc_id", asked)
    return a.groupBy("question").agg(F.count("*").alias("n"), F.count_if(F.col("p") >= 0.5).alias("yes")).join(F.broadcast(of), "question").select("grp", "question", "n", "yes")


def _results(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    c = pages.cases(spark, d)
    n = F.col("doc_id") + F.col("page")
    lane = F.when(n % 10 == 3, None).when(F.col("path_p") < 0.35, "uncertain").otherwise(F.col("candidate"))
    return c.select(_id(), "gt", "grp"), c.filter(n % 17 != 0).select(_id(), lane.alias("lane"), F.when(n % 10 == 1, "timeout").alias("error"))


def system_lanes(spark: Spark, d: str) -> DataFrame:
    return scoring.lane_metrics(*_results(spark, d), by="grp")


def layer_accuracy(spark: Spark, d: str) -> DataFrame:
    c = pages.cases(spark, d)
    return scoring.layer_accuracy(c.select(F.when(F.col("doc_id") % 6 != 0, F.col("text_layer_trustworthy")).alias("p"), F.arrays_overlap("gt", F.array(F.lit("L1"), F.lit("L2"))).alias("truth")))


def mean_probability(spark: Spark, d: str) -> DataFrame:
    return scoring.mean_probability(pages.cases(spark, d).select(F.col("path_p").alias("p"), evaluate.hit("candidate").alias("ok")))


def system_timing(spark: Spark, d: str) -> DataFrame:
    return scoring.timing(pages.cases(spark, d).withColumn("run", F.col("page") % 3), "grp", "run")


def truth_lanes(spark: Spark, d: str) -> DataFrame:
    i = F.col("doc_id")
    captures = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in (("fax",), ("fax", "flatbed_scan"), ("flatbed_scan",), ("camera_photo", "fax"))]), (i % 4 + 1).cast("int"))
    degraded = scoring.degraded_label(captures, _pick(F.floor(i / 4), "clean", "degraded", None))
    is_complex = scoring.complex_label(F.when(i % 5 != 0, i % 2 == 0), i % 3 == 0, i % 7 == 0)
    lanes = scoring.truth_lanes(F.col("quality") == 1, _pick(F.floor(i / 5), "none", "some", "mostly", None), is_complex, degraded)
    return _labels(spark, d).select("doc_id", F.array_join(lanes, "/").alias("lanes"))


def vision_only_lanes(spark: Spark, d: str) -> DataFrame:
    i = F.col("doc_id")
    lane = scoring.by_vision_only(F.col("quality") == 1, i % 3 == 0, _pick(i, *evidence.HANDWRITING), _pick(F.floor(i / 2), *evidence.CAPTURE), _pick(F.floor(i / 3), *evidence.LEGIBILITY))
    return _labels(spark, d).select("doc_id", lane.alias("lane"))


def hash_parity(spark: Spark, d: str) -> DataFrame:
    order, parity = dataset.hash_order(F.col("doc_id").cast("string"))
    return _labels(spark, d).select("doc_id", order.alias("rank"), parity.alias("parity"))


def case_build(spark: Spark, d: str) -> DataFrame:
    l = _labels(spark, d).withColumn("key", F.concat(F.lit("k"), F.col("doc_id").cast("string")))
    final = l.select("key", F.when(F.col("toxic") == 1, F.array().cast("array<string>")).when(F.col("quality") == 1, F.array(F.lit("L1"))).otherwise(F.array(F.lit("L3"), F.lit("L4"))).alias("gt"))
    at = F.concat(F.lit("i"), F.col("doc_id").cast("string"))
    variants = l.filter("doc_id % 4 = 0").select(F.concat(at, F.lit("-fax")).alias("id"), at.alias("of"), F.lit("fax").alias("variant"))
    built = dataset.built_cases(l.filter("doc_id % 3 <> 0").select("key", at.alias("id")), final, variants)
    return built.select("id", "key", F.array_join("gt", "/").alias("gt"), "variant")


def repeated_files(spark: Spark, d: str) -> DataFrame:
    docs = pages.documents(spark, d).select("doc_id", F.sha2("text", 256).alias("digest")).filter("digest is not null")
    return dataset.repeated_files(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"))


def answer_faults(spark: Spark, d: str) -> DataFrame:
    l = _labels(spark, d).select((F.col("doc_id") % 50).alias("batch"), F.col("doc_id").alias("image"))
    given = l.filter("image % 7 <> 0").unionByName(l.filter("image % 9 = 0")).unionByName(l.filter("image % 20 = 3").select("batch", (F.col("image") + 1_000_000).alias("image")))
    return dataset.answer_faults(l, given)


def first_seen(spark: Spark, d: str) -> DataFrame:
    docs = pages.documents(spark, d).select("lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "doc_id")
    return dataset.first_seen(docs, ["lang", "digest"], "doc_id")


def qualification(spark: Spark, d: str) -> DataFrame:
    i = F.col("doc_id")
    codes = {k: v for k, v in dataset.CODES["capture"].items()}
    lanes = F.element_at(F.array(*[F.array(*map(F.lit, v)).cast("array<string>") for v in codes.values()]), (F.floor(i / 3) % len(codes) + 1).cast("int"))
    gt = F.when(F.col("quality") == 1, F.array(F.lit("L3"))).otherwise(F.array(F.lit("L3"), F.lit("L4")))
    return scoring.qualification(_labels(spark, d).select(_pick(i, "a", "b", "c").alias("labeller"), lanes.alias("lanes"), gt.alias("gt")))


def release_faults(spark: Spark, d: str) -> DataFrame:
    listed = pages.documents(spark, d).select(F.col("doc_id").alias("file"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    present = listed.filter("file % 10 <> 4").select("file", F.when(F.col("file") % 25 == 1, "0").otherwise(F.col("digest")).alias("digest"))
    return dataset.release_faults(listed, present)


def holdout_report(spark: Spark, d: str) -> DataFrame:
    """The review rule's outcome on the held-out split and, apart from it, on the rest."""
    c = pages.cases(spark, d)
    held = F.col("split").eqNullSafe("holdout")
    both = [evaluate.outcome(c.filter(f), 0.3).withColumn("held", F.lit(name)) for f, name in ((held, True), (~held, False))]
    return both[0].unionByName(both[1])


def job_keys(spark: Spark, d: str) -> DataFrame:
    return pages.documents(spark, d).select("doc_id", policy.job_id(F.coalesce("text", F.lit("")), policy.digest_of(ROUTE)).alias("job"))


QUERIES = {f.__name__: f for f in (evidence_sentences, vision_sentence, stage_timeline, replay_events, finished_recordings, live_or_past, route_summary, answer_groups, system_lanes, layer_accuracy, mean_probability, system_timing, truth_lanes, vision_only_lanes, hash_parity, case_build, repeated_files, answer_faults, first_seen, qualification, release_faults, holdout_report, job_keys)}
