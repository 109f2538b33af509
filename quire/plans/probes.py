"""Named queries on boxes, responses, simple systems and the live view, each next to its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import answers, layout, lifecycle, pages

Spark = SparkSession
_KEYS = ["doc_id", "page"]
_CODES = ("simple", "complex", "borderline", "unusable")
#: Globs on label ids and the fields they set.
OVERRIDES = [("doc-1*", {"state": "seen"}), ("doc-*7", {"state": "again", "content.table": "yes"}), ("doc-1?", {"content.math": "no"})]
_REPLIES = ('{"code":"simple","why":"  a\\n b "}', '[{"code":"complex","why":"x  y"}]', '```json\n{"code":"borderline","why":"z"}\n```', "not json", '{"code":"other","why":"q"}', '[{"code":"simple","why":"one"},{"code":"simple","why":"two"}]')


def _lines(spark: Spark, d: str) -> DataFrame:
    """Order lines, whose numbers stand for boxes."""
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_linenumber").alias("z"), F.col("l_quantity").cast("int").alias("qty"))


def _objects(spark: Spark, d: str) -> DataFrame:
    o = _lines(spark, d).select(F.col("l_orderkey").alias("page"), "z", F.when(F.col("pk") % 3 == 0, "text").otherwise("image").alias("kind"), (F.col("sk") % 11 == 0).alias("invisible"), (F.col("pk") % 30 - 5).alias("left"), (F.col("qty") % 40 - 10).alias("bottom"), "pk", "sk")
    return o.select("page", "z", "kind", "invisible", "left", "bottom", (F.col("left") + 20 + F.col("sk") * 7 % 90).alias("right"), (F.col("bottom") + 30 + F.col("pk") % 90).alias("top"), F.lit(100).alias("width"), F.lit(100).alias("height"))


def _regions(spark: Spark, d: str) -> DataFrame:
    r = _lines(spark, d).select(F.col("l_orderkey").alias("page"), F.element_at(F.array(*map(F.lit, ("Text", "text", "Equation", "table"))), (F.col("pk") % 4 + 1).cast("int")).alias("label"), (F.col("pk") % 60).alias("left"), (F.col("qty") * 7 % 80).alias("top"), "pk", "sk")
    return r.select("page", "label", "left", "top", (F.col("left") + 8 + F.col("sk") % 30).alias("right"), (F.col("top") + 3 + F.col("pk") % 15).alias("bottom"), F.lit(100).alias("width"), F.lit(100).alias("height"))


def image_coverage(spark: Spark, d: str) -> DataFrame:
    return layout.coverage(_objects(spark, d))


def projection_columns(spark: Spark, d: str) -> DataFrame:
    odd = F.col("z") % 2 == 1
    r = _lines(spark, d).select(F.floor(F.col("l_orderkey") / 5).alias("page"), F.when(odd, 55 + F.col("pk") % 8).otherwise(5 + F.col("pk") % 8).alias("left"), F.when(F.col("sk") % 9 == 0, 92).when(odd, 88 + F.col("pk") % 5).otherwise(40 + F.col("pk") % 5).alias("right"), F.col("z").alias("size"), F.lit(100).alias("width"))
    return layout.profile_columns(r).select("page", F.col("columns").cast("double").alias("columns"))


def region_facts(spark: Spark, d: str) -> DataFrame:
    return layout.region_facts(_regions(spark, d))


def region_columns(spark: Spark, d: str) -> DataFrame:
    return layout.region_columns(_regions(spark, d)).select("page", F.col("columns").cast("double").alias("columns"))


def _attempts(spark: Spark, d: str) -> DataFrame:
    """Three replies for each labelled document, some of them unusable."""
    l = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("key"))
    a = l.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(2))))
    reply = F.element_at(F.array(*map(F.lit, _REPLIES)), ((F.col("key") * 7 + F.col("attempt") * 3 + F.floor(F.col("key") / 5)) % len(_REPLIES) + 1).cast("int"))
    return a.select("key", "attempt", reply.alias("content"), (100 + (F.col("key") * 13 + F.col("attempt") * 7) % 50).alias("cost"))


def first_valid_answer(spark: Spark, d: str) -> DataFrame:
    return answers.first_valid(_attempts(spark, d), _CODES)


def parse_modes(spark: Spark, d: str) -> DataFrame:
    """Replies that are an object as they stand, and with fences and lists taken off."""
    a = _attempts(spark, d)
    strict, lenient = answers.is_object(F.try_parse_json("content")), answers.is_object(answers.unwrapped(F.col("content"), lenient=True))
    return a.groupBy("attempt").agg(F.count("*").alias("n"), F.count_if(strict).alias("strict"), F.count_if(lenient).alias("lenient"))


def batch_cost(spark: Spark, d: str) -> DataFrame:
    """Orders as batches and their lines as pages."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("batch"), F.col("o_totalprice").alias("cost"))
    l = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("page"))
    return answers.page_cost(l.join(o, "batch")).select("batch", "page", F.round("page_cost", 6).alias("page_cost"))


def five_question_rules(spark: Spark, d: str) -> DataFrame:
    lane, p = answers.five_questions(*map(F.col, ("mostly_handwritten", "text_layer_trustworthy", "camera_or_fax", "heavily_degraded", "complex_layout")))
    return pages.answered(spark, d).select(*_KEYS, lane.alias("lane"), F.round(p, 4).alias("p"))


def rules_without_model(spark: Spark, d: str) -> DataFrame:
    n = lambda k, m: F.col("doc_id") * k % m
    lane = answers.without_model(F.col("trusted"), F.col("text"), F.col("has_math") >= 0.5, n(3, 10) / 10, n(7, 10) / 50, 150 + n(11, 100), 200 + n(13, 400), 220 + n(17, 30), n(19, 4))
    return pages.answered(spark, d).select(*_KEYS, lane.alias("lane"))


def text_layer_class(spark: Spark, d: str) -> DataFrame:
    """Every eleventh document has private-use characters behind its text, a fifth of it without the blanks between them."""
    cover = F.when(F.col("doc_id") % 5 == 0, 0.95).otherwise(0.1)
    m = pages.layers(pages.explode_pages(pages.documents(spark, d)))
    odd = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.repeat(F.lit("\ue000  "), F.floor(F.length("text") / 4).cast("int")))).otherwise(F.col("text"))
    return m.select(*_KEYS, answers.layer_class(odd, cover).alias("layer"))


def label_overrides(spark: Spark, d: str) -> DataFrame:
    l = spark.read.parquet(f"{d}/labels.parquet")
    l = l.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("state"), F.struct(F.lit("?").alias("table"), F.lit("?").alias("math")).alias("content"))
    return answers.overridden(l, OVERRIDES).select("id", "state", F.col("content.table").alias("has_table"), F.col("content.math").alias("has_math"), F.array_join("overrides", ",").alias("overrides"))


def category_counts(spark: Spark, d: str) -> DataFrame:
    return pages.cases(spark, d).select("grp", F.explode("gt").alias("category")).groupBy("grp", "category").agg(F.count("*").alias("n"))


def landed_counts(spark: Spark, d: str) -> DataFrame:
    e = lifecycle.job_events(spark, d)
    return lifecycle.landed(e.select("id", F.col("job").alias("page"), F.concat(F.lit("L"), (F.col("ms") % 5 + 1).cast("string")).alias("lane")))


def activity_heat(spark: Spark, d: str) -> DataFrame:
    h = lifecycle.heat(lifecycle.job_events(spark, d), F.timestamp_seconds(F.lit(1706745600)), decay_s=1.4 * 86400)
    return h.select("type", F.round("heat", 8).alias("heat"))


def capped_log(spark: Spark, d: str) -> DataFrame:
    return lifecycle.newest_events(lifecycle.job_events(spark, d)).select("id", "job", "type")


def status_backlog(spark: Spark, d: str) -> DataFrame:
    return lifecycle.backlog(lifecycle.states(lifecycle.job_events(spark, d)))


def latency_buckets(spark: Spark, d: str) -> DataFrame:
    return pages.cases(spark, d).groupBy("grp").agg(*lifecycle.buckets(F.col("latency_ms"), (100, 500, 1000, 2500)))


QUERIES = {f.__name__: f for f in (image_coverage, projection_columns, region_facts, region_columns, first_valid_answer, parse_modes, batch_cost, five_question_rules, rules_without_model, text_layer_class, label_overrides, category_counts, landed_counts, activity_heat, capped_log, status_backlog, latency_buckets)}
