"""Documents to pages, their measures, answers and routes, on the tables at hand.

The hosted models are an answer source; here it is a scripted scorer, which tests the rules and
says nothing about a model's quality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import policy, text

PAGE_CHARS = 1200
#: Scripted answers: seed and scale of the noise.
SCRIPTED = {"mostly_handwritten": (1, 0.52), "complex_layout": (3, 0.7), "has_code": (5, 0.4), "is_form": (6, 0.45), "camera_or_fax": (7, 0.6), "heavily_degraded": (8, 0.55), "capture_defects": (9, 0.55), "has_handwriting": (11, 0.6)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def explode_pages(docs: DataFrame, size: int = PAGE_CHARS) -> DataFrame:
    """doc_id, source, lang, page, text: texts cut into pages of `size` code points; one page at least.  Null text is empty.

    One pass over each text, whatever its length.
    """
    whole = F.coalesce("text", F.lit(""))
    cut = F.when(whole == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    return docs.select("doc_id", "source", "lang", F.posexplode(cut).alias("page", "text"))


def layers(pages: DataFrame) -> DataFrame:
    """Every seventh document's layer is garbled, as broken fonts do."""
    return pages.withColumn("text", F.when(F.col("doc_id") % 7 == 0, text.garble_cid("text")).otherwise(F.col("text")))


def measured(pages: DataFrame) -> DataFrame:
    """pages with chars, cid_share, odd_char_share, short_token_share, math_share."""
    t = F.col("text")
    return pages.withColumns({"chars": text.chars(t), "cid_share": text.cid_share(t), "odd_char_share": text.odd_char_share(t), "short_token_share": text.short_token_share(t), "math_share": text.math_share(t)})


def noise(seed: int) -> Column:
    return ((F.col("doc_id") * 7919 + F.col("page") * 104729 + seed * 1299709) % 1000) / 1000.0


def answered(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Measured pages with trust, the scripted answers and their lane and path; no shuffle up to here."""
    m = measured(layers(explode_pages(documents(spark, sf_dir) if docs is None else docs)))
    m = m.withColumn("trusted", policy.trusted(F.col("chars"), F.lit(""), F.col("cid_share"), F.col("odd_char_share"), F.lit(False), F.lit(0.0)))
    made = {k: noise(seed) * scale for k, (seed, scale) in SCRIPTED.items()}
    made["text_layer_trustworthy"] = F.when(F.col("trusted"), 0.5 + noise(2) * 0.5).otherwise(noise(2) * 0.6)
    made["has_table"] = F.when(text.count_of(F.col("text"), "|") > 5, 0.9).otherwise(noise(4) * 0.4)
    made["has_math"] = F.when(F.col("math_share") >= 0.008, 0.8).otherwise(0.1)
    made["continuation"] = noise(10)
    m = m.withColumns(made)
    rules = policy.Rules(F.col)
    return m.withColumns({"candidate": rules.lane(), "path_p": rules.path()})


def routed(spark: SparkSession, sf_dir: str, least: float = 0.35, docs: DataFrame | None = None) -> DataFrame:
    return answered(spark, sf_dir, docs).withColumn("lane", policy.reviewed(F.col("candidate"), F.col("path_p"), least))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed pages of labelled documents with a set of right lanes, group, split, latency and cost.

    Only labelled documents are cut into pages and measured.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    docs = documents(spark, sf_dir)
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    gt = F.when(F.col("toxic") == 1, F.array(F.lit("L3"), F.lit("L4"))).when(F.col("quality") == 0, F.array(F.lit("L2"))).when(F.col("doc_id") % 3 == 0, F.array(F.lit("L1"), F.lit("L2"))).otherwise(F.array(F.lit("L1")))
    group = F.element_at(F.array(*map(F.lit, ("img", "pdf", "ocr", "garb"))), (F.col("doc_id") % 4 + 1).cast("int"))
    split = F.when(F.col("doc_id") % 3 == 0, "tune").when(F.col("doc_id") % 3 == 1, "holdout")
    rows = routed(spark, sf_dir, docs=labelled).join(labels, "doc_id")
    return rows.withColumns({"gt": gt, "grp": group, "split": split, "latency_ms": (F.col("doc_id") * 31 + F.col("page") * 17) % 5000, "cost_micro": F.col("chars").cast("long") * 3})
