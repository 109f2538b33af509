"""One page's way to its lane: probe, trust, reading and looking, answers, policy and review, with every way to fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import policy

def knots(calibration: dict) -> Column:
    """A calibration's curves as a map of knots by lane, '*' for the pooled one."""
    curve = lambda points: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])
    curves = {"*": calibration["pooled"], **calibration["lanes"]}
    return F.create_map(*[c for k, points in curves.items() for c in (F.lit(k), curve(points))])


def decided(rows: DataFrame, calibration: dict | None, raw: float = 0.5) -> DataFrame:
    """rows with lane, candidate, path_p, confidence, modifiers, reasons.

    rows: doc_id, page, kind (pdf or image), trusted, needs_ocr, the answers by name, columns, text_script, vision_script
    (null: no vision check), and what went wrong: probe_error, ocr_error, vision_error, answer_error, null where nothing did.
    calibration: pooled and lanes (knots, a few each) and threshold, or None for the raw rule.

    A page that can't be measured goes to LQ; one without a trusted layer that can't be looked at, and one whose
    answers are refused, to review.  A failed OCR only adds its reason.
    """
    rules = policy.Rules(F.col)
    r = rows.withColumns({"candidate_": rules.lane(), "path_": rules.path(), "rule_reasons": rules.reasons()})
    p = policy.confidence(knots(calibration), F.col("candidate_"), F.col("path_")) if calibration else F.lit(None).cast("double")
    r = r.withColumn("confidence_", p)
    lane, why = policy.review(F.col("candidate_"), F.col("path_"), F.col("confidence_"), F.lit(calibration["threshold"] if calibration else 0.0), raw)
    script = F.when(F.col("vision_script").isNotNull(), F.col("vision_script")).otherwise(F.col("text_script"))
    columns = F.when(F.col("kind") == "pdf", F.col("columns"))
    modifiers = rules.modifiers(F.col("candidate_"), F.coalesce(columns, F.lit(0)), F.coalesce(script, F.lit("")))
    said = lambda what, error: F.concat(F.lit(f"{what}: "), error)
    ocr_failed = F.when(~F.col("trusted") & F.col("needs_ocr") & F.col("ocr_error").isNotNull(), said("ocr_failed", F.col("ocr_error")))
    unseen = ~F.col("trusted") & F.col("vision_error").isNotNull()
    stop = (
        F.when(F.col("probe_error").isNotNull(), F.struct(F.lit("LQ").alias("lane"), said("probe_failed", F.col("probe_error")).alias("reason")))
        .when(unseen, F.struct(F.lit("LH").alias("lane"), said("vision_unavailable", F.col("vision_error")).alias("reason")))
        .when(F.col("answer_error").isNotNull(), F.struct(F.lit("LH").alias("lane"), said("jev_rejected", F.col("answer_error")).alias("reason")))
    )
    r = r.withColumns({"stop": stop, "lane_": lane, "why": why, "modifiers_": modifiers, "ocr_failed": ocr_failed})
    went = F.col("stop").isNull()
    made = {
        "lane": F.coalesce("stop.lane", "lane_"),
        "candidate": F.coalesce("stop.lane", "candidate_"),
        "path_p": F.when(went, F.round("path_", 4)).otherwise(1.0),
        "confidence": F.when(went, F.round("confidence_", 4)),
        "modifiers": F.when(went, F.col("modifiers_")).otherwise(F.array().cast("array<string>")),
        "reasons": F.when(went, F.concat("rule_reasons", F.array_compact(F.array("why", "ocr_failed")))).otherwise(F.array("stop.reason")),
    }
    return r.withColumns(made).drop("candidate_", "path_", "rule_reasons", "confidence_", "stop", "lane_", "why", "modifiers_", "ocr_failed")


def timings(stages: dict[str, Column], total: Column) -> Column:
    """map of the milliseconds of the stages that ran, and of the whole page; stages overlap, so they don't add up to it."""
    entries = F.array_compact(F.array(*[F.when(ms.isNotNull(), F.struct(F.lit(k).alias("key"), ms.cast("long").alias("value"))) for k, ms in (stages | {"total": total}).items()]))
    return F.map_from_entries(entries)


def latency(timed: Column) -> Column:
    """The whole page's milliseconds, or the sum of its stages where that wasn't kept."""
    return F.coalesce(F.try_element_at(timed, F.lit("total")), F.aggregate(F.map_values(timed), F.lit(0).cast("long"), lambda s, v: s + v))


def layout_columns(of_layout: Column, of_pdf: Column, is_pdf: Column) -> Column:
    """Columns of a PDF page: as the layout model has them, else by the projection of its text; images have none."""
    return F.when(is_pdf, F.coalesce(of_layout, of_pdf))


def calibration_for(basis: str, stored: DataFrame) -> DataFrame:
    """The stored calibrations (basis, version, threshold, curves) that were fitted on this basis; an empty result means the raw rule."""
    return stored.filter(F.col("basis") == basis)
