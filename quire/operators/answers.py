"""Responses of models: parsing, attempts, cost by page, and the simpler routing systems they are compared with."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import SPACE, odd_body_share


def unwrapped(content: Column, lenient: bool = False) -> Column:
    """The JSON of a response as a variant, a list of one element as that element; null if it isn't JSON.

    lenient: code fences around it go first.
    """
    if lenient:
        content = F.trim(F.regexp_replace(F.regexp_replace(content, r"^\s*```(json)?", ""), r"```\s*$", ""))
    v = F.try_parse_json(content)
    single = F.schema_of_variant(v).startswith("ARRAY") & F.try_variant_get(v, "$[0]", "variant").isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull()
    return F.when(single, F.try_variant_get(v, "$[0]", "variant")).otherwise(v)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def first_valid(attempts: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """key, code, why, cost: the first attempt with a known code; cost is that of all attempts up to it.

    attempts: key, attempt, content, cost.  Without a valid one code is null and cost is that of all.
    """
    v = unwrapped(F.col("content"))
    upto = Window.partitionBy("key").orderBy("attempt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = attempts.withColumns({"spent": F.sum("cost").over(upto), "v": v})
    a = a.withColumns({"code": F.try_variant_get("v", "$.code", "string"), "why": F.trim(F.regexp_replace(F.try_variant_get("v", "$.why", "string"), r"\s+", " "))})
    valid = F.col("code").isin(*codes) & F.col("why").isNotNull()
    best = F.min_by(F.struct("code", "why", "spent"), F.when(valid, F.col("attempt")))
    made = a.groupBy("key").agg(best.alias("best"), F.max("spent").alias("all"))
    return made.select("key", "best.code", F.coalesce("best.why", F.lit("")).alias("why"), F.coalesce("best.spent", "all").alias("cost"))


def page_cost(calls: DataFrame) -> DataFrame:
    """calls (batch, cost of the batch) with the share of each page."""
    return calls.withColumn("page_cost", F.col("cost") / F.count("*").over(Window.partitionBy("batch")))


def five_questions(hw: Column, tl: Column, camera: Column, degraded: Column, cx: Column) -> tuple[Column, Column]:
    """Lane and probability of its path by the rule table of five answers; missing answers count as 0."""
    hw, tl, camera, degraded, cx = (F.coalesce(c, F.lit(0.0)) for c in (hw, tl, camera, degraded, cx))
    bad, half = F.greatest(camera, degraded), 0.5
    rules = [(hw >= half, "L5", hw), ((tl >= half) & (cx >= half), "L2", (1 - hw) * tl * cx), (tl >= half, "L1", (1 - hw) * tl * (1 - cx)), (bad >= half, "L4", (1 - hw) * (1 - tl) * bad)]
    lane, p = F.lit("L3"), (1 - hw) * (1 - tl) * (1 - bad)
    for when, name, path in reversed(rules):
        lane, p = F.when(when, name).otherwise(lane), F.when(when, path).otherwise(p)
    return lane, p


def without_model(real_text: Column, text: Column, fonts: Column, confidence: Column, common: Column, border: Column, sharpness: Column, background: Column, noise: Column) -> Column:
    """Lane by measures alone: what a system without any model gets."""
    digits = F.regexp_count(text, F.lit(r"\p{Nd}")) / F.greatest(F.length(text), F.lit(1))
    poor = (border < 200) | (sharpness < 300) | (background < 235) | (noise >= 2)
    return F.when(real_text, F.when(fonts | (digits > 0.12), "L2").otherwise("L1")).when((confidence < 0.7) & (common < 0.1), "L5").when(poor, "L4").otherwise("L3")


def layer_class(text: Column, coverage: Column) -> Column:
    """none, ocr (a layer over a scan), garbled or trusted."""
    n = F.length(F.regexp_replace(text, SPACE, ""))
    broken = text.contains("(cid:") | (odd_body_share(text) >= 0.2)
    return F.when(coverage >= 0.9, F.when(n > 50, "ocr").otherwise("none")).when((n >= 200) & broken, "garbled").when(n >= 20, "trusted").otherwise("none")


def overridden(labels: DataFrame, overrides: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """labels (id, columns, structs) with fields set where a glob fits the id, the last one last, and the globs that did in `overrides`.

    A name with a dot sets a field of a struct column.
    """
    fits = {glob: F.col("id").rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$") for glob, _ in overrides}
    out = labels
    for glob, fields in overrides:
        for name, value in fields.items():
            outer, _, inner = name.partition(".")
            new = F.col(outer).withField(inner, F.lit(value)) if inner else F.lit(value)
            out = out.withColumn(outer, F.when(fits[glob], new).otherwise(F.col(outer)))
    return out.withColumn("overrides", F.array_compact(F.array(*[F.when(fit, F.lit(glob)) for glob, fit in fits.items()])))
