"""Segments and manifests: ordered folds over a document's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = "struct<page:int,lane:string,continuation:double,modifiers:array<string>>"
RUN = "struct<start:int,stop:int,lane:string,modifiers:array<string>>"
_MERGING = ("L1", "L2", "L3", "L4", "L5")


def fold(pages: Column) -> Column:
    """Runs of a sorted array of PAGE structs.

    A page joins the run before it if their lanes are equal, or if both lanes may merge and the
    page continues; the run then has the stronger lane.  The run's lane, not the last page's, is compared.
    """
    may = lambda lane: lane.isin(*_MERGING)

    def step(runs: Column, p: Column) -> Column:
        run = F.element_at(runs, -1)
        alone = F.struct(p["page"].alias("start"), p["page"].alias("stop"), p["lane"].alias("lane"), p["modifiers"].alias("modifiers")).cast(RUN)
        joins = (run["lane"] == p["lane"]) | (may(run["lane"]) & may(p["lane"]) & (F.coalesce(p["continuation"], F.lit(0.0)) >= 0.5))
        # names of merging lanes sort as their ranks do
        merged = F.struct(run["start"].alias("start"), p["page"].alias("stop"), F.greatest(run["lane"], p["lane"]).alias("lane"), F.array_union(run["modifiers"], p["modifiers"]).alias("modifiers")).cast(RUN)
        shorter = F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0)))
        return F.when(F.size(runs) == 0, F.array(alone)).when(joins, F.array_append(shorter, merged)).otherwise(F.array_append(runs, alone))

    runs = F.aggregate(pages, F.array().cast(f"array<{RUN}>"), step)
    return F.transform(runs, lambda r: r.withField("modifiers", F.array_sort(r["modifiers"])))


def by_document(routes: DataFrame) -> DataFrame:
    """doc_id, pages (sorted array of PAGE).  A document has 2,000 pages at most by the intake limit."""
    p = F.struct(F.col("page").cast("int").alias("page"), "lane", F.col("continuation").cast("double").alias("continuation"), F.coalesce("modifiers", F.array().cast("array<string>")).alias("modifiers"))
    return routes.groupBy("doc_id").agg(F.array_sort(F.collect_list(p)).alias("pages"))


def segments(routes: DataFrame) -> DataFrame:
    """doc_id, start, stop, lane, modifiers: one row a segment of routes (doc_id, page, lane, continuation, modifiers)."""
    runs = by_document(routes).select("doc_id", F.explode(fold(F.col("pages"))).alias("r"))
    return runs.select("doc_id", "r.start", "r.stop", "r.lane", "r.modifiers")


def widths(runs: DataFrame) -> DataFrame:
    """runs with width, the percentage of the document's pages."""
    total = runs.groupBy("doc_id").agg(F.max("stop").alias("last"))
    return runs.join(total, "doc_id").withColumn("width", (F.col("stop") - F.col("start") + 1) * 100.0 / F.greatest(F.col("last") + 1, F.lit(1))).drop("last")


def manifests(routes: DataFrame) -> DataFrame:
    """One row a document: pages in order, segments, lane counts, cost in millionths."""
    p = F.struct(F.col("page").cast("int").alias("page"), "lane", F.col("continuation").cast("double").alias("continuation"), F.coalesce("modifiers", F.array().cast("array<string>")).alias("modifiers"))
    docs = routes.groupBy("doc_id").agg(F.array_sort(F.collect_list(p)).alias("pages"), F.sum("cost_micro").alias("cost_micro"))
    return docs.withColumn("segments", fold(F.col("pages")))


def lane_counts(routes: DataFrame) -> DataFrame:
    """doc_id, pages, lanes: pages of each document, in all and by lane (array of lane and n, by lane)."""
    each = routes.groupBy("doc_id", "lane").agg(F.count("*").alias("n"))
    return each.groupBy("doc_id").agg(F.sum("n").alias("pages"), F.array_sort(F.collect_list(F.struct("lane", "n"))).alias("lanes"))  # a few lanes a document


def reuse(wanted: DataFrame, stored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Documents whose manifest is stored under the route key, and those to be routed."""
    have = stored.filter(F.col("route_key") == key).select("doc_id").distinct()
    return wanted.join(have, "doc_id", "left_semi"), wanted.join(have, "doc_id", "left_anti")
