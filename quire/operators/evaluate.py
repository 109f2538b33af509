"""Evaluation metrics, calibration and benchmark scores as DataFrame algebra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import policy
from quire.shared import checkpoint

#: Draws that a task makes, and distinct values that are told apart without a list.
DRAWS, FEW = 4_000_000, 64
#: Lanes need so many cases for a curve of their own.
CURVE_ROWS = 30


def hit(lane: str) -> Column:
    return F.array_contains("gt", F.col(lane))


def order_statistics(counted: DataFrame, by: list[str], value: str, at: dict[str, Column], rest: list[Column] | None = None) -> DataFrame:
    """by and, for each name in at, the value at that place (from 0) among a group's sorted values; `rest` is aggregated too.

    counted: a row for each group and value with n, how often it occurs, so that no group is gathered as a list.  The
    places are Columns over `all`, the group's number of values.
    """
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = counted.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(*by))})
    return c.groupBy(*by).agg(*[F.min(F.when(F.col("upto") > place, F.col(value))).alias(name) for name, place in at.items()], *(rest or []))


def nearest_rank(q: float) -> Column:
    """Place min(n - 1, int(q n))."""
    return F.least(F.col("all") - 1, F.floor(F.col("all") * q))


def upper_rank(q: float) -> Column:
    """Place max(0, int(q n) - 1)."""
    return F.greatest(F.floor(F.col("all") * q) - 1, F.lit(0))


def latencies(rows: DataFrame, *by: str) -> DataFrame:
    """p50 and p95 by nearest rank, p95 by the upper rank, and the median, of latency_ms."""
    counted = rows.groupBy(*by, "latency_ms").agg(F.count("*").alias("n"))
    at = {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95), "upper95": upper_rank(0.95), "low": F.floor((F.col("all") - 1) / 2), "high": F.floor(F.col("all") / 2)}
    return order_statistics(counted, list(by), "latency_ms", at).select(*by, "p50", "p95", "upper95", ((F.col("low") + F.col("high")) / 2).alias("median"))


def _ranks(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"lane_rank": policy.rank(F.col("lane")), "candidate_rank": policy.rank(F.col("candidate")), "gt_rank": policy.least_rank(F.col("gt"))})


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and rates by the given columns, or over all rows, in one pass: sums by latency first, then over the latencies."""
    r = _ranks(rows).withColumn("most_rank", F.array_max(F.array_compact(F.transform("gt", policy.rank))))
    counts = {
        "n": F.lit(True),
        "right": hit("lane"),
        "right_candidates": hit("candidate"),
        "under": F.col("lane_rank") < F.col("gt_rank"),
        "candidate_under": F.col("candidate_rank") < F.col("gt_rank"),
        "over": F.col("lane_rank") > F.col("most_rank"),
        "reviewed": F.col("lane") == "LH",
    }
    counted = r.groupBy(*by, "latency_ms").agg(*[F.count_if(c).alias(k) for k, c in counts.items()], F.sum("cost_micro").alias("cost_micro"))
    m = order_statistics(counted, list(by), "latency_ms", {"p50_ms": nearest_rank(0.5), "p95_ms": nearest_rank(0.95)}, [F.sum(k).alias(k) for k in (*counts, "cost_micro")])
    share = lambda c: F.col(c) / F.col("n")
    return m.select(
        *by,
        "n",
        share("right").alias("accuracy"),
        share("right_candidates").alias("candidate_accuracy"),
        "under",
        "candidate_under",
        "over",
        share("reviewed").alias("review_rate"),
        "p50_ms",
        "p95_ms",
        "cost_micro",
        F.round(F.col("cost_micro") / 1000 / F.col("n"), 4).alias("cost_per_1k"),
    )


def grouped(rows: DataFrame) -> DataFrame:
    """n and right candidates at three grains in one pass: overall, by group, by split (null left out)."""
    flat = rows.select("grp", "split", hit("candidate").cast("int").alias("ok"))
    g = flat.groupingSets([[], ["grp"], ["split"]], "grp", "split").agg(F.grouping_id().alias("grain"), F.count("*").alias("n"), F.sum("ok").alias("right"))
    named = F.when(F.col("grain") == 3, "all").when(F.col("grain") == 1, "group").otherwise("split")
    return g.select(named.alias("grain"), F.coalesce("grp", "split", F.when(F.col("grain") == 3, F.lit("*"))).alias("value"), "n", "right").filter("value is not null")


def at_grains(rows: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """All metrics overall, by group and by split, in one pass: grain, value and the columns of metrics.

    expected (grain, value) are filled in where no row has them: n is 0 and the rest null.  A null group or split counts overall alone.
    """
    pairs = F.array(F.struct(F.lit("all").alias("grain"), F.lit("*").alias("value")), *[F.struct(F.lit(g).alias("grain"), F.col(c).alias("value")) for g, c in (("group", "grp"), ("split", "split"))])
    m = metrics(rows.withColumn("_at", F.explode(pairs)).filter("_at.value is not null").withColumns({"grain": F.col("_at.grain"), "value": F.col("_at.value")}), "grain", "value")
    if expected is None:
        return m
    filled = m.join(expected.select("grain", "value").distinct(), ["grain", "value"], "full")
    return filled.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def confusion(rows: DataFrame, lanes: tuple[str, ...] = ("L1", "L2", "L3", "L4", "L5")) -> DataFrame:
    """Right sets against candidate lanes, zeros filled."""
    return rows.groupBy(F.array_join("gt", "/").alias("gt")).pivot("candidate", list(lanes)).count().na.fill(0)


def threshold(cost_ratio: float) -> float:
    if cost_ratio <= 0:
        raise ValueError("the cost ratio must be positive")
    return round(max(0.0, 1 - 1 / cost_ratio), 6)


def lower_hull(weight: np.ndarray, total: np.ndarray) -> list[tuple[int, int, float]]:
    """Isotonic means by their definition: first and last position and slope of each edge of the lower convex hull.

    The points are the running sums of total against those of weight, from (0, 0).  From each vertex the hull
    goes on to the point of least slope, the last one of these on a tie.
    """
    x, y = np.append(0.0, np.cumsum(weight)), np.append(0.0, np.cumsum(total))
    at, edges = 0, []
    while at < len(weight):
        slopes = (y[at + 1 :] - y[at]) / (x[at + 1 :] - x[at])
        end = len(weight) - int(np.argmin(slopes[::-1]))
        edges.append((at, end - 1, float(slopes[end - at - 1])))
        at = end
    return edges


def _curve(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("x")
    x, edges = pdf["x"].to_numpy(), lower_hull(pdf["n"].to_numpy(dtype=float), pdf["ok"].to_numpy(dtype=float))
    knots = [(x[k], round(slope, 4)) for lo, hi, slope in edges for k in sorted({lo, hi})]
    return pd.DataFrame({"curve": pdf["curve"].iloc[0], "x": [k[0] for k in knots], "y": [k[1] for k in knots]})


def curves(rows: DataFrame) -> DataFrame:
    """curve ('*' for all lanes, else a lane with CURVE_ROWS cases), x, y.

    Ties are grouped first; x has four places, so a curve's group has 10,001 rows at most however many cases there are,
    and what counts a curve's cases needs no second pass over them.
    """
    cases_ = rows.select("candidate", F.round("path_p", 4).alias("x"), hit("candidate").cast("int").alias("ok"))
    each = cases_.groupBy("candidate", "x").agg(F.sum("ok").alias("ok"), F.count("*").alias("n"))
    # other lanes go here, since a filter on the cases is pushed down to their texts and has all measures made once more there
    usable = F.col("candidate").isin(*[x for x in policy.RANK if x != "L0"])
    named = F.array(*[F.when(usable, name) for name in (F.lit("*"), F.col("candidate"))])
    each = each.withColumn("curve", F.explode(named)).filter(F.col("curve").isNotNull()).groupBy("curve", "x").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n"))
    cases = F.sum("n").over(Window.partitionBy("curve"))
    return each.withColumn("cases", cases).filter((F.col("cases") >= CURVE_ROWS) | (F.col("curve") == "*")).groupBy("curve").applyInPandas(_curve, "curve string, x double, y double")


def knot_table(fitted: DataFrame) -> DataFrame:
    """One row a curve with its knots as array<struct<x, y>>, ascending."""
    return fitted.groupBy("curve").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("knots"))


def versioned(fitted: DataFrame, cost_ratio: float, basis: str | None) -> DataFrame:
    """version, threshold, curves, basis of fitted curves: one row, whose version follows all that it says."""
    knot = F.concat_ws("|", "curve", F.format_string("%.4f", "x"), F.format_string("%.4f", "y"))
    parts = fitted.agg(F.array_join(F.array_sort(F.collect_list(knot)), ";").alias("knots"), F.count_distinct("curve").alias("curves"))  # a few thousand knots at most
    least = threshold(cost_ratio)
    whole = F.concat_ws("#", "knots", F.lit(f"{least:.6f}"), F.lit("" if basis is None else basis))
    return parts.select(F.concat(F.lit("c2-"), F.left(F.sha2(whole, 256), F.lit(10))).alias("version"), F.lit(least).alias("threshold"), "curves", F.lit(basis).cast("string").alias("basis"))


def calibration(fitted: DataFrame, cost_ratio: float, basis: str | None) -> dict:
    """What a calibration file holds: version, threshold, cost_ratio, basis, pooled and lanes (knots)."""
    knots = {r["curve"]: [[k["x"], k["y"]] for k in r["knots"]] for r in knot_table(fitted).collect()}
    head = versioned(fitted, cost_ratio, basis).first()
    return {"version": head["version"], "threshold": head["threshold"], "cost_ratio": cost_ratio, "basis": basis, "pooled": knots.pop("*", []), "lanes": dict(sorted(knots.items()))}


def applicable(calibration_: dict | None, basis: str) -> dict | None:
    """The calibration if it was fitted on this basis; else none, and review goes by the raw threshold."""
    return calibration_ if calibration_ and calibration_["basis"] == basis else None


def one_basis(rows: DataFrame) -> DataFrame:
    """bases, null counted as one, and whether the rows can be fitted on."""
    n = rows.agg((F.count_distinct("basis") + F.max(F.col("basis").isNull().cast("int"))).alias("bases"))
    return n.select("bases", (F.col("bases") == 1).alias("fits"))


def outcome(rows: DataFrame, least: float) -> DataFrame:
    """What reviewing below a probability costs: review, wrong among it, and wrong or too weak without review."""
    r = _ranks(rows).withColumns({"ok": hit("candidate"), "review": F.col("path_p") < least})
    n, of = F.count("*"), lambda c: F.count_if(c)
    return r.agg(
        n.alias("n"),
        of(F.col("review")).alias("reviewed"),
        of(F.col("review") & ~F.col("ok")).alias("reviewed_wrong"),
        of(~F.col("review") & F.col("ok")).alias("kept_right"),
        of(~F.col("review") & ~F.col("ok")).alias("silent_wrong"),
        of(~F.col("review") & (F.col("candidate_rank") < F.col("gt_rank"))).alias("silent_under"),
    )


def selective(rows: DataFrame, least: tuple[float, ...] = (0.5, 0.7, 0.9, 0.99)) -> DataFrame:
    """Coverage and right ones at several thresholds, in one pass over the rows."""
    r = rows.select("path_p", hit("candidate").alias("ok"), F.explode(F.array(*map(F.lit, least))).alias("tau"))
    return r.groupBy("tau").agg(F.count("*").alias("n"), F.count_if(F.col("path_p") >= F.col("tau")).alias("covered"), F.count_if((F.col("path_p") >= F.col("tau")) & F.col("ok")).alias("right"))


def calibration_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Cases, right ones and probability (millionths) by equal bins, the last closed."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("path_p") * bins)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.count_if(hit("candidate")).alias("right"), F.sum(F.round(F.col("path_p") * 1_000_000).cast("long")).alias("p_micro"))


def expected_error(rows: DataFrame) -> DataFrame:
    b = calibration_bins(rows)
    gap = F.abs(F.col("p_micro") / 1_000_000 - F.col("right"))
    return b.agg(F.round(F.sum(gap) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))


def pareto(systems: DataFrame, parts: int = 1024) -> DataFrame:
    """Systems (name, score, cost) that no other beats.

    The best score at each cost is aggregated first; of these those stay that exceed every cheaper one.  Costs are cut
    into ranges whose best scores are compared first, so that no task sorts all of them.
    """
    best = systems.filter("cost is not null and score is not null").groupBy("cost").agg(F.max("score").alias("score"))
    ends = best.agg(F.min("cost").alias("lo"), F.max("cost").alias("hi"))
    part = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("cost") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (parts - 1))).otherwise(F.lit(0))
    best = best.join(F.broadcast(ends)).withColumn("part", part)  # ends is one row
    cheaper = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over `parts` rows at most
    tops = best.groupBy("part").agg(F.max("score").alias("top")).select("part", F.max("top").over(cheaper).alias("below"))
    inside = F.max("score").over(Window.partitionBy("part").orderBy("cost").rowsBetween(Window.unboundedPreceding, -1))
    seen = best.withColumn("inside", inside).join(F.broadcast(tops), "part").withColumn("before", F.greatest("inside", "below"))
    front = seen.filter(F.col("before").isNull() | (F.col("score") > F.col("before"))).select("cost", "score")
    return systems.join(front, ["cost", "score"], "left_semi").select("name", "score", "cost")


def shared_core(results: DataFrame, least: float = 0.8) -> DataFrame:
    """Pages that every system with at least `least` of the largest coverage has (name, page)."""
    cover = results.groupBy("name").agg(F.count_distinct("page").alias("n"))
    top = cover.agg(F.max("n").alias("top"))
    core = cover.join(F.broadcast(top), F.col("n") >= least * F.col("top")).select("name")
    k = core.agg(F.count("*").alias("k"))
    pages = results.join(core, "name").groupBy("page").agg(F.count_distinct("name").alias("have"))
    return pages.join(F.broadcast(k), F.col("have") == F.col("k")).select("page")


def run_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Same lanes and mean absolute change of probability between two runs (doc_id, page, lane, p)."""
    j = a.alias("a").join(b.alias("b"), ["doc_id", "page"])
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("a.lane") == F.col("b.lane")).alias("same"), F.sum(F.round(F.abs(F.col("a.p") - F.col("b.p")) * 1_000_000).cast("long")).alias("moved_micro"))


def bootstrap(rows: DataFrame, value: str, resamples: int = 1000, seed: int = 3, places: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """low and high of the mean of value over resamples of whole rows with replacement: order statistics at int(place * resamples).

    Rows are counted by value first.  Draw j of resample k picks the row at place hash(seed, k, j) modulo n in order of
    value, found among the running counts of the distinct values, so neither order nor place of the rows matters and
    every run agrees.  The draws, rows times resamples, are made on the executors, DRAWS a task.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row a distinct value
    counted = checkpoint(counted.withColumn("upto", upto))
    n, kinds = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # a row a draw, dealt evenly: a resample's draws lie in one or two tasks and are added up there
    drawn = rows.sparkSession.range(0, resamples * n, 1, max(1, -(-resamples * n // DRAWS)))
    drawn = drawn.select((F.expr(f"id div {max(n, 1)}") + 1).alias("k"), (F.col("id") % max(n, 1) + 1).alias("j"))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "k", "j")), 1, 15)
    drawn = drawn.withColumn("place", F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(n)))
    if kinds <= FEW:
        picked = F.lit(None)
        for r in counted.orderBy(F.desc("upto")).collect():
            picked = F.when(F.col("place") < r["upto"], F.lit(r["value"])).otherwise(picked)
    else:
        drawn = drawn.join(F.broadcast(counted.agg(F.array_sort(F.collect_list(F.struct("upto", "value"))).alias("steps"))))
        picked = F.element_at(F.filter("steps", lambda s: s["upto"] > F.col("place")), 1)["value"]
    means = drawn.groupBy("k").agg(F.avg(picked).alias("mean")).withColumn("i", F.row_number().over(Window.orderBy("mean", "k")) - 1)
    at = [int(q * resamples) for q in places]
    return means.agg(F.min(F.when(F.col("i") == at[0], F.col("mean"))).alias("low"), F.min(F.when(F.col("i") == at[1], F.col("mean"))).alias("high"), F.count("*").alias("resamples"))
