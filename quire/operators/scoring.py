"""Scores of systems on labelled cases: lanes with abstentions, the text layer, probabilities, timing, votes on truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import policy

HARD_CAPTURE = ("fax", "camera_photo")


def truth_lanes(real_text: Column, handwriting: Column, is_complex: Column, degraded: Column) -> Column:
    """Right lanes by labels; an unknown (null) label leaves both of its lanes."""
    lanes = lambda *names: F.array(*map(F.lit, names))
    pair = lambda flag, yes, no: F.when(flag.isNull(), lanes(no, yes)).when(flag, lanes(yes)).otherwise(lanes(no))
    return F.when(handwriting == "mostly", lanes("L5")).when(real_text, pair(is_complex, "L2", "L1")).otherwise(pair(degraded, "L4", "L3"))


def degraded_label(captures: Column, legibility: Column) -> Column:
    """True, false or unknown, from the captures that a labeller accepts and the legibility given."""
    hard = F.array(*map(F.lit, HARD_CAPTURE))
    return F.when((F.coalesce(legibility, F.lit("")) == "degraded") | (F.size(F.array_except(captures, hard)) == 0), True).when((legibility == "clean") & ~F.arrays_overlap(captures, hard), False)


def complex_label(table: Column, math: Column, code: Column) -> Column:
    """Unknown if any of the three is."""
    return F.when(table.isNotNull() & math.isNotNull() & code.isNotNull(), table | math | code)


def by_vision_only(real_text: Column, has_complex: Column, handwriting: Column, capture: Column, legibility: Column) -> Column:
    """Lane of a system that sees the page image alone."""
    poor = capture.isin(*HARD_CAPTURE) | legibility.isin("hard_to_read", "illegible", "mild_issues")
    return F.when(real_text, F.when(has_complex, "L2").otherwise("L1")).when(handwriting == "mostly_handwritten", "L5").when(poor, "L4").otherwise("L3")


def lane_metrics(cases: DataFrame, results: DataFrame, by: str | None = None) -> DataFrame:
    """Counts of cases (id, gt) against results (id, lane, error): answered, right, abstained, too weak, too strong, in error.

    A case without a result or with a null lane is an error; lane 'uncertain' abstains.
    """
    r = cases.join(results.select("id", "lane", "error"), "id", "left")
    answered = F.col("error").isNull() & F.col("lane").isNotNull()
    decided, ok = answered & (F.col("lane") != "uncertain"), F.array_contains("gt", F.col("lane"))
    rank, ranks = policy.rank(F.col("lane")), F.transform("gt", policy.rank)
    counts = {
        "n": answered,
        "errors": ~answered,
        "right": decided & ok,
        "abstained": answered & (F.col("lane") == "uncertain"),
        "under": decided & ~ok & (rank < F.array_min(ranks)),
        "over": decided & ~ok & (rank > F.array_max(ranks)),
    }
    return (r.groupBy(by) if by else r.groupBy()).agg(*[F.count_if(c).alias(k) for k, c in counts.items()])


def layer_accuracy(rows: DataFrame) -> DataFrame:
    """How often p >= 0.5 says rightly whether a text layer is real (columns p, truth); rows without p don't count."""
    known = rows.filter("p is not null")
    return known.agg(F.count("*").alias("n"), F.count_if((F.col("p") >= 0.5) == F.col("truth")).alias("right"))


def mean_probability(rows: DataFrame) -> DataFrame:
    """Mean probability in millionths (columns p, ok) where right and where wrong, 0 where there is none."""
    micro = F.round(F.col("p") * 1_000_000).cast("long")
    mean = lambda c: F.coalesce(F.round(F.avg(F.when(c, micro)), 3), F.lit(0.0))
    return rows.agg(mean(F.col("ok")).alias("right_micro"), mean(~F.col("ok")).alias("wrong_micro"))


def timing(rows: DataFrame, *by: str) -> DataFrame:
    """Median latency, the order statistic int(0.95 n) - 1 (the last for n = 1), and cost a thousand; zero latencies don't count."""
    at = F.greatest(F.floor(F.lit(0.95) * F.col("n_latency")), F.lit(1))
    # counts of distinct latencies, so that no list of all rows is built
    each = rows.withColumn("late", F.when(F.col("latency_ms") > 0, F.col("latency_ms"))).groupBy(*by, "late").agg(F.count("*").alias("k"), F.sum("cost_micro").alias("cost"))
    total = each.groupBy(*by).agg(F.sum("k").alias("n"), F.sum("cost").alias("cost"), F.coalesce(F.sum(F.when(F.col("late").isNotNull(), F.col("k"))), F.lit(0)).alias("n_latency"), F.expr("percentile(late, 0.5, k)").alias("p50"), F.sort_array(F.collect_list(F.when(F.col("late").isNotNull(), F.struct("late", "k")))).alias("steps"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("value"))
    step = lambda acc, x: F.struct((acc["seen"] + x["k"]).alias("seen"), F.when(acc["value"].isNull() & (acc["seen"] + x["k"] >= at), x["late"]).otherwise(acc["value"]).alias("value"))
    return total.select(*by, "n", "p50", F.aggregate("steps", start, step, lambda acc: acc["value"]).alias("p95"), F.round(F.col("cost") * 1000 / F.col("n"), 4).alias("micro_per_1000"))


def qualification(answers: DataFrame) -> DataFrame:
    """Answers whose lanes lie within the right ones, and those that equal them (labeller, lanes, gt); no lanes at all is not agreement with any."""
    inside = (F.size("lanes") > 0) & (F.size(F.array_except("lanes", "gt")) == 0)
    return answers.groupBy("labeller").agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"), F.count_if(F.array_sort("lanes") == F.array_sort("gt")).alias("exact"))


def results(cases: DataFrame, routes: DataFrame) -> DataFrame:
    """ordinal, id, lane, error of cases (id, doc_id, page, ordinal), each once and in their order; a page that wasn't routed is an error."""
    joined = cases.join(routes.select("doc_id", "page", "lane"), ["doc_id", "page"], "left")
    error = F.when(F.col("lane").isNull(), F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(" out of range")))
    return joined.select("ordinal", "id", "lane", error.alias("error")).orderBy("ordinal")


def routed_by(override: Column, api: Column) -> Column:
    """A case with a text of its own can't go through a service."""
    return F.when(api & override.isNull(), "service").otherwise("local")


def transport_error(error: Column, status: Column, content: Column) -> Column:
    """Whether a record's call failed, whatever it answered; status null counts as fine."""
    return (F.coalesce(error, F.lit("")) != "") | (F.coalesce(status, F.lit("200")) != "200") | content.isNull()


AXES = ("capture", "legibility", "handwriting", "content", "script")
#: Axes of the composite, kinds of handwriting as labels tell them, what counts as degraded, and flags of content.  Fixed values.
COMPOSITE = ("capture", "handwriting", "content", "script")
WRITTEN = {"none": "none", "annotations_only": "some", "fields_filled_by_hand": "some", "mostly_handwritten": "mostly"}
DEGRADED = ("mild_issues", "hard_to_read", "illegible")
FLAGS = ("table", "math", "form", "code", "chart", "photo")


def page_scores(rows: DataFrame) -> DataFrame:
    """rows (pred, label) with a column for each axis: 1 or 0, null where the label is unknown; content is the share of known flags that match."""
    right = lambda known, test: F.when(known, F.coalesce(test, F.lit(False)).cast("double"))
    kind = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in WRITTEN.items() for x in kv]), c)
    read = F.when(F.col("pred.legibility") == "clean", "clean").when(F.col("pred.legibility").isin(*DEGRADED), "degraded")
    flag = lambda side, k: F.try_element_at(F.col(f"{side}.content"), F.lit(k))
    match = F.array_compact(F.array(*[F.when(flag("label", k).isNotNull(), F.coalesce(flag("pred", k) == flag("label", k), F.lit(False)).cast("double")) for k in FLAGS]))
    made = {
        "capture": right(F.size("label.capture_ok") > 0, F.array_contains("label.capture_ok", F.col("pred.capture"))),
        "legibility": right(F.col("label.legibility").isNotNull(), read == F.col("label.legibility")),
        "handwriting": right(F.col("label.handwriting").isNotNull(), kind(F.col("pred.handwriting")) == F.col("label.handwriting")),
        "content": F.when(F.size(match) > 0, F.aggregate(match, F.lit(0.0), lambda s, x: s + x) / F.size(match)),
        "script": right(F.col("label.script").isNotNull(), F.col("pred.script") == F.col("label.script")),
    }
    return rows.withColumns(made)


def composite(means: list[Column]) -> Column:
    """Mean of the axes that have one."""
    have = F.array_compact(F.array(*means))
    return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda s, x: s + x) / F.size(have))


def ranked(scores: DataFrame, systems: DataFrame) -> DataFrame:
    """system, composite, place: best first; systems without an answer have neither and come last."""
    means = scores.groupBy("system").agg(*[F.avg(a).alias(a) for a in COMPOSITE]).select("system", F.round(composite([F.col(a) for a in COMPOSITE]), 9).alias("composite"))
    by = Window.orderBy(F.desc("composite"), "system")  # a row a system
    return systems.join(means, "system", "left").withColumn("place", F.when(F.col("composite").isNotNull(), F.row_number().over(by)))


def agreement_axes(first: DataFrame, second: DataFrame) -> DataFrame:
    """For each system: pages of both runs (system, page_id, pred, label), share of equal answers by axis, and the first run's composite where all agree and where not."""
    a = page_scores(first).select("system", "page_id", *AXES, F.col("pred").alias("one"))
    j = a.join(second.select("system", "page_id", F.col("pred").alias("two")), ["system", "page_id"])
    same = {x: F.to_json(F.struct(F.col(f"one.{x}").alias("v"))) == F.to_json(F.struct(F.col(f"two.{x}").alias("v"))) for x in COMPOSITE}
    j = j.withColumns({f"same_{x}": c for x, c in same.items()})
    every = F.lit(True)
    for x in COMPOSITE:
        every = every & F.col(f"same_{x}")
    j = j.withColumn("every", every)
    where = lambda test, x: F.avg(F.when(test, F.col(x)))
    g = j.groupBy("system").agg(F.count("*").alias("pages"), F.count_if(~F.col("every")).alias("differ"), *[F.round(F.avg(F.col(f"same_{x}").cast("int")), 6).alias(f"agree_{x}") for x in COMPOSITE], *[where(F.col("every"), x).alias(f"a_{x}") for x in COMPOSITE], *[where(~F.col("every"), x).alias(f"d_{x}") for x in COMPOSITE])
    of = lambda k: F.round(composite([F.col(f"{k}_{x}") for x in COMPOSITE]), 6)
    return g.select("system", "pages", "differ", *[f"agree_{x}" for x in COMPOSITE], of("a").alias("when_agree"), of("d").alias("when_differ"))


def sweep(models: DataFrame, cases: DataFrame) -> DataFrame:
    """system, doc_id, vision_used: every case for every model (a handful), with its vision answer, and again without it on trusted pages."""
    pairs = cases.join(F.broadcast(models))
    runs = F.array(F.struct(F.col("model").alias("system"), F.lit(True).alias("vision_used")), F.struct(F.concat("model", F.lit("_skiptrusted")).alias("system"), (~F.col("trusted")).alias("vision_used")))
    return pairs.select("doc_id", F.explode(runs).alias("r")).select("r.system", "doc_id", "r.vision_used")
