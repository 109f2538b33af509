"""Facts of a page's boxes: image coverage, hidden text, text columns, regions by label.

Boxes of one page are the only thing ever gathered in one row, and a page has a few dozen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of the coverage grid by side; a row of cells is one long.
GRID = 64
#: Share of the grid under later images that hides a page's text.
HIDDEN_SHARE = 0.9
#: Rectangles that a projection profile needs.
LEAST_RECTS = 10
#: Least width of a text region that counts for columns, and least share of text height side by side.
REGION_WIDTH, SIDE_BY_SIDE = 0.15, 0.2
#: Detector labels that have another name here.  Fixed values.
LABEL_NAMES = {"equation": "formula"}


def _cells(low: Column, high: Column, size: Column) -> tuple[Column, Column]:
    """First cell and the one behind the last that a span touches."""
    return F.greatest(F.floor(low / size * GRID), F.lit(0)).cast("int"), F.least(F.ceil(high / size * GRID), F.lit(GRID)).cast("int")


def coverage(objects: DataFrame) -> DataFrame:
    """page, coverage, hidden from page objects: page, z, kind (text or image), invisible, left, bottom, right, top, width, height.

    coverage is the share of grid cells under images, overlaps counted once.  Text is hidden
    when it is drawn invisibly, or under images drawn after the first text that cover nearly
    all.  Each row of cells is a mask of 64 bits; boxes alone are shuffled.
    """
    a, z = _cells(F.col("left"), F.col("right"), F.col("width"))
    low, high = _cells(F.col("bottom"), F.col("top"), F.col("height"))
    o = objects.select("page", "z", "kind", "invisible", a.alias("a"), (z - a).alias("n"), low.alias("low"), high.alias("high"))
    drawn = (F.col("kind") == "image") & (F.col("n") > 0) & (F.col("high") > F.col("low"))
    mask = F.expr(f"shiftleft(shiftrightunsigned(-1L, {GRID} - n), a)")  # n set bits from bit a on
    seen = (F.col("kind") == "text") & F.col("invisible")
    # one row a box is sent, and a page's boxes are laid on its grid where they meet
    boxes = o.groupBy("page").agg(F.collect_list(F.when(drawn, F.struct("z", "low", "high", mask.alias("mask")))).alias("boxes"), F.min(F.when(F.col("kind") == "text", F.col("z"))).alias("first"), F.bool_or(seen).alias("invisible"))
    late = F.filter("boxes", lambda b: F.coalesce(b["z"] > F.col("first"), F.lit(False)))
    covers = lambda some, row: F.aggregate(some, F.lit(0).cast("long"), lambda m, b: F.when((b["low"] <= row) & (row < b["high"]), m.bitwiseOR(b["mask"])).otherwise(m))
    cells = lambda some: F.aggregate(F.sequence(F.lit(0), F.lit(GRID - 1)), F.lit(0).cast("long"), lambda n, row: n + F.bit_count(covers(some, row)))
    whole = GRID * GRID
    pages = boxes.withColumn("late", late).select("page", "invisible", cells(F.col("boxes")).alias("under"), cells(F.col("late")).alias("over"))
    return pages.select("page", (F.col("under") / whole).alias("coverage"), (F.col("invisible") | (F.col("over") / whole >= HIDDEN_SHARE)).alias("hidden"))


def profile_columns(rects: DataFrame) -> DataFrame:
    """page, columns from text rectangles: page, left, right, size, width (size is the height).

    Sizes are summed over 100 bins of the width.  Two columns when the emptiest bin of the
    middle is well below both sides and these are dense; null for few or flat rectangles.
    """
    a = (F.greatest(F.col("left") / F.col("width"), F.lit(0.0)) * 100).cast("int")
    z = (F.least(F.col("right") / F.col("width"), F.lit(1.0)) * 100).cast("int")
    spans = rects.select("page", F.col("size").cast("double").alias("size"), a.alias("a"), F.greatest(a + 1, z).alias("z"))
    # a row a rectangle is sent, and a page's are laid on its bins where they meet
    pages = spans.groupBy("page").agg(F.collect_list(F.when(F.col("a") < 100, F.struct("a", "z", "size"))).alias("spans"), F.count("*").alias("n"))
    held = lambda b: F.aggregate("spans", F.lit(0.0), lambda s, x: F.when((x["a"] <= b) & (b < x["z"]), s + F.coalesce(x["size"], F.lit(0.0))).otherwise(s))
    pages = pages.select("page", "n", F.transform(F.sequence(F.lit(0), F.lit(99)), held).alias("bins")).withColumn("most", F.array_max("bins"))
    # of equal bins the first
    emptiest = F.array_min(F.transform(F.sequence(F.lit(30), F.lit(70)), lambda b: F.struct(F.get("bins", b).alias("held"), b.alias("bin"))))
    pages = pages.withColumn("gutter", emptiest)
    total = lambda lo, n: F.aggregate(F.slice("bins", lo + 1, n), F.lit(0.0), lambda s, x: s + x) / n
    g = F.col("gutter.bin")
    lower = F.least(total(F.lit(10), g - 10), total(g + 1, F.lit(89) - g))
    split = (F.col("gutter.held") < 0.3 * lower) & (lower > 0.3 * F.col("most"))
    return pages.select("page", F.when((F.col("n") >= LEAST_RECTS) & (F.col("most") > 0), F.when(split, 2).otherwise(1)).alias("columns"))


def named(label: Column) -> Column:
    low = F.lower(label)
    for old, new in LABEL_NAMES.items():
        low = F.when(low == old, new).otherwise(low)
    return low


def region_facts(regions: DataFrame) -> DataFrame:
    """page, label, n, area from regions: page, label, left, top, right, bottom, width, height.  The share of area is 1 at most."""
    share = F.sum((F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))) / F.max(F.col("width") * F.col("height"))
    return regions.groupBy("page", named(F.col("label")).alias("label")).agg(F.count("*").alias("n"), F.round(F.least(F.lit(1.0), share), 3).alias("area"))


def span_length(spans: Column) -> Column:
    """Length that spans (structs top, bottom) cover together, overlaps counted once."""
    def step(s, x):
        return F.struct((s["covered"] + F.greatest(F.lit(0.0), x["bottom"] - F.greatest(x["top"], s["reach"]))).alias("covered"), F.greatest(s["reach"], x["bottom"]).alias("reach"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0.0).alias("covered"), F.lit(0.0).alias("reach")), step, lambda s: s["covered"])


def region_columns(regions: DataFrame) -> DataFrame:
    """page, columns: 2 where wide text regions stand side by side over enough of the text's height, else 1; null without text."""
    wide = (named(F.col("label")) == "text") & (F.col("right") - F.col("left") >= REGION_WIDTH * F.col("width"))
    box = F.struct(*[F.col(k).cast("double").alias(k) for k in ("top", "bottom", "left", "right")])
    pages = regions.groupBy("page").agg(F.collect_list(F.when(wide, box)).alias("boxes"))
    # each box with those to its right; apart horizontally, so a pair is met once
    met = F.flatten(F.transform("boxes", lambda a: F.transform(F.filter("boxes", lambda b: (a["right"] <= b["left"]) & (F.least(a["bottom"], b["bottom"]) > F.greatest(a["top"], b["top"]))), lambda b: F.struct(F.greatest(a["top"], b["top"]).alias("top"), F.least(a["bottom"], b["bottom"]).alias("bottom")))))
    spans = F.transform("boxes", lambda a: F.struct(a["top"].alias("top"), a["bottom"].alias("bottom")))
    return pages.select("page", F.when(F.size("boxes") > 0, F.when(span_length(met) >= SIDE_BY_SIDE * span_length(spans), 2).otherwise(1)).alias("columns"))
