"""Mixing sources to target weights.

Every row gets a hash-random key.  Rows are range-partitioned by that key inside their
source (a hot source has as many ranges as its rows ask for), ranges are summed and the
sums turned into prefix sums, and each source is cut where its word budget is spent.  A
budget above a source's size takes whole epochs first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from .common import WORD, checkpoint, n_words

#: Rows that one range of a source should hold.
ROWS_PER_RANGE = 8000


def cycle_weights(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3 ... for ranks from 0."""
    return rank % 3 + 1


def budgets(sizes: DataFrame, weight=cycle_weights, share: float = 1.0, most: int = 3) -> DataFrame:
    """Target words of each source: (source, source_size, target).

    sizes: one row a source with source, source_size.  Sources rank by code point, null last,
    and weigh weight(rank).  `share` of all words is divided by weight; a target stops at
    `most` times its source's size and the excess goes to the others by weight until none is
    above.  That fixed point is min(most * size, level * weight): sources saturate in order
    of most * size / weight, so one pass of running sums finds the level.
    The table has a row a source, which is what the un-partitioned windows below sort.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    zero = F.lit(0).cast("long")
    s = (
        sizes.withColumn("rank", F.row_number().over(by_name).cast("long") - 1)
        .withColumn("weight", weight(F.col("rank")).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all", (F.sum("source_size").over(everything) * share).cast("long"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), zero))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("full", F.col("cap") * (F.col("all_weight") - F.col("weight_before")) <= (F.col("all") - F.col("cap_before")) * F.col("weight"))
        .withColumn("left", F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), zero))
        .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(everything), zero))
    )
    shared = (F.col("left") * F.col("weight")).cast("double") / F.greatest(F.col("left_weight"), F.lit(1).cast("long"))
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def mix(docs: DataFrame, weight=cycle_weights, share: float = 1.0, most: int = 3, seed: str = "mix", size: Column | None = None, keep: tuple[str, ...] = (), order: list[Column] | None = None) -> DataFrame:
    """Rows of docs (doc_id, source and what `keep` names) with size, source_size, target, taken.

    taken is the number of words the mix uses of a row, epochs counted: taken div size whole
    passes and, for the row in which a source's budget ends, the rest as a partial pass.
    Null text has size 0; a null source is a source of its own, ranked last; equal doc_ids
    are separate rows with the same key; an empty table gives an empty result.  order tells rows apart that are equal in
    key, doc_id and size, where the kept columns themselves can't be sorted.
    """
    rows = docs.select(F.col("doc_id"), F.col("source"), *keep, (n_words(F.col("text")) if size is None else size).alias("size"))
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    if not keep:  # narrow rows: words are counted once
        rows = checkpoint(rows)
    most_rows = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(1, most_rows / ROWS_PER_RANGE), 16)))
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    at = ("source", "range")
    ranges = rows.groupBy(*at).agg(F.sum("size").alias("range_size"))
    prefix = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(prefix), F.lit(0).cast("long")))
    target = budgets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weight, share, most)
    b, t = ranges.alias("b"), target.alias("t")
    plan = b.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).select(F.col("b.source").alias("b_source"), F.col("b.range").alias("b_range"), "start", "source_size", "target")
    inside = Window.partitionBy(*at).orderBy("key", "doc_id", "size", *(keep if order is None else order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("end", F.sum("size").over(inside))
    joined = summed.join(plan, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("range") == F.col("b_range")))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    cut = F.least(F.greatest(rest - (F.col("start") + F.col("end") - F.col("size")), F.lit(0).cast("long")), F.col("size"))
    return joined.select("doc_id", "source", *keep, "size", "source_size", "target", (whole * F.col("size") + cut).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The first n words of text, joined by blanks."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), n), " ")


def sortable(kind: DataType) -> bool:
    """Whether Spark can order values of this type."""
    if isinstance(kind, StructType):
        return all(sortable(f.dataType) for f in kind.fields)
    return sortable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: rows of docs, as often as the mix takes them.  All columns of docs stay.

    Each source is cut at its exact budget: the row in which that ends has its last copy cut to the words that are left
    (joined by blanks, with n_chars counted anew where docs has it).  Rows that are not taken are gone; rows without a word
    cost no budget and stay once.
    """
    columns = [c for c in docs.columns if c not in ("doc_id", "source")]
    named = docs.select("doc_id", "source", F.col("text"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    order = [F.col(f"row.`{c}`") if sortable(docs.schema[c].dataType) else F.to_json(F.struct(F.col(f"row.`{c}`"))) for c in columns]
    mixed = mix(named, size=n_words(F.col("text")), keep=("row",), order=order, **options)
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    copies = mixed.withColumn("times", times).filter("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("times"))))
    left = (F.col("taken") - (F.col("epoch") - 1) * F.col("size")).cast("int")
    cut = (F.col("size") > 0) & (left < F.col("size"))
    copies = copies.withColumns({"cut": cut, "kept": F.when(cut, first_words(F.col("row.text"), left))})
    made = {"doc_id": F.col("doc_id"), "source": F.col("source"), "text": F.when(F.col("cut"), F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in columns:
        made["n_chars"] = F.when(F.col("cut"), F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return copies.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
