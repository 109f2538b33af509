"""A language model fitted on labelled text: counts of character trigrams by language, smoothed, and scores by join.

Scores are sums of logarithms in millionths, so that they don't depend on the order in which they are added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as layer
from quire.shared import checkpoint

MICRO = 1_000_000
#: Trigrams of a model, the most frequent ones, that are sent to all tasks at most; the others are joined.
BROADCAST = 200_000


def grams(clean: Column) -> Column:
    """The trigrams of a text with a blank at both ends, in one pass over it."""
    return F.regexp_extract_all(F.concat(F.lit(" "), clean, F.lit(" ")), F.lit("(?s)(?=(...))."), F.lit(1))


def each_gram(rows: DataFrame, keys: Sequence[str], clean: str = "clean") -> DataFrame:
    """keys, gram: a row for each place of a trigram; text without a letter has none."""
    return rows.filter(F.col(clean) != "").select(*keys, F.explode(grams(F.col(clean))).alias("gram"))


def counted(rows: DataFrame, keys: Sequence[str], clean: str = "clean") -> DataFrame:
    """keys, gram, n of rows.  Tasks count before anything is sent."""
    return each_gram(rows, keys, clean).groupBy(*keys, "gram").agg(F.count("*").cast("long").alias("n"))


def fit(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model of labelled (lang, text): trigrams (gram, lang, n, micro) and languages (lang, total, other).

    micro is the logarithm of a trigram's smoothed share (add one) in its language, other that of one that it doesn't have.
    Rows without language or text count nowhere.
    """
    clean = labelled.filter("lang is not null and text is not null").select("lang", layer.cleaned(F.col("text")).alias("clean"))
    counts = checkpoint(counted(clean, ["lang"]))  # as small as the model, and used several times
    kinds = counts.agg(F.count_distinct("gram").alias("kinds"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).join(F.broadcast(kinds))  # one row
    log = lambda n: F.round(F.log(n / (F.col("total") + F.col("kinds"))) * MICRO).cast("long")
    known = counts.join(F.broadcast(totals), "lang")  # one row a language
    return known.select("gram", "lang", "n", log(F.col("n") + 1).alias("micro")), totals.select("lang", "total", log(F.lit(1)).alias("other"))


def scored(rows: DataFrame, model: tuple[DataFrame, DataFrame], keys: Sequence[str], clean: str = "clean") -> DataFrame:
    """keys, lang, grams, micro, second, p: the most likely language of each row, its score, the next one's, and its probability among all.

    Equal scores go to the least language.  Rows without trigrams aren't there; trigrams that no language has count for nothing.
    """
    known, languages = model
    langs = [(r["lang"], r["other"]) for r in languages.orderBy("lang").collect()]  # a handful
    of = [f"_of{i}" for i in range(len(langs))]  # a column a language
    each = known.groupBy("gram").agg(F.sum("n").alias("_all"), *[F.coalesce(F.max(F.when(F.col("lang") == lang, F.col("micro"))), F.lit(other)).alias(c) for c, (lang, other) in zip(of, langs, strict=True)])
    # frequent trigrams are added up where the text is; rare ones are counted by text, and these counts joined
    frequent = F.broadcast(each.orderBy(F.desc("_all"), "gram").limit(BROADCAST).drop("_all"))
    found = each_gram(rows, keys, clean).join(frequent.withColumn("_known", F.lit(True)), "gram", "left")
    rare = F.when(F.col("_known").isNull(), F.col("gram")).alias("gram")
    mine = found.groupBy(*keys, rare).agg(F.count("*").cast("long").alias("n"), *[F.sum(c).alias(f"_sum{i}") for i, c in enumerate(of)])
    total = mine.join(each, "gram", "left").groupBy(*keys).agg(F.sum("n").alias("grams"), *[F.sum(F.coalesce(f"_sum{i}", F.col("n") * F.col(c), F.lit(0))).cast("long").alias(f"_{i}") for i, c in enumerate(of)])
    order = F.array_sort(F.array(*[F.struct((-F.col(f"_{i}")).alias("less"), F.lit(lang).alias("lang")) for i, (lang, _) in enumerate(langs)]))
    total = total.withColumn("order", order)
    best, second = -F.col("order")[0]["less"], -F.col("order")[1]["less"] if len(langs) > 1 else F.lit(None).cast("long")
    p = 1 / F.aggregate("order", F.lit(0.0), lambda s, o: s + F.exp((-o["less"] - best) / MICRO))
    return total.select(*keys, F.col("order")[0]["lang"].alias("lang"), "grams", best.alias("micro"), second.alias("second"), p.alias("p"))


def with_language(rows: DataFrame, model: tuple[DataFrame, DataFrame], keys: Sequence[str], codes: dict[str, str], least_grams: int = 3, text: str = "text") -> DataFrame:
    """rows with language, readability, unreadable by the vote of their chunks, each judged by the model.

    codes: the model's languages as codes; chunks whose best language isn't there, or that have fewer trigrams, are no language.
    """
    plain = F.translate(F.replace(F.col(text), F.lit("￾"), F.lit("")), "፡", " ")
    pieces = rows.select(*keys, F.explode(F.array_distinct(F.transform(layer.chunks(plain), layer.cleaned))).alias("clean")).filter("clean <> ''")
    judged = scored(pieces.withColumn("_chunk", F.col("clean")), model, [*keys, "_chunk"])
    code = F.lit("zxx")
    for lang, its in codes.items():
        code = F.when((F.col("grams") >= least_grams) & (F.col("lang") == lang), F.lit(its)).otherwise(code)
    said = judged.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_chunk", F.struct(code.alias("code"), "p")))).alias("_said"))  # the chunks of one page
    return layer.with_language(rows.join(said, list(keys), "left"), lambda clean: F.col("_said")[clean], text).drop("_said")
