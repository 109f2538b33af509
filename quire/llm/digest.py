"""Document fingerprints: canonical exact digest, DataFrame and SQL functions only.

A text's canonical form is its NFKC normal form with full case folding and white space
folded; its fingerprint is 128 bits of XXH64 over that form.  Fingerprints that several
documents share are checked by comparing the canonical bytes inside the bucket: should two
different forms ever meet in one bucket, each gets its own number behind the digest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, wide_hash

#: Rows that a range of doc_ids should hold, whose texts are sorted in one task; and ranges of one level at most.
ROWS_PER_BUCKET, PARTS = 1024, 1024
#: Shared digests are broadcast only below this number (40 bytes each).
BROADCAST_ROWS = 500_000


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC, and runs of Unicode white space as one blank, ends trimmed.

    Normalisation is the JVM's own ICU through the SQL function java_method; null stays null.
    """
    nfkc = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"(?U)\s+", " "))


def digest(form: Column) -> Column:
    """32 hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in wide_hash(form)]))


def _quantiles(n: int) -> Column:
    """The doc_ids that cut rows into n parts of about equal size."""
    return F.percentile_approx("doc_id", [(i + 1) / n for i in range(n - 1)] or [0.5], 20 * n)


def _part(cuts: Column, doc_id: Column, most: int) -> Column:
    """How many of the ascending cuts aren't above doc_id, by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, most).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.try_element_at(cuts, at + step) <= doc_id, at + step).otherwise(at))


def bucketed(docs: DataFrame) -> DataFrame:
    """docs (doc_id long, text) with order (within one doc_id) and bucket: ranges of doc_id in ascending order.

    Ranges are cut at quantiles of doc_id, whatever its gaps are: at most PARTS, and each of those again at most PARTS
    if there are rows for it.  Rows without doc_id come first, in order of a hash of their text, and are cut evenly by it.
    """
    n, nulls = docs.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    first = min(PARTS, max(1, -(-n // ROWS_PER_BUCKET)))
    cuts = docs.agg(_quantiles(first).alias("cuts")).first()["cuts"] if first > 1 else None
    order = F.when(F.col("doc_id").isNull(), F.shiftrightunsigned(F.xxhash64("text"), 1)).otherwise(F.lit(0).cast("long"))
    outer = _part(F.array(*map(F.lit, cuts)), F.col("doc_id"), PARTS) if cuts else F.lit(0)
    rows = docs.select("doc_id", "text", order.alias("order"), outer.alias("outer"))
    inner = min(PARTS, -(-n // (first * ROWS_PER_BUCKET)))
    if inner > 1:  # PARTS * PARTS longs at most
        finer = rows.filter("doc_id is not null").groupBy("outer").agg(_quantiles(inner).alias("cuts"))
        rows = rows.join(F.broadcast(finer), "outer", "left").withColumn("inner", _part(F.col("cuts"), F.col("doc_id"), PARTS))
    else:
        rows = rows.withColumn("inner", F.lit(0))
    bits = min(20, max(0, math.ceil(math.log2(max(1, nulls / ROWS_PER_BUCKET)))))
    of_null = F.shiftright("order", 63 - bits) - (1 << 20) if bits else F.lit(-1).cast("long")
    bucket = F.when(F.col("doc_id").isNull(), of_null).otherwise((F.col("outer") * (2 * PARTS) + F.col("inner")).cast("long"))
    return rows.select("doc_id", "text", "order", bucket.alias("bucket"))


def with_next(docs: DataFrame) -> DataFrame:
    """Each row of docs (doc_id, text; no null text) with next_text: that of the next row by doc_id.

    After the last row comes the first.  Equal doc_ids follow each other in order of text.
    Each range's last row takes its text from the first row of the next range that has rows,
    found on two levels of bucket numbers.
    """
    rows = bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    w = Window.partitionBy("bucket").orderBy("doc_id", "order", "text")
    inside = rows.select("doc_id", "text", "bucket", F.lead("text").over(w).alias("lead"))
    heads = rows.withColumn("k", F.row_number().over(w)).filter("k = 1").select(F.col("bucket").alias("next_bucket"), F.col("text").alias("head"))
    buckets = rows.select("bucket").distinct().withColumn("super", F.shiftright("bucket", 10))
    following = buckets.withColumn("next_bucket", F.lead("bucket").over(Window.partitionBy("super").orderBy("bucket")))
    # one row for about a thousand buckets: a few thousand rows at most
    supers = buckets.groupBy("super").agg(F.min("bucket").alias("first"))
    whole = Window.partitionBy().orderBy("super")
    first = F.first("first").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    supers = supers.select("super", F.coalesce(F.lead("first").over(whole), first).alias("after"))
    order = following.join(supers, "super").select("bucket", F.coalesce("next_bucket", "after").alias("next_bucket"))
    tails = order.join(heads, "next_bucket").select("bucket", "head")
    return inside.join(tails, "bucket", "left").select("doc_id", "text", F.coalesce("lead", "head").alias("next_text"))


def edited_text() -> Column:
    """The text with its last floor(n_chars / 2) code points replaced by the first as many of next_text."""
    half = F.floor(F.length("text") / 2).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))


def numbered(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(digest, form, number) for digests in which different canonical bytes meet; as good as always empty.

    prints: fingerprint, edited_fingerprint and near_edited of each document.  Only digests that two texts share are looked
    at; an edited text whose canonical bytes are its own document's was compared with those already.
    """
    edited = prints.filter("near_edited < 1").select(F.col("edited_fingerprint").alias("digest"), F.lit(1).alias("edited"))
    counts = prints.select(F.col("fingerprint").alias("digest"), F.lit(0).alias("edited")).unionByName(edited).groupBy("digest").agg(F.count("*").alias("n"), F.sum("edited").alias("edited"))
    shared = checkpoint(counts.filter("n > 1").select("digest", "edited"))
    n = shared.agg(F.count("*").alias("n"), F.count_if(F.col("edited") > 0).alias("edited")).first()
    small = F.broadcast if n["n"] <= BROADCAST_ROWS else lambda df: df
    forms = docs.select(canonical(F.col("text")).alias("form")).withColumn("digest", digest(F.col("form"))).join(small(shared), "digest", "left_semi")
    if n["edited"]:
        more = with_next(docs).select(canonical(edited_text()).alias("form")).withColumn("digest", digest(F.col("form")))
        forms = forms.unionByName(more.join(small(shared.filter("edited > 0")), "digest", "left_semi").select(*forms.columns))
    distinct = forms.groupBy("digest", "form").agg(F.count("*").alias("n")).select("digest", "form")
    several = distinct.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    return distinct.join(several, "digest", "left_semi").withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("form")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of docs (doc_id, text).

    Likeness is 1.0 where canonical bytes are equal, else 0.0.  Null text counts as empty; rows with equal doc_id each
    give a row; an empty table gives none.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    edited = edited_text()
    rows = with_next(docs).select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), canonical(F.col("text")).alias("form"), canonical(edited).alias("edited_form"), canonical(F.col("next_text")).alias("next_form"))
    same = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    out = checkpoint(
        rows.select(
            "doc_id",
            "n_chars",
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            digest(F.col("form")).alias("fingerprint"),
            digest(F.col("edited_form")).alias("edited_fingerprint"),
            same("form", "edited_form").alias("near_edited"),
            same("form", "next_form").alias("near_next"),
        )
    )
    clashes = numbered(docs, out)
    if clashes.isEmpty():
        return out
    # Never seen; here for the one case in 2**128: the number of the form goes behind both digests.
    named = with_next(docs).select("doc_id", F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), canonical(F.col("text")).alias("form"), canonical(edited).alias("edited_form"))
    for form, print_ in (("form", "fingerprint"), ("edited_form", "edited_fingerprint")):
        number = F.broadcast(clashes.select(F.col("form").alias(form), F.col("digest").alias(print_), F.col("number").alias(f"{form}_number")))
        named = named.withColumn(print_, digest(F.col(form))).join(number, [form, print_], "left")
    behind = lambda c, n: F.concat(c, F.coalesce(F.concat(F.lit("-"), n), F.lit("")))
    named = named.select("doc_id", "edited_sha256", "fingerprint", "edited_fingerprint", "form_number", "edited_form_number").distinct()
    out = out.join(named, ["doc_id", "edited_sha256", "fingerprint", "edited_fingerprint"])
    return out.select("doc_id", "n_chars", "edited_sha256", behind(F.col("fingerprint"), F.col("form_number")).alias("fingerprint"), behind(F.col("edited_fingerprint"), F.col("edited_form_number")).alias("edited_fingerprint"), "near_edited", "near_next")
