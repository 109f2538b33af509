"""Building evaluation sets: labels, splits, near duplicates, disjointness."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lanes that each code of a rubric stands for.  Fixed values.
CODES = {"capture": {"clean": ["L3"], "degraded": ["L4"], "borderline": ["L3", "L4"], "handwritten": ["L5"], "unusable": []}, "layout": {"simple": ["L1"], "complex": ["L2"], "borderline": ["L1", "L2"], "unusable": []}}


#: Rows and columns of the grey picture that a difference hash is taken of.
GRID = (16, 17)


def difference_hash(grey: Column) -> Column:
    """array<long> of 256 bits: whether a picture's value exceeds its left neighbour's, 16 rows of 17 values."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def bit(i: Column) -> Column:  # i of 256 from 0; its right-hand value stands behind i // 16 further ones, row by row
        at = i + F.floor(i / (GRID[1] - 1)).cast("int") + 1
        return F.when(F.element_at(grey, at + 1) > F.element_at(grey, at), one).otherwise(zero)

    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda h, k: h.bitwiseOR(F.call_function("shiftleft", bit(F.lit(64 * w) + k), k)))
    return F.array(*map(word, range(4)))


def near_pairs(hashes: DataFrame, most: int = 2) -> DataFrame:
    """a, b, distance of rows (id, doc, h) of different documents whose hashes (four longs) differ in at most `most` bits, a < b.

    With two bits or fewer at least two of the four words are equal, so the join is on pairs of words; a pair is kept in
    the first of these in which it agrees.  Equal hashes are joined as one, and pairs of their rows made last.
    """
    if most > 2:
        raise ValueError("two equal words of four are only sure up to two bits")
    known = hashes.select("h").distinct()
    two = [(i, j) for i in range(4) for j in range(i)]
    keyed = known.select("h", F.posexplode(F.array(*[F.struct(F.col("h")[i].alias("p"), F.col("h")[j].alias("q")) for i, j in two])).alias("band", "key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    same = F.array(*[(F.col("a.h")[i] == F.col("b.h")[i]) & (F.col("a.h")[j] == F.col("b.h")[j]) for i, j in two])
    d = sum(F.bit_count(F.col("a.h")[i].bitwiseXOR(F.col("b.h")[i])) for i in range(4))
    j = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key"))).filter((d <= most) & (F.array_position(same, True) == F.col("a.band") + 1))
    near = j.select(F.col("a.h").alias("x"), F.col("b.h").alias("y"), d.alias("distance"))
    x, y = (hashes.select(F.col("h").alias(c), F.col("id").alias(f"id_{c}"), F.col("doc").alias(f"doc_{c}")) for c in "xy")
    pairs = near.join(x, "x").join(y, "y").filter((F.col("id_x") < F.col("id_y")) & (F.col("doc_x") != F.col("doc_y")))
    return pairs.select(F.col("id_x").alias("a"), F.col("id_y").alias("b"), "distance")


#: How a source page is named in an attribution.  Fixed values.
SOURCE_PAGE = (r"olmOCR-Bench.*(bench_data/pdfs/\S+\.pdf)", r"(Berzerker/gnhk_ocr_dataset).*row_idx=(\d+)", r"PureDocBench.*(page_id=\S+)")


def source_pages(text: Column) -> Column:
    """Identifiers of source pages in an attribution: what the patterns' groups hold, joined."""
    groups = lambda p: F.concat_ws(" ", *[F.regexp_extract(text, p, i + 1) for i in range(p.count("(") - p.count(r"\("))])
    return F.array_compact(F.array(*[F.when(text.rlike(p), groups(p)) for p in SOURCE_PAGE]))


def overlapping(pages: DataFrame, other: DataFrame) -> DataFrame:
    """key, found of pages (key, source) whose source page the other set (source) has too."""
    taken = other.select(F.explode(source_pages(F.col("source"))).alias("found")).distinct()
    return pages.select("key", F.explode(source_pages(F.col("source"))).alias("found")).join(taken, "found", "left_semi").select("key", "found")


def verdicts(opinions: DataFrame) -> DataFrame:
    """key, state, lanes from opinions (key, rubric, labeller a, b or c, code).

    Two that agree settle a page.  Else a third is needed; two `unusable` drop it, different
    opinions across one boundary give both lanes, and otherwise the majority decides.
    """
    lanes = F.create_map(*[x for r, codes in CODES.items() for c, ls in codes.items() for x in (F.lit(f"{r}/{c}"), F.array(*map(F.lit, ls)) if ls else F.array().cast("array<string>"))])
    of = lambda code: F.element_at(lanes, F.concat("rubric", F.lit("/"), code))
    none = F.array().cast("array<string>")
    table = opinions.groupBy("key", "rubric").pivot("labeller", ["a", "b", "c"]).agg(F.first("code"))
    table = table.withColumn("given", F.array_compact(F.array("a", "b", "c")))
    table = table.withColumn("useful", F.array_remove("given", "unusable")).withColumn("spread", F.array_distinct(F.flatten(F.transform("useful", of))))
    within = [F.when((F.size("spread") > 0) & (F.size(F.array_except("spread", F.array(F.lit(lo), F.lit(hi)))) == 0), F.array(F.lit(lo), F.lit(hi))) for lo, hi in (("L1", "L2"), ("L3", "L4"))]
    table = table.withColumn("boundary", F.when(F.size(F.array_distinct("useful")) > 1, F.coalesce(*within)))
    agreed, third = F.col("a") == F.col("b"), F.col("c").isin(F.col("a"), F.col("b"))
    decided = F.when(agreed, of(F.col("a"))).when(F.size("given") - F.size("useful") >= 2, none).otherwise(F.coalesce("boundary", F.when(third, of(F.col("c"))), none))
    waiting = F.when(F.col("a").isNull() | F.col("b").isNull(), "pending").when(~agreed & F.col("c").isNull(), "needs_c")
    out = table.withColumns({"waiting": waiting, "decided": decided})
    state = F.coalesce("waiting", F.when(F.size("decided") > 0, "final").otherwise("drop"))
    return out.select("key", state.alias("state"), F.when(F.col("waiting").isNull(), F.col("decided")).otherwise(none).alias("lanes"))


def append_opinions(store: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of new to append to the store, and those that conflict with it, by (key, labeller, rubric)."""
    by = ["key", "labeller", "rubric"]
    once = new.dropDuplicates([*by, "code"])
    known = store.select(*by, F.col("code").alias("old"))
    joined = once.join(known, by, "left")
    return joined.filter("old is null").drop("old"), joined.filter("old <> code")


#: What goes before an id that is hashed for a split.  Fixed value.
SALT = "split:"
SIDES = ("tune", "holdout")


def split_rank(doc: Column) -> Column:
    return F.sha2(F.concat(F.lit(SALT), doc.cast("string")), 256)


def _balance(pdf: pd.DataFrame) -> pd.DataFrame:
    digest = pdf["doc_id"].map(lambda d: hashlib.sha256(f"{SALT}{d}".encode()).hexdigest())
    pdf = pdf.assign(digest=digest, split=pdf["fixed"].where(pdf["fixed"].isin(SIDES))).sort_values("digest")
    lead = pdf["weight"].where(pdf["split"] == SIDES[0], -pdf["weight"].where(pdf["split"] == SIDES[1], 0)).sum()  # how much heavier the first side is
    open_ = pdf["split"].isna()
    for at in pdf.index[open_]:
        second = int(pdf.at[at, "digest"][-1], 16) % 2 == 1 if lead == 0 else lead > 0
        pdf.at[at, "split"] = SIDES[int(second)]
        lead += -pdf.at[at, "weight"] if second else pdf.at[at, "weight"]
    return pdf[["doc_id", "stratum", "split"]]


def sticky_split(docs: DataFrame) -> DataFrame:
    """Split of each document (doc_id, stratum, weight, fixed): tune and holdout balanced within strata.

    Assignments in `fixed` stay; the rest go in a stable hash order to the lighter side, ties by
    the hash's parity.  The balance feeds back, so a stratum is one sequential fold; strata
    hold labelled documents only, whose number people's work bounds.
    """
    return docs.groupBy("stratum").applyInPandas(_balance, "doc_id long, stratum string, split string")


def round_robin(rows: DataFrame, stratum: str, n: int) -> DataFrame:
    """n rows, the first of every stratum in hash order, then the second, and so on."""
    w = Window.partitionBy(stratum).orderBy(split_rank(F.col("doc_id")), "doc_id")
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", stratum).limit(n)


def hash_order(ids: Column, salt: str = SALT) -> tuple[Column, Column]:
    """A stable order for ids, and its parity."""
    h = F.sha2(F.concat(F.lit(salt), ids), 256)
    return h, F.conv(F.right(h, F.lit(1)), 16, 10).cast("int") % 2


def built_cases(pages: DataFrame, final: DataFrame, variants: DataFrame) -> DataFrame:
    """Cases id, key, gt, variant: labelled pages (key, id), and variants (id, of, variant) that take their base's truth."""
    base = pages.join(final.filter(F.size("gt") > 0), "key").select("id", "key", "gt", F.lit(None).cast("string").alias("variant"))
    made = variants.join(base.select(F.col("id").alias("of"), "key", "gt"), "of").select("id", "key", "gt", "variant")
    return base.unionByName(made)


def repeated_files(cases: DataFrame, other: DataFrame) -> DataFrame:
    """Digests (column digest) that occur twice among cases or at all in the other set, and which of both it is."""
    twice = cases.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest", F.lit("twice").alias("why"))
    shared = cases.join(other.select("digest"), "digest", "left_semi").select("digest").distinct().withColumn("why", F.lit("shared"))
    return twice.unionByName(shared)


def answer_faults(asked: DataFrame, given: DataFrame) -> DataFrame:
    """batch, image, fault: images without an answer, answers to unknown images, and repeated answers."""
    key = ["batch", "image"]
    counted = given.groupBy(*key).agg(F.count("*").alias("n"))
    both = asked.select(*key).distinct().withColumn("asked", F.lit(True)).join(counted, key, "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return both.select(*key, fault.alias("fault")).filter("fault is not null")


def first_seen(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each combination of `by`, by an aggregate instead of a sort; all columns stay."""
    rest = [c for c in rows.columns if c not in by and c != order]
    best = rows.groupBy(*by).agg(F.min(F.struct(order, *rest)).alias("first"))
    return best.select(*by, *[F.col(f"first.{c}").alias(c) for c in [order, *rest]]).select(*rows.columns)


def release_faults(listed: DataFrame, present: DataFrame) -> DataFrame:
    """file, fault of listed files (file, digest) that are missing or differ."""
    found = present.select("file", F.col("digest").alias("found"))
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("digest"), "changed")
    return listed.join(found, "file", "left").select("file", fault.alias("fault")).filter("fault is not null")


def catalogue_faults(rows: DataFrame) -> DataFrame:
    """what, value, n: repeated keys and ids of a catalogue (key, id, of), and rows that are neither a page (key) nor a variant (of) or both."""
    twice = lambda c: rows.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(f"repeated {c}").alias("what"), "value", "n")
    odd = rows.filter(F.col("key").isNull() == F.col("of").isNull()).select(F.lit("neither page nor variant").alias("what"), F.col("id").alias("value"), F.lit(1).cast("long").alias("n"))
    return twice("key").unionByName(twice("id")).unionByName(odd)


def rubric(layer: Column) -> Column:
    """Pages with a trusted text layer are judged on layout, all others on capture."""
    return F.when(layer == "trusted", "layout").otherwise("capture")


def current(opinions: DataFrame, rubrics: DataFrame) -> DataFrame:
    """opinions with state: counts, moved (given under a rubric that the page has left), unknown page, or unknown code."""
    known = F.exists(F.element_at(F.create_map(*[x for r, codes in CODES.items() for x in (F.lit(r), F.array(*map(F.lit, codes)))]), F.col("rubric")), lambda c: c == F.col("code"))
    now = rubrics.select("key", F.col("rubric").alias("now"))
    state = F.when(F.col("now").isNull(), "unknown page").when(~F.coalesce(known, F.lit(False)), "unknown code").when(F.col("now") != F.col("rubric"), "moved").otherwise("counts")
    return opinions.join(now, "key", "left").withColumn("state", state)


def batches(pages: DataFrame, secret: str, size: int = 50) -> DataFrame:
    """rubric, batch, image of pages (key, rubric): shuffled by a keyed hash and cut into batches; the image's name tells nothing without the secret."""
    h = F.sha2(F.concat_ws(":", F.lit(secret), "key"), 256)
    w = Window.partitionBy("rubric").orderBy("h")
    p = pages.withColumn("h", h).withColumn("batch", F.ceil(F.row_number().over(w) / size).cast("int"))
    return p.select("rubric", "batch", F.left("h", F.lit(12)).alias("image"))
