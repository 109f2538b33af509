"""Texts whose sets of word shingles are alike, found without loss.

Likeness is Jaccard over distinct shingles of lower-cased words, and two texts are alike from
LEAST_OF out of LEAST_IN on.  Shingles have one order for all texts: those that a sample of
documents finds common come last, the others by hash.  Alike texts share a shingle among
the first fifth (and one) of both, whatever the order is, so a join on those finds every
pair; the sample only keeps lists short.

Pairs are compared on their whole sets.  Since groups are wanted and not pairs, what SimHash
links is compared first, and each text with the one that it shares most lists with among the
lists' leaders, in a few rounds of linear work with other leaders each; after that only pairs
that aren't in one group yet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.shipping import map_arrow

from .common import Scratch, wide_hash
from .words import Words, slices

LEAST_OF, LEAST_IN = 4, 5
#: One text in SAMPLE_SHARE is looked at for shingles with SAMPLE_LEAST rows there, of which COMMON at most come last.
SAMPLE_SHARE, SAMPLE_LEAST, COMMON = 64, 3, 20_000
#: Bits of a sketch, as a power of two, at most; longer texts' sketches rule less out.
MOST_BITS = 20
#: Rounds in which each text meets a leader, before all pairs that are left are sought.  They save work, and nothing is found through them alone.
ROUNDS = 3
#: Lists from CROWDED texts on carry sketches of SHORT bits; a list has a row and a column of its grid for each GRID texts.
CROWDED, SHORT, GRID = 16, 1024, 4096
#: So many ids, of a few bytes each, are sent to all executors at most.
BROADCAST = 100_000
KEY = ["doc_id", "h1", "h2"]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each text's distinct shingles, sorted; a text with fewer words is one shingle."""
    hashes, n = w.hashes(table=_LOWER), np.diff(w.first)
    docs, values = [], []
    for k in range(1, size + 1):
        if k == size or (n == k).any():
            at, value = w.grams(hashes, k)
            use = np.ones(len(at), dtype=bool) if k == size else n[w.doc[at]] == k
            docs.append(w.doc[at][use])
            values.append(value[use])
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]) if len(doc) else np.zeros(0, dtype=bool)
    return doc[new], value[new]


def sketches(doc: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
    """Bits of each text that its shingles fall on by their top bits: four a shingle and more, a power of two."""
    first, out = np.searchsorted(doc, np.arange(n + 1)), []
    for a, b in zip(first, first[1:]):
        k = min(MOST_BITS, max(9, int(4 * (b - a) - 1).bit_length()))
        bits = np.zeros(1 << k, dtype=np.uint8)
        bits[(value[a:b] >> np.uint64(64 - k)).astype(np.int64)] = 1
        out.append(np.packbits(bits).tobytes())
    return pa.array(out, pa.binary())


def short_sketches(doc: np.ndarray, value: np.ndarray, n: int) -> pa.ListArray:
    """SHORT bits of each text as longs, on which its shingles fall by their top bits."""
    bits = np.zeros((n, SHORT), dtype=np.uint8)
    bits[doc, (value >> np.uint64(64 - SHORT.bit_length() + 1)).astype(np.int64)] = 1
    words = np.packbits(bits, axis=1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (SHORT // 64)), pa.array(words.ravel()))


def alone(a: bytes, b: bytes) -> tuple[int, int]:
    """At least so many shingles has each of two texts that the other lacks, by their sketches."""
    x, y = (np.unpackbits(np.frombuffer(v, dtype=np.uint8)) for v in (a, b))
    n = min(len(x), len(y))
    x, y = (v if len(v) == n else v.reshape(n, -1).max(axis=1) for v in (x, y))
    both = int((x & y).sum())
    return int(x.sum()) - both, int(y.sum()) - both


def _possible(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their sketches don't rule out."""
    for batch in batches:
        n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        only = np.array([alone(a.as_py(), b.as_py()) for a, b in zip(batch.column("bits_a"), batch.column("bits_b"), strict=True)], dtype=np.int64).reshape(-1, 2)
        shared = np.minimum(n_a - only[:, 0], n_b - only[:, 1])
        yield batch.select(["a", "b"]).filter(pa.array((LEAST_OF + LEAST_IN) * shared >= LEAST_OF * (n_a + n_b)))


def _compared(size: int):
    """Pairs of texts whose sets of shingles are alike."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in slices(batch.column("text_a")):
                sets_x = _sets(*shingles(x, size), j - i)
                for k, m, y in slices(batch.column("text_b").slice(i, j - i)):
                    keep = np.zeros(m - k, dtype=bool)
                    for at, set_y in enumerate(_sets(*shingles(y, size), m - k)):
                        set_x = sets_x[k + at]
                        shared = len(np.intersect1d(set_x, set_y, assume_unique=True))
                        keep[at] = (LEAST_OF + LEAST_IN) * shared >= LEAST_OF * (len(set_x) + len(set_y))
                    yield batch.select(["a", "b"]).slice(i + k, m - k).filter(pa.array(keep))

    return run


def _sets(doc: np.ndarray, value: np.ndarray, n: int) -> list[np.ndarray]:
    first = np.searchsorted(doc, np.arange(n + 1))
    return [value[a:b] for a, b in zip(first, first[1:])]


def _lists(doc: np.ndarray, value: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(value.view(np.int64)))


def beginnings(doc: np.ndarray, value: np.ndarray, n: int, common: np.ndarray, level: np.ndarray) -> pa.ListArray:
    """Per text, the first of its shingles in the order of all texts: as many as alike texts need to share one."""
    rank = np.zeros(len(value), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, value), len(common) - 1)
        rank = np.where(common[at] == value, level[at], 0)
    order = np.lexsort((value, rank, doc))
    first = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(first)
    most = size - (LEAST_OF * size + LEAST_IN - 1) // LEAST_IN + 1
    keep = np.arange(len(doc)) - first[doc] < most[doc]
    return _lists(doc[keep], value[order][keep], n)


def _described(size: int, common: np.ndarray, level: np.ndarray, fingerprint: Callable):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in slices(batch.column("text")):
                part = batch.slice(i, j - i)
                doc, value = shingles(w, size)
                first = np.searchsorted(doc, np.arange(j - i + 1))
                sets = np.array([xxhash.xxh64_intdigest(value[a:b].tobytes()) for a, b in zip(first, first[1:])], dtype=np.uint64)
                prints = fingerprint(part.column("text").cast(pa.large_binary()).to_pylist(), size)
                made = [pa.array(prints.view(np.int64)), pa.array(sets.view(np.int64)), pa.array(np.diff(first).astype(np.int64)), beginnings(doc, value, j - i, common, level), sketches(doc, value, j - i), short_sketches(doc, value, j - i)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in KEY], *made], names=[*KEY, "print", "sid", "n", "beginning", "bits", "short"])

    return run


def _items(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(w, size)[1].view(np.int64))], names=["item"])

    return run


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample have, sorted, and how many; they tell the order of shingles, never what is found."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_SHARE)) == 0).select("text")
    n = map_arrow(some, _items(size), "item long").groupBy("item").agg(F.count("*").alias("n"))
    got = n.filter(F.col("n") >= SAMPLE_LEAST).orderBy(F.desc("n"), "item").limit(COMMON).collect()
    common, level = np.array([r["item"] for r in got], dtype=np.int64).view(np.uint64), np.array([r["n"] for r in got], dtype=np.int64)
    order = np.argsort(common)
    return common[order], level[order]


def _alike(shared: Column, a: Column, b: Column) -> Column:
    """Whether sets of a and b items with so many in common are alike."""
    return (LEAST_OF + LEAST_IN) * shared >= LEAST_OF * (a + b)


def _may_be(x: str, y: str) -> Column:
    """Whether sets x and y can be alike if the item at their places is the first that they share."""
    n = lambda s, c: F.col(f"{s}.{c}")
    return _alike(F.least(n(x, "n") - n(x, "pos"), n(y, "n") - n(y, "pos")), n(x, "n"), n(y, "n"))


def _possibly(x: str, y: str) -> Column:
    """Whether sets x and y can be alike by their short sketches; without sketches they can."""
    bit = lambda s, i: F.col(f"{s}.short")[i]
    lone = lambda s, t: sum((F.bit_count(bit(s, i).bitwiseAND(F.bitwise_not(bit(t, i)))) for i in range(SHORT // 64)), F.lit(0))
    n = lambda s: F.col(f"{s}.n")
    return F.coalesce(_alike(F.least(n(x) - lone(x, y), n(y) - lone(y, x)), n(x), n(y)), F.lit(True))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, places: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) that are alike, by the whole sets of their texts.

    Pairs that the sketches of texts (sid, n, bits) rule out for certain aren't looked at.
    """
    x, y = (texts.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    pairs = scratch.keep(map_arrow(pairs.filter("a <> b").distinct().join(x, "a").join(y, "b"), _possible, "a long, b long"))
    named = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    where = places.join(named, "sid").groupBy("sid", *KEY).agg(F.count("*").alias("rows")).groupBy("sid").agg(F.min(F.struct("rows", *KEY)).alias("key"))
    where = scratch.keep(where.select("sid", "key.*"))
    found = where.agg(F.count("*").alias("n"), F.max("rows").alias("rows")).first()
    at = F.broadcast(where) if found["n"] <= BROADCAST else where
    whole = docs.join(at.drop("rows"), KEY).select("sid", "text")
    if (found["rows"] or 1) > 1:  # rows equal in doc_id and text
        whole = whole.dropDuplicates(["sid"])
    a, b = (whole.select(F.col("sid").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return scratch.keep(map_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b"), _compared(size), "a long, b long"))


def _with_root(listed: DataFrame, roots: DataFrame) -> DataFrame:
    """listed with root and the size of its group, without the items whose texts are all in one group."""
    sized = roots.withColumn("texts", F.count("*").over(Window.partitionBy("root"))).withColumnRenamed("node", "sid")
    rooted = listed.join(sized, "sid", "left").withColumns({"root": F.coalesce("root", "sid"), "texts": F.coalesce("texts", F.lit(1).cast("long"))})
    ends = Window.partitionBy("item")
    return rooted.withColumns({"least": F.min("root").over(ends), "top": F.max("root").over(ends), "m": F.count("*").over(ends)}).filter("least < top").drop("least", "top")


def across(left: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts of different groups that share a list and may be alike by their sizes, places and, in crowded lists, short sketches.

    The join itself decides, so what is ruled out is never a row.  Very long lists are dealt over a grid.
    """
    cells = (F.floor(F.col("m") / GRID) + 1).cast("int")
    long_ = left.filter(F.col("m") >= CROWDED).join(texts.select("sid", "short"), "sid")
    rows = long_.unionByName(left.filter(F.col("m") < CROWDED).withColumn("short", F.lit(None).cast("array<long>"))).select("sid", "n", "pos", "item", "root", "short", cells.alias("cells"))
    x = rows.withColumn("cell", F.pmod(F.xxhash64("sid"), F.col("cells")).cast("int")).alias("x")
    y = rows.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).alias("y")
    same = (F.col("x.item") == F.col("y.item")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.root") < F.col("y.root"))
    return x.join(y, same & _may_be("x", "y") & _possibly("x", "y")).select(*_ordered("x.sid", "y.sid"))


def with_leaders(listed: DataFrame, seed: int) -> DataFrame:
    """A pair (a, b) for each text of listed at most: with the text of another group that leads most of its lists.

    A list's leader is a member of its largest group, another one for each seed, so that what belongs to a large group
    meets one member of it after another.
    """
    one = listed.groupBy("item").agg(F.min_by(F.struct("sid", "n", "pos", "root"), F.struct(-F.col("texts"), F.xxhash64("sid", F.lit(seed)))).alias("one")).select("item", "one.*")
    star = listed.alias("x").join(one.alias("y"), "item").filter((F.col("x.root") != F.col("y.root")) & _may_be("x", "y"))
    star = star.groupBy(F.col("x.sid").alias("x"), F.col("y.sid").alias("y")).agg(F.count("*").alias("shared"))
    return star.groupBy("x").agg(F.max_by("y", F.struct("shared", F.xxhash64("y"))).alias("y")).select(*_ordered("x", "y"))


def merged(roots: DataFrame, links: DataFrame, components: Callable) -> DataFrame:
    """roots (node, root) with further links: only the groups that these connect are looked at again."""
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    top = components(between)
    known = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return known.unionByName(top.join(roots.select("node"), "node", "left_anti").select("node", "root"))


def groups(docs: DataFrame, size: int, fingerprint: Callable, print_links: Callable, components: Callable, scratch: Scratch) -> DataFrame:
    """doc_id, h1, h2, group of each row of docs (doc_id, h1, h2, text with a word): equal groups are connected by alike texts."""
    common, level = common_shingles(docs, size)
    rows = scratch.keep(map_arrow(docs, _described(size, common, level, fingerprint), "doc_id long, h1 long, h2 long, print long, sid long, n long, beginning array<long>, bits binary, short array<long>"))
    places = rows.select("sid", *KEY)
    texts = scratch.keep(rows.select("sid", "n", "beginning", "bits", "short").dropDuplicates(["sid"]))

    listed = texts.select("sid", "n", F.posexplode("beginning").alias("pos", "item"))
    listed = scratch.keep(listed.withColumn("m", F.count("*").over(Window.partitionBy("item"))).filter("m > 1").drop("m"))

    of_print = rows.select("print", "sid").distinct()
    least = of_print.groupBy("print").agg(F.min("sid").alias("least"))
    near = print_links(least.select("print")).join(least.select(F.col("print").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("print").alias("b"), F.col("least").alias("y")), "b")
    near = near.select(*_ordered("x", "y")).unionByName(of_print.join(least, "print").select(*_ordered("sid", "least")))
    links = verified(near.unionByName(with_leaders(listed.withColumns({"root": F.col("sid"), "texts": F.lit(1)}), 0)), docs, texts, places, size, scratch)
    roots = scratch.keep(components(links))
    left = scratch.keep(_with_root(listed, roots))
    for seed in range(1, ROUNDS):
        more = verified(with_leaders(left, seed), docs, texts, places, size, scratch)
        if more.isEmpty():
            break
        roots = scratch.keep(merged(roots, more, components))
        left = scratch.keep(_with_root(left.drop("root", "texts", "m"), roots))
    roots = scratch.keep(merged(roots, verified(across(left, texts), docs, texts, places, size, scratch), components))

    found = roots.select(F.col("node").alias("sid"), F.col("root").alias("group"))
    return rows.select(*KEY, "sid").join(found, "sid", "left").select(*KEY, F.coalesce("group", "sid").alias("group"))


def with_key(docs: DataFrame, h1: str = "h1", h2: str = "h2") -> DataFrame:
    """docs with 128 bits of each text, which with doc_id tell rows apart."""
    one, two = wide_hash(F.col("text"))
    return docs.withColumns({h1: one, h2: two})
