"""Substring dedup by relative Lempel-Ziv parsing.

Every run of WIDTH words is a reference block, indexed by a 96-bit hash with the place where
it starts first.  A document is parsed from left to right: where the block at a word is
indexed with an earlier place, a factor begins, and it goes on word by word as long as the
next block is indexed with an earlier place too.  Blocks that straddle the border between
two references are looked up like all others, so a repeat is found wherever its parts come from.
A factor's source place isn't kept beside it, and blocks are told apart by 96 bits of hash, not by their words.
Words in factors (each at least WIDTH long) are duplicates.

Only blocks that can repeat are indexed.  Each block is named by its anchor, the smallest
hash among its GRAM-word grams: equal blocks have equal anchors, and about one word in seven
begins an anchor.  Anchors that occur once in the corpus rule their blocks out, exactly.
Texts that repeat an earlier text as a whole are one factor and aren't parsed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.shipping import map_arrow

from .common import wide_hash
from .words import Words, covered, mix, slices

WIDTH = 20
GRAM = 8
FACTOR = "struct<start:int,length:int>"
#: One document in HINT_SHARE is looked at for anchors with HINT_LEAST rows there, of which HOT at most are dealt over all tasks.
HINT_SHARE, HINT_LEAST, HOT = 64, 16, 1000


def anchors(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each block, where its anchor begins, and the anchor's hash."""
    gram = min(GRAM, width)
    at, grams = w.grams(w.hashes(), gram)
    value = np.full(len(w) + width, np.iinfo(np.uint64).max, dtype=np.uint64)
    value[at] = grams
    begin = np.flatnonzero(np.arange(len(w)) + width <= w.first[1:][w.doc]) if len(w) else np.zeros(0, dtype=np.int64)
    if not len(begin):
        return begin, begin, np.zeros(0, dtype=np.uint64)
    place = np.zeros(len(begin), dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(value, width - gram + 1)
    for i in range(0, len(begin), 1 << 18):
        part = begin[i : i + (1 << 18)]
        place[i : i + (1 << 18)] = part + views[part].argmin(axis=1)
    return begin, place, value[place]


def _keys(batch: pa.RecordBatch, key: list[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in key]


def _anchor_rows(width: int, key: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _keys(batch, key)
            for i, j, w in slices(batch.column("text")):
                _, place, value = anchors(w, width)
                new = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(value[new].view(np.int64)), *[pa.array(k[i:j][w.doc[place[new]]]) for k in ids]], names=["anchor", *key])

    return run


def _pairs(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every element of a list column, null as empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False)


def candidates(w: Words, shared: pa.ListArray, width: int) -> np.ndarray:
    """First words of the blocks whose anchors are among their text's shared ones."""
    begin, _, value = anchors(w, width)
    owner, wanted = _pairs(shared)
    salt = lambda doc: (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    with np.errstate(over="ignore"):
        return begin[np.isin(mix(value + salt(w.doc[begin])), mix(wanted.view(np.uint64) + salt(owner)))]


def _block_rows(width: int, key: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _keys(batch, key)
            for i, j, w in slices(batch.column("text")):
                begin = candidates(w, batch.column("shared").slice(i, j - i), width)
                first, second = np.zeros(len(w), dtype=np.uint64), np.zeros(len(w), dtype=np.uint64)
                for out, which in ((first, 0), (second, 1)):
                    at, h = w.grams(w.hashes(which), width, which)
                    out[at] = h
                doc = w.doc[begin]
                yield pa.RecordBatch.from_arrays([pa.array(first[begin].view(np.int64)), pa.array((second[begin] >> np.uint64(32)).astype(np.uint32).view(np.int32)), *[pa.array(k[i:j][doc]) for k in ids], pa.array((begin - w.first[doc]).astype(np.int32))], names=["h1", "h2", *key, "start"])

    return run


def runs(starts: np.ndarray, width: int) -> list[dict]:
    """Factors of one document: runs of repeated blocks, from the sorted starts of these."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > 1) + 1
    return [{"start": int(r[0]), "length": int(r[-1] - r[0]) + width} for r in np.split(starts, new)]


def _cut(width: int):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in slices(batch.column("text")):
                part = batch.slice(i, j - i)
                begin = candidates(w, part.column("shared"), width)
                owner, first = _pairs(part.column("firsts"))
                repeated = begin[~np.isin(begin, w.first[owner] + first)]
                gone = covered(len(w), repeated, width)
                upto = np.searchsorted(repeated, w.first)
                n_words, n_removed, kept, found = np.diff(w.first), np.zeros(j - i, dtype=np.int64), [], []
                whole = part.column("copy_of").is_valid().to_numpy(zero_copy_only=False) & (n_words >= width)
                data = w.data.tobytes()
                for k in range(j - i):
                    a, b = w.first[k], w.first[k + 1]
                    words = data[w.offsets[k] : w.offsets[k + 1]].split()
                    if whole[k]:
                        words, made = [], [{"start": 0, "length": int(n_words[k])}]
                    elif upto[k + 1] > upto[k]:
                        words, made = list(itertools.compress(words, (~gone[a:b]).tolist())), runs(repeated[upto[k] : upto[k + 1]] - a, width)
                    else:
                        made = []
                    n_removed[k] = n_words[k] - len(words)
                    kept.append(b" ".join(words).decode())
                    found.append(made)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), pa.array(n_words.astype(np.int64)), pa.array(n_removed), pa.array(kept, pa.string()), pa.array(found, kind)], names=["doc_id", "part", "n_words", "n_removed", "kept_text", "factors"])

    return run


def crowded(named: DataFrame, width: int, key: list[str]) -> list[int]:
    """Anchors of very many rows, most frequent first.  They tell where to send rows, never what is found: each occurs HINT_LEAST times at least."""
    some = named.filter(F.pmod(F.xxhash64("doc_id"), F.lit(HINT_SHARE)) == 0)
    n = map_arrow(some, _anchor_rows(width, key), "anchor long, " + _longs(key)).groupBy("anchor").agg(F.count("*").alias("n"))
    return [r["anchor"] for r in n.filter(F.col("n") >= HINT_LEAST).orderBy(F.desc("n"), "anchor").limit(HOT).collect()]


def _longs(key: list[str]) -> str:
    return ", ".join(f"{c} long" for c in key)


def in_common(found: DataFrame, hot: list[int], key: list[str]) -> DataFrame:
    """Rows of found (anchor, key) whose anchor occurs twice or more.

    Anchors in `hot` are known to; their rows are dealt over all tasks by document.  All others
    are counted next to their rows, so that found is made and sent once.
    """
    hints = F.broadcast(found.sparkSession.createDataFrame([(a,) for a in hot], "hot long"))  # HOT rows at most
    tagged = found.join(hints, F.col("anchor") == F.col("hot"), "left")
    tagged = tagged.select("anchor", *key, F.coalesce(F.when(F.col("hot").isNotNull(), F.xxhash64("doc_id")), F.col("anchor")).alias("place"), F.col("hot").isNotNull().alias("known"))
    counted = tagged.withColumn("n", F.count("*").over(Window.partitionBy("place", "known")))
    return counted.filter("known or n > 1").select("anchor", *key)


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, part, n_words, n_removed, kept_text, factors of each row of docs (doc_id, text).

    Removed are the words of every block of `width` words that also starts earlier: in a
    smaller doc_id, or earlier in the same document.  Blocks are those of the input, whatever
    is removed elsewhere.  Kept words are joined by one blank.  Null text has no words.  Rows
    with one doc_id and different texts are documents of their own, in order of `part`, a hash of
    the text; rows equal in both are one document and give equal rows.  A row without doc_id is
    neither indexed nor cut.
    """
    # without a cast that isn't needed, since the texts' exchange is then the same wherever it is asked for
    docs = docs.select("doc_id" if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id"), "text")
    # `part` is carried through the joins only if some doc_id has several rows; without such, it decides nothing
    several = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").limit(1).count() > 0
    key = ["doc_id", "part"] if several else ["doc_id"]
    named = docs.filter("doc_id is not null")
    if several:
        named = named.withColumn("part", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))).dropDuplicates(key)
    h1, h2 = wide_hash(F.col("text"))
    texts = named.filter("text is not null").select(*key, h1.alias("t1"), h2.alias("t2"))
    place = F.struct(*key)
    first = texts.groupBy("t1", "t2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").drop("last")
    copies = texts.join(first, ["t1", "t2"]).filter(place > F.col("first")).groupBy(*key).agg(F.min("first.doc_id").alias("copy_of"))

    found = map_arrow(named, _anchor_rows(width, key), "anchor long, " + _longs(key))
    shared = in_common(found, crowded(named, width, key), key).groupBy(*key).agg(F.collect_set("anchor").alias("shared"))
    shared = shared.join(copies, key, "left_anti")

    blocks = map_arrow(named.join(shared, key).select(*key, "text", "shared"), _block_rows(width, key), f"h1 long, h2 int, {_longs(key)}, start int")
    # the index; only where a block starts first goes back to the documents, not what repeats it
    index = blocks.groupBy("h1", "h2").agg(F.min(F.struct(*key, "start")).alias("first"))
    firsts = index.groupBy(*[F.col(f"first.{c}").alias(c) for c in key]).agg(F.collect_list("first.start").alias("firsts"))
    known = docs.filter("doc_id is not null").withColumn("part", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))) if several else named
    parsed = known.join(shared, key, "left").join(firsts, key, "left").join(copies, key, "left")
    columns = ["doc_id", "part", "text", "shared", "firsts", "copy_of"]
    parsed = parsed.withColumn("part", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))).select(*columns)
    bare = docs.filter("doc_id is null").select("doc_id", F.lit(0).cast("long").alias("part"), "text", F.lit(None).cast("array<long>").alias("shared"), F.lit(None).cast("array<int>").alias("firsts"), F.lit(None).cast("long").alias("copy_of"))
    return map_arrow(parsed.unionByName(bare), _cut(width), f"doc_id long, part long, n_words long, n_removed long, kept_text string, factors array<{FACTOR}>")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of docs with repeated passages cut from their text; all columns stay.

    A text without a repeat stays as it is, white space included; one that loses every word is
    left out.  n_chars, where docs has it, is counted anew.
    """
    cut = dedup(docs, width).filter("n_removed > 0").dropDuplicates(["doc_id", "part"])
    cut = cut.select(F.struct("doc_id", "part", "n_words", "n_removed", "kept_text").alias("cut"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so that no name of docs clashes
    joined = rows.join(cut, (F.col("row.doc_id").cast("long") == F.col("cut.doc_id")) & (F.coalesce(F.xxhash64("row.text"), F.lit(0).cast("long")) == F.col("cut.part")), "left")
    joined = joined.filter("cut is null or cut.n_removed < cut.n_words")
    made = {"text": F.when(F.col("cut").isNotNull(), F.col("cut.kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("cut").isNotNull(), F.length("cut.kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return joined.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
