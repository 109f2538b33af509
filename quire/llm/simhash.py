"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into three segments.  A segment's keys are the codewords of
the perfect binary Golay code next to it and next to its neighbours at one bit: two
segments at most two bits apart always share such a key, since some word lies within one
bit of both and has one nearest codeword.

With at most four differing bits, either no segment has more than two of them, so that all
three segments share a key; or one has three or four, and of the other two one is equal and
the other at most one bit apart.  Joining on these composite keys finds every such pair; the
bits are then compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.shipping import map_arrow

from . import near
from .common import Scratch, checkpoint, wide_hash
from .words import mix

MOST_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that are compared with each other in memory; beyond it they go another way.
BUCKET = 256
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101
_tables: list[np.ndarray] = []


def _remainder(words: np.ndarray) -> np.ndarray:
    r = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        r = np.where(r >> np.uint32(bit) & np.uint32(1), r ^ np.uint32(_GENERATOR << (bit - 11)), r)
    return r


def golay_index() -> np.ndarray:
    """For each word of 23 bits, the 12 information bits of its nearest codeword."""
    if not _tables:
        masks = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)] + [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
        masks = np.array(masks, dtype=np.uint32)
        error = np.zeros(2048, dtype=np.uint32)
        error[_remainder(masks)] = masks
        table = np.zeros(1 << 23, dtype=np.uint16)
        for lo in range(0, len(table), 1 << 17):  # in parts, for the sake of the worker's memory
            words = np.arange(lo, lo + (1 << 17), dtype=np.uint32)
            table[lo : lo + (1 << 17)] = (words ^ error[_remainder(words)]) >> np.uint32(11)
        _tables.append(table)
    return _tables[0]


def segment_keys(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and codeword indices: those next to each word and its neighbours at one bit, each once."""
    index = golay_index()
    near = np.concatenate([segment[:, None], segment[:, None] ^ (np.uint32(1) << np.arange(bits, dtype=np.uint32))[None, :]], axis=1)
    keys = np.sort(index[near], axis=1)
    new = np.concatenate([np.ones((len(keys), 1), dtype=bool), keys[:, 1:] != keys[:, :-1]], axis=1)
    return np.nonzero(new)[0], keys[new]


def _cross(rows_a: np.ndarray, a: np.ndarray, rows_b: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All combinations of a and b with equal row number; rows are sorted."""
    count_b = np.bincount(rows_b, minlength=n)
    first_b = np.cumsum(count_b) - count_b
    times = count_b[rows_a]
    rows = np.repeat(rows_a, times)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
    return rows, np.repeat(a, times), b[first_b[rows] + within]


def composite_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 64-bit keys; two fingerprints within MOST_BITS bits share one."""
    n = len(prints)
    parts = [(prints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.uint32) for at, bits in SEGMENTS]
    near = [segment_keys(p, bits) for p, (_, bits) in zip(parts, SEGMENTS, strict=True)]
    rows_ab, a, b = _cross(*near[0], *near[1], n)
    rows, ab, c = _cross(rows_ab, a.astype(np.uint64) << np.uint64(12) | b.astype(np.uint64), *near[2], n)
    out_rows, out = [rows], [ab << np.uint64(12) | c.astype(np.uint64)]
    for i in range(3):
        for j in range(3):
            if i != j:
                r, k = near[j]
                out_rows.append(r)
                out.append(np.uint64(1 + 3 * i + j) << np.uint64(40) | parts[i][r].astype(np.uint64) << np.uint64(12) | k.astype(np.uint64))
    return np.concatenate(out_rows), np.concatenate(out)


def fingerprint(texts: list[bytes | None], shingle: int) -> np.ndarray:
    """64-bit SimHash of each text over the XXH64 of its shingles of words, repeats included."""
    out, digest = np.zeros(len(texts), dtype=np.uint64), xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.translate(_LOWER).split() if text else []
        if not words:
            continue
        joined = b" ".join(words)
        gap = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        starts, ends = [0, *(gap + 1).tolist()], [*gap.tolist(), len(joined)]
        counts, n = np.zeros(64, dtype=np.int64), max(1, len(words) - shingle + 1)
        for lo in range(0, n, 1 << 16):
            hi = min(n, lo + (1 << 16))
            h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[lo:hi], ends[min(len(ends), lo + shingle) - 1 : hi + shingle - 1], strict=True)], dtype="<u8")
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id and print (the fingerprint's bits as a long) of each row of docs (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for i in range(0, len(batch), 512):
                part = texts.slice(i, 512)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 512), pa.array(fingerprint(part.to_pylist(), shingle).view(np.int64))], names=["doc_id", "print"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, print long")


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(prints), 512):
            part = prints[i : i + 512]
            rows, keys = composite_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(part[rows].view(np.int64))], names=["key", "print"])


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def group_links(prints: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links (fingerprint, root) that join what at most `most` bits connect; one fewer than members per component."""
    near = bit_count(prints[:, None] ^ prints[None, :]) <= most
    root, out = np.full(len(prints), -1), []
    for i in range(len(prints)):
        if root[i] < 0:
            root[i], front = i, [i]
            while front:
                found = np.flatnonzero(near[front].any(axis=0) & (root < 0))
                root[found] = i
                out += [(prints[k], prints[i]) for k in found]
                front = found.tolist()
    return out


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the keys of a partition sorted by key, print.

    A key with more than BUCKET fingerprints gives (print, null): those go to spread().
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held_key, held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    large: int | None = None

    def links(key: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal large
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([begin, [len(key)]]))
        two = begin[size == 2]
        two = two[bit_count(prints[two] ^ prints[two + 1]) <= MOST_BITS]
        found = list({*zip(prints[two + 1].tolist(), prints[two].tolist(), strict=True)})
        hot: list[int] = []
        for at, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if n > BUCKET:
                hot += prints[at : at + n].tolist()
            else:
                found += [(int(a), int(b)) for a, b in group_links(prints[at : at + n])]
        found = list(set(found)) + [(h, None) for h in set(hot)]
        if found:
            a = np.array([x for x, _ in found], dtype=np.uint64).view(np.int64)
            b = pa.array([None if y is None else y - (1 << 64) if y >= 1 << 63 else y for _, y in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), b], schema=schema)

    for batch in batches:
        key, prints = batch.column("key").to_numpy(zero_copy_only=False), batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
        if large is not None:  # the rest of a key that is known to be large
            n = int(np.searchsorted(key, large, "right"))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(prints[:n]).view(np.int64)), pa.nulls(len(np.unique(prints[:n])), pa.int64())], schema=schema)
            key, prints = key[n:], prints[n:]
            if not len(key):
                continue
            large = None
        key, prints = np.concatenate([held_key, key]), np.concatenate([held, prints])
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1], "left"))
        if len(key) - last > BUCKET:
            large, last = int(key[-1]), len(key)
        if last:
            yield from links(key[:last], prints[:last])
        held_key, held = key[last:], prints[last:]
    if len(held_key):
        yield from links(held_key, held)


def _balls(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    two = (one[:, None] ^ one[None, :])[np.triu_indices(64, 1)]
    masks = np.concatenate([[np.uint64(0)], one, two])
    for batch in batches:
        prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(prints), 256):
            part = prints[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks[None, :]).ravel().view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], names=["word", "print"])


def spread(hot: DataFrame) -> DataFrame:
    """Links among fingerprints of crowded keys, in work proportional to their number.

    Two words at most four bits apart have a word within two bits of both, and two words that
    share one are at most four bits apart: each print meets the least print of every word
    within two bits of it.  Spark doesn't know how many words a print has, so that its estimate
    would have `least` broadcast; the join is by shuffle.
    """
    words = map_arrow(hot.select("print").distinct(), _balls, "word long, print long")
    least = words.groupBy("word").agg(F.min("print").alias("b"), F.max("print").alias("top")).filter(F.col("b") < F.col("top")).select("word", "b")
    return words.join(least.hint("merge"), "word").filter(F.col("print") != F.col("b")).select(F.col("print").alias("a"), "b").distinct()


def print_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column print) that connect all within MOST_BITS bits.

    Every linked pair is connected through links, though not each by a link of its own.
    """
    keyed = map_arrow(prints, _keyed, "key long, print long")
    found = checkpoint(map_arrow(keyed.repartition("key").sortWithinPartitions("key", "print"), _compared, "a long, b long").distinct())
    direct = found.filter("b is not null")
    hot = found.filter("b is null").select(F.col("a").alias("print"))
    return direct if hot.isEmpty() else direct.unionByName(spread(hot))


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b): root is the least node it is connected to.

    Large-star and small-star steps alternate until nothing changes; each round is a few
    aggregations and joins on the links, which are rewritten to the shared folder.  Joins are by
    shuffle: a broadcast a join would pass the driver, some of each round at once.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(edges.select("b", "a"))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        near = both.join(m.hint("merge"), "u")
        if large:
            return near.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        return near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(m.select("u", "m")).filter("a <> b").distinct()

    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    state = None
    while True:
        edges = checkpoint(star(star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now


def near_groups(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, print, component_id of each row of docs (doc_id, text).

    component_id is the least doc_id reachable over fingerprints at most MOST_BITS bits apart.
    Null and wordless texts have print 0, linked like any other.  Equal doc_ids give a row
    each.  Copies share one print, so links are sought between distinct prints only.
    """
    prints = checkpoint(fingerprints(docs, shingle))
    least = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = components(print_links(least.select("print")))
    rooted = least.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named, "root").select("print", "component_id")
    return prints.join(by_print, "print").select("doc_id", "print", "component_id")


def print_hex(column: str = "print") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The first row of each group of docs; a null doc_id or a text without a word stays.

    Groups are connected by texts with Jaccard 0.8 or more over their shingles, all of which
    are found (near.py).  First is the least doc_id, then the least hash of the text; of
    rows equal in both one stays.
    """
    keyed = near.with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull()))
    scratch = Scratch(docs.sparkSession, "near")
    rows = checkpoint(near.groups(keyed.select(*near.KEY, "text"), shingle, fingerprint, print_links, components, scratch))
    scratch.drop()
    counted = rows.groupBy("group", *near.KEY).agg(F.count("*").alias("copies"))
    first = counted.groupBy("group").agg(F.min(F.struct(*near.KEY)).alias("first"))
    marked = counted.join(first, "group").withColumn("is_first", F.struct(*near.KEY) == F.col("first")).filter("not is_first or copies > 1")
    marked = checkpoint(marked.select(F.struct("doc_id", "h1", "h2").alias("key"), "is_first"))
    n = marked.agg(F.count("*").alias("all"), F.count_if("is_first").alias("first")).first()
    small = F.broadcast if n["all"] <= near.BROADCAST else lambda df: df
    # columns of docs may have any name and any type, so they travel in one struct
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    h1, h2 = wide_hash(F.col("row.text"))
    named = row.withColumns({"t0": F.col("row.doc_id").cast("long"), "t1": h1, "t2": h2})
    same = (F.col("t0") == F.col("key.doc_id")) & (F.col("t1") == F.col("key.h1")) & (F.col("t2") == F.col("key.h2"))
    alone = named.join(small(marked), same, "left_anti").select("row")
    if n["first"]:
        repeated = named.join(small(marked.filter("is_first")), same, "left_semi").dropDuplicates(["t0", "t1", "t2"])
        alone = alone.unionByName(repeated.select("row"))
    return alone.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
