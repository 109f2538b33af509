"""Sharding by vector bin packing.

Groups of equal texts are packed so that bytes, tokens and rows of the shards come out
near equal together.  Every group goes to the shard with room for it whose residual capacity
has the highest dot product with the group's size vector, larger groups first.

The groups are dealt into chunks by hash, and each chunk is packed by itself against its part
of every shard's capacity, so chunks go side by side.  A group that is large beside a chunk is
placed first, on the driver, against the whole capacities: fewer than 3 * CHUNKS * n_shards * LARGE
of them exist whatever the input.  What these leave of each shard is shared out to the chunks.
A group that no shard can hold is cut into pieces by doc_id, for shards could not be equal otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.shipping import map_arrow

from .common import checkpoint, n_bytes, n_words, wide_hash

#: Groups of a chunk, and chunks at most (beyond them chunks grow).
GROUPS, CHUNKS = 50_000, 1024
#: A group is large from this part of a chunk's share of a shard on.
LARGE = 8
#: Pieces of a group that no shard can hold, per shard's capacity.
PIECES = 64
ROWS_PER_RUN = 10_000
DIMS = ("size", "n_tokens", "n_rows")


def place(sizes: np.ndarray, residual: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Shard of each unit; residual (shards x dimensions, in parts of total) is used up.

    sizes: units x dimensions.  Larger units go first; where no shard has room, the best by dot product is overfilled.
    """
    share = sizes / np.maximum(total, 1)
    out = np.zeros(len(sizes), dtype=np.int64)
    for i in np.lexsort((np.arange(len(share)), -share.max(axis=1))) if len(sizes) else ():
        fits = (residual >= share[i]).all(axis=1)
        score = residual @ share[i]
        best = int(np.argmax(np.where(fits, score, score - 2.0)))
        out[i] = best
        residual[best] -= share[i]
    return out


def _packer(residual: np.ndarray, total: np.ndarray):
    """Packs the groups of each chunk; a partition has whole chunks, sorted by chunk and group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed(rows: pa.Table) -> pa.RecordBatch:
            sizes = np.stack([rows.column(d).to_numpy() for d in DIMS], axis=1).astype(np.float64)
            # ties go to another shard first in each chunk, so that chunks' odd ends don't add up in one
            turn = int(rows.column("chunk")[0].as_py()) % len(residual)
            where = (place(sizes, np.roll(residual, -turn, axis=0).copy(), total) + turn) % len(residual)
            return pa.RecordBatch.from_arrays([rows.column("group").combine_chunks(), pa.array(where.astype(np.int32))], names=["group", "shard"])

        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    if held and held[-1].column("chunk")[-1].as_py() != chunk[a]:
                        yield packed(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield packed(pa.Table.from_batches(held))

    return run


def pack(docs: DataFrame, n_shards: int = 8, size: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, n_tokens, shard, slot of every row of docs (doc_id, text).

    Null text is a group of its own with no bytes.  Rows with equal text share a shard unless
    their group alone exceeds a shard's capacity in some dimension.  Slots number each
    shard's rows from 0 without gaps.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.col("text")
    h, _ = wide_hash(F.coalesce(text, F.lit("")))
    rows = checkpoint(
        docs.select(
            "doc_id",
            (n_bytes(text) + 1 if size is None else size).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            n_words(text).alias("n_tokens"),
            F.xxhash64(h, text.isNull()).alias("group"),
        )
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"))
    groups = checkpoint(groups)
    t = groups.agg(F.count("*").alias("groups"), *[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMS]).first()
    total = np.array([float(t[d]) for d in DIMS])
    chunks = min(CHUNKS, max(1, -(-t["groups"] // GROUPS)))
    share = F.greatest(*[F.col(d) / max(1, t[d]) for d in DIMS])
    limit = 1 / (chunks * n_shards * LARGE)
    large = groups.withColumn("share", share).filter(F.col("share") > limit)
    pieces = F.when(F.col("share") > 1 / n_shards, F.ceil(F.col("share") * n_shards * PIECES)).otherwise(1).cast("int")
    cut = spark.createDataFrame([(r["group"], r["pieces"]) for r in large.filter(F.col("share") > 1 / n_shards).select("group", pieces.alias("pieces")).collect()], "cut_group long, pieces int")  # fewer than 3 * n_shards
    piece = lambda df: df.join(F.broadcast(cut), F.col("group") == F.col("cut_group"), "left").withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).otherwise(0).cast("int")).drop("cut_group", "pieces")
    rows = piece(rows)
    parts = rows.join(F.broadcast(cut.select(F.col("cut_group").alias("group"))), "group").groupBy("group", "piece").agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"))
    whole = large.filter(F.col("share") <= 1 / n_shards).select("group", F.lit(0).alias("piece"), *DIMS)
    units = whole.unionByName(parts).orderBy("group", "piece").collect()
    residual = np.full((n_shards, len(DIMS)), 1.0 / n_shards)
    where = place(np.array([[u[d] for d in DIMS] for u in units], dtype=np.float64).reshape(len(units), len(DIMS)), residual, total)
    first = spark.createDataFrame([(u["group"], u["piece"], int(s)) for u, s in zip(units, where, strict=True)], "group long, piece int, large_shard int")
    small = groups.join(F.broadcast(first.select("group").distinct()), "group", "left_anti").withColumn("chunk", F.pmod("group", F.lit(chunks)).cast("int"))
    small = small.repartition(chunks, "chunk").sortWithinPartitions("chunk", "group").select("chunk", "group", *DIMS)
    packed = map_arrow(small, _packer(residual / chunks, total), "group long, shard int")
    placed = rows.join(F.broadcast(first), ["group", "piece"], "left")
    done = placed.filter("large_shard is not null").withColumn("shard", F.col("large_shard"))
    rest = placed.filter("large_shard is null").join(packed, "group")
    columns = ["doc_id", "size", "text_crc32", "n_tokens", "shard"]
    placed = checkpoint(done.select(*columns).unionByName(rest.select(*columns)))
    # Rows of a shard are numbered in runs, so that no task holds a whole shard.
    runs = max(1, -(-t["n_rows"] // (n_shards * ROWS_PER_RUN)))
    placed = placed.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)))
    starts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "run", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "run").orderBy("doc_id", "size", "text_crc32")
    return placed.withColumn("k", F.row_number().over(inside)).join(starts, ["shard", "run"]).select("doc_id", "size", "text_crc32", "n_tokens", "shard", (F.col("start") + F.col("k") - 1).cast("long").alias("slot"))
