"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers cut one byte string.  The ends of their tokens are two packed bitsets over its
bytes.  AND of the two gives the cuts that both make, popcounts of the words before a cut rank it
among each one's token ends, and so a group between two cuts is a range of tokens on either side.
OR of the two gives every cut; between two neighbouring ones lies one token of each, which is one
link.  Links are counted over the corpus by pair of ids.

Ids are made once and written to the shared folder, since counts have to be known before a
document's links can be valued.  The most frequent pairs, HOT at most whatever the corpus, are
handed to all tasks; the links of all other pairs are joined with their counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.shipping import map_arrow

from .common import Scratch

MARK = "▁"
#: Pairs of ids that all tasks get, 17 bytes each.
HOT = 1 << 20
#: Words whose ids a Python worker remembers at most, about 300 bytes each.
MEMORY = 150_000
#: Texts that are encoded at once, bytes that are aligned at once, and links that are counted at once.
ROWS, SLICE, LINKS = 200, 1 << 20, 1 << 21
#: Fixed value: how byte-level vocabularies cut text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Text that two libraries cut alike, whatever their Unicode version.
_PLAIN = re.compile("[\x00-ɏ]*")
MEASURES = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_tokenizers: dict[tuple, Tokenizers] = {}


def folder() -> str:
    return os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, those from U+0100 on for the others."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """A byte-level tokenizer (A) and a SentencePiece model (B), read from their files."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(byte_level, encoding="utf-8") as f:
            read = json.load(f)
        vocabulary, code = read["model"]["vocab"], byte_of()
        added = {x["content"]: x["id"] for x in read.get("added_tokens", [])}
        ranks = {bytes(map(code.__getitem__, token)): i for token, i in vocabulary.items() if token not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in read["model"]["merges"]]
        order = [vocabulary[a + b] for a, b in merges]
        self.byte_level = byte_level
        self.slow = None
        # where ids are in order of merging, they are ranks
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if order == sorted(order) else None
        self.a_raw = [b""] * (1 + max([*vocabulary.values(), *added.values()]))
        for raw, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.a_raw[i] = raw
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_raw = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(MARK, " ").encode() for i in range(self.b.get_piece_size()) for x in [self.b.id_to_piece(i)]]
        self.kind = np.dtype("<u2" if max(len(self.a_raw), len(self.b_raw)) <= 1 << 16 else "<u4")
        self.a_size, self.b_size = (np.array([len(x) for x in raw], dtype=np.int64) for raw in (self.a_raw, self.b_raw))
        self.names: list[str] | None = None
        self.memory: dict[str, tuple[bytes, bytes] | None] = {}

    def a_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts by A, special tokens' strings being plain text."""
        out: list[list[int]] = []
        rest = [t for t in texts if self.fast is None or not _PLAIN.fullmatch(t)]
        if rest and self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.byte_level)
            self.slow.encode_special_tokens = True
        slow = iter(self.slow.encode_batch(rest, add_special_tokens=False) if rest else ())
        for t in texts:
            out.append(next(slow).ids if self.fast is None or not _PLAIN.fullmatch(t) else self.fast.encode_ordinary(t))
        return out

    def both(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Packed ids of each text by A, behind a space, and by B; None where the bytes of either differ from the text's."""
        out = []
        for t, a, b in zip(texts, self.a_ids([" " + t for t in texts]), self.b.encode(texts, num_threads=1), strict=True):
            want = (" " + t).encode()
            same = b"".join([self.a_raw[i] for i in a]) == want and b"".join([self.b_raw[i] for i in b]) == want
            out.append((np.array(a, self.kind).tobytes(), np.array(b, self.kind).tobytes()) if same else None)
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """As both, word by word.

        A space before anything but white space begins a token in A and in B, so texts are cut there; texts
        with other runs of white space are taken whole, and so are those with U+2581.
        """
        words = [t.split(" ") if t and MARK not in t else None for t in texts]
        if len(self.memory) > MEMORY:
            self.memory.clear()
        new = sorted(set().union(*(w for w in words if w)).difference(self.memory))
        new = [w for w in new if w and not w[0].isspace()]
        self.memory.update(zip(new, self.both(new), strict=True))
        get = self.memory.get
        out: list[tuple[bytes, bytes] | None] = []
        whole = []
        for i, (t, w) in enumerate(zip(texts, words, strict=True)):
            parts = [get(x) for x in w] if w else []
            if w and None not in parts:
                out.append((b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])))
                continue
            out.append(None)
            if t:
                whole.append(i)
        for i, got in zip(whole, self.both([texts[i] for i in whole]), strict=True):
            out[i] = got
        return out

    def decimals(self) -> list[str]:
        """Each id as it stands in a group: of A before a comma, of A at the end, of B before a comma, of B at the end."""
        if self.names is None:
            n = max(len(self.a_raw), len(self.b_raw))
            self.names = [f"{i}{end}" for end in ",|,;" for i in range(n)]
        return self.names


def tokenizers(paths: tuple[str, str]) -> Tokenizers:
    """The worker's one copy of the tokenizers at paths."""
    if paths not in _tokenizers:
        _tokenizers[paths] = Tokenizers(*paths)
    return _tokenizers[paths]


class Bitset:
    """Packed bits at ends (each the number of bytes up to the end of a token) and their ranks."""

    def __init__(self, ends: np.ndarray, size: int):
        flags = np.zeros(-(-max(size, 1) // 64) * 64, dtype=np.uint8)
        flags[ends - 1] = 1
        self.words = np.packbits(flags, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words)
        self.before = np.cumsum(counts, dtype=np.int64) - counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Bits set before position at."""
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)


def select(words: np.ndarray) -> np.ndarray:
    """Positions of the set bits."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


class Aligned:
    """Groups and links of some documents at once, whose texts stand one behind the other.

    a, b: ids; a_first, b_first: where each document's begin, and their number;
    group_a, group_b: behind the last token of each group; group_first: as a_first, of groups;
    link_a, link_b: the tokens of each link; link_first: as a_first, of links.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, a_size: np.ndarray, b_size: np.ndarray):
        self.a, self.b, self.a_first, self.b_first = a, b, a_first, b_first
        a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
        size = int(a_end[-1]) if len(a_end) else 0
        ends = np.concatenate([[0], a_end])[a_first]
        x, y = Bitset(a_end, size), Bitset(b_end, size)
        cuts, all_ = select(x.words & y.words), select(x.words | y.words)
        self.group_a, self.group_b = x.rank(cuts) + 1, y.rank(cuts) + 1
        self.link_a, self.link_b = x.rank(all_), y.rank(all_)
        self.group_first, self.link_first = np.searchsorted(cuts, ends), np.searchsorted(all_, ends)

    def pairs(self) -> np.ndarray:
        """Each link's pair of ids as one number."""
        return self.a[self.link_a].astype(np.int64) << 32 | self.b[self.link_b].astype(np.int64)

    def named(self, t: Tokenizers) -> list[str]:
        """Each document's groups in order, `a1,a2|b1;a3|b2,b3`."""
        n = len(t.decimals()) // 4
        a_last, b_last = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        a_last[self.group_a - 1] = b_last[self.group_b - 1] = 1
        # a group's tokens of A, then those of B: each token moves by the other's tokens of the groups before, or up to its own
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        order = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        order[np.arange(len(self.a)) + np.concatenate([[0], self.group_b])[a_group]] = self.a + n * a_last
        order[np.arange(len(self.b)) + self.group_a[b_group]] = self.b + n * (2 + b_last)
        first = (self.a_first + self.b_first).tolist()
        get, codes = t.decimals().__getitem__, order.tolist()
        return ["".join(map(get, codes[i:j]))[:-1] for i, j in zip(first[:-1], first[1:], strict=True)]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _packed(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def aligned(batch: pa.RecordBatch, t: Tokenizers) -> Iterator[tuple[int, int, Aligned]]:
    """First row, row behind the last, and Aligned, for slices of encoded rows; a document is never cut."""
    a, b = _packed(batch.column("a")), _packed(batch.column("b"))
    width = t.kind.itemsize
    i = 0
    while i < len(a):
        j, held = i, 0
        while j < len(a) and (j == i or held + len(a[j]) + len(b[j]) <= SLICE):
            held += len(a[j]) + len(b[j])
            j += 1
        first = [np.concatenate([[0], np.cumsum([len(x) // width for x in side[i:j]], dtype=np.int64)]) for side in (a, b)]
        ids = [np.frombuffer(b"".join(side[i:j]), dtype=t.kind).astype(np.int64) for side in (a, b)]
        yield i, j, Aligned(*ids, *first, t.a_size, t.b_size)
        i = j


def encode(docs: DataFrame, paths: tuple[str, str], text: str = "text") -> DataFrame:
    """row, doc_id, a, b of each row of docs: a number for the row and its packed ids by both tokenizers.

    Null and empty texts, and those whose tokens don't join to their bytes, have empty a and b.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(paths)
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                ids = [x or (b"", b"") for x in t.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *[pa.array([x[k] for x in ids], pa.binary()) for k in (0, 1)]], names=["row", "doc_id", "a", "b"])

    return map_arrow(rows, run, "row long, doc_id long, a binary, b binary")


def pair_counts(encoded: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """pair, n, best: links of each pair of ids over all documents, and whether no other pair with its B id has more.

    Links are counted per LINKS in the tasks, so what is shuffled follows the vocabularies.  The window of a
    B id holds one row for each A id at most.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(paths)
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for _, _, x in aligned(batch, t):
                held.append(x.pairs())
                if sum(map(len, held)) >= LINKS:
                    yield counted()
        if held:
            yield counted()

    counts = map_arrow(encoded, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    return counts.withColumn("best", F.col("n") == most)


def hot_from(counts: DataFrame, hot: int) -> int:
    """The least power of two from which on there are `hot` pairs at most."""
    by_size = dict(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("pairs")).collect())  # 62 rows at most: no corpus has 2^62 links
    total, least = 0, 62
    for size in sorted(by_size, reverse=True):
        total += by_size[size]
        if total > hot:
            break
        least = size
    return 1 << least


def align(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, text: str = "text", groups: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id and MEASURES of each row of docs (doc_id, text); with groups also the groups themselves.

    n_groups, n_links: groups between shared cuts and links; n_best: links whose pair has, over the corpus, the most
    links of its B id, ties included; count_sum: the pair's links over the corpus, summed over the document's links.
    Null, empty and not reproduced texts have zeros and an empty string.  Rows with equal doc_id, or none, are
    documents of their own and each count.
    """
    spark = docs.sparkSession
    paths = byte_level or f"{folder()}/byte_bpe_50k.json", pieces or f"{folder()}/piece_bpe_32k.model"
    scratch = Scratch(spark, "alignment")
    encoded = scratch.keep(encode(docs, paths, text))
    counts = scratch.keep(pair_counts(encoded, paths))
    least = hot_from(counts, hot)
    known = counts.filter(F.col("n") >= least).orderBy("pair").toPandas()  # `hot` rows at most
    shared = spark.sparkContext.broadcast((known["pair"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(bool)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(paths)
        pair, n, best = shared.value
        pair, n, best = np.append(pair, np.iinfo(np.int64).max), np.append(n, 0), np.append(best, False)
        for batch in batches:
            for i, j, x in aligned(batch, t):
                mine = x.pairs()
                at = np.searchsorted(pair, mine)
                there = pair[at] == mine
                names = x.named(t)
                rare = np.concatenate([[0], np.cumsum(~there)])[x.link_first]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(i, j - i) for c in ("row", "doc_id")],
                        *[pa.array(np.diff(f)) for f in (x.a_first, x.b_first, x.group_first, x.link_first)],
                        pa.array(_sums(best[at] & there, x.link_first)),
                        pa.array(_sums(np.where(there, n[at], 0), x.link_first)),
                        pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in names], pa.string()),
                        pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(mine[~there])),
                        *([pa.array(names, pa.string())] if groups else []),
                    ],
                    names=["row", "doc_id", *[c.split()[0] for c in MEASURES.split(", ")], "rare", *(["groups"] if groups else [])],
                )

    made = scratch.keep(map_arrow(encoded, run, f"row long, doc_id long, {MEASURES}, rare array<long>" + (", groups string" if groups else "")))
    rare = made.select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("links"))
    valued = rare.join(counts.filter(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more"))
    out = made.drop("rare").join(valued, "row", "left")
    out = out.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
    return out.drop("row", "more_best", "more")
