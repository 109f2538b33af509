"""SentencePiece encoding and decoding with shared prefixes.

A text's words carry their leading mark; no piece has a mark behind another character, so
marked words are encoded one by one.  The distinct words of a batch are sorted, which is a
trie walked depth-first: a word goes on from the forward states of the prefix that it
shares with the word before.

The forward state of a prefix is the last piece of its best segmentation.  For a merge model
the best segmentation is the one that merging by score gives, and a sequence of pieces is
that segmentation exactly if every two neighbours are: so at each character one piece is
valid behind the state where it starts.  The results are the ids the model's own library gives.
"""

from __future__ import annotations

import heapq
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.shipping import map_arrow

MARK = "▁"
#: Words whose ids a Python worker remembers at most, about 200 bytes each.
MEMORY = 150_000
#: Neighbouring pieces whose fit it remembers.
PAIRS = 400_000
#: Texts that are encoded at once.
ROWS = 200
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_models: dict[str, Model] = {}


def model_path(path: str | None = None) -> str:
    return path or os.environ.get("QUIRE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


class Model:
    """A SentencePiece merge model with byte fallback: its vocabulary, read from `path`, never trained."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        special = [p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i) for i in range(n)]
        self.ids = {x: i for i, x in enumerate(self.pieces) if not special[i]}
        if any(MARK in x.lstrip(MARK) for x in self.ids):
            raise ValueError("a piece has a mark behind another character; words can't be encoded one by one")
        self.scores = [p.get_score(i) for i in range(n)]
        self.bytes = {int(x[3:5], 16): i for i, x in enumerate(self.pieces) if p.is_byte(i)}
        self.unknown = p.unk_id()
        self.raw = [b"" if p.is_control(i) else bytes([int(x[3:5], 16)]) if p.is_byte(i) else " ⁇ ".encode() if i == self.unknown else x.replace(MARK, " ").encode() for i, x in enumerate(self.pieces)]
        self.halves: dict[int, tuple[int, int] | None | bool] = {}
        # The longest end of a prefix that begins a piece is its state; steps between states and the pieces that end in one are found as they come up.
        self.heads = {x[:i] for x in self.ids for i in range(len(x) + 1)}
        self.states: dict[str, int] = {}
        self.ending: list[tuple[tuple[int, int], ...]] = []
        self.named: list[str] = []
        self.steps: dict[int, int] = {}
        self.state("")
        self.pairs: dict[int, bool] = {}
        self.memory: dict[str, bytes] = {}

    def merge(self, text: str, last: list | None = None) -> list[str]:
        """Pieces of text by merging, highest score first, then leftmost; `last` gets the two sides of the last merge."""
        parts: list[str | None] = list(text)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (k := self.ids.get(joined := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, j, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != joined:
                continue
            if last is not None:
                last[:] = parts[i], parts[j]
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for x in parts if x is not None]

    def made_of(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge completes piece; None for a single character.  False if merging its text gives something else."""
        if piece not in self.halves:
            last: list[str] = []
            whole = self.merge(self.pieces[piece], last) == [self.pieces[piece]]
            self.halves[piece] = (self.ids[last[0]], self.ids[last[1]]) if whole and last else None if whole else False
        return self.halves[piece]

    def fits(self, left: int, piece: int) -> bool:
        """Whether piece stays whole behind the piece left (below 0: nothing or an unknown character).

        The merges of both are undone from the last to the first.  Should the two pieces that
        then touch make a piece that merges before what is undone so far, merging would have
        crossed the border.
        """
        if left < 0:
            return self.made_of(piece) is not False
        if self.made_of(piece) is False:
            return False
        scores, ids, pieces = self.scores, self.ids, self.pieces
        a, b = left, piece
        # Of merges with equal score the left one comes first; so a crossing merge ties with one in `a` after, with one in `b` before.
        done_a = done_b = float("-inf")  # scores of the merges undone last on either side
        while True:
            crossing = ids.get(pieces[a] + pieces[b])
            if crossing is not None and scores[crossing] > done_a and scores[crossing] >= done_b:
                return False
            halves_a, halves_b = self.made_of(a), self.made_of(b)
            if halves_a is None and halves_b is None:
                return True
            if halves_b is None or halves_a is not None and scores[a] <= scores[b] and (scores[a] < scores[b] or halves_b is None):
                done_a, a = scores[a], halves_a[1]
            else:
                done_b, b = scores[b], halves_b[0]

    def fallback(self, ch: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in ch.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def to_ids(self, pieces: Iterable[str]) -> bytes:
        return array("i", [k for x in pieces for k in ([self.ids[x]] if x in self.ids else self.fallback(x))]).tobytes()

    def state(self, end: str) -> int:
        if end not in self.states:
            self.states[end] = len(self.named)
            self.named.append(end)
            self.ending.append(tuple((self.ids[x], len(x)) for i in range(len(end)) if (x := end[i:]) in self.ids))
        return self.states[end]

    def step(self, state: int, ch: str) -> int:
        """State behind a further character."""
        end = self.named[state] + ch
        while end not in self.heads:
            end = end[1:]
        if len(self.steps) >= PAIRS:
            self.steps.clear()
        out = self.steps[state << 21 | ord(ch)] = self.state(end)
        return out

    def walk(self, words: Iterable[str]) -> None:
        """Put the ids of marked words into memory; words come without their mark, distinct and sorted."""
        pairs, steps, ending, memory, fits = self.pairs, self.steps, self.ending, self.memory, self.fits
        # Forward states of the prefixes of the word at hand: the last piece (-1: none, an unknown
        # character), where it begins, and the automaton's state.  The first is the mark's.
        mark = self.ids[MARK]
        last, begin, node = [mark], [0], [self.step(0, MARK)]
        held = ""
        for word in words:
            shared = 0
            for x, y in zip(word, held):  # noqa: B905
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :], node[shared + 1 :]
            at = node[shared]
            for i in range(shared, len(word)):
                ch = word[i]
                key = at << 21 | ord(ch)
                at = steps[key] if key in steps else self.step(at, ch)
                state, start = -1, i + 1
                for k, size in ending[at]:
                    j = i + 2 - size
                    left = last[j - 1] if j else -1
                    key = left << 20 | k
                    good = pairs.get(key)
                    if good is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        good = pairs[key] = fits(left, k)
                    if good:
                        state, start = k, j
                        break
                last.append(state)
                begin.append(start)
                node.append(at)
            held, out, i = word, [], len(word)
            while i >= 0:
                if last[i] >= 0:
                    out.append(last[i])
                else:
                    out += self.fallback(word[i - 1])[::-1]
                i = begin[i] - 1
            out.reverse()
            memory[word] = array("i", out).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty text have none."""
        if len(self.memory) > MEMORY:
            self.memory.clear()
        plain = [t.split(" ") if t and "  " not in t and t[0] != " " and t[-1] != " " and MARK not in t else None for t in texts]
        self.walk(sorted(set().union(*(w for w in plain if w)).difference(self.memory)))
        get = self.memory.__getitem__
        return [np.frombuffer(b"".join(map(get, w)) if w else self.uncommon(t), dtype=np.int32) for w, t in zip(plain, texts, strict=True)]

    def uncommon(self, text: str | None) -> bytes:
        """Ids of a text with marks of its own or several blanks in a row.

        Pieces of marks alone have equal scores, so for runs of marks the order of merging decides.
        """
        chunks = _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []
        common = {c[1:] for c in chunks if c[:1] == MARK and c[1:2] not in ("", MARK)}
        self.walk(sorted(common.difference(self.memory)))
        return b"".join(self.memory[c[1:]] if c[1:] in common else self.to_ids(self.merge(c)) for c in chunks)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; the blank that encoding put in front goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def model(path: str | None = None) -> Model:
    """The worker's one copy of the model at path."""
    path = model_path(path)
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", check: bool = True) -> DataFrame:
    """docs with ids array<int>, n_ids int and, with check, round_trip boolean.

    Encoding takes whole texts, row by row, so nothing is shuffled.  round_trip says whether
    decoding gives the text back, as it does for all texts without U+2581, which the model
    reads as a blank.  Null text is encoded as the empty text.  Columns of docs that have these
    names are replaced.
    """
    path = model_path(path)
    made = {"ids": "array<int>", "n_ids": "int"} | ({"round_trip": "boolean"} if check else {})
    columns = [c for c in docs.columns if c not in made]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), *(f"{c} {t}" for c, t in made.items())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                texts = part.column(text).to_pylist()
                ids = m.encode(texts)
                sizes = np.array([len(x) for x in ids], dtype=np.int32)
                flat = np.concatenate(ids) if sizes.any() else np.zeros(0, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
                more = [pa.array([m.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], lists, pa.array(sizes), *more], names=[*columns, *made])

    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in columns]), run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with decoded string, the text of its ids; null ids give null."""
    path = model_path(path)
    columns = [c for c in encoded.columns if c != "decoded"]
    schema = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in columns), "decoded string"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array([None if x is None else m.decode(x) for x in batch.column("ids").to_pylist()], pa.string())], names=[*columns, "decoded"])

    return map_arrow(encoded.select(*[F.col(f"`{c}`") for c in columns]), run, schema)
