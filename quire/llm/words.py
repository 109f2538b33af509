"""Words of a batch of texts as numpy arrays, and rolling hashes over them.

Works on the UTF-8 bytes that Arrow hands over, without a Python object per word.  Texts are
taken in slices of about SLICE bytes, so memory doesn't follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 1 << 19
#: Bytes hashed at once.
BLOCK = 1 << 17
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20240101)
_BYTE = [_RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
#: Longer words are hashed one by one: over very long runs a polynomial modulo a power of two has equal values for different bytes.
LONG_WORD = 64
#: Odd multipliers of the rolling hashes, for bytes and for words.
_BASE = [int(x) * 2 + 1 for x in _RANDOM.integers(2**61, 2**62, 4, dtype=np.uint64)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if base not in _powers or len(_powers[base][0]) < n:
        n = max(n, BLOCK + 1024)
        with np.errstate(over="ignore"):
            _powers[base] = tuple(np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, b, dtype=np.uint64))]) for b in (np.uint64(base), np.uint64(pow(base, -1, 2**64))))
    up, down = _powers[base]
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of h (uint64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(32))


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each pair; equal runs have equal hashes wherever they start."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _power(base, len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
        return (total[ends] - total[starts]) * down[starts]


class Words:
    """The words of some texts: byte range, text and hash of each.

    data: bytes of the texts; offsets: where each begins, and the end of the last;
    starts, ends: of the words; doc: each word's text; first: each text's first word, and the
    number of words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        word = ~SPACE[data]
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        full = offsets[1:] > offsets[:-1]
        at, last = offsets[:-1][full], offsets[1:][full] - 1
        begins[at], stops[last] = word[at], word[last]
        self.word, self.starts, self.ends = word, np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int = 0, table: np.ndarray | None = None) -> np.ndarray:
        """A hash of each word's bytes, of which there are two kinds; `table` maps bytes first."""
        out, i = np.zeros(len(self), dtype=np.uint64), 0
        code = _BYTE[which] if table is None else _BYTE[which][table]
        while i < len(self):
            lo = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, lo + BLOCK, "right")))
            out[i:j] = rolled(code[self.data[lo : self.ends[j - 1]]], self.starts[i:j] - lo, self.ends[i:j] - lo, _BASE[which])
            i = j
        for k in np.flatnonzero(self.ends - self.starts > LONG_WORD).tolist():
            word = self.data[self.starts[k] : self.ends[k]]
            out[k] = xxhash.xxh64_intdigest((word if table is None else table[word]).tobytes(), seed=which)
        with np.errstate(over="ignore"):
            return mix(out + (self.ends - self.starts).astype(np.uint64))

    def grams(self, hashes: np.ndarray, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that begin n words of one text, and the hash of those n words."""
        at = np.flatnonzero(np.arange(len(self)) + n <= self.first[1:][self.doc]) if len(self) else np.zeros(0, dtype=np.int64)
        out, i = np.zeros(len(at), dtype=np.uint64), 0
        while i < len(at):
            j = int(np.searchsorted(at, at[i] + BLOCK - n, "right"))
            lo = at[i]
            out[i:j] = rolled(hashes[lo : at[j - 1] + n], at[i:j] - lo, at[i:j] - lo + n, _BASE[2 + which])
            i = j
        return at, mix(out)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Per text, the number of set bytes."""
        total = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def doc_sums(self, per_word: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def chars(self) -> np.ndarray:
        """Code points of each word."""
        total = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80, dtype=np.int64)])
        return total[self.ends] - total[self.starts]


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n positions lie in [start, start + width) of some start."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, Words]]:
    """First row, row behind the last, and Words, for slices of a string column; a text is never cut."""
    data, offsets = text_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1))
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
