"""Quality classifier: hierarchical empirical Bayes.

Two things are judged, low quality and toxicity.  A text's own evidence comes from a
logistic model over its shape (symbols, capitals, repeated words ...) and over words whose
share among labelled rows differs clearly.  Evidence of all documents is then gathered by
host and by path under it: a host's rate is shrunk to the global rate and a path's to its
host's, the more the fewer documents it has, with strengths estimated from the spread
between groups (method of moments).  A document's posterior joins its own evidence with its
path's rate, from which its own share is taken out first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.shipping import map_arrow

from .common import checkpoint, wide_hash
from .words import Words, mix, slices

#: Labelled rows that the text model is fitted on, at most; those with the smallest hashes of doc_id.
SAMPLE = 20_000
#: Beginnings of words, in bytes, that count as words of their own kind.
PREFIXES = (4, 5, 6, 8)
#: A word counts as evidence from so many labelled documents and standard deviations on.
LEAST_DOCS, LEAST_Z = 12, 6.0
EDGES = [0.0, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.75]
TARGETS = ("low", "toxic")
REJECT = 0.5
KEY = ["doc_id", "h1", "h2"]
#: Groups of host and path that are broadcast at most, about 100 bytes each; beyond it each goes to SALTS places.
BROADCAST, SALTS = 100_000, 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ONE = {k: np.isin(np.arange(256), list(v)) for k, v in {"symbol": b"#*$%&|<>", "upper": bytes(range(65, 91)), "letter": bytes([*range(65, 91), *range(97, 123), *range(128, 256)]), "digit": bytes(range(48, 58)), "shout": b"!?", "stop": b".,;:"}.items()}
_PUNCTUATION = np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))


def word_keys(w: Words) -> np.ndarray:
    """64-bit hashes of each word, a row for the whole and one for each length of its beginning.

    A-Z are lower-cased and punctuation at the ends is left out; a short word has its own key again.
    """
    starts, ends = w.starts.copy(), w.ends.copy()
    for _ in range(3):
        ends -= (ends - starts > 1) & _PUNCTUATION[w.data[ends - 1]]
        starts += (ends - starts > 1) & _PUNCTUATION[w.data[starts]]
    bare = object.__new__(Words)
    bare.data, bare.offsets, bare.starts, bare.ends, bare.first, bare.doc = w.data, w.offsets, starts, ends, w.first, w.doc
    rows = [bare.hashes(table=_LOWER)]
    for k in PREFIXES:
        bare.ends = np.minimum(ends, starts + k)
        rows.append(np.where(ends - starts > k, mix(bare.hashes(table=_LOWER) ^ np.uint64(k)), rows[0]))
    return np.stack(rows)


def distinct(w: Words, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and key of each pair that occurs."""
    doc, key = np.broadcast_to(w.doc, keys.shape).ravel(), keys.ravel()
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return doc[new], key[new]


class Lexicon:
    """Keys that count as evidence and a row of weights for each target."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[:, order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys (flat) are listed, and as which.  16 bits rule most out; the whole key decides."""
        may = np.zeros(1 << 16, dtype=bool)
        may[self.keys & np.uint64(0xFFFF)] = True
        at = np.flatnonzero(may[keys & np.uint64(0xFFFF)])
        which = np.searchsorted(self.keys, keys[at])
        same = self.keys[np.minimum(which, len(self.keys) - 1)] == keys[at] if len(self.keys) else np.zeros(0, dtype=bool)
        return at[same], which[same]


def shape(w: Words, keys: np.ndarray) -> np.ndarray:
    """Bins of a text's shape, one-hot."""
    n = np.diff(w.first)
    chars = np.maximum(w.sums(w.word), 1)
    letters = np.maximum(w.sums(_ONE["letter"][w.data]), 1)
    kinds = np.bincount(distinct(w, keys[:1])[0], minlength=len(n))
    values = [w.sums(_ONE[k][w.data]) / (letters if k == "upper" else chars) for k in ("symbol", "upper", "digit", "shout", "stop")]
    values += [1 - kinds / np.maximum(n, 1), np.minimum(n / 400, 1), np.minimum(chars / np.maximum(n, 1) / 16, 1)]
    out = np.zeros((len(n), len(values) * len(EDGES)))
    for i, v in enumerate(values):
        out[np.arange(len(n)), i * len(EDGES) + np.searchsorted(EDGES, v, "right") - 1] = 1
    return out


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each key, and those of them with each label, by slice."""
    for batch in batches:
        labels = np.stack([batch.column(t).to_numpy(zero_copy_only=False) for t in TARGETS], axis=1).astype(np.int64)
        for i, _, w in slices(batch.column("text")):
            doc, key = distinct(w, word_keys(w))
            one, of = np.unique(key, return_inverse=True)
            counts = [np.bincount(of, minlength=len(one)), *[np.bincount(of, weights=labels[i:][doc][:, k], minlength=len(one)).astype(np.int64) for k in range(len(TARGETS))]]
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), *[pa.array(c) for c in counts]], names=["key", "n", *TARGETS])


def features(w: Words, lexicon: Lexicon) -> np.ndarray:
    """Shape, and for each target the evidence of the text's distinct listed words, as sum and as strongest."""
    keys = word_keys(w)
    out = [shape(w, keys)]
    at, which = lexicon.find(keys.ravel())
    size = max(1, len(lexicon.keys))
    seen = np.unique(w.doc.astype(np.int64)[at % max(1, len(w))] * size + which)
    for row in lexicon.weights:
        total, top = np.zeros(len(w.first) - 1), np.zeros(len(w.first) - 1)
        np.add.at(total, seen // size, row[seen % size])
        np.maximum.at(top, seen // size, row[seen % size])
        out.append(np.stack([np.clip(total, -6, 6), top], axis=1))
    return np.concatenate(out, axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic model by Newton's method; the last is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Lexicon, np.ndarray]:
    """Word weights and logistic weights (a row for each target).

    labels: doc_id, quality, toxic; rows without them don't count, and with none of either
    kind the model falls back to a flat one.  A labelled doc_id counts once, with the text of least hash
    should several rows have it, so the sample is bounded.  Only listed words and weights reach the driver.
    """
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    chosen = known.groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("low"), F.max("toxic").cast("int").alias("toxic")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *TARGETS).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = checkpoint(rows.select("text", *TARGETS))
    total = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TARGETS]).first()
    rates = [(total[t] + 0.5) / (total["n"] + 1) for t in TARGETS]
    counted = map_arrow(rows, _counts, "key long, n long, " + ", ".join(f"{t} long" for t in TARGETS)).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)])
    far = [F.abs(F.col(t) - F.col("n") * rate) >= LEAST_Z * F.sqrt(F.col("n") * rate * (1 - rate)) for t, rate in zip(TARGETS, rates, strict=True)]
    listed = counted.filter(F.col("n") >= LEAST_DOCS).filter(far[0] | far[1]).collect()
    n, values = np.array([r["n"] for r in listed], dtype=float), []
    for t, rate in zip(TARGETS, rates, strict=True):
        hits = np.array([r[t] for r in listed], dtype=float)
        own = np.clip((hits + rate) / (n + 1), 1e-3, 1 - 1e-3)
        values.append(np.where(np.abs(hits - n * rate) >= LEAST_Z * np.sqrt(n * rate * (1 - rate)), np.log(own / (1 - own)) - np.log(rate / (1 - rate)), 0))
    lexicon = Lexicon(np.array([r["key"] for r in listed], dtype=np.int64).view(np.uint64), np.stack(values))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in slices(batch.column("text")):
                x = features(w, lexicon).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([lists, *[batch.column(t).slice(i, j - i) for t in TARGETS]], names=["x", *TARGETS])

    # the sample is bounded, so its feature rows (270 bytes each) fit one task, and the driver gets the weights alone
    made = map_arrow(rows, run, "x array<float>, " + ", ".join(f"{t} int" for t in TARGETS))
    fitted = map_arrow(made.repartition(1), _fitted, "target string, weights array<double>").collect()
    weights = {r["target"]: r["weights"] for r in fitted}
    flat = [0.0] * (8 * len(EDGES) + 2 * len(TARGETS)) + [-3.0]
    return lexicon, np.array([weights.get(t, flat) for t in TARGETS])


def _fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Logistic weights for each target that has rows of both kinds, from all feature rows."""
    held = [(b.column("x").flatten().to_numpy().reshape(len(b), -1), np.stack([b.column(t).to_numpy() for t in TARGETS], axis=1)) for b in batches if len(b)]
    if held:
        x, y = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        # rows come in no fixed order; sums over sorted rows are the same in every run
        order = np.lexsort(np.concatenate([y, x], axis=1).T)
        x, y = x[order].astype(float), y[order].astype(float)
        out = [(t, logistic(x, y[:, k]).tolist()) for k, t in enumerate(TARGETS) if 0 < y[:, k].sum() < len(y)]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([w for _, w in out], pa.list_(pa.float64()))], names=["target", "weights"])


def evidence(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray, host: Column, path: Column) -> DataFrame:
    """KEY, host, path, and logit_low and logit_toxic of each row of docs by its text alone."""
    carried = [*KEY, "host", "path"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in slices(batch.column("text")):
                logits = np.clip(features(w, lexicon) @ weights[:, :-1].T + weights[:, -1], -12, 12)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in carried], *[pa.array(np.round(logits[:, k], 6)) for k in range(len(TARGETS))]], names=[*carried, *[f"logit_{t}" for t in TARGETS]])

    h1, h2 = wide_hash(F.coalesce("text", F.lit("")))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), "text", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    return map_arrow(named, run, "doc_id long, h1 long, h2 long, host string, path string, " + ", ".join(f"logit_{t} double" for t in TARGETS))


def _strength(groups: DataFrame, mean: Column, n: Column, about: Column, parent_n: Column, parents: int, rate: float) -> float:
    """Documents that the level above counts as, from how far groups spread about its mean beyond chance.

    With k groups under `parents` means, chance alone spreads them by (k - parents) times the
    variance within; the rest is the variance between, times sum n - sum n * n / parent_n.
    """
    var = max(rate * (1 - rate), 1e-6)
    r = groups.agg(F.sum(n * (mean - about) ** 2).alias("spread"), F.sum(n - n * n / parent_n).alias("free"), F.count("*").alias("k")).first()
    if not r["k"] or r["k"] <= parents or r["free"] <= 0:
        return 1000.0
    between = (r["spread"] - (r["k"] - parents) * var) / r["free"]
    return float(np.clip(var / between - 1, 10.0, 1000.0)) if between > 0 else 1000.0


def _spread(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows joined to their group by host and path: by broadcast while groups are few, else salted, since one may hold a third of all rows."""
    if groups.count() <= BROADCAST:
        return rows.join(F.broadcast(groups), ["host", "path"])
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.col("h1"), F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "salt"]).drop("salt")


def _judged(docs: DataFrame, labels: DataFrame, host: Column | None, path: Column | None, sample: int) -> DataFrame:
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", "source", "lang") if path is None else path
    lexicon, weights = fit(docs, labels, sample)
    rows = checkpoint(evidence(docs, lexicon, weights, host, path))
    p = lambda c: 1 / (1 + F.exp(-F.col(c)))
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(F.round(p(f"logit_{t}"), 9).cast("decimal(28,9)")).cast("double").alias(f"sum_{t}") for t in TARGETS])
    paths = checkpoint(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.round(F.sum(f"sum_{t}"), 6).alias(f"host_sum_{t}") for t in TARGETS])
    groups = checkpoint(paths.join(hosts, "host"))
    whole = hosts.agg(F.sum("host_n").alias("n"), F.count("*").alias("hosts"), *[F.sum(f"host_sum_{t}").alias(t) for t in TARGETS]).first()
    joined = _spread(rows, groups)
    out = [*KEY, "host", "path"]
    bad = F.lit(False)
    logit = lambda c: F.log(c / (1 - c))
    for t in TARGETS:
        rate = float(np.clip((whole[t] or 0) / max(1, whole["n"] or 0), 1e-4, 1 - 1e-4))
        of = F.col(f"host_sum_{t}") / F.col("host_n")
        k_host = _strength(hosts, of, F.col("host_n"), F.lit(rate), F.lit(max(1, whole["n"] or 0)), 1, rate)
        k_path = _strength(groups, F.col(f"sum_{t}") / F.col("n"), F.col("n"), of, F.col("host_n"), whole["hosts"], rate)
        own = p(f"logit_{t}")
        of_host = (F.col(f"host_sum_{t}") - own + k_host * rate) / (F.col("host_n") - 1 + k_host)
        of_path = (F.col(f"sum_{t}") - own + k_path * F.col(f"host_{t}")) / (F.col("n") - 1 + k_path)
        joined = joined.withColumn(f"p_{t}", own).withColumn(f"host_{t}", F.least(F.greatest(of_host, F.lit(1e-4)), F.lit(1 - 1e-4)))
        joined = joined.withColumn(f"path_{t}", F.least(F.greatest(of_path, F.lit(1e-4)), F.lit(1 - 1e-4)))
        joined = joined.withColumn(f"joint_{t}", 1 / (1 + F.exp(-(F.col(f"logit_{t}") - float(np.log(rate / (1 - rate))) + logit(F.col(f"path_{t}"))))))
        out += [f"{k}_{t}" for k in ("p", "host", "path", "joint")]
        bad = bad | (F.col(f"joint_{t}") > REJECT)
    return joined.withColumn("rejected", bad).select(*out, "rejected")


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, host, path; for low and toxic the text's own, host's, path's and joint probability; rejected.

    docs: doc_id, text, source, lang.  The host is the source and the path its part in one
    language, unless given.  Null text is judged as empty, null hosts and paths form a group; every row
    of docs gives a row, rows with one doc_id too.  A row is rejected if either joint probability exceeds REJECT.
    """
    return _judged(docs, labels, host, path, sample).drop("h1", "h2")


def accepted(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """Rows of docs that aren't rejected; all columns stay, and so do rows without doc_id.

    A row goes by its doc_id and text, so of rows with one doc_id only those with a rejected text go.
    """
    gone = _judged(docs, labels, host, path, sample).filter("rejected").select(*[F.col(c).alias(f"gone_{c}") for c in KEY]).distinct()
    h1, h2 = wide_hash(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, (docs["doc_id"].cast("long") == F.col("gone_doc_id")) & (h1 == F.col("gone_h1")) & (h2 == F.col("gone_h2")), "left_anti").select(*docs.columns)
