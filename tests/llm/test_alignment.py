"""Cross-tokenizer alignment against plain interval overlaps on the libraries' own output."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import alignment, queries

PATHS = f"{alignment.folder()}/byte_bpe_50k.json", f"{alignment.folder()}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def texts():
    rng = random.Random(4)
    words = ["the", "Über", "naïve", "don't", "1234", "x" * 300, "日本語", "<|endoftext|>", "</s>", "🙂👍", "\tq", "foo\nbar", "é", "\x00", "it's--", "ﬁ", "ẞɐ", "<0x41>", "…"]
    out = [None, "", " ", "  ", "a", " lead", "trail ", "two  blanks", "three   blanks", "x \n y", "x\n  \ny", "\n", "mark ▁ in", "▁", "a  b", "q" * 30_000, "word " * 8000, "\x1c z", "a \x85b", "�"]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return out + [out[30]] * 5


def brute(made, libraries):
    """Expected columns of each text."""
    a, b = libraries
    t = alignment.tokenizers(PATHS)
    per, counts = [], Counter()
    for text in made:
        if not text:
            per.append(None)
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        want = (" " + text).encode()
        if b"".join(t.a_raw[i] for i in x) != want or b"".join(t.b_raw[i] for i in y) != want:
            per.append(None)
            continue
        ends = [np.cumsum([len(raw[i]) for i in ids]).tolist() for ids, raw in ((x, t.a_raw), (y, t.b_raw))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links, k = [], 0
        starts = [[0, *e[:-1]] for e in ends]
        for i in range(len(x)):
            while k and starts[1][k] >= starts[0][i]:
                k -= 1
            j = k
            while j < len(y) and starts[1][j] < ends[0][i]:
                if ends[1][j] > starts[0][i]:
                    links.append((x[i], y[j]))
                    k = j
                j += 1
        groups, i, j = [], 0, 0
        for c in cuts:
            i2, j2 = ends[0].index(c) + 1, ends[1].index(c) + 1
            groups.append(",".join(map(str, x[i:i2])) + "|" + ",".join(map(str, y[j:j2])))
            i, j = i2, j2
        counts.update(links)
        per.append((len(x), len(y), len(cuts), links, ";".join(groups)))
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [(0, 0, 0, 0, 0, 0, "") if p is None else (p[0], p[1], p[2], len(p[3]), sum(counts[k] == top[k[1]] for k in p[3]), sum(counts[k] for k in p[3]), hashlib.sha256(p[4].encode()).hexdigest()) for p in per]


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_against_overlaps(spark, libraries, hot):
    made = texts()
    if hot != 1 << 20:
        made = [t for t in made if t is None or len(t) < 1000]
    docs = spark.createDataFrame([(None if i == 3 else 5 if i < 8 else i, t, "row", 1) for i, t in enumerate(made)], "doc_id long, text string, pair string, n int").repartition(3)
    got = sorted(tuple(r) for r in alignment.align(docs, *PATHS, hot=hot).select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    want = sorted(brute(made, libraries))
    assert got == want and sum(w[0] == 0 for w in want) >= 4


def test_groups_and_empty(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    r = alignment.align(docs, *PATHS, groups=True).first()
    assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and r.groups.count(";") == r.n_groups - 1
    assert alignment.align(docs.filter("false"), *PATHS).count() == 0


def test_words_encode_as_in_their_text(libraries):
    t = alignment.Tokenizers(*PATHS)
    assert t.fast is not None
    made = [x for x in texts() if x]
    for text, got in zip(made, t.encode(made), strict=True):
        if got is not None:
            assert np.frombuffer(got[0], t.kind).tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
            assert np.frombuffer(got[1], t.kind).tolist() == libraries[1].encode(text)


def test_whole_table(spark, libraries):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_alignment(spark, "/root/testdata/sf0.001").collect()}
    for r, w in zip(rows, brute([r.text for r in rows], libraries), strict=True):
        g = got[r.doc_id]
        assert (g.n_a, g.n_b, g.n_groups, g.n_links, g.n_best, g.count_sum, g.groups_sha256) == w
