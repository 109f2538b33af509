"""The fitted language model on small text, votes by it, metrics with empty groups, schemas and uploads."""

import hashlib
import io
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators import evaluate, languages, requests
from quire.plans import language
from quire.sources import files, uploads

DATA = "/root/testdata/sf0.001"


def test_scores_are_the_smoothed_shares(spark):
    rows = [("a", "aba ab"), ("a", "abab"), ("b", "bcb"), ("b", "Bc, bc!"), (None, "zzz"), ("a", None)]
    known, langs = languages.fit(spark.createDataFrame(rows, "lang string, text string"))
    counts = {"a": Counter(), "b": Counter()}
    for lang, text in rows:
        if lang and text:
            t = f" {''.join(c for c in text.lower() if c.isalpha() or c == ' ')} "
            counts[lang].update(t[i : i + 3] for i in range(len(t) - 2))
    kinds = len(set().union(*counts.values()))
    want = {(g, lang): (n, round(math.log((n + 1) / (sum(c.values()) + kinds)) * 1e6)) for lang, c in counts.items() for g, n in c.items()}
    assert {(r.gram, r.lang): (r.n, r.micro) for r in known.collect()} == want
    asked = spark.createDataFrame([(1, "abab"), (2, "bc"), (3, ""), (4, "𝔘𝔘𝔘"), (5, "q")], "id long, clean string")
    got = {r.id: r for r in languages.scored(asked, (known, langs), ["id"]).collect()}
    assert got[1].lang == "a" and got[2].lang == "b" and 3 not in got and got[4].grams == 3 and got[5].p == 0.5 and got[1].p > 0.5


@pytest.mark.parametrize("limit", [languages.BROADCAST, 0])
def test_held_out_documents_are_named_right(spark, monkeypatch, limit):
    monkeypatch.setattr(languages, "BROADCAST", limit)
    rows = language.language_accuracy(spark, DATA).filter("held_out").agg(F.sum("n"), F.sum("right")).first()
    assert rows[0] > 10 and rows[1] >= 0.9 * rows[0]


def test_vote_by_the_model(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("lang is not null and length(text) > 400").select("doc_id", "lang", F.left("text", F.lit(1200)).alias("text")).limit(60)
    model = languages.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    codes = {r.lang: f"x-{r.lang}" for r in model[1].collect()}
    said = languages.with_language(docs, model, ["doc_id"], codes).collect()
    named = [r for r in said if r.language]
    assert len(said) == docs.count() and len(named) > 30 and sum(r.language == f"x-{r.lang}" for r in named) >= 0.9 * len(named)
    none = languages.with_language(docs, model, ["doc_id"], {}).filter("language <> ''")
    assert none.count() == 0


def test_vision_schema_is_strict(spark):
    flags = lambda names, **other: "{" + ", ".join(f'"{n}": {other.get(n, "false")}' for n in names) + "}"
    made = lambda content=flags(requests.FLAGS["content"]), defects=flags(requests.FLAGS["defects"]), more="", script="cjk": f'{{"capture": "fax", "legibility": "clean", "handwriting": "none", "script": "{script}", "content": {content}, "defects": {defects}{more}}}'
    bad = [made(more=', "x": 1'), made(script="runic"), made(content=flags(requests.FLAGS["content"][1:])), made(content=flags([*requests.FLAGS["content"], "x"])), made(defects=flags(requests.FLAGS["defects"], photocopy='"yes"')), made(content=flags(requests.FLAGS["content"], math="null")), "[]", "{}", "no", None]
    got = spark.createDataFrame([(t,) for t in [made(), *bad]], "t string").select(requests.vision_facts(F.col("t")).alias("v")).collect()
    assert [r.v is not None for r in got] == [True] + [False] * len(bad) and got[0].v.content["math"] is False


def test_metrics_at_grains_fill_empty_groups(spark):
    rows = [("g", "s", "L1", "L1", ["L1"], 10, 5), ("g", None, "L2", "L2", ["L1"], 20, 7), (None, "s", "LH", "L1", ["L2"], 30, 0)]
    df = spark.createDataFrame(rows, "grp string, split string, lane string, candidate string, gt array<string>, latency_ms long, cost_micro long")
    got = {(r.grain, r.value): r for r in evaluate.at_grains(df, spark.createDataFrame([("group", "h"), ("group", "g")], "grain string, value string")).collect()}
    assert set(got) == {("all", "*"), ("group", "g"), ("split", "s"), ("group", "h")} and got["group", "h"].n == 0 and got["group", "h"].accuracy is None
    assert (got["all", "*"].n, got["group", "g"].n, got["split", "s"].n) == (3, 2, 2) and got["group", "g"].accuracy == 0.5 and got["split", "s"].review_rate == 0.5 and got["group", "g"].over == 1
    assert evaluate.at_grains(df.filter("false")).count() == 0


class Counted(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.given = 0

    def read(self, n=-1):
        out = super().read(n)
        self.given += len(out)
        return out


def test_uploads_stop_at_the_limit(spark, tmp_path):
    large = Counted(bytes(10_000))
    assert uploads.taken(large, 1000, 64)[1:] == (None, None, 413) and large.given <= 1000 + 64
    assert uploads.taken(io.BytesIO(b""), 0) == (0, hashlib.sha256(b"").hexdigest(), b"", 202)
    (tmp_path / "in" / ".hidden").mkdir(parents=True)
    for name, data in (("a.txt", b"abc"), ("b.gz", b"x" * 11), (".hidden/c", b"no"), (".d", b"no"), ("e", b"y" * 10)):
        (tmp_path / "in" / name).write_bytes(data)
    got = {r.name.rsplit("/", 1)[-1]: (r.sha, r.content and bytes(r.content), r.status) for r in uploads.uploads(spark, str(tmp_path / "in"), 10).collect()}
    assert got == {"a.txt": (hashlib.sha256(b"abc").hexdigest(), b"abc", 202), "b.gz": (None, None, 413), "e": (hashlib.sha256(b"y" * 10).hexdigest(), b"y" * 10, 202)}


def test_reports_say_what_they_leave_out(spark):
    rows = spark.range(7)
    assert "4 more rows" in files.report(rows, "t", 3) and "more" not in files.report(rows, "t", 7)
    sections = rows.selectExpr("cast(id as string) name", "concat('<b>', id, '</b>') content")
    assert "5 more aren't shown" in files.html_page(sections, "t", 2) and "more" not in files.html_page(sections, "t", 7)
