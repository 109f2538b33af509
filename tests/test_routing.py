import io
import json
import random
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from quire.functions import evidence, policy, text
from quire.operators import answers, dataset, evaluate, intake, layout, pages, queue, segments
from quire.plans import oracles, queries
from quire.sources import files
from quire.streaming import jobs

DATA = "/root/testdata/sf0.001"


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].astype(float).round(6) if df[c].dtype.kind in "iufb" else df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in "part orders lineitem events documents embeddings pages benchmark labels".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = normal(queries.QUERIES[name](spark, DATA).toPandas()), normal(duck.sql(oracles.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) and got.equals(want)


def test_entry_has_every_query(spark):
    assert set(oracles.ORACLE_SQL) <= set(driver.queries()) and driver.entry(spark).count() == 8


@pytest.mark.parametrize(
    "answers, lane",
    [({"text_layer_trustworthy": 0.9}, "L1"), ({"text_layer_trustworthy": 0.9, "has_code": 0.5}, "L2"), ({}, "L3"), ({"capture_defects": 0.6}, "L4"), ({"mostly_handwritten": 0.7, "text_layer_trustworthy": 0.9}, "L5")],
)
def test_rule_table(spark, answers, lane):
    rules = policy.Rules(lambda k: F.lit(answers.get(k, 0.02)))
    row = spark.range(1).select(rules.lane().alias("l"), rules.path().alias("p"), F.size(rules.reasons()).alias("n")).first()
    assert row.l == lane and 0 < row.p <= 1 and row.n == (1 if lane == "L5" else 2)


def merged(pages):
    """Runs by a plain loop."""
    out, may = [], {"L1", "L2", "L3", "L4", "L5"}
    for i, (lane, c) in enumerate(pages):
        if out and (out[-1][2] == lane or (out[-1][2] in may and lane in may and (c or 0) >= 0.5)):
            out[-1][1], out[-1][2] = i, max(out[-1][2], lane)
        else:
            out.append([i, i, lane])
    return [tuple(r) for r in out]


def test_segments_random_and_hand_cases(spark):
    rng = random.Random(5)
    docs = {0: [("L2", 0.0), ("L1", 0.9), ("L1", 0.0)], 1: [("L2", 0.0), ("L1", 0.9), ("L2", 0.0)], 2: [("L2", None), ("LH", 0.95), ("LH", 0.0), ("L2", 0.95)]}
    docs |= {i: [(rng.choice(["L1", "L2", "L3", "L5", "LH", "L0"]), rng.choice([None, 0.2, 0.5, 0.9])) for _ in range(rng.randint(1, 12))] for i in range(3, 60)}
    rows = [(d, i, lane, c, ["b", "a"] if i else ["c"]) for d, ps in docs.items() for i, (lane, c) in enumerate(ps)]
    df = spark.createDataFrame(rows, "doc_id long, page int, lane string, continuation double, modifiers array<string>")
    got: dict = {}
    for r in segments.segments(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.stop, r.lane))
        assert r.modifiers == sorted(set(r.modifiers))
    assert {d: sorted(v) for d, v in got.items()} == {d: merged(ps) for d, ps in docs.items()}


def test_isotonic_toy_and_thresholds():
    x, edges = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], evaluate.lower_hull(np.ones(6), np.array([0, 1, 0, 1, 1, 1.0]))
    assert [(x[k], y) for lo, hi, y in edges for k in sorted({lo, hi})] == [(0.1, 0.0), (0.2, 0.5), (0.3, 0.5), (0.4, 1.0), (0.6, 1.0)]
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        w, ok = rng.integers(1, 6, n).astype(float), rng.integers(0, 4, n).astype(float)
        low = [max(min(ok[a : b + 1].sum() / w[a : b + 1].sum() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose([y for lo, hi, y in evaluate.lower_hull(w, ok) for _ in range(lo, hi + 1)], low)
    assert [evaluate.threshold(r) for r in (20, 4, 1)] == [0.95, 0.75, 0]
    with pytest.raises(ValueError):
        evaluate.threshold(0)


def test_interpolation_clamps(spark):
    knots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.1, 0.0), (0.2, 0.5), (0.3, 0.5), (0.4, 1.0), (0.6, 1.0))])
    ps = spark.createDataFrame([(p,) for p in (0.0, 0.25, 0.35, 0.9)], "p double")
    assert [round(r[0], 6) for r in ps.select(policy.interpolate(knots, F.col("p"))).collect()] == [0.0, 0.5, 0.75, 1.0]


def test_text_measures(spark):
    t = spark.createDataFrame([("a\x00\x01\x02b",), ("a b c d e",), ("x" * 40,), ("plain words read well",), ("日本語の文字",), ("",)], "t string")
    assert [r[0] for r in t.select(text.guard(F.col("t"))).collect()] == ["control or undefined characters", "many one-letter fragments", "words run together without spaces", "", "", ""]
    got = spark.createDataFrame([("x  y\n" + "w" * 90 + "\nshort",)], "t string").select(text.chunks(F.col("t"))).first()[0]
    assert got == ["x  y " + "w" * 90 + " short"]
    pair = spark.createDataFrame([("alpha beta", "beta gamma"), ("日本語", "本語"), ("a b", "x")], "a string, b string")
    assert [r[0] for r in pair.select(text.agreement(F.col("a"), F.col("b"))).collect()] == [0.333, 0.5, None]
    assert spark.range(1).select(evidence.coarse_count(F.lit(7), "table"), evidence.describe_agreement(F.lit(0.5))).first()[0] == "many tables"


def test_intake_expands_and_quarantines(spark):
    def packed(members):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
            for n, c in members.items():
                z.writestr(n, c)
        return b.getvalue()

    mail = b"From: a@b.c\r\nSubject: x\r\nMIME-Version: 1.0\r\nContent-Type: text/plain\r\n\r\nhello\r\n"
    nested = packed({"in.zip": packed({"deep.txt": b"deep"})})
    rows = [("a.zip", packed({"x.txt": b"one", "../evil.txt": b"no"})), ("b.zip", packed({"z": b"\0" * 15_000_000})), ("c.eml", mail), ("d.zip", nested), ("e.zip", b"PK\x03\x04broken"), ("f.bin", bytes(range(256)) * 4), ("g", b"%PDF-1.7"), ("h.html", b"<html></html>")]
    files_ = spark.createDataFrame(rows, "name string, content binary")
    got = {(r.name, r.quarantine) for r in intake.expand(files_).collect()}
    assert got == {("x.txt", None), ("b.zip", "archive_bomb"), ("c.eml#body.txt", None), ("deep.txt", None), ("e.zip", "corrupt"), ("f.bin", "unsupported_type"), ("g", None), ("h.html", None)}
    kinds = {r.name: (r.s.kind, r.s.mime) for r in files_.select("name", intake.sniff(F.col("content"), F.col("name")).alias("s")).collect()}
    assert kinds["g"] == ("pdf", "application/pdf") and kinds["f.bin"][0] == "unknown" and kinds["h.html"] == ("text", "text/html")


def test_sticky_split_is_balanced_and_sticky(spark):
    rows = [(i, f"s{i % 3}", 1, "holdout" if i < 6 else "") for i in range(90)]
    got = {r.doc_id: r.split for r in dataset.sticky_split(spark.createDataFrame(rows, "doc_id long, stratum string, weight long, fixed string")).collect()}
    assert all(got[i] == "holdout" for i in range(6)) and all(abs(sum((got[i] == "tune") * 2 - 1 for i in range(s, 90, 3))) <= 1 for s in range(3))


def test_sources_and_idempotent_sink(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "a\u0085b"}\nbroken\n\n{"id": 2, "t": "c"}\n')
    rows = files.json_lines(spark, str(tmp_path / "a.jsonl"), "id long, t string", skip_broken=True)
    assert sorted(r.id for r in rows.collect()) == [1, 2]
    with pytest.raises(Exception, match="broken line"):
        files.json_lines(spark, str(tmp_path / "a.jsonl"), "id long, t string").collect()
    out = str(tmp_path / "out")
    assert files.append_once(rows, out, ["id"]) == 2 and files.append_once(rows, out, ["id"]) == 0
    assert spark.read.parquet(out).count() == 2 and "| id |" in files.report(rows.select("id"), "ids")
    assert files.scan(spark, str(tmp_path)).filter("name like '%a.jsonl'").count() == 1
    sections = files.html_report(spark.sql("SELECT '<n>' AS name, 'L1:2' AS lanes, array(named_struct('lane', 'L1', 'width', 50.0D)) AS segments"))
    assert "&lt;n&gt;" in files.html_page(sections, "t") and "width:50.00%" in files.html_page(sections, "t")


def test_mails_and_zips_of_many_kinds(spark):
    hostile = [b"", b"\xff\xfe", b"Subject: x\r\nContent-Type: multipart/mixed\r\n\r\nno boundary", b"From: a\r\nContent-Type: text/plain; charset=nonsense\r\n\r\n\xe9", b"Content-Type: message/rfc822\r\n\r\n\r\n"]
    for data in hostile:
        try:
            assert all(isinstance(c, bytes) for _, c in intake.mail_children("m", data))
        except intake.Unusable:
            pass
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w") as z:
        for i in range(501):
            z.writestr(f"{i}.txt", b"x")
    for data, why in ((big.getvalue(), "too_many_children"), (b"PK\x05\x06" + b"\0" * 18, "empty"), (b"PK\x03\x04", "corrupt")):
        with pytest.raises(intake.Unusable, match=why):
            intake.archive_children(data)
    nul = spark.createDataFrame([("a", "x\u0000y".encode()), ("b", "héllo".encode()), ("c", b"\xe9"), ("d", "é".encode() * 40_000)], "name string, content binary")
    kinds = {r.name: r.kind for r in intake.typed(nul).collect()}
    assert kinds == {"a": "unknown", "b": "text", "c": "unknown", "d": "text"}


def test_long_documents_are_paged_in_linear_time(spark):
    import time

    docs = spark.sql("SELECT 1L AS doc_id, 's' AS source, 'en' AS lang, repeat('wörter 𝒳 ', 700000) AS text UNION ALL SELECT 2L, 's', 'en', NULL")
    began = time.time()
    got = pages.explode_pages(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("page").alias("last"), F.sum(F.length("text")).alias("chars")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 5250, 5249, 6_300_000), (2, 1, 0, 0)] and time.time() - began < 30


def test_running_totals_do_not_depend_on_ranges(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.randint(-5, 9)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, k string, v long")
    for largest in (False, True):
        want, held = {}, {}
        for i, k, v in rows:
            held[k] = (max(held.get(k, v), v) if largest else held.get(k, 0) + v)
            want[i] = held[k]
        for size in (1 << 16, 100, 7):
            assert {r.id: r.t for r in queue.running(frame, "k", "v", "t", largest=largest, size=size).collect()} == want


def test_streams_of_windows_and_sessions(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    batch = {(r.start, r.event_type): r.n for r in events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n").collect()}
    got = {(r.start, r.event_type): r.n for r in jobs.run_to_table(jobs.windowed(jobs.source(spark, DATA)), "windows", str(tmp_path / "w")).collect()}
    assert got and all(batch[k] == n for k, n in got.items())
    sessions = jobs.run_to_table(jobs.sessions(jobs.source(spark, DATA)), "sessions", str(tmp_path / "s"))
    assert 0 < sessions.agg(F.sum("n")).first()[0] <= events.count()


def test_streams_agree_with_batch(spark, tmp_path):
    got = jobs.run_to_table(jobs.job_states(jobs.source(spark, DATA)), "states", str(tmp_path / "c1"), "update").toPandas().groupby("job").last()
    want = queries.job_state(spark, DATA).toPandas().set_index("job")
    assert (got["retries"].sort_index() == want["retries"].sort_index()).all() and (got["pages"].sort_index() == want["pages"].sort_index()).all()
    n = jobs.run_to_table(jobs.first_seen(jobs.source(spark, DATA)), "seen", str(tmp_path / "c2")).count()
    assert n == spark.read.parquet(f"{DATA}/events.parquet").count()


OBJECTS = "page int, z int, kind string, invisible boolean, left double, bottom double, right double, top double, width double, height double"


def test_coverage_counts_overlaps_once_and_finds_hidden_text(spark):
    rows = [
        (1, 0, "text", False, 0.0, 0.0, 10.0, 10.0, 64.0, 64.0),
        (1, 1, "image", False, -5.0, -5.0, 99.0, 99.0, 64.0, 64.0),  # beyond the page, over the text
        (2, 0, "image", False, 0.0, 0.0, 63.0, 32.0, 64.0, 64.0),  # 63 cells in a row
        (2, 1, "image", False, 1.0, 0.0, 64.0, 32.0, 64.0, 64.0),
        (2, 2, "text", False, 0.0, 0.0, 1.0, 1.0, 64.0, 64.0),
        (3, 0, "text", True, 0.0, 0.0, 1.0, 1.0, 64.0, 64.0),
        (4, 0, "image", False, 5.0, 5.0, 5.0, 5.0, 64.0, 64.0),  # no area
        (4, 1, None, None, None, None, None, None, 64.0, 64.0),
    ]
    got = {r["page"]: (r["coverage"], bool(r["hidden"])) for r in layout.coverage(spark.createDataFrame(rows, OBJECTS)).collect()}
    assert got == {1: (1.0, True), 2: (0.5, False), 3: (0.0, True), 4: (0.0, False)}
    assert layout.coverage(spark.createDataFrame([], OBJECTS)).count() == 0


def test_columns_of_regions(spark):
    kind = "page int, label string, left double, top double, right double, bottom double, width double, height double"
    rows = [(1, "text", 0, 0, 40, 90), (1, "Text", 50, 0, 95, 90), (2, "text", 0, 0, 90, 20), (2, "text", 0, 30, 90, 60), (3, "equation", 0, 0, 90, 20), (4, "text", 0, 0, 10, 50), (5, None, 0, 0, 50, 50), (6, "text", 0, 0, 30, 50), (6, "text", 35, 0, 60, 50), (6, "text", 65, 20, 95, 70)]
    regions = spark.createDataFrame([(p, k, *map(float, box), 100.0, 100.0) for p, k, *box in rows], kind)
    assert {r["page"]: r["columns"] for r in layout.region_columns(regions).collect()} == {1: 2, 2: 1, 3: None, 4: None, 5: None, 6: 2}
    facts = {(r["page"], r["label"]): (r["n"], r["area"]) for r in layout.region_facts(regions).collect()}
    assert facts[3, "formula"] == (1, 0.18) and facts[1, "text"] == (2, 0.765) and facts[5, None] == (1, 0.25)


def test_first_valid_answer_and_its_cost(spark):
    rows = [(1, 0, "no", 5), (1, 1, '[{"code": "simple", "why": " a  b"}]', 7), (1, 2, '{"code": "complex", "why": "c"}', 9), (2, 0, None, 1), (2, 1, '[{"code": "simple"}, 1]', 2), (2, 2, '"simple"', 3)]
    a = spark.createDataFrame(rows, "key int, attempt int, content string, cost int")
    assert sorted(tuple(r) for r in answers.first_valid(a, ("simple", "complex")).collect()) == [(1, "simple", "a b", 12), (2, None, "", 6)]


def test_bootstrap_resamples_as_often_as_the_reference(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(40)], "id long, ok int")
    got = evaluate.bootstrap(rows, "ok").first()
    assert got.resamples == 1000 and 0.25 < got.low < 0.45 and 0.55 < got.high < 0.75
    assert evaluate.bootstrap(rows.repartition(3), "ok").first() == got


def test_commands(spark, tmp_path, capsys):
    from quire.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Some words to read.\n" * 20)
    (tmp_path / "in" / "b.bin").write_bytes(b"\x00\x01")
    main(["route", str(tmp_path / "in"), "--out", str(tmp_path / "out")])
    made = {json.loads(p.read_text())["doc"]["name"]: json.loads(p.read_text())["pages"][0]["lane"] for p in (tmp_path / "out").glob("*.json")}
    assert made == {"a.txt": "L0", "b.bin": "LQ"}
    main(["view", str(tmp_path / "out"), "--out", str(tmp_path / "view.html")])
    assert "a.txt" in (tmp_path / "view.html").read_text() and "width:100.00%" in (tmp_path / "view.html").read_text()
    main(["probe", str(tmp_path / "in" / "a.txt"), "--page", "0"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["evidence"].startswith("Text: a short amount of text")
    toy = [(0.1, "L3", ["L4"]), (0.2, "L1", ["L1"]), (0.3, "L1", ["L2"]), (0.4, "L2", ["L2"]), (0.5, "L3", ["L3", "L4"]), (0.6, "L5", ["L5"])]
    rows = [{"id": str(i), "grp": "pdf", "gt": gt, "lane": c, "candidate": c, "path_p": p, "basis": "b", "latency_ms": 10 * i, "cost_usd": 0.001} for i, (p, c, gt) in enumerate(toy)] + [{"id": "e", "error": "no"}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    main(["calibrate", str(tmp_path / "r.jsonl"), "--out", str(tmp_path / "c.json"), "--cost-ratio", "4", "--check"])
    made = json.loads((tmp_path / "c.json").read_text())
    assert made["pooled"] == [[0.1, 0.0], [0.2, 0.5], [0.3, 0.5], [0.4, 1.0], [0.6, 1.0]] and made["threshold"] == 0.75 and made["lanes"] == {} and made["basis"] == "b"
    assert evaluate.applicable(made, "b") is made and evaluate.applicable(made, "other") is None
    main(["evaluate", str(tmp_path / "r.jsonl"), "--out", str(tmp_path / "report.md")])
    assert "| pdf | 6 |" in (tmp_path / "report.md").read_text()


def test_settings(tmp_path):
    from quire import settings

    (tmp_path / "env").write_text("# QUIRE_MAX_PAGES=1\nQUIRE_MAX_PAGES = 7\nQUIRE_USE_CALIBRATION=no\nOTHER=1\n")
    got = settings.load({"QUIRE_REVIEW_THRESHOLD": "0.25"}, tmp_path / "env")
    assert (got.max_pages, got.use_calibration, got.review_threshold, got.max_depth) == (7, False, 0.25, 3)
    assert settings.load({"QUIRE_MAX_PAGES": "9"}, tmp_path / "env").max_pages == 9
    with pytest.raises(ValueError):
        settings.load({"QUIRE_USE_CALIBRATION": "maybe"}, None)
    assert [settings.ocr_backend(*a) for a in (("auto", "darwin", True), ("auto", "darwin", False), ("auto", "linux", True), ("rapid", "darwin", True))] == ["apple", "rapid", "rapid", "rapid"]
