"""Queries on small tables that hold what larger ones do: rare cases, and sizes at which plans differ."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire.operators import intake
from quire.plans import oracles, queries
from quire.sources import files


def rows_of(folder, name):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in folder.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return sorted(c.execute(oracles.ORACLE_SQL[name]).fetchall(), key=str)


def same(spark, folder, name):
    want = rows_of(folder, name)
    assert sorted(map(tuple, queries.QUERIES[name](spark, str(folder)).collect()), key=str) == want
    return want


def documents(folder, texts, langs=None):
    n = len(texts)
    pq.write_table(pa.table({"doc_id": list(range(n)), "text": texts, "lang": langs or ["en"] * n, "source": ["web"] * n, "n_chars": [len(t or "") for t in texts]}), folder / "documents.parquet")


DAY = 86_400_000_000


def events(folder, rows):
    """rows: day, user, type."""
    at = 1_704_067_200_000_000
    pq.write_table(pa.table({"event_id": list(range(len(rows))), "ts": pa.array([at + int(day * DAY) for day, *_ in rows], pa.timestamp("us")), "user_id": [r[1] for r in rows], "event_type": [r[2] for r in rows], "value": [1.0] * len(rows), "props": ['{"k": 7}'] * len(rows)}), folder / "events.parquet")


def test_jobs_are_not_forgotten_after_a_long_pause_and_no_event_is_too_late(spark, tmp_path):
    pause = [(0, 1, "signup"), (0.1, 1, "view"), (0.2, 1, "error"), (0.3, 1, "view"), (0.4, 1, "click"), (0.5, 1, "purchase"), (9, 1, "click"), (20, 2, "signup")]
    late = [(1, 3, "signup"), (1.1, 3, "view"), (1.2, 3, "click"), (25, 2, "view"), (2, 4, "signup")]
    events(tmp_path, pause + late)
    want = same(spark, tmp_path, "job_states_live")
    assert (1, "done", 1, 2) in want and (3, "running", 0, 1) in want


def test_widths_at_a_tie_are_rounded_as_in_sql(spark, tmp_path):
    documents(tmp_path, ["word " * 7600])  # 32 pages: bars of 3.125 percent
    want = same(spark, tmp_path, "html_sections")
    assert "width:3.12%" in want[0][1] and want[0][1].count("<i ") == 32
    wide = spark.createDataFrame([("a", "L1 1", [{"lane": "L1", "width": w} for w in (100.0, 12345.675, 0.0, 0.375)])], "name string, lanes string, segments array<struct<lane:string,width:double>>")
    shown = files.html_report(wide).first()["content"]
    assert all(f"width:{w}%" in shown for w in ("100.00", "%.2f" % 12345.675, "0.00", "0.38"))


def test_a_character_at_the_end_of_what_is_looked_at(spark, tmp_path):
    documents(tmp_path, [("x" * (intake.HEAD - k) + "é€😀" * 9) if k else "short" for k in (1, 3, 2, 4, 5, 6, 7, 8)])  # each kind of container
    same(spark, tmp_path, "expanded_files")
    cut = b"x" * (intake.HEAD - 1)
    cases = [cut + "é".encode(), cut + b"\xc3", cut + b"\xc3x", cut + "😀".encode() + b"\xff", cut + b"\xff", cut + b"a\xff", cut]
    got = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, content binary").select("i", intake.looks_like_text(F.col("content")).alias("is")).orderBy("i").collect()
    assert [r["is"] for r in got] == [True, False, False, True, False, True, True]


def test_batches_that_run_over_many_chunks(spark, monkeypatch):
    from quire.operators import requests

    rows, at = [], 0
    for i in range(900):
        at += (i * 7919 % 97) ** 2 // 30 + (5000 if i % 211 == 0 else 0)
        rows.append((i, at, None if i % 3 == 0 else "ab"[i % 2]))
    rows += [(1000 + i, 5, "c") for i in range(30)]  # one time, and one in a chunk each below
    made = spark.createDataFrame(rows, "id long, at long, source string").repartition(3)

    def folded(size, wait):
        out, state = {}, {}
        for i, t, s in sorted(rows, key=lambda r: (r[1], r[0])):
            before, first, part, n, place = state.get(s, (t, t, 0, 0, size))
            part, n = (part + 1, 0) if t - before > wait else (part, n)
            new = n == 0 or place + 1 >= size or t - first > wait
            first, n, place = (t, n + 1, 0) if new else (first, n, place + 1)
            state[s] = t, first, part, n, place
            out[i] = ("/".join([*([s] if s else []), str(part), str(n)]), place)
        return out

    for chunk, size, wait in ((1, 4, 900), (7, 3, 400), (100, 4, 100), (50_000, 5, 900), (3, 1, 900)):
        monkeypatch.setattr(requests, "CHUNK", chunk)
        assert {r["id"]: (r["batch"], r["place"]) for r in requests.batches(made, size, wait).collect()} == folded(size, wait), (chunk, size, wait)


def test_draws_are_dealt_over_tasks_and_lists_of_values_agree_with_few(spark, monkeypatch):
    from quire.operators import evaluate

    rows = spark.createDataFrame([(i % 5,) for i in range(500)], "ok int")
    want = evaluate.bootstrap(rows, "ok", resamples=100).first()
    monkeypatch.setattr(evaluate, "FEW", 1)
    monkeypatch.setattr(evaluate, "DRAWS", 999)
    assert evaluate.bootstrap(rows, "ok", resamples=100).first() == want
    none = evaluate.bootstrap(rows.filter("ok > 9"), "ok").first()
    assert (none["low"], none["resamples"]) == (None, 0)


def test_trigrams_of_characters_beyond_the_basic_plane_and_models_that_are_not_sent(spark, tmp_path, monkeypatch):
    from quire.operators import languages

    documents(tmp_path, ["a𝒜b ñ́c", "", None, "x", "😀 𝒜𝒜𝒜 ab", "the cat  sat", "le chat", "!!"] * 4, ["en", "fr", "de", "en", "fr", "en", "fr", None] * 4)
    same(spark, tmp_path, "language_model")
    want = same(spark, tmp_path, "language_scores")
    monkeypatch.setattr(languages, "BROADCAST", 3)
    assert same(spark, tmp_path, "language_scores") == want


def test_boxes_are_sent_once_and_not_once_a_bin(spark):
    from quire.operators import layout

    boxes = spark.createDataFrame([(1, 2, "image", False, 0, 0, 50, 100, 100, 100), (1, 1, "text", False, 5, 5, 9, 9, 100, 100), (2, 1, "image", False, -5, 0, 200, 120, 100, 100), (3, 1, "image", False, 200, 9, 210, 9, 100, 100)], "page long, z int, kind string, invisible boolean, left int, bottom int, right int, top int, width int, height int")
    made, columns = layout.coverage(boxes), layout.profile_columns(boxes.select("page", "left", "right", "width", F.col("z").alias("size")))
    assert all("Generate" not in df._jdf.queryExecution().toString() for df in (made, columns))
    assert sorted(map(tuple, made.collect())) == [(1, 0.5, False), (2, 1.0, False), (3, 0.0, False)]
