"""What makes queries grow with their input beyond need: matches listed one by one, measures made more than once."""

from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import evaluate

TEXTS = ["", "plain words | a b (cid:7)(cid:12) x", "�͸ ☃ 😀", "α+β = 𝜋 ≤ 3", "漢字かな 한글 кот عربي été", "\x01\x02\t\n\x85  q", "x" * 30 + " y", "Đ ñ́ 𝒜b  a", "(cid:x) (cid:)"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_characters_are_those_of_matches_without_a_list_of_them(spark):
    t = F.col("t")
    frame = spark.createDataFrame([(x,) for x in [*TEXTS, None]], "t string")
    classes = (r"\p{Co}\p{Cn}\p{So}\x{FFFD}", r"\p{Sm}\x{0370}-\x{03FF}\x{1D400}-\x{1D7FF}", r"\p{L}", text.UNSPACED[1:-1], "|")
    for kind in classes:
        assert all(a == b for a, b in frame.select(F.regexp_count(t, F.lit(f"[{kind}]")), text.count_of(t, kind)).collect()), kind
    made = frame.select(text.cid_share(t).alias("cid"), text.math_share(t).alias("math"), text.garble_cid(t).alias("garbled"))
    want = frame.select(F.regexp_count(t, F.lit(r"\(cid:[0-9]+\)")) * 7 / F.greatest(F.length(t), F.lit(1)), F.regexp_count(t, F.lit(r"[\p{Sm}\x{0370}-\x{03FF}\x{1D400}-\x{1D7FF}]")) / F.greatest(F.regexp_count(t, F.lit(r"(?U)\S")), F.lit(1)), F.regexp_replace(t, "[A-Za-z]", "(cid:12)"))
    assert made.collect() == want.collect()
    measures = (text.cid_share, text.odd_char_share, text.math_share, text.guard, text.script_shares)
    assert "regexp_extract_all" not in plan(frame.select(*[m(t).alias(m.__name__) for m in measures]))


def test_units_are_made_once_a_side(spark):
    frame = spark.createDataFrame([("the cat 漢字かな", "the dog 漢字"), ("", "x"), ("one two", None), (None, "abc")], "a string, b string")
    made = frame.select(text.agreement(F.col("a"), F.col("b")).alias("p"))
    assert [r["p"] for r in made.collect()] == [0.333, None, None, None]
    assert plan(made).count("array_union") == 2


def test_curves_do_not_have_the_measures_made_once_more_for_a_filter(spark):
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(["L1", "L2", "L0", "LH"] * 40)], "t string, i int")
    lane = F.regexp_replace("t", "x", "")
    cases = rows.select(lane.alias("candidate"), (F.col("i") / 160).alias("path_p"), F.array(F.lit("L1")).alias("gt"))
    made = evaluate.curves(cases)
    assert plan(made).count("regexp_replace") == 1
    assert {r["curve"] for r in made.collect()} == {"*", "L1", "L2"}


def test_releases_are_made_and_read_in_parts(spark, monkeypatch):
    from quire.sources import files

    rows = [(f"r{i % 2}", f"d{i}.txt", bytes([i % 251]) * (i * 37 % 3000)) for i in range(300)] + [("r0", "é.txt", b""), ("r3", "one", b"x" * 512)]
    frame = spark.createDataFrame(rows, "release string, name string, content binary")
    monkeypatch.setattr(files, "PART", 20_000)
    parts = files.releases(frame)
    got = sorted(parts.collect())
    assert len(got) > 20 and max(len(r["content"]) for r in got) < 24_000
    for release in ("r0", "r1", "r3"):
        assert b"".join(bytes(r["content"]) for r in got if r["release"] == release) == files.packed("", [(n, c) for k, n, c in rows if k == release])
    named = parts.select(F.col("release").alias("name"), "content")
    assert sorted((r["archive"], r["member"], r["size"]) for r in files.tar_headers(named).collect()) == sorted((k, n, len(c)) for k, n, c in rows)
    assert sorted((r["archive"], r["member"], bytes(r["content"])) for r in files.tar_members(named, {"d7.txt", "one"}).collect()) == [("r1", "d7.txt", b"\x07" * 259), ("r3", "one", b"x" * 512)]
    sums = files.checksums(parts).collect()
    again = files.checksums(files.releases(frame.repartition(5).orderBy(F.desc("name")))).collect()
    other = files.checksums(files.releases(frame.withColumn("content", F.when(F.col("name") == "one", F.lit(b"y")).otherwise(F.col("content"))))).collect()
    assert sorted(sums) == sorted(again) and len(set(sums) - set(other)) == 1


def test_rows_of_files_go_on_in_pieces(spark, monkeypatch):
    from quire.operators import intake

    taken = []
    frame = spark.createDataFrame([(i,) for i in range(50)], "i long")
    monkeypatch.setattr(type(frame), "mapInPandas", lambda self, run, schema: taken.append(run) or self)
    monkeypatch.setattr(intake, "BATCH", 5000)
    intake._rows(frame, lambda r: [(r.i, b"x" * 900)], "i long, content binary")
    pieces = list(taken[0](iter([frame.toPandas()])))
    assert len(pieces) > 5 and [i for p in pieces for i in p["i"]] == list(range(50))


def test_zip_files_are_made_and_read_in_parts(spark, monkeypatch):
    import io
    import zipfile

    from quire.sources import files

    rows = [(f"r{i % 2}", f"d{i}.txt", bytes([i % 251]) * (i * 37 % 3000), i % 3 == 0) for i in range(300)] + [("r0", "é.txt", b"", False), ("r3", "one", b"x" * 512, True), (None, "none", b"n", False)]
    frame = spark.createDataFrame(rows, "archive string, name string, content binary, stored boolean")
    monkeypatch.setattr(files, "PART", 20_000)
    parts = files.zips(frame, f"file://{spark.conf.get('spark.checkpoint.dir')}/zips-{id(frame)}")
    got = sorted(parts.collect(), key=lambda r: (r["name"] or "", r["part"]))
    assert sum(r["part"] < files.DIRECTORY for r in got) > 15 and max(len(r["content"]) for r in got) < 24_000
    for archive in ("r0", "r1", "r3", None):
        whole = b"".join(bytes(r["content"]) for r in got if r["name"] == archive)
        with zipfile.ZipFile(io.BytesIO(whole)) as z:
            assert z.testzip() is None
            assert sorted((m.filename, z.read(m), m.compress_type == 0) for m in z.infolist()) == sorted((n, c, s) for k, n, c, s in rows if k == archive)
            assert sorted(r[:2] for r in files.central_directory(whole)) == sorted((m.filename, m.header_offset) for m in z.infolist())
    listed = files.zip_directory(parts)
    assert sorted((r["archive"] or "", r["member"], r["method"], r["size"]) for r in listed.collect()) == sorted((k or "", n, 0 if s else 8, len(c)) for k, n, c, s in rows)
    wanted = listed.filter("member rlike '[05].txt$|n' or member = 'é.txt'").select("archive", "member")
    cut = files.zip_members(parts, wanted.union(wanted)).collect()
    assert sorted((r["archive"] or "", r["member"], bytes(r["content"])) for r in cut) == sorted((k or "", n, c) for k, n, c, _ in rows if n[-5:] in ("0.txt", "5.txt") or "n" in n or n == "é.txt")


def test_zip_places_beyond_32_bits():
    import io
    import zipfile

    from quire.sources import files

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"aa")
        z.writestr("b", b"bbb")
    begin, size = files.directory_span(out.getvalue())
    records = out.getvalue()[begin : begin + size]
    far = 5 << 32
    moved, n = files._moved(records, far)
    assert n == 2 and [(r[2], r[3], r[6]) for r in files.directory_records(moved, 0, len(moved))] == [("a", far, 2), ("b", far + 33, 3)]
    assert files.directory_span(moved + files._zip_end(n, len(moved), far), far) == (far, len(moved))
    near, _ = files._moved(records, 7)
    assert len(near) == size and files.directory_span(files._zip_end(70_000, 9, 10)) == (10, 9)
