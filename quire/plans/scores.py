"""Named queries on evaluation, benchmark scores, building of sets, pictures and what people are shown, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import dataset, evaluate, lifecycle, pages, pictures, scoring, segments, shown

Spark = SparkSession
_KEYS = ["doc_id", "page"]


def _labels(spark: Spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic")


def eval_rows(spark: Spark, d: str) -> DataFrame:
    """Cases in their order with their page's lane, or why there is none: a page that its document doesn't have."""
    cases = _labels(spark, d).select(F.concat(F.lit("c"), "doc_id").alias("id"), "doc_id", (F.col("doc_id") % 4).cast("int").alias("page"), (1_000_000 - F.col("doc_id")).alias("ordinal"))
    return scoring.results(cases, pages.routed(spark, d).select(*_KEYS, "lane"))


def eval_paths(spark: Spark, d: str) -> DataFrame:
    """Where cases are routed: those with a text of their own never through the service, all others if there is one."""
    cases = _labels(spark, d).withColumns({"override": F.when(F.col("doc_id") % 9 == 0, "text"), "api": F.col("quality") == 1})
    return cases.groupBy(scoring.routed_by(F.col("override"), F.col("api")).alias("path")).agg(F.count("*").alias("n"))


def fit_basis(spark: Spark, d: str) -> DataFrame:
    """Whether results can be fitted on together: those of one basis, null being one of its own."""
    rows = _labels(spark, d).withColumn("basis", F.when(F.col("doc_id") % 2 == 0, "b1"))
    parts = [("even", rows.filter("doc_id % 2 = 0")), ("odd", rows.filter("doc_id % 2 = 1")), ("all", rows)]
    out = None
    for name, part in parts:
        one = evaluate.one_basis(part).withColumn("rows", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def calibration_version(spark: Spark, d: str) -> DataFrame:
    return evaluate.versioned(evaluate.curves(pages.cases(spark, d)), 10.0, "b1")


def transport_errors(spark: Spark, d: str) -> DataFrame:
    i = F.col("doc_id")
    status = F.element_at(F.array(*map(F.lit, ("200", "500", None, "404"))), (i % 4 + 1).cast("int"))
    bad = scoring.transport_error(F.when(i % 7 == 0, "timeout").when(i % 7 == 1, ""), status, F.when(i % 5 > 0, "{}"))
    return _labels(spark, d).select("doc_id", bad.alias("bad"))


def _vision(spark: Spark, d: str) -> DataFrame:
    """Two runs' answers of three systems on labelled pages, with the labels."""
    i, n = F.col("doc_id"), F.col("system")
    pick = lambda by, *values: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    rows = _labels(spark, d).withColumn("system", F.explode(F.array(*map(F.lit, (0, 1, 2))))).withColumn("run", F.explode(F.array(F.lit(1), F.lit(2))))
    said = i * (n + 2) + F.col("run") * (i % 3)
    return rows.select(
        "system", "run", i.alias("page_id"),
        F.struct(pick(said, "fax", "screenshot", "camera_photo").alias("capture"), pick(said, "clean", "mild_issues", "unsure").alias("legibility"), pick(said, "none", "annotations_only", "mostly_handwritten").alias("handwriting"), pick(said, "latin", "greek").alias("script"), F.create_map(F.lit("table"), said % 2 == 0, F.lit("math"), said % 3 == 0).alias("content")).alias("pred"),
        F.struct(F.when(i % 5 > 0, F.array(pick(i, "fax", "camera_photo"), F.lit("screenshot"))).alias("capture_ok"), pick(i, "clean", "degraded", None).alias("legibility"), pick(i, "none", "some", "mostly", None).alias("handwriting"), pick(i, "latin", None).alias("script"), F.create_map(F.lit("table"), F.when(i % 4 > 0, i % 2 == 0), F.lit("math"), F.when(i % 3 > 0, F.lit(True))).alias("content")).alias("label"),
    )


def page_scores(spark: Spark, d: str) -> DataFrame:
    v = _vision(spark, d)
    return scoring.page_scores(v).select("system", "run", "page_id", *scoring.AXES)


def ranked_systems(spark: Spark, d: str) -> DataFrame:
    """Systems by composite, those whose answers never came apart."""
    return scoring.ranked(scoring.page_scores(_vision(spark, d).filter("run = 1")), spark.createDataFrame([(0,), (1,), (2,), (3,)], "system int"))


def run_agreement_axes(spark: Spark, d: str) -> DataFrame:
    v = _vision(spark, d)
    return scoring.agreement_axes(v.filter("run = 1"), v.filter("run = 2"))


def evidence_sweep(spark: Spark, d: str) -> DataFrame:
    """Each model's runs on all cases, with its own answers in place of the vision check, and once without on trusted pages."""
    cases = _labels(spark, d).select("doc_id", (F.col("quality") == 1).alias("trusted"))
    models = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "model string")
    return scoring.sweep(models, cases).groupBy("system").agg(F.count("*").alias("n"), F.count_if("vision_used").alias("with_vision"))


def key_checks(spark: Spark, d: str) -> DataFrame:
    """Keys and ids of a catalogue that occur twice, and rows that are neither page nor variant."""
    i = F.col("doc_id")
    rows = pages.documents(spark, d).select(F.when(i % 5 > 0, F.concat(F.lit("k"), F.floor(i / F.when(i % 50 < 2, 2).otherwise(1)))).alias("key"), F.concat(F.lit("i"), i % 900).alias("id"), F.when(i % 10 == 0, F.concat(F.lit("k"), i + 1)).alias("of"))
    return dataset.catalogue_faults(rows)


def rubrics(spark: Spark, d: str) -> DataFrame:
    layer = F.element_at(F.array(*map(F.lit, ("trusted", "none", "ocr", "garbled"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return _labels(spark, d).select(F.col("doc_id").alias("key"), dataset.rubric(layer).alias("rubric"))


def current_opinions(spark: Spark, d: str) -> DataFrame:
    """Opinions that count, and faults: those under an earlier rubric don't count, unknown pages and codes are faults."""
    i = F.col("doc_id")
    o = _labels(spark, d).select(F.when(i % 11 == 0, -i).otherwise(i).alias("key"), F.when(i % 3 == 0, "capture").otherwise("layout").alias("rubric"), F.lit("a").alias("labeller"), F.when(i % 7 == 0, "odd").when(i % 3 == 0, "clean").otherwise("simple").alias("code"))
    now = _labels(spark, d).select(i.alias("key"), F.when(i % 2 == 0, "layout").otherwise("capture").alias("rubric"))
    return dataset.current(o, now).select("key", "rubric", "state")


def blind_batches(spark: Spark, d: str) -> DataFrame:
    """Pages of each rubric in batches of 50, shuffled, under ids that tell nothing."""
    p = _labels(spark, d).select(F.col("doc_id").cast("string").alias("key"), F.when(F.col("quality") == 1, "layout").otherwise("capture").alias("rubric"))
    return dataset.batches(p, secret="s1")


def spend_ledger(spark: Spark, d: str) -> DataFrame:
    return lifecycle.spend_ledger(lifecycle.job_events(spark, d), cap=1500)


def replay_merge(spark: Spark, d: str) -> DataFrame:
    """Two documents' replays, the second begun while the first runs, in order of time."""
    e = lifecycle.job_events(spark, d).filter("ms is not null").select("job", "id", (F.col("id") % 1000).alias("at"))
    return lifecycle.merged([(e.filter("job = 3"), 0), (e.filter("job = 5"), 400), (e.filter("job = 9"), 450)])


def picture_quality(spark: Spark, d: str) -> DataFrame:
    """Vectors as pictures of 17 by 16 in three colours."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    colour = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(271)), lambda i: F.floor((F.element_at("embedding", (i * a + b) % 64 + 1).cast("double") + 0.5) * 255))
    clipped = lambda c: F.transform(c, lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int"))
    p = e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 50 == 0, 19).otherwise(17).alias("width"), *[clipped(colour(a, b)).alias(n) for n, a, b in (("blue", 13, 0), ("green", 13, 5), ("red", 7, 3))])
    m = pictures.measured(p)
    return m.select("id", *[F.round(c, 4).alias(c) for c in m.columns[1:]])


def font_flags(spark: Spark, d: str) -> DataFrame:
    i = F.col("doc_id")
    names = F.array(F.element_at(F.array(*map(F.lit, ("ABCDEE+CMMI10", "Times", "courier-Bold", "cmmi10"))), (i % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("Arial", "DejaVuSansMono", "STIXGeneral"))), (i % 3 + 1).cast("int")))
    return pages.documents(spark, d).select("doc_id", pictures.fonts(names).alias("f")).select("doc_id", "f.*")


def object_bounds(spark: Spark, d: str) -> DataFrame:
    """Boxes inside none, one or two forms that turn, scale and move them."""
    i = F.col("doc_id").cast("double")
    box = F.struct((i % 7).alias("left"), (i % 5).alias("bottom"), (i % 7 + 10).alias("right"), (i % 5 + 4).alias("top"))
    form = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip("abcdef", v, strict=True)])
    forms = F.slice(F.array(form(0, 1, -1, 0, 5, 2), form(2, 0, 0, 0.5, -1, 3)), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    return pages.documents(spark, d).select("doc_id", pictures.page_bounds(box, forms).alias("b")).select("doc_id", "b.*")


def ocr_lines(spark: Spark, d: str) -> DataFrame:
    """Lines of first pages as a reading of them; every sixth page reads as nothing."""
    p = pages.explode_pages(pages.documents(spark, d)).filter("page = 0").select(F.col("doc_id").alias("page"), F.posexplode_outer(F.when(F.col("doc_id") % 6 > 0, F.split("text", "\n"))).alias("at", "text"))
    return pictures.read_lines(p.withColumn("confidence", (F.col("at") * 7 % 10 + 1) / 16)).select("page", F.md5("text").alias("text"), F.round("confidence", 9).alias("confidence"), "lines")


def document_view(spark: Spark, d: str) -> DataFrame:
    """What a report shows of a document: pages and their count by lane."""
    return segments.lane_counts(pages.routed(spark, d)).select("doc_id", "pages", F.array_join(F.transform("lanes", lambda x: F.concat_ws(":", x["lane"], x["n"])), " ").alias("lanes"))


def formatted(spark: Spark, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    i = F.col("event_id")
    small = F.when(i % 5 == 0, F.lit(0.0)).otherwise(F.col("value") / F.element_at(F.array(*map(F.lit, (1013.0, 101_323.0, 10_132_323.0))), (i % 3 + 1).cast("int")))
    return e.select(i.alias("id"), shown.ms(F.when(i % 9 > 0, i * i % 40_000)).alias("ms"), shown.usd(F.when(i % 8 > 0, small)).alias("usd"), shown.size(F.when(i % 7 > 0, i * i * 10)).alias("size"))


def metrics_page(spark: Spark, d: str) -> DataFrame:
    """Counters of ended jobs, running jobs, and a histogram of durations, as a metrics endpoint gives them."""
    return shown.exposition(lifecycle.job_events(spark, d))


QUERIES = {f.__name__: f for f in (eval_rows, eval_paths, fit_basis, calibration_version, transport_errors, page_scores, ranked_systems, run_agreement_axes, evidence_sweep, key_checks, rubrics, current_opinions, blind_batches, spend_ledger, replay_merge, picture_quality, font_flags, object_bounds, ocr_lines, document_view, formatted, metrics_page)}


def oracles(pages_sql: str, answered_sql: str, cases_sql: str, events_sql: str, isotonic_sql: str) -> dict[str, str]:
    said = "(doc_id * (system + 2) + run * (doc_id % 3))"
    vision = f"""v AS (SELECT system, run, doc_id AS page_id, ['fax', 'screenshot', 'camera_photo'][{said} % 3 + 1] AS capture, ['clean', 'mild_issues', 'unsure'][{said} % 3 + 1] AS legibility, ['none', 'annotations_only', 'mostly_handwritten'][{said} % 3 + 1] AS handwriting, ['latin', 'greek'][{said} % 2 + 1] AS script,
            {said} % 2 = 0 AS has_table, {said} % 3 = 0 AS has_math, CASE WHEN doc_id % 5 > 0 THEN [['fax', 'camera_photo'][doc_id % 2 + 1], 'screenshot'] END AS capture_ok, ['clean', 'degraded', NULL][doc_id % 3 + 1] AS legible, ['none', 'some', 'mostly', NULL][doc_id % 4 + 1] AS written, ['latin', NULL][doc_id % 2 + 1] AS of_script,
            CASE WHEN doc_id % 4 > 0 THEN doc_id % 2 = 0 END AS want_table, CASE WHEN doc_id % 3 > 0 THEN true END AS want_math FROM labels, (SELECT unnest([0, 1, 2]) AS system), (SELECT unnest([1, 2]) AS run)),
        sc AS (SELECT *, CASE WHEN capture_ok IS NOT NULL THEN list_contains(capture_ok, capture)::INT::DOUBLE END AS s_capture, CASE WHEN legible IS NOT NULL THEN coalesce(CASE legibility WHEN 'clean' THEN 'clean' WHEN 'mild_issues' THEN 'degraded' END = legible, false)::INT::DOUBLE END AS s_legibility,
            CASE WHEN written IS NOT NULL THEN (CASE handwriting WHEN 'none' THEN 'none' WHEN 'annotations_only' THEN 'some' ELSE 'mostly' END = written)::INT::DOUBLE END AS s_handwriting,
            CASE WHEN want_table IS NOT NULL OR want_math IS NOT NULL THEN (coalesce((has_table = want_table)::INT, 0) + coalesce((has_math = want_math)::INT, 0)) / ((want_table IS NOT NULL)::INT + (want_math IS NOT NULL)::INT)::DOUBLE END AS s_content,
            CASE WHEN of_script IS NOT NULL THEN (script = of_script)::INT::DOUBLE END AS s_script FROM v)"""
    mean = lambda test: "list_avg(list_filter([" + ", ".join(f"avg(s_{a}) FILTER ({test})" for a in scoring.COMPOSITE) + "], lambda q: q IS NOT NULL))"
    grey = "floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5)"
    colour = lambda a, c: f"greatest(0, least(255, floor((embedding[(i * {a} + {c}) % 64 + 1]::DOUBLE + 0.5) * 255)))"
    clamp = lambda v, hi: f"greatest(0, least({hi}, {v}))"
    mirror = lambda v, hi: f"CASE WHEN {v} < 0 THEN 1 WHEN {v} > {hi} THEN {hi} - 1 ELSE {v} END"
    return {
        "eval_rows": f"WITH {answered_sql}, k AS (SELECT 'c' || doc_id AS id, doc_id, (doc_id % 4)::INT AS page, 1000000 - doc_id AS ordinal FROM labels) SELECT ordinal, id, lane, CASE WHEN lane IS NULL THEN 'page ' || k.page || ' out of range' END AS error FROM k LEFT JOIN routed ON routed.doc_id = k.doc_id AND routed.page = k.page",
        "eval_paths": "SELECT CASE WHEN quality = 1 AND doc_id % 9 <> 0 THEN 'service' ELSE 'local' END AS path, count(*) AS n FROM labels GROUP BY 1",
        "fit_basis": "SELECT 'even' AS rows, 1::BIGINT AS bases, true AS fits UNION ALL SELECT 'odd', 1, true UNION ALL SELECT 'all', 2, false",
        "calibration_version": f"""{isotonic_sql.replace('SELECT curve, x, round(y, 4) AS y FROM z WHERE', ', kn AS (SELECT curve, x, round(y, 4) AS y FROM z WHERE')}), js AS (SELECT string_agg(k, ';' ORDER BY k) AS knots, count(DISTINCT curve) AS curves FROM (SELECT curve, curve || '|' || printf('%.4f', x) || '|' || printf('%.4f', y) AS k FROM kn))
            SELECT 'c2-' || left(sha256(knots || '#0.900000#b1'), 10) AS version, 0.9::DOUBLE AS threshold, curves, 'b1' AS basis FROM js""",
        "transport_errors": "SELECT doc_id, doc_id % 7 = 0 OR doc_id % 4 IN (1, 3) OR doc_id % 5 = 0 AS bad FROM labels",
        "page_scores": f"WITH {vision} SELECT system, run, page_id, " + ", ".join(f"s_{a} AS {a}" for a in scoring.AXES) + " FROM sc",
        "ranked_systems": f"WITH {vision}, m AS (SELECT system, round({mean('true')}, 9) AS composite FROM sc WHERE run = 1 GROUP BY system), a AS (SELECT unnest([0, 1, 2, 3]) AS system) SELECT a.system, composite, CASE WHEN composite IS NOT NULL THEN row_number() OVER (ORDER BY composite DESC NULLS LAST, a.system)::INT END AS place FROM a LEFT JOIN m USING (system)",
        "run_agreement_axes": f"""WITH {vision}, j AS (SELECT a.*, a.capture = b.capture AS e_capture, a.handwriting = b.handwriting AS e_handwriting, a.has_table = b.has_table AND a.has_math = b.has_math AS e_content, a.script = b.script AS e_script FROM sc a JOIN sc b ON a.system = b.system AND a.page_id = b.page_id AND a.run = 1 AND b.run = 2),
            k AS (SELECT *, e_capture AND e_handwriting AND e_content AND e_script AS every FROM j) SELECT system, count(*) AS pages, count(*) FILTER (NOT every) AS differ, {', '.join(f'round(avg(e_{a}::INT), 6) AS agree_{a}' for a in scoring.COMPOSITE)}, round({mean('every')}, 6) AS when_agree, round({mean('NOT every')}, 6) AS when_differ FROM k GROUP BY system""",
        "evidence_sweep": "SELECT m || s AS system, count(*) AS n, count(*) FILTER (s = '' OR quality <> 1) AS with_vision FROM labels, (VALUES ('m1'), ('m2'), ('m3')) models(m), (VALUES (''), ('_skiptrusted')) runs(s) GROUP BY 1",
        "key_checks": """WITH r AS (SELECT CASE WHEN doc_id % 5 > 0 THEN 'k' || floor(doc_id / CASE WHEN doc_id % 50 < 2 THEN 2 ELSE 1 END)::BIGINT END AS key, 'i' || doc_id % 900 AS id, CASE WHEN doc_id % 10 = 0 THEN 'k' || (doc_id + 1) END AS of FROM documents)
            SELECT 'repeated key' AS what, key AS value, count(*) AS n FROM r WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1 UNION ALL SELECT 'repeated id', id, count(*) FROM r GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'neither page nor variant', id, 1 FROM r WHERE (key IS NULL) = (of IS NULL)""",
        "rubrics": "SELECT doc_id AS key, CASE WHEN doc_id % 4 = 0 THEN 'layout' ELSE 'capture' END AS rubric FROM labels",
        "current_opinions": """WITH o AS (SELECT CASE WHEN doc_id % 11 = 0 THEN -doc_id ELSE doc_id END AS key, CASE WHEN doc_id % 3 = 0 THEN 'capture' ELSE 'layout' END AS rubric, doc_id % 7 = 0 AS odd FROM labels)
            SELECT key, rubric, CASE WHEN key NOT IN (SELECT doc_id FROM labels) THEN 'unknown page' WHEN odd THEN 'unknown code' WHEN rubric <> CASE WHEN key % 2 = 0 THEN 'layout' ELSE 'capture' END THEN 'moved' ELSE 'counts' END AS state FROM o""",
        "blind_batches": "WITH p AS (SELECT CASE WHEN quality = 1 THEN 'layout' ELSE 'capture' END AS rubric, sha256('s1:' || doc_id) AS h FROM labels) SELECT rubric, ceil(row_number() OVER (PARTITION BY rubric ORDER BY h) / 50)::INT AS batch, left(h, 12) AS image FROM p",
        "spend_ledger": f"WITH {events_sql} SELECT id, job, spent FROM (SELECT id, job, coalesce(sum(ms) OVER w, 0)::BIGINT AS spent, greatest(coalesce(max(ms) OVER w, 0) * 1.5, 20) AS dearest FROM e WHERE ms IS NOT NULL WINDOW w AS (PARTITION BY job ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE spent + dearest <= 1500",
        "replay_merge": f"WITH {events_sql} SELECT job, id, id % 1000 + CASE job WHEN 3 THEN 0 WHEN 5 THEN 400 ELSE 450 END AS at FROM e WHERE ms IS NOT NULL AND job IN (3, 5, 9)",
        "picture_quality": f"""WITH px AS (SELECT vec_id AS id, i // 17 AS y, i % 17 AS x, {colour(13, 0)} AS b, {colour(13, 5)} AS g, {colour(7, 3)} AS r FROM embeddings, (SELECT unnest(range(272)) AS i) WHERE vec_id % 50 <> 0),
            gr AS (SELECT id, y, x, {grey} AS v, CASE WHEN greatest(b, g, r) > 0 THEN floor(255 * (greatest(b, g, r) - least(b, g, r)) / greatest(b, g, r) + 0.5) ELSE 0 END AS sat FROM px),
            im AS (SELECT id, list(v ORDER BY y, x) AS a, avg(sat) AS colour FROM gr GROUP BY id),
            cell AS (SELECT id, a, y, x, a[y * 17 + x + 1] AS v, a[({mirror('y - 1', 15)}) * 17 + x + 1] + a[({mirror('y + 1', 15)}) * 17 + x + 1] + a[y * 17 + ({mirror('x - 1', 16)}) + 1] + a[y * 17 + ({mirror('x + 1', 16)}) + 1] - 4 * a[y * 17 + x + 1] AS lap,
                list_median(list_transform(range(9), lambda k: a[{clamp('y + k // 3 - 1', 15)} * 17 + {clamp('x + k % 3 - 1', 16)} + 1])) AS med, (y < 4)::INT + (y >= 12)::INT + (x < 4)::INT + (x >= 13)::INT AS edge FROM im, (SELECT unnest(range(16)) AS y), (SELECT unnest(range(17)) AS x)),
            ms AS (SELECT id, var_pop(lap) AS sharpness, stddev_pop(v) AS contrast, median(abs(v - med)) AS noise, avg((v <= 30 OR v >= 225)::INT) AS bilevel_share, quantile_cont(v, 0.9) AS background_mean, sum(v * edge) / sum(edge) AS border_mean, sqrt(greatest(0, sum(v * v * edge) / sum(edge) - (sum(v * edge) / sum(edge)) ** 2)) AS border_std FROM cell GROUP BY id)
            SELECT e.vec_id AS id, round(sharpness, 4) AS sharpness, round(contrast, 4) AS contrast, round(noise, 4) AS noise, round(bilevel_share, 4) AS bilevel_share, round(background_mean, 4) AS background_mean, round(border_mean, 4) AS border_mean, round(border_std, 4) AS border_std, round(colour, 4) AS colour
            FROM embeddings e LEFT JOIN ms ON ms.id = e.vec_id LEFT JOIN im ON im.id = e.vec_id""",
        "font_flags": "SELECT doc_id, doc_id % 4 = 0 OR doc_id % 3 = 2 AS math_font, doc_id % 4 = 2 OR doc_id % 3 = 1 AS mono_font FROM documents",
        "object_bounds": """WITH b AS (SELECT doc_id, (doc_id % 7)::DOUBLE AS l, (doc_id % 5)::DOUBLE AS o, doc_id % 7 + 10.0 AS r, doc_id % 5 + 4.0 AS t FROM documents), f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [l, o, r, t] ELSE [5 - t, l + 2, 5 - o, r + 2] END AS q FROM b)
            SELECT doc_id, (CASE WHEN doc_id % 3 = 2 THEN 2 * q[1] - 1 ELSE q[1] END)::DOUBLE AS "left", (CASE WHEN doc_id % 3 = 2 THEN 0.5 * q[2] + 3 ELSE q[2] END)::DOUBLE AS bottom, (CASE WHEN doc_id % 3 = 2 THEN 2 * q[3] - 1 ELSE q[3] END)::DOUBLE AS "right", (CASE WHEN doc_id % 3 = 2 THEN 0.5 * q[4] + 3 ELSE q[4] END)::DOUBLE AS top FROM f""",
        "ocr_lines": f"""WITH {pages_sql}, l AS (SELECT doc_id, CASE WHEN doc_id % 6 > 0 THEN string_split(text, chr(10)) ELSE [] END AS ls, text FROM p WHERE page = 0)
            SELECT doc_id AS page, md5(CASE WHEN len(ls) > 0 THEN text ELSE '' END) AS text, CASE WHEN len(ls) > 0 THEN round(list_avg(list_transform(range(len(ls)), lambda i: (i * 7 % 10 + 1) / 16)), 9) ELSE 0 END::DOUBLE AS confidence, len(ls)::INT AS lines FROM l""",
        "document_view": f"WITH {answered_sql}, k AS (SELECT doc_id, lane, count(*) AS n FROM routed GROUP BY ALL) SELECT doc_id, sum(n)::BIGINT AS pages, string_agg(lane || ':' || n, ' ' ORDER BY lane) AS lanes FROM k GROUP BY doc_id",
        "formatted": """WITH f AS (SELECT event_id AS id, CASE WHEN event_id % 9 > 0 THEN event_id * event_id % 40000 END AS m, CASE WHEN event_id % 8 > 0 THEN CASE WHEN event_id % 5 = 0 THEN 0 ELSE value / [1013, 101323, 10132323][event_id % 3 + 1] END END AS u, CASE WHEN event_id % 7 > 0 THEN event_id * event_id * 10 END AS b FROM events)
            SELECT id, CASE WHEN m IS NULL THEN '-' WHEN m < 1000 THEN m || ' ms' WHEN m < 10000 THEN ((m + 50) // 100) // 10 || '.' || ((m + 50) // 100) % 10 || ' s' ELSE (m + 500) // 1000 || ' s' END AS ms,
                CASE WHEN u IS NULL THEN '-' WHEN u = 0 THEN '$0' WHEN u < 0.0001 THEN '<$0.0001' WHEN u < 0.01 THEN '$' || printf('%.4f', u::DOUBLE) ELSE '$' || printf('%.3f', u::DOUBLE) END AS usd,
                CASE WHEN b IS NULL THEN '' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN floor(b / 1024 + 0.5)::BIGINT || ' KB' ELSE (b * 10 + 524288) // 1048576 // 10 || '.' || (b * 10 + 524288) // 1048576 % 10 || ' MB' END AS size FROM f""",
        "metrics_page": f"""WITH {events_sql}, c AS (SELECT count(*) FILTER (type = 'job.done') AS done, count(*) FILTER (type = 'job.retry') AS retry, count(*) FILTER (type = 'job.started') AS start, sum(ms)::BIGINT AS total, count(ms) AS n FROM e)
            SELECT 'jobs_total{{result="done"}}' AS metric, done AS value FROM c UNION ALL SELECT 'jobs_total{{result="error"}}', retry FROM c UNION ALL SELECT 'jobs_running', start - done - retry FROM c UNION ALL SELECT 'job_ms_sum', total FROM c UNION ALL SELECT 'job_ms_count', n FROM c
            UNION ALL SELECT 'job_ms_bucket{{le="' || b || '"}}', (SELECT count(*) FROM e WHERE ms <= b) FROM (VALUES (10), (25), (50), (75)) t(b) UNION ALL SELECT 'job_ms_bucket{{le="+Inf"}}', n FROM c""",
    }
