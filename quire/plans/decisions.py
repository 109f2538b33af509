"""Named queries on evidence sentences, the state that answers are asked on, and the whole route of a page, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import evidence, text
from quire.operators import pages, route

Spark = SparkSession
_KEYS = ["doc_id", "page"]
#: A calibration with curves for two lanes.
CALIBRATION = {"pooled": [(0.05, 0.1), (0.2, 0.4), (0.4, 0.4), (0.7, 0.9), (0.95, 1.0)], "lanes": {"L1": [(0.1, 0.2), (0.6, 0.95)], "L3": [(0.2, 0.3), (0.3, 0.3), (0.5, 0.8)]}, "threshold": 0.5}
PRODUCERS = ("ABBYY FineReader 15", "LaTeX", "Tesseract 5.3", "Writer")
#: Scripted measures: what the id and the page are multiplied with, and the modulus.
IMAGE = {"sharpness": (37, 11, 2000), "contrast": (7, 3, 60), "border_mean": (13, 5, 120), "border_std": (3, 1, 40), "background": (11, 7, 60), "colour": (5, 2, 20), "noise": (1, 1, 4), "bilevel": (9, 4, 100)}


def _made(a: int, b: int, n: int) -> Column:
    return (F.col("doc_id") * a + F.col("page") * b) % n


def _measures() -> dict[str, Column]:
    m = {k: _made(*v) for k, v in IMAGE.items()}
    return m | {"border_mean": m["border_mean"] + 140, "background": m["background"] + 190, "bilevel": m["bilevel"] / 100.0}


def _pick(values: tuple, by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _pages(spark: Spark, d: str) -> DataFrame:
    """Pages with what their probes gave: kind, coverage, hidden text, producer, fonts, columns by layout and by text."""
    i = F.col("doc_id")
    facts = {
        "kind": F.when(i % 5 == 0, "image").otherwise("pdf"),
        "coverage": _made(13, 7, 100) / 100.0,
        "hidden": _made(1, 1, 4) == 0,
        "producer": _pick(PRODUCERS, i),
        "math_font": i % 9 == 0,
        "mono_font": i % 8 == 0,
        "layout_columns": F.when(i % 6 == 0, 2).when(i % 6 == 1, 1),
        "pdf_columns": F.when(i % 4 == 0, 2).when(i % 4 == 1, 1),
    }
    return pages.explode_pages(pages.documents(spark, d)).withColumns(facts)


def image_sentence(spark: Spark, d: str) -> DataFrame:
    m = _measures()
    return _pages(spark, d).select(*_KEYS, evidence.describe_image(m["sharpness"], m["contrast"], m["border_mean"], m["border_std"], m["background"], m["colour"], m["noise"], m["bilevel"]).alias("said"))


def _structure() -> Column:
    return evidence.describe_structure(F.col("kind") == "pdf", F.col("coverage"), F.col("hidden"), F.col("producer"), F.col("math_font"), F.col("mono_font"), F.col("chars"), F.col("math_share"), F.when(F.col("layout_columns").isNull(), F.col("pdf_columns")))


def structure_sentence(spark: Spark, d: str) -> DataFrame:
    return pages.measured(_pages(spark, d)).select(*_KEYS, _structure().alias("said"))


def _agreement() -> Column:
    return F.when((F.col("kind") == "pdf") & (_made(1, 2, 3) > 0), _made(17, 29, 100) / 100.0)


def agreement_sentence(spark: Spark, d: str) -> DataFrame:
    return _pages(spark, d).select(*_KEYS, evidence.describe_agreement(_agreement()).alias("said"))


def _layer() -> Column:
    reading = evidence.reads(F.lit(""), F.when(F.col("chars") >= 20, F.lit(0.9)), F.col("lang"))
    said = evidence.describe_text("Embedded text layer", F.col("chars"), reading, F.col("cid_share"), F.col("odd_char_share"), F.col("short_token_share"), F.col("math_share"), F.lit("latin"), F.lit(""))
    return F.when(F.col("kind") == "pdf", said)


def state_assembly(spark: Spark, d: str) -> DataFrame:
    """All that a page's answers are asked on: its evidence, a sample of its text, the vision check, the end of the page before."""
    m = _measures()
    p = pages.measured(_pages(spark, d)).withColumn("previous", F.lag("text").over(Window.partitionBy("doc_id").orderBy("page")))
    image = evidence.describe_image(m["sharpness"], m["contrast"], m["border_mean"], m["border_std"], m["background"], m["colour"], m["noise"], m["bilevel"])
    vision = F.when(_made(1, 1, 2) == 0, evidence.describe_vision(F.lit("fax"), F.lit("clean"), F.lit("none"), F.array(F.lit("photocopy"), F.lit("curved_page")), F.array(F.lit("form")), F.lit("latin")))
    state = evidence.state(F.col("kind") == "pdf", [_structure(), image, _layer(), evidence.describe_agreement(_agreement())], F.col("text"), vision, F.col("previous"))
    return p.select(*_KEYS, state.alias("s")).select(*_KEYS, "s.*")


def probe_facts(spark: Spark, d: str) -> DataFrame:
    """What a live view is shown of a probed page: never its text."""
    m = _measures()
    p = pages.measured(_pages(spark, d))
    trusted = (F.col("kind") == "pdf") & (F.col("chars") > 50) & ~(F.col("hidden") & (F.col("coverage") > 0.9))
    columns = route.layout_columns(F.col("layout_columns"), F.col("pdf_columns"), F.col("kind") == "pdf")
    return p.select(*_KEYS, trusted.alias("trusted"), _structure().alias("evidence"), m["sharpness"].alias("sharpness"), columns.alias("columns"))


ERRORS = {"probe_error": (7, 1, 41, "TimeoutError"), "ocr_error": (1, 1, 5, "RuntimeError"), "vision_error": (1, 2, 17, "vision 400: bad image"), "answer_error": (1, 3, 23, "jev 422: no")}


def _attempted(spark: Spark, d: str) -> DataFrame:
    """Answered pages with the errors of their stages and what else routing needs."""
    a = pages.answered(spark, d)
    i = F.col("doc_id")
    more = {k: F.when(_made(x, y, n) == 0, said) for k, (x, y, n, said) in ERRORS.items()}
    more |= {"kind": F.when(i % 5 == 0, "image").otherwise("pdf"), "columns": F.when(i % 3 == 0, 2).otherwise(1), "text_script": _pick(("latin", "arabic", "cjk", "other"), i)}
    a = a.withColumns(more).withColumn("trusted", F.col("trusted") & (F.col("kind") == "pdf"))
    return a.withColumns({"needs_ocr": (F.col("kind") == "pdf") & (F.col("chars") > 0), "vision_script": F.when(~F.col("trusted") & F.col("vision_error").isNull(), _pick(("cyrillic", "latin", "hebrew"), i))})


def _out(r: DataFrame) -> DataFrame:
    return r.select(*_KEYS, "lane", "candidate", "path_p", "confidence", F.array_join("modifiers", ",").alias("modifiers"), F.array_join("reasons", "; ").alias("reasons"))


def routed_pages(spark: Spark, d: str) -> DataFrame:
    return _out(route.decided(_attempted(spark, d), CALIBRATION))


def routed_pages_raw(spark: Spark, d: str) -> DataFrame:
    """Without a calibration, or with one fitted on another basis."""
    return _out(route.decided(_attempted(spark, d), None, raw=0.35))


def stage_totals(spark: Spark, d: str) -> DataFrame:
    """Stage times kept with a page, and its latency: their sum for pages without a total."""
    p = _pages(spark, d)
    stages = {"probe": _made(3, 1, 50), "ocr": F.when(F.col("page") % 2 == 0, _made(5, 1, 900)), "vision": F.when(F.col("doc_id") % 3 == 0, _made(7, 3, 5000))}
    timed = route.timings(stages, F.when(F.col("doc_id") % 4 > 0, _made(11, 5, 6000)))
    return p.select(*_KEYS, F.size(timed).alias("stages"), route.latency(timed).alias("latency_ms"))


def first_wording(spark: Spark, d: str) -> DataFrame:
    """The text sentence in the wording of the first evidence version: by frequent English words."""
    p = pages.measured(pages.explode_pages(pages.documents(spark, d)))
    share = text.common_share(F.col("text"), ("the", "of", "and", "to", "in", "a", "is", "for"))
    reads = F.when(share >= 0.3, "reads as normal English prose").when(share >= 0.1, "partly readable: names, numbers, fragments, or a non-English language").otherwise("few recognisable English words")
    said = evidence.describe_text("OCR text", F.col("chars"), reads, F.col("cid_share"), F.col("odd_char_share"), F.col("short_token_share"), F.lit(0.0), F.lit("latin"), F.lit(""))
    return p.select(*_KEYS, said.alias("said"))


QUERIES = {f.__name__: f for f in (image_sentence, structure_sentence, agreement_sentence, state_assembly, probe_facts, routed_pages, routed_pages_raw, stage_totals, first_wording)}


def _sql(a: int, b: int, n: int) -> str:
    return f"((doc_id * {a} + page * {b}) % {n})"


def _curve(points: list, p: str) -> str:
    between = "".join(f" WHEN {p} < {x2} THEN {y1}::DOUBLE + ({p} - {x1}::DOUBLE) / ({x2}::DOUBLE - {x1}::DOUBLE) * ({y2}::DOUBLE - {y1}::DOUBLE)" for (x1, y1), (x2, y2) in zip(points, points[1:]))
    return f"CASE WHEN {p} <= {points[0][0]} THEN {points[0][1]}::DOUBLE{between} ELSE {points[-1][1]}::DOUBLE END"


def oracles(pages_sql: str, measured_sql: str, answered_sql: str, reasons_sql: str, two_places) -> dict[str, str]:
    m = {k: _sql(*v) for k, v in IMAGE.items()}
    image = f"""'Page image: ' || concat_ws(', ', CASE WHEN {m['sharpness']} < 300 THEN 'very soft or blurry' WHEN {m['sharpness']} < 1500 THEN 'somewhat soft' ELSE 'sharp' END, CASE WHEN {m['contrast']} < 25 THEN 'low contrast' ELSE 'normal contrast' END,
        CASE WHEN {m['border_mean']} + 140 < 200 THEN 'dark or coloured surroundings at the page edges, as when a page is photographed on a surface' WHEN {m['border_std']} > 20 THEN 'uneven or speckled page edges' ELSE 'clean white page edges' END,
        CASE WHEN {m['background']} + 190 < 235 THEN 'grey or tinted paper background' ELSE 'white paper background' END, CASE WHEN {m['colour']} > 15 THEN 'colourful' WHEN {m['colour']} > 3 THEN 'some colour' ELSE 'greyscale' END,
        CASE WHEN {m['noise']} >= 2 THEN 'visible pixel noise' END, CASE WHEN {m['bilevel']} > 95 AND {m['contrast']} < 30 THEN 'almost only pure black and pure white pixels' END) || '.'"""
    cov, hid = f"{_sql(13, 7, 100)} / 100.0", f"{_sql(1, 1, 4)} = 0"
    layer_free = measured_sql.replace("FROM l)", "FROM p)")
    structure = f"""CASE WHEN doc_id % 5 = 0 THEN 'Input: an image file (JPEG) with no embedded text.' ELSE concat_ws(', ', 'Input: a one-page PDF', CASE WHEN {cov} > 0.9 THEN 'the page is one full-page image' WHEN {cov} > 0.3 THEN 'images cover a large part of the page' ELSE 'little or no image content' END,
        CASE WHEN {hid} AND {cov} > 0.9 THEN 'its text layer is hidden behind or under the page image, typical of an earlier OCR pass' END, CASE doc_id % 4 WHEN 0 THEN 'made by scanning or OCR software (ABBYY)' WHEN 2 THEN 'made by scanning or OCR software (Tesseract)' END,
        CASE WHEN doc_id % 9 = 0 THEN 'uses mathematical fonts' WHEN chars > 0 AND math_share < 0.008 THEN 'no mathematical fonts or symbols' END, CASE WHEN doc_id % 8 = 0 THEN 'uses monospaced fonts' END,
        CASE WHEN doc_id % 6 > 1 THEN CASE doc_id % 4 WHEN 0 THEN 'text is laid out in two or more columns' WHEN 1 THEN 'text is in a single column' END END) || '.' END"""
    agree = f"CASE WHEN doc_id % 5 <> 0 AND {_sql(1, 2, 3)} > 0 THEN CASE WHEN {_sql(17, 29, 100)} >= 50 THEN 'The embedded text layer and a fresh OCR pass mostly agree.' WHEN {_sql(17, 29, 100)} >= 20 THEN 'The embedded text layer and a fresh OCR pass partly agree.' ELSE 'The embedded text layer and a fresh OCR pass mostly disagree, so the layer is probably not a faithful copy of the page.' END END"
    flags = "CASE WHEN cid_share > 0.05 THEN 'contains encoding codes like (cid:NN)' END, CASE WHEN odd_char_share > 0.05 THEN 'many unusual or private-use symbols' END, CASE WHEN short_token_share > 0.35 THEN 'many one-letter fragments' END"
    amount = "CASE WHEN chars < 100 THEN 'only a few words' WHEN chars < 500 THEN 'a short amount of text' ELSE 'a full page of text' END"
    layer = f"""CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN chars = 0 THEN 'Embedded text layer: none.' ELSE 'Embedded text layer: ' || concat_ws(', ', {amount}, CASE WHEN chars < 20 THEN 'mostly numbers and symbols' ELSE 'reads as ' || lang || ' text' END, {flags},
        CASE WHEN math_share >= 0.008 THEN 'frequent mathematical symbols or operators' END, 'mostly Latin letters') || '.' END END"""
    vision = "Vision check of the page image: capture looks like a fax; legibility: every character is easy to read; defects that make characters harder to read: curved or warped paper; handwriting: no handwriting; contains form; main script latin."
    err = {k: f"{_sql(a, b, n)} = 0" for k, (a, b, n, _) in ERRORS.items()}
    said = {k: v[3] for k, v in ERRORS.items()}
    curve = "CASE candidate " + " ".join(f"WHEN '{k}' THEN {_curve(v, 'path_p')}" for k, v in CALIBRATION["lanes"].items()) + f" ELSE {_curve(CALIBRATION['pooled'], 'path_p')} END"
    mods = """list_sort(list_distinct(list_filter([CASE WHEN has_table >= 0.5 THEN 'table' END, CASE WHEN has_math >= 0.5 THEN 'math' END, CASE WHEN has_code >= 0.5 THEN 'code' END, CASE WHEN is_form >= 0.5 THEN 'form' END, CASE WHEN candidate <> 'L5' AND has_handwriting >= 0.5 THEN 'handwriting' END,
        CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 = 0 THEN 'multi_column' END, CASE WHEN script IN ('cjk', 'arabic', 'hebrew', 'cyrillic', 'greek') THEN 'script_' || script END, CASE WHEN script IN ('arabic', 'hebrew') THEN 'rtl' END], lambda q: q IS NOT NULL)))"""

    def routed(p: str, low: str, why: str) -> str:
        # the scripted answers follow the trust of the text alone; a page of an image file is never trusted beyond that
        return f"""WITH {answered_sql}, t0 AS (SELECT *, trusted AND doc_id % 5 <> 0 AS trust2 FROM r),
            t1 AS (SELECT *, CASE WHEN NOT trust2 AND NOT ({err['vision_error']}) THEN ['cyrillic', 'latin', 'hebrew'][doc_id % 3 + 1] ELSE ['latin', 'arabic', 'cjk', 'other'][doc_id % 4 + 1] END AS script, {p} AS conf, {reasons_sql} AS why0 FROM t0),
            t2 AS (SELECT *, CASE WHEN {err['probe_error']} THEN 'LQ' WHEN NOT trust2 AND {err['vision_error']} THEN 'LH' WHEN {err['answer_error']} THEN 'LH' END AS stop,
                CASE WHEN {err['probe_error']} THEN 'probe_failed: {said['probe_error']}' WHEN NOT trust2 AND {err['vision_error']} THEN 'vision_unavailable: {said['vision_error']}' WHEN {err['answer_error']} THEN 'jev_rejected: {said['answer_error']}' END AS stop_why FROM t1)
            SELECT doc_id, page, CASE WHEN stop IS NOT NULL THEN stop WHEN {low} THEN 'LH' ELSE candidate END AS lane, coalesce(stop, candidate) AS candidate, CASE WHEN stop IS NULL THEN round(path_p, 4) ELSE 1 END::DOUBLE AS path_p, CASE WHEN stop IS NULL THEN round(conf, 4) END AS confidence,
                CASE WHEN stop IS NULL THEN array_to_string({mods}, ',') ELSE '' END AS modifiers,
                CASE WHEN stop IS NULL THEN concat_ws('; ', why0, CASE WHEN {low} THEN {why} END, CASE WHEN NOT trust2 AND doc_id % 5 <> 0 AND chars > 0 AND {err['ocr_error']} THEN 'ocr_failed: {said['ocr_error']}' END) ELSE stop_why END AS reasons FROM t2"""

    total = f"CASE WHEN doc_id % 4 > 0 THEN {_sql(11, 5, 6000)} END"
    words = "'the', 'of', 'and', 'to', 'in', 'a', 'is', 'for'"
    return {
        "image_sentence": f"WITH {pages_sql} SELECT doc_id, page, {image} AS said FROM p",
        "structure_sentence": f"WITH {layer_free} SELECT doc_id, page, {structure} AS said FROM m",
        "agreement_sentence": f"WITH {pages_sql} SELECT doc_id, page, {agree} AS said FROM p",
        "state_assembly": f"""WITH {layer_free} SELECT doc_id, page, concat_ws(' ', {structure}, {image}, {layer}, {agree}) AS page_evidence, CASE WHEN doc_id % 5 <> 0 THEN left(text, 1200) END AS embedded_text_sample,
            CASE WHEN {_sql(1, 1, 2)} = 0 THEN '{vision}' END AS vision_check, CASE WHEN before <> '' THEN right(before, 600) END AS previous_page_text_sample FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY page) AS before FROM m)""",
        "probe_facts": f"""WITH {layer_free} SELECT doc_id, page, doc_id % 5 <> 0 AND chars > 50 AND NOT ({hid} AND {cov} > 0.9) AS trusted, {structure} AS evidence, {m['sharpness']} AS sharpness,
            CASE WHEN doc_id % 5 <> 0 THEN coalesce(CASE doc_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 END, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 END) END AS columns FROM m""",
        "routed_pages": routed(curve, f"conf < {CALIBRATION['threshold']}", f"'low confidence (calibrated ' || {two_places('conf')} || ' < 0.50)'"),
        "routed_pages_raw": routed("NULL::DOUBLE", "path_p < 0.35::DOUBLE", f"'low confidence (path ' || {two_places('path_p')} || ' < 0.35)'"),
        "stage_totals": f"""WITH {pages_sql}, q AS (SELECT doc_id, page, {_sql(3, 1, 50)} AS a, CASE WHEN page % 2 = 0 THEN {_sql(5, 1, 900)} END AS b, CASE WHEN doc_id % 3 = 0 THEN {_sql(7, 3, 5000)} END AS c, {total} AS t FROM p)
            SELECT doc_id, page, 1 + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (t IS NOT NULL)::INT AS stages, coalesce(t, a + coalesce(b, 0) + coalesce(c, 0)) AS latency_ms FROM q""",
        "first_wording": f"""WITH {layer_free}, w AS (SELECT *, len(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda w: w IN ({words}))) / greatest(len(regexp_extract_all(lower(text), '[a-z'']+')), 1) AS share FROM m)
            SELECT doc_id, page, CASE WHEN chars = 0 THEN 'OCR text: none.' ELSE 'OCR text: ' || concat_ws(', ', {amount}, CASE WHEN share >= 0.3 THEN 'reads as normal English prose' WHEN share >= 0.1 THEN 'partly readable: names, numbers, fragments, or a non-English language' ELSE 'few recognisable English words' END, {flags}, 'mostly Latin letters') || '.' END AS said FROM w""",
    }
