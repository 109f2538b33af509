"""Named queries on requests to external models, with their SQL; pages, events and labels stand for requests and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import pages, requests

Spark = SparkSession
_KEYS = ["doc_id", "page"]


def _pages(spark: Spark, d: str) -> DataFrame:
    return pages.explode_pages(pages.documents(spark, d))


def _events(spark: Spark, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("source"))


def question_sets(spark: Spark, d: str) -> DataFrame:
    p = _pages(spark, d).withColumn("previous", F.lag("text").over(Window.partitionBy("doc_id").orderBy("page")))
    return requests.asked(p).groupBy("question").agg(F.count("*").alias("pages"))


def question_info(spark: Spark, d: str) -> DataFrame:
    return requests.questions(spark)


def micro_batches(spark: Spark, d: str) -> DataFrame:
    """Batches of up to four requests of one type that come within four hours."""
    return requests.batches(_events(spark, d), 4, 14_400_000_000)


def batch_keys(spark: Spark, d: str) -> DataFrame:
    """Fields and instructions of batched pages; a page left alone in its batch is asked as without batching."""
    b = requests.batches(_events(spark, d), 3, 3_600_000_000)
    b = b.withColumn("alone", F.count("*").over(Window.partitionBy("batch")) == 1)
    told = F.lit("Compare `page_evidence` with `previous_page_text_sample`; `Not this`.")
    return b.select("id", requests.keyed(F.lit("page_evidence"), F.col("place"), F.col("alone")).alias("field"), requests.scoped(told, F.col("place"), F.col("alone")).alias("instructions"))


def parsed_answers(spark: Spark, d: str) -> DataFrame:
    """Responses with a probability and a score; some lack one, some aren't JSON."""
    l = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("id"))
    i = F.col("id")
    whole = F.format_string('{"model": "m", "answers": {"has_table": {"noul": %s}, "degradation": {"score": %s}}}', (i % 10).cast("string"), (i % 4).cast("string"))
    content = F.when(i % 5 == 0, F.lit('{"answers": {"has_table": {"noul": 0.5}}}')).when(i % 7 == 0, F.lit("no json")).otherwise(whole)
    wanted = l.withColumn("q", F.explode(F.array(F.struct(F.lit("has_table").alias("name"), F.lit("noul").alias("type")), F.struct(F.lit("degradation").alias("name"), F.lit("score").alias("type")))))
    a = requests.answers(l.select("id", content.alias("content")), wanted.select("id", "q.name", "q.type"))
    return a.select("id", "usable", F.element_at("answers", F.lit("has_table")).alias("has_table"), F.element_at("answers", F.lit("degradation")).alias("degradation"))


def vision_schema(spark: Spark, d: str) -> DataFrame:
    """Vision responses for labelled documents: whole ones, unknown codes and scripts, missing fields and flags, further keys, flags that are no booleans, lists instead of objects."""
    l = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("id"), F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("string").alias("flag"))
    i = F.col("id")
    code = F.when(i % 3 == 0, "fax").when(i % 3 == 1, "telex").otherwise("screenshot")
    others = lambda names: ", ".join(f'"{x}": false' for x in names)
    made = F.format_string(f'{{"capture": "%s", "legibility": "clean", "handwriting": "none", "script": "latin", "content": {{"table": %s, {others(requests.FLAGS["content"][1:])}}}, "defects": {{{others(requests.FLAGS["defects"])}}}}}', code, "flag")
    content = (
        F.when(i % 5 == 0, F.regexp_replace(made, '"script": "latin", ', ""))
        .when(i % 7 == 0, F.concat(F.lit("["), made, F.lit("]")))
        .when(i % 11 == 0, F.replace(made, F.lit('"latin"'), F.lit('"runes"')))
        .when(i % 13 == 0, F.replace(made, F.lit(', "photo": false'), F.lit("")))
        .when(i % 17 == 0, F.replace(made, F.lit('"capture"'), F.lit('"note": 1, "capture"')))
        .when(i % 19 == 0, F.replace(made, F.lit('"code": false'), F.lit('"code": "no"')))
        .when(i % 23 == 0, F.replace(made, F.lit('"photocopy"'), F.lit('"stain": true, "photocopy"')))
        .otherwise(made)
    )
    v = requests.vision_facts(content)
    return l.select("id", v["capture"].alias("capture"), v["content"]["table"].cast("string").alias("table_"))


def cache_hits(spark: Spark, d: str) -> DataFrame:
    """Requests of documents' pages: a third of the digests are stored, some of these with output that can't be used."""
    r = _pages(spark, d).select(*_KEYS, F.sha2("text", 256).alias("digest"))
    store = r.filter("doc_id % 3 = 0").groupBy("digest").agg(F.min("doc_id").alias("least")).select("digest", (F.col("least") % 2 == 0).alias("usable"))
    return requests.cached(r, store).select(*_KEYS, "found")


def error_classes(spark: Spark, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"))
    i = F.col("id")
    status = F.element_at(F.array(*map(F.lit, (200, 401, 402, 403, 404, 422, 429, 500, 503, None))), (i % 10 + 1).cast("int"))
    return e.select("id", requests.fault(status, F.when(i % 20 == 0, "error"), F.floor(i / 10) % 5).alias("fault"))


def retry_waits(spark: Spark, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_id < 300").select(F.col("event_id").alias("id"))
    return requests.waits(e.select("id", F.when(F.col("id") % 6 == 0, F.col("id") % 9).alias("retry_after"), (F.col("id") % 97 / 97).alias("jitter")), timeout_s=20)


def stored_decisions(spark: Spark, d: str) -> DataFrame:
    """Pages joined to the store of answers by digest."""
    p = _pages(spark, d).select(F.concat_ws("-", *_KEYS).alias("id"), "doc_id", F.md5("text").alias("digest"))
    store = p.filter("doc_id % 4 > 0").groupBy("digest").agg(F.min("doc_id").alias("i")).select("digest", F.explode(F.array(F.struct(F.lit("has_math").alias("question"), (F.col("i") % 8 / 8).alias("value")), F.struct(F.lit("has_code").alias("question"), F.lit(0.25).alias("value")))).alias("q")).select("digest", "q.*")
    a = requests.decided(p, store)
    return a.select("id", F.element_at("answers", F.lit("has_math")).alias("has_math"), F.size("answers").alias("n"))


QUERIES = {f.__name__: f for f in (question_sets, question_info, micro_batches, batch_keys, parsed_answers, vision_schema, cache_hits, error_classes, retry_waits, stored_decisions)}


def oracles(pages_sql: str) -> dict[str, str]:
    flat = [(name, group, kind) for group, names in requests.QUESTIONS.items() for name, kind in names.items()]
    fold = lambda size, wait: f"""e AS (SELECT event_id AS id, epoch_us(ts) AS at_us, event_type AS source FROM events),
        p0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY at_us, id) AS i, coalesce((at_us - lag(at_us) OVER (PARTITION BY source ORDER BY at_us, id) > {wait})::INT, 0) AS pause FROM e),
        p1 AS (SELECT *, sum(pause) OVER (PARTITION BY source ORDER BY i) AS part FROM p0), p2 AS (SELECT *, row_number() OVER (PARTITION BY source, part ORDER BY i) AS k FROM p1),
        b AS (SELECT id, source, part, k, at_us, at_us AS first, 1 AS n, 0 AS place FROM p2 WHERE k = 1 UNION ALL
            SELECT x.id, x.source, x.part, x.k, x.at_us, CASE WHEN new THEN x.at_us ELSE b.first END, CASE WHEN new THEN b.n + 1 ELSE b.n END, CASE WHEN new THEN 0 ELSE b.place + 1 END
            FROM b JOIN p2 x ON x.source = b.source AND x.part = b.part AND x.k = b.k + 1, LATERAL (SELECT b.place + 1 >= {size} OR x.at_us - b.first > {wait} AS new))"""  # noqa: E731
    return {
        "question_sets": f"WITH {pages_sql}, q(question, grp) AS (VALUES {', '.join(f"('{n}', '{g}')" for n, g, _ in flat)}), l AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY page) AS before FROM p) SELECT question, count(*) AS pages FROM l JOIN q ON grp <> 'continuation' OR coalesce(before, '') <> '' GROUP BY question",
        "question_info": f"SELECT * FROM (VALUES {', '.join(f"('{n}', '{g}', '{k}')" for n, g, k in flat)}) q(name, grp, type)",
        "micro_batches": f"WITH RECURSIVE {fold(4, 14400000000)} SELECT source, id, source || '/' || part || '/' || n AS batch, place FROM b",
        "batch_keys": f"""WITH RECURSIVE {fold(3, 3600000000)}, a AS (SELECT id, place, count(*) OVER (PARTITION BY source, part, n) = 1 AS alone FROM b)
            SELECT id, CASE WHEN alone THEN 'page_evidence' ELSE 'p' || place || '_page_evidence' END AS field, CASE WHEN alone THEN 'Compare `page_evidence` with `previous_page_text_sample`; `Not this`.'
                ELSE 'About page p' || place || ' only (the state fields that start with `p' || place || '_`): Compare `p' || place || '_page_evidence` with `p' || place || '_previous_page_text_sample`; `Not this`.' END AS instructions FROM a""",
        "parsed_answers": "SELECT doc_id AS id, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS usable, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN doc_id % 10 END::DOUBLE AS has_table, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN doc_id % 4 END::DOUBLE AS degradation FROM labels",
        "vision_schema": f"WITH l AS (SELECT doc_id, toxic, doc_id % 3 <> 1 AND {' AND '.join(f'doc_id % {k} <> 0' for k in (5, 7, 11, 13, 17, 19, 23))} AS good FROM labels) SELECT doc_id AS id, CASE WHEN good THEN CASE doc_id % 3 WHEN 0 THEN 'fax' ELSE 'screenshot' END END AS capture, CASE WHEN good THEN CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END END AS table_ FROM l",
        "cache_hits": f"WITH {pages_sql}, s AS (SELECT text FROM p WHERE doc_id % 3 = 0 GROUP BY text HAVING min(doc_id) % 2 = 0) SELECT doc_id, page, text IN (SELECT text FROM s) AS found FROM p",
        "error_classes": """SELECT event_id AS id, CASE event_id % 10 WHEN 0 THEN CASE WHEN event_id % 20 = 0 THEN 'rejected' WHEN event_id // 10 % 5 >= 3 THEN 'rejected' WHEN event_id // 10 % 5 > 0 THEN 'retry' ELSE 'ok' END
            WHEN 1 THEN 'unavailable' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'unavailable' WHEN 4 THEN 'rejected' WHEN 5 THEN 'rejected' ELSE 'retry' END AS fault FROM events""",
        "retry_waits": """WITH a AS (SELECT event_id AS id, k AS attempt, round(CASE WHEN event_id % 6 = 0 THEN (event_id % 9)::DOUBLE ELSE least(30.0::DOUBLE, 2.0::DOUBLE ** k) END * (0.5::DOUBLE + event_id % 97 / 97::DOUBLE), 6) AS wait_s FROM events, (SELECT unnest(range(1, 13))::INT AS k) WHERE event_id < 300)
            SELECT id, attempt, wait_s FROM (SELECT *, round(sum(wait_s) OVER (PARTITION BY id ORDER BY attempt), 6) AS spent FROM a) WHERE spent <= 80""",
        "stored_decisions": f"WITH {pages_sql}, s AS (SELECT text, min(doc_id) AS i FROM p WHERE doc_id % 4 > 0 GROUP BY text) SELECT doc_id || '-' || page AS id, i % 8 / 8 AS has_math, CASE WHEN i IS NOT NULL THEN 2 END AS n FROM p LEFT JOIN s USING (text)",
    }
