"""Named queries that write files to the shared folder and read them back, with the SQL of what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import pages, segments
from quire.shared import shared_folder
from quire.sources import files, paged

Spark = SparkSession


def folder(spark: Spark) -> str:
    """A folder of its own under the one that all executors share."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _docs(spark: Spark, d: str) -> DataFrame:
    return pages.documents(spark, d).select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def json_line_cases(spark: Spark, d: str) -> DataFrame:
    """Cases as JSON lines whose texts hold characters that look like line ends, read back whole."""
    at = folder(spark)
    _docs(spark, d).select("doc_id", F.concat("text", F.lit("\x85 x")).alias("text")).write.json(at)
    return files.json_lines(spark, at, "doc_id long, text string").select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


def catalogue(spark: Spark, d: str) -> DataFrame:
    """Pages and variants of one file: pages have a key, variants name the page that they are of."""
    at = folder(spark)
    i = F.col("doc_id")
    _docs(spark, d).select(F.concat(F.lit("id"), i).alias("id"), F.when(i % 4 > 0, F.concat(F.lit("k"), i)).alias("key"), F.when(i % 4 == 0, F.concat(F.lit("k"), i + 1)).alias("of")).write.json(at)
    first, second = files.two_kinds(files.json_lines(spark, at, "id string, key string, of string"), "key", "of")
    return first.select(F.lit("page").alias("kind"), "id").unionByName(second.select(F.lit("variant").alias("kind"), "id"))


def result_files(spark: Spark, d: str) -> DataFrame:
    """Results of two systems in files of their own, with system, run and case in the path, read as one table."""
    at = folder(spark)
    i = F.col("doc_id")
    r = _docs(spark, d).filter("doc_id % 20 = 0").select(F.concat(F.lit("sys"), F.floor(i / 20) % 2, F.lit("/run"), F.floor(i / 40) % 2, F.lit("/c"), i, F.lit(".json")).alias("name"), F.to_json(F.struct((i % 7 / 8).alias("p"))).alias("content"))
    files.write_files(r, at)
    return files.results_tree(spark, at, "p double").select("system", "run", "case", "p")


def file_scan(spark: Spark, d: str) -> DataFrame:
    """Files of texts, some hidden by their name or their folder's, with their hash; uploads above the limit are refused."""
    at = folder(spark)
    i = F.col("doc_id")
    name = F.concat(F.when(i % 60 == 0, ".hidden/").otherwise("open/"), F.when(i % 100 == 40, ".").otherwise(""), i, F.lit(".txt"))
    files.write_files(_docs(spark, d).filter("doc_id % 20 = 0").select(name.alias("name"), F.col("text").alias("content")), at)
    got = files.capped(files.scan(spark, at), 3000)
    return got.select(F.regexp_extract("name", r"([0-9]+)\.txt$", 1).cast("long").alias("doc_id"), "sha", "size", "status", F.octet_length("content").alias("kept"))


def _routes(spark: Spark, d: str) -> DataFrame:
    return pages.routed(spark, d).select("doc_id", F.col("page").cast("int").alias("page"), "lane")


def manifest_scan(spark: Spark, d: str) -> DataFrame:
    """One file a manifest, next to files that are none; scanned in order of their path."""
    at = folder(spark)
    m = _routes(spark, d).filter("doc_id % 10 = 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "lane"))).alias("pages"))
    sha = F.sha2(F.col("doc_id").cast("string"), 256)
    made = m.select(F.concat(F.lit("doc"), "doc_id", F.lit("-"), F.left(sha, F.lit(8)), F.lit(".json")).alias("name"), F.to_json(F.struct("doc_id", F.lit("rk1").alias("route_key"), "pages")).alias("content"))
    other = spark.createDataFrame([("notes.json", '{"a": 1}'), ("broken.json", "{"), ("list.json", "[1]"), ("x.txt", "x")], "name string, content string")
    files.write_files(made.unionByName(other), at)
    got = files.manifests(spark, at, "doc_id long, route_key string, pages array<struct<page:int,lane:string>>", "route_key")
    return got.select("doc_id", "route_key", F.size("pages").alias("n_pages"), F.array_join(F.transform("pages", lambda p: p["lane"]), "").alias("lanes"))


def manifest_store(spark: Spark, d: str) -> DataFrame:
    """Manifests kept once by document and route key, whatever is written again; then read by key, absent ones as null."""
    at = folder(spark)
    m = _routes(spark, d).groupBy("doc_id").agg(F.count("*").alias("n")).select(F.concat_ws("/", F.lit("manifests"), "doc_id").alias("key"), F.lit("rk1").alias("route_key"), F.col("n").cast("string").alias("value"), "doc_id")
    part = lambda test: m.filter(test).select("key", "value", "route_key")
    first = files.append_once(part("doc_id % 3 < 2"), at, ["key"], "route_key")
    again = files.append_once(part("doc_id % 3 > 0").withColumn("value", F.lit("new")).select("key", "value", "route_key"), at, ["key"], "route_key")
    keys = m.select("key").unionByName(spark.createDataFrame([("manifests/none",)], "key string"))
    read = files.point_reads(keys, spark.read.parquet(at))
    return read.withColumns({"first": F.lit(first).cast("long"), "again": F.lit(again).cast("long")})


def job_index(spark: Spark, d: str) -> DataFrame:
    """A job's index (a job for each source): its documents with their pages by lane."""
    lanes = segments.lane_counts(pages.routed(spark, d)).join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    entry = F.concat_ws(" ", "doc_id", F.array_join(F.transform("lanes", lambda x: F.concat_ws(":", x["lane"], x["n"])), " "))
    return lanes.groupBy(F.col("source").alias("job")).agg(F.md5(F.array_join(F.array_sort(F.collect_list(entry)), ";")).alias("documents"), F.count("*").alias("n"))


def results_and_errors(spark: Spark, d: str) -> DataFrame:
    """Results without their group, and error rows, in one file of JSON lines."""
    at = folder(spark)
    r = _docs(spark, d).select(F.col("doc_id").alias("id"), F.lit("pdf").alias("grp"), F.lit("L1").alias("lane"))
    files.write_results(r.filter("id % 9 > 0"), r.filter("id % 9 = 0").select("id", F.lit("page out of range").alias("error")), at)
    return files.json_lines(spark, at, "id long, grp string, lane string, error string")


def score_table(spark: Spark, d: str) -> DataFrame:
    """Scores as a CSV file with a header, read back by it."""
    at = folder(spark)
    files.write_csv(_docs(spark, d).select("doc_id", F.concat(F.lit('a "b", '), "source").alias("name"), (F.col("doc_id") % 8 / 8).alias("score")), at)
    return spark.read.option("header", True).schema("doc_id long, name string, score double").csv(at)


def byte_ranges(spark: Spark, d: str) -> DataFrame:
    """Ranges over a file kept in parts: they begin and end anywhere, across parts too."""
    whole = spark.range(0, 40).select(F.col("id").alias("part"), F.encode(F.substring(F.repeat(F.sha2(F.col("id").cast("string"), 256), 2), F.lit(1), (F.col("id") % 30 + 60).cast("int")), "UTF-8").alias("content"))
    wanted = spark.range(0, 300).select("id", (F.col("id") * 9).alias("start"), (F.col("id") * 7 % 200 + 1).alias("length"))
    return files.ranges(whole, wanted).select("id", F.md5("content").alias("digest"), F.octet_length("content").alias("n"))


def _archives(spark: Spark, d: str) -> DataFrame:
    """A release for each source, its documents' texts as members."""
    return files.releases(_docs(spark, d).select(F.col("source").alias("release"), F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content")))


def release_headers(spark: Spark, d: str) -> DataFrame:
    """Members of reproducible tar files, by their headers alone."""
    return files.tar_headers(_archives(spark, d).select(F.col("release").alias("name"), "content")).select("archive", "member", "size")


def release_members(spark: Spark, d: str) -> DataFrame:
    """Wanted members out of the tar files, found in one pass."""
    names = {f"d{i}.txt" for i in range(0, 200, 7)}
    got = files.tar_members(_archives(spark, d).select(F.col("release").alias("name"), "content"), names)
    return got.select("archive", "member", "size", F.sha2("content", 256).alias("sha"))


def release_repeats(spark: Spark, d: str) -> DataFrame:
    """Two makings of every release, in another order of files, have one checksum."""
    a = files.checksums(_archives(spark, d))
    b = files.checksums(files.releases(_docs(spark, d).repartition(7, "doc_id").orderBy(F.desc("doc_id")).select(F.col("source").alias("release"), F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content")))).select("release", F.col("sha").alias("again"))
    return a.join(b, "release").select("release", (F.col("sha") == F.col("again")).alias("same"))


def zip_directories(spark: Spark, d: str) -> DataFrame:
    """Directories of zip files, which are made and read in parts, and members cut out by them; every third member is stored as it is."""
    texts = _docs(spark, d).select(F.col("source").alias("archive"), F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"), (F.col("doc_id") % 3 == 0).alias("stored"))
    zips = files.zips(texts, folder(spark))
    listed = files.zip_directory(zips)
    cut = files.zip_members(zips, listed.filter("member rlike '[05].txt$'").select("archive", "member")).select(F.col("archive").alias("of"), F.col("member").alias("cut"), F.sha2("content", 256).alias("sha"))
    return listed.join(cut, F.col("archive").eqNullSafe(F.col("of")) & (F.col("member") == F.col("cut")), "left").select("archive", "member", "method", "size", "sha")


def html_sections(spark: Spark, d: str) -> DataFrame:
    """Sections of a report on documents: lanes, and bars as wide as their segments."""
    r = pages.routed(spark, d).filter("doc_id % 10 = 0").select("doc_id", F.col("page").alias("start"), F.col("page").alias("stop"), "lane")
    w = segments.widths(r).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "lane", "width"))).alias("segments"))
    lanes = segments.lane_counts(pages.routed(spark, d)).select("doc_id", F.array_join(F.transform("lanes", lambda x: F.concat_ws(" ", x["lane"], x["n"])), ", ").alias("lanes"))
    return files.html_report(w.join(lanes, "doc_id").select(F.concat(F.lit("a<b> & "), "doc_id").alias("name"), "lanes", "segments"))


def paged_rows(spark: Spark, d: str) -> DataFrame:
    """Rows that are served in pages of 64, each page read by a task of its own."""
    at = folder(spark)
    docs = _docs(spark, d).select("doc_id", "source")
    rows = docs.select("doc_id", F.struct(F.struct("doc_id", F.concat("source", F.lit("!")).alias("label"), F.lit("unused").alias("more")).alias("row")).alias("r"))
    served_ = rows.groupBy((F.floor(F.col("doc_id") / 64) * 64).alias("offset")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "r"))), lambda x: x["r"]).alias("rows"))).alias("content"))
    files.write_files(served_.select(F.concat(F.lit("rows-"), "offset", F.lit(".json")).alias("name"), "content"), at)
    total = docs.agg((F.max("doc_id") + 1).alias("n")).first()["n"]
    return paged.rows(spark, at.removeprefix("file://") + "/rows-{offset}.json", total, 64, "doc_id long, label string")


def fetch_plan(spark: Spark, d: str) -> DataFrame:
    """What is still to be fetched, archives' members together; every third file is there."""
    i = F.col("doc_id")
    entries = pages.documents(spark, d).select(F.concat(F.lit("raw/"), i).alias("raw"), F.when(i % 5 == 0, F.concat(F.lit("https://a/"), i)).otherwise(F.concat(F.lit("https://z/"), i % 10, F.lit(".zip"))).alias("url"), F.when(i % 5 > 0, F.concat(F.lit("m"), i)).alias("member"))
    todo = files.to_fetch(entries, entries.filter(F.substring_index("raw", "/", -1).cast("long") % 3 == 0))
    return todo.select("url", F.size("members").alias("n"), F.md5(F.array_join("members", ",")).alias("members"))


def kept_children(spark: Spark, d: str) -> DataFrame:
    """Bytes of documents out of containers are kept once by their hash, whoever brings them again."""
    at = folder(spark)
    children = _docs(spark, d).select(F.concat(F.lit("inputs/"), F.sha2("text", 256)).alias("key"), "text")
    first, again = files.append_once(children, at, ["key"]), files.append_once(children, at, ["key"])
    return spark.read.parquet(at).select("key", F.length("text").alias("n")).withColumns({"first": F.lit(first).cast("long"), "again": F.lit(again).cast("long")})


def lookups(spark: Spark, d: str) -> DataFrame:
    """Stored answers of a service by key, and 404 for what isn't there."""
    store = _docs(spark, d).filter("doc_id % 4 > 0").select(F.concat(F.lit("jobs/"), "doc_id").alias("key"), F.col("source").alias("value"))
    return files.served(_docs(spark, d).select(F.concat(F.lit("jobs/"), "doc_id").alias("key")), store)


QUERIES = {f.__name__: f for f in (json_line_cases, catalogue, result_files, file_scan, manifest_scan, manifest_store, job_index, results_and_errors, score_table, byte_ranges, release_headers, release_members, release_repeats, zip_directories, html_sections, paged_rows, fetch_plan, kept_children, lookups)}


def oracles(answered_sql: str) -> dict[str, str]:
    docs = "d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)"
    lanes = f"WITH {answered_sql}, k AS (SELECT doc_id, lane, count(*) AS n FROM routed GROUP BY ALL)"
    return {
        "json_line_cases": f"WITH {docs} SELECT doc_id, length(text) + 3 AS n, md5(text || chr(133) || chr(8232) || 'x') AS digest FROM d",
        "catalogue": "SELECT CASE WHEN doc_id % 4 > 0 THEN 'page' ELSE 'variant' END AS kind, 'id' || doc_id AS id FROM documents",
        "result_files": "SELECT 'sys' || doc_id // 20 % 2 AS system, 'run' || doc_id // 40 % 2 AS run, 'c' || doc_id AS \"case\", doc_id % 7 / 8 AS p FROM documents WHERE doc_id % 20 = 0",
        "file_scan": f"WITH {docs} SELECT doc_id, sha256(text) AS sha, strlen(text) AS size, CASE WHEN strlen(text) > 3000 THEN 413 ELSE 202 END AS status, CASE WHEN strlen(text) <= 3000 THEN strlen(text) END::INT AS kept FROM d WHERE doc_id % 20 = 0 AND doc_id % 60 <> 0 AND doc_id % 100 <> 40",
        "manifest_scan": f"WITH {answered_sql} SELECT doc_id, 'rk1' AS route_key, count(*)::INT AS n_pages, string_agg(lane, '' ORDER BY page) AS lanes FROM routed WHERE doc_id % 10 = 0 GROUP BY doc_id",
        "manifest_store": f"""WITH {answered_sql}, mm AS (SELECT doc_id, count(*) AS n FROM routed GROUP BY doc_id), kk AS (SELECT count(*) FILTER (doc_id % 3 < 2) AS first, count(*) FILTER (doc_id % 3 = 2) AS again FROM mm)
            SELECT 'manifests/' || doc_id AS key, CASE WHEN doc_id % 3 < 2 THEN n::VARCHAR ELSE 'new' END AS value, first, again FROM mm, kk UNION ALL SELECT 'manifests/none', NULL, first, again FROM kk""",
        "job_index": f"{lanes}, e AS (SELECT doc_id, doc_id || ' ' || string_agg(lane || ':' || n, ' ' ORDER BY lane) AS entry FROM k GROUP BY doc_id) SELECT source AS job, md5(string_agg(entry, ';' ORDER BY entry)) AS documents, count(*) AS n FROM e JOIN documents USING (doc_id) GROUP BY source",
        "results_and_errors": "SELECT doc_id AS id, NULL::VARCHAR AS grp, CASE WHEN doc_id % 9 > 0 THEN 'L1' END AS lane, CASE WHEN doc_id % 9 = 0 THEN 'page out of range' END AS error FROM documents",
        "paged_rows": "SELECT doc_id, source || '!' AS label FROM documents",
        "fetch_plan": """WITH e AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'https://a/' || doc_id ELSE 'https://z/' || doc_id % 10 || '.zip' END AS url, CASE WHEN doc_id % 5 > 0 THEN 'm' || doc_id END AS member FROM documents WHERE doc_id % 3 <> 0)
            SELECT url, count(member)::INT AS n, md5(coalesce(string_agg(member, ',' ORDER BY member), '')) AS members FROM e GROUP BY url""",
        "kept_children": f"WITH {docs} SELECT DISTINCT 'inputs/' || sha256(text) AS key, length(text) AS n, (SELECT count(DISTINCT text) FROM d) AS first, 0::BIGINT AS again FROM d",
        "lookups": "SELECT 'jobs/' || doc_id AS key, CASE WHEN doc_id % 4 > 0 THEN 200 ELSE 404 END AS status, CASE WHEN doc_id % 4 > 0 THEN source END AS body FROM documents",
        "score_table": "SELECT doc_id, 'a \"b\", ' || source AS name, doc_id % 8 / 8 AS score FROM documents",
        "byte_ranges": "WITH p AS (SELECT i, left(repeat(sha256(i::VARCHAR), 2), (i % 30 + 60)::INT) AS t FROM (SELECT unnest(range(40)) AS i)), w AS (SELECT string_agg(t, '' ORDER BY i) AS whole FROM p), r AS (SELECT i AS id, substr(whole, i * 9 + 1, i * 7 % 200 + 1) AS t FROM w, (SELECT unnest(range(300)) AS i)) SELECT id, md5(t) AS digest, length(t)::INT AS n FROM r WHERE t <> ''",
        "release_headers": f"WITH {docs} SELECT source AS archive, 'd' || doc_id || '.txt' AS member, strlen(text) AS size FROM d",
        "release_members": f"WITH {docs} SELECT source AS archive, 'd' || doc_id || '.txt' AS member, strlen(text) AS size, sha256(text) AS sha FROM d WHERE doc_id < 200 AND doc_id % 7 = 0",
        "release_repeats": "SELECT DISTINCT source AS release, true AS same FROM documents",
        "zip_directories": f"WITH {docs} SELECT source AS archive, 'd' || doc_id || '.txt' AS member, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 8 END AS method, strlen(text) AS size, CASE WHEN doc_id % 5 = 0 THEN sha256(text) END AS sha FROM d",
        "html_sections": f"""{lanes}, ll AS (SELECT doc_id, string_agg(lane || ' ' || n, ', ' ORDER BY lane) AS lanes FROM k GROUP BY doc_id), ss AS (SELECT doc_id, string_agg('<i class="' || lane || '" style="width:' || printf('%.2f', 100.0::DOUBLE / n) || '%"></i>', '' ORDER BY page) AS bars
            FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM routed) WHERE doc_id % 10 = 0 GROUP BY doc_id) SELECT 'a<b> & ' || doc_id AS name, '<section><h2>a&lt;b&gt; &amp; ' || doc_id || '</h2><p>' || lanes || '</p><div>' || bars || '</div></section>' AS content FROM ss JOIN ll USING (doc_id)""",
    }
