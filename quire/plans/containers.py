"""Named queries on intake: types by content, containers, page limits; the files are made of the documents' texts."""

from __future__ import annotations

import io
import zipfile
from email.message import EmailMessage

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import intake, pages

Spark = SparkSession
#: Cases of sniffed files by doc_id modulo their number: name, bytes in front of the text (hex), whether the text follows, kind, mime.
CASES = [
    ("a.md", "", True, "text", "text/markdown"),
    ("a", "255044462D312E34", True, "pdf", "application/pdf"),
    ("a.txt", "89504E470D0A1A0A", True, "image", "image/png"),
    ("a", "FFD8FFE0", True, "image", "image/jpeg"),
    ("a", "49492A00", True, "image", "image/tiff"),
    ("a", "4D4D002A", True, "image", "image/tiff"),
    ("a", "474946383961", True, "image", "image/gif"),
    ("a", "524946460000000057454250", True, "image", "image/webp"),
    ("a", "424D0102030400000000", True, "image", "image/bmp"),
    ("a", "0000001866747970" + b"heix".hex(), True, "image", "image/heic"),
    ("a", "D0CF11E0A1B11AE1", True, "office", "application/x-ole-storage"),
    ("a", b"{\\rtf1".hex(), True, "office", "application/rtf"),
    ("a", b"X-Any: 1\r\n folded: line\r\nSubject: s\r\n\r\n".hex(), True, "email", "message/rfc822"),
    ("a.EML", "41", True, "email", "message/rfc822"),
    ("a", "610062", True, "unknown", "application/octet-stream"),
    ("a", b' \n{"t": [1, null]}'.hex(), False, "text", "application/json"),
    ("a", b"{not json".hex(), False, "text", "text/plain"),
    ("a", b"<!DOCTYPE HTML><p>".hex(), False, "text", "text/html"),
    ("a", "FF41", True, "unknown", "application/octet-stream"),
    ("a.x.JSON", b"no json".hex(), False, "text", "application/json"),
    ("a", b"BM and more text".hex(), False, "text", "text/plain"),
    ("a", b"Note that: this is prose\nFrom: x\n\n".hex(), False, "text", "text/plain"),
    ("a", "", False, "unknown", "application/octet-stream"),
    ("a", "504B0304", True, "archive", "application/zip"),
    ("a", "504B0708", True, "archive", "application/zip"),
    (".md", b"prose".hex(), False, "text", "text/plain"),
]


def _pick(values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))


def sniffed_types(spark: Spark, d: str) -> DataFrame:
    text = F.when(_pick([c[2] for c in CASES]), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).otherwise(F.lit(b""))
    content = F.concat(F.unhex(_pick([c[1] for c in CASES])), text)
    files = pages.documents(spark, d).select("doc_id", _pick([c[0] for c in CASES]).alias("name"), content.alias("content"))
    return intake.typed(files).select("doc_id", "kind", "mime", "quarantine")


#: Members of zip files by doc_id modulo 5, and the type that follows.
ZIPS = [
    (("[Content_Types].xml", "word/document.xml"), "office", intake.OFFICE["word/"]),
    (("[Content_Types].xml", "xl/workbook.xml"), "office", intake.OFFICE["xl/"]),
    (("[Content_Types].xml", "other.xml"), "office", intake.NO_TYPE),
    (("mimetype", "content.xml"), "office", "application/vnd.oasis.opendocument.text"),
    (("a.txt", "word/document.xml"), "archive", "application/zip"),
]


def _zip(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def zip_types(spark: Spark, d: str) -> DataFrame:
    def made(r: tuple) -> list[tuple]:
        names = ZIPS[r.doc_id % len(ZIPS)][0]
        return [(r.doc_id, "a.zip", _zip([(n, b"application/vnd.oasis.opendocument.text\n" if n == "mimetype" else (r.text or "").encode()) for n in names]))]

    files = intake._rows(pages.documents(spark, d).select("doc_id", "text"), made, "doc_id long, name string, content binary")
    return intake.typed(files).select("doc_id", "kind", "mime")


def _container(doc_id: int, text: str) -> tuple[str, bytes]:
    data = text.encode()
    kind = doc_id % 8
    if kind == 1:
        return "two.zip", _zip([("in/", b""), ("in/a.txt", data), ("b.txt", b"b"), ("../out.txt", b"no"), ("/abs.txt", b"no")])
    if kind == 2:
        mail = EmailMessage()
        mail["Subject"], mail["From"] = "s", "a@example.org"
        mail.set_content("body")
        mail.add_attachment(data, maintype="application", subtype="octet-stream", filename="att.txt")
        return "mail", bytes(mail)
    if kind in (3, 4):
        name = "deep.txt"
        for i in range(2 if kind == 3 else 5):
            data, name = _zip([(name, data)]), f"level{i}.zip"
        return name, data
    if kind == 5:
        return "none.zip", _zip([])
    if kind == 6:
        return "broken.zip", b"PK\x03\x04" + data
    return ("odd", b"\x00\x01") if kind == 7 else ("plain.txt", data or b" ")


def expanded_files(spark: Spark, d: str) -> DataFrame:
    """Leaf documents of files of eight kinds, with what manifests call them."""
    files = intake._rows(pages.documents(spark, d).select("doc_id", "text"), lambda r: [(f"{r.doc_id}/{_container(r.doc_id, r.text or '')[0]}", _container(r.doc_id, r.text or "")[1])], "name string, content binary")
    leaves = intake.expand(files)
    label = F.concat(F.lit("in/"), "name")
    shown = intake.shown_name(label, F.col("name"), F.col("parent_sha"))
    return leaves.groupBy(F.regexp_replace(shown, "[0-9]+/", "").alias("shown"), "kind", "quarantine", "depth").agg(F.count("*").alias("n"), F.count("parent_sha").alias("with_parent"))


def page_limit_checks(spark: Spark, d: str) -> DataFrame:
    """Headers of images and PDFs of nine kinds, with sizes and page counts that follow from the ids."""
    w, h = F.col("doc_id") % 50 + 1, F.when(F.col("doc_id") % 3 == 0, 9_000_000).otherwise(F.col("doc_id") % 40 + 1)
    big = lambda v, n: F.lpad(F.hex(v.cast("long")), 2 * n, "0")
    little = lambda v, n: F.concat(*[F.substring(big(v, n), 2 * (n - i) - 1, 2) for i in range(n)])
    ifd = lambda after: F.concat(F.lit("0200" + "0001" + "0400" + "01000000"), little(w, 4), F.lit("0101" + "0400" + "01000000"), little(h, 4), F.lit(after))
    cases = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4)),
        F.concat(F.lit("474946383961"), little(w, 2), little(w, 2), F.lit("000000"), F.repeat(F.lit("2C00000000010001000002024C0100"), (F.col("doc_id") % 3 + 1).cast("int")), F.lit("3B")),
        F.concat(F.lit("424D0000000000000000000000002800" + "0000"), little(w, 4), little(h, 4)),
        F.concat(F.lit("FFD8FFE000040000FFC0001108"), big(w, 2), big(F.col("doc_id") % 60 + 1, 2)),
        F.concat(F.lit("49492A0008000000"), ifd("26000000"), ifd("00000000")),
        F.lit("89504E47" + "0D0A1A0A0000"),
        F.concat(F.lit(b"%PDF-1.4\n".hex()), F.repeat(F.lit(b"<< /Type /Page >>\n".hex()), (F.col("doc_id") % 5).cast("int")), F.lit(b"<< /Type /Pages >> startxref".hex())),
        F.lit(b"%PDF-1.4 /Encrypt 5 0 R startxref".hex()),
        F.lit(b"%PDF-1.4 cut".hex()),
    ]
    content = F.unhex(F.element_at(F.array(*cases), (F.col("doc_id") % len(cases) + 1).cast("int")))
    files = intake.typed(pages.documents(spark, d).select(F.col("doc_id").cast("string").alias("name"), content.alias("content")))
    limited = intake.page_limits(files, most_pages=3)
    return limited.select(F.col("name").cast("long").alias("doc_id"), "kind", "page_count", "quarantine")


def jpeg_segments(spark: Spark, d: str) -> DataFrame:
    """JPEG headers with a comment, with an Exif segment, with neither."""
    body = F.concat(F.lit("FFD8FFE000040000"), F.when(F.col("doc_id") % 4 == 1, "FFFE00044142").when(F.col("doc_id") % 4 == 2, "FFDB00040102FFE1000645786966").otherwise("FFDB00040102"), F.lit("FFDA000802FFFE0004"))
    return pages.documents(spark, d).select("doc_id", intake.named_segments(F.unhex(body)).alias("named"))


QUERIES = {f.__name__: f for f in (sniffed_types, zip_types, expanded_files, page_limit_checks, jpeg_segments)}

_TYPES = ", ".join(f"({i}, '{kind}', '{mime}', {'NULL' if kind != 'unknown' else repr('empty' if not sign else 'unsupported_type')})" for i, (_, sign, _, kind, mime) in enumerate(CASES))
_ZIPS = ", ".join(f"({i}, '{kind}', '{mime}')" for i, (_, kind, mime) in enumerate(ZIPS))

ORACLE_SQL = {
    "sniffed_types": f"SELECT doc_id, kind, mime, quarantine FROM documents JOIN (VALUES {_TYPES}) t(i, kind, mime, quarantine) ON doc_id % {len(CASES)} = i",
    "zip_types": f"SELECT doc_id, kind, mime FROM documents JOIN (VALUES {_ZIPS}) t(i, kind, mime) ON doc_id % {len(ZIPS)} = i",
    "expanded_files": """WITH d AS (SELECT doc_id % 8 AS k, coalesce(text, '') = '' AS bare FROM documents),
        l AS (SELECT CASE k WHEN 0 THEN 'in/plain.txt' WHEN 1 THEN 'a.txt' WHEN 2 THEN 'att.txt' WHEN 3 THEN 'deep.txt' WHEN 4 THEN 'level1.zip' WHEN 5 THEN 'in/none.zip' WHEN 6 THEN 'in/broken.zip' ELSE 'in/odd' END AS shown,
                CASE WHEN k IN (0, 1, 2, 3) THEN CASE WHEN bare AND k > 0 THEN 'unknown' ELSE 'text' END WHEN k = 7 THEN 'unknown' ELSE 'archive' END AS kind,
                CASE WHEN k IN (1, 2, 3) AND bare THEN 'empty' WHEN k = 4 THEN 'too_deep' WHEN k = 5 THEN 'empty' WHEN k = 6 THEN 'corrupt' WHEN k = 7 THEN 'unsupported_type' END AS quarantine,
                CASE k WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 0 END AS depth FROM d
            UNION ALL SELECT 'b.txt', 'text', NULL, 1 FROM d WHERE k = 1 UNION ALL SELECT 'mail#body.txt', 'text', NULL, 1 FROM d WHERE k = 2)
        SELECT shown, kind, quarantine, depth, count(*) AS n, count(*) FILTER (depth > 0) AS with_parent FROM l GROUP BY ALL""",
    "page_limit_checks": """WITH d AS (SELECT doc_id, doc_id % 9 AS k, doc_id % 50 + 1 AS w, CASE WHEN doc_id % 3 = 0 THEN 9000000 ELSE doc_id % 40 + 1 END AS h FROM documents),
        p AS (SELECT doc_id, k, CASE WHEN k < 6 THEN 'image' ELSE 'pdf' END AS kind, CASE k WHEN 0 THEN 1 WHEN 1 THEN doc_id % 3 + 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 6 THEN doc_id % 5 ELSE 0 END AS page_count,
            CASE WHEN k IN (0, 2, 4) AND w * h > 120000000 THEN 'image_too_large' WHEN k IN (5, 8) THEN 'corrupt' WHEN k = 7 THEN 'encrypted' WHEN k = 6 AND doc_id % 5 > 3 THEN 'too_many_pages' END AS quarantine FROM d)
        SELECT doc_id, kind, page_count::INT AS page_count, quarantine FROM p""",
    "jpeg_segments": "SELECT doc_id, doc_id % 4 IN (1, 2) AS named FROM documents",
}
