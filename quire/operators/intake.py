"""Intake: type by content, container checks, expansion, deduplication."""

from __future__ import annotations

import email
import email.policy
import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.shared import checkpoint
from quire.shipping import give_back, ship

#: (signs in hex with their place from 1, kind, mime), tried in order; all signs of a row must be there.  Fixed values.
MAGIC = [
    ({1: "255044462D"}, "pdf", "application/pdf"),
    ({1: "89504E470D0A1A0A"}, "image", "image/png"),
    ({1: "FFD8FF"}, "image", "image/jpeg"),
    ({1: "49492A00"}, "image", "image/tiff"),
    ({1: "4D4D002A"}, "image", "image/tiff"),
    ({1: "474946383761"}, "image", "image/gif"),
    ({1: "474946383961"}, "image", "image/gif"),
    ({1: "52494646", 9: "57454250"}, "image", "image/webp"),
    ({1: "424D", 7: "00000000"}, "image", "image/bmp"),
    *[({5: "66747970", 9: brand.encode().hex().upper()}, "image", "image/heic") for brand in ("heic", "heix", "heim", "heis", "hevc", "hevx", "hevm", "hevs", "mif1", "msf1")],
    ({1: "D0CF11E0A1B11AE1"}, "office", "application/x-ole-storage"),
    ({1: "7B5C727466"}, "office", "application/rtf"),
    ({1: "504B0304"}, "zip", "application/zip"),
    ({1: "504B0506"}, "zip", "application/zip"),
    ({1: "504B0708"}, "zip", "application/zip"),
]
#: Types of text by suffix, headers that tell a mail, office types by folder of their members, and the beginning of OpenDocument types.  Fixed values.
SUFFIXES = {".md": "text/markdown", ".markdown": "text/markdown", ".csv": "text/csv", ".json": "application/json", ".html": "text/html", ".htm": "text/html"}
MAIL_HEADERS = ("from", "to", "subject", "date", "message-id", "mime-version", "received")
OFFICE = {"word/": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xl/": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "ppt/": "application/vnd.openxmlformats-officedocument.presentationml.presentation"}
OPEN_DOCUMENT = "application/vnd.oasis.opendocument"
NO_TYPE = "application/octet-stream"
HEAD = 65536
#: Bytes of rows that are handed on at once, about.
BATCH = 1 << 20
#: Limits.  Fixed values.
MOST_MB, MOST_PAGES, MOST_PIXELS, MOST_CHILDREN, MOST_DEPTH = 200, 2000, 120_000_000, 500, 3
BOMB_TOTAL, BOMB_MEMBER, BOMB_RATIO = 1_000_000_000, 10_000_000, 100


def looks_like_mail(content: Column, name: Column) -> Column:
    """By name, or if the lines up to the first empty one (20 of 4 KiB at most) are headers and a telling one is among them."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    lines = F.transform(F.slice(F.split(head, "\n"), 1, 20), lambda x: F.regexp_replace(x, "\r+$", ""))
    end = F.array_position(lines, "")
    lines = F.when(end > 0, F.slice(lines, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(lines)
    own = F.filter(lines, lambda x: ~x.rlike(r"^[ \t]"))
    headers = F.forall(own, lambda x: x.rlike(r"^[\x00-\x7F&&[^ :]]*:"))
    told = F.exists(own, lambda x: F.lower(F.regexp_replace(F.substring_index(x, ":", 1), r"^\s+|\s+$", "")).isin(*MAIL_HEADERS))
    return F.lower(name).endswith(".eml") | (headers & told)


def looks_like_text(content: Column) -> Column:
    """No NUL and valid UTF-8 in the first 64 KiB; a character cut at their end is read to its own."""
    valid = lambda n: F.is_valid_utf8(F.substring(content, 1, n).cast("string"))
    return ~F.hex(F.substring(content, 1, HEAD)).rlike("^(?:..)*?00") & (valid(HEAD) | valid(HEAD + 1) | valid(HEAD + 2) | valid(HEAD + 3))


def text_type(content: Column, name: Column) -> Column:
    """By suffix, then by parsing as JSON, then by the first 512 bytes."""
    suffix = F.lower(F.regexp_extract(name, r"[^/.](\.[^./]+)$", 1))
    by_name = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), suffix)
    whole = F.try_validate_utf8(content.cast("string"))
    as_json = whole.rlike(r"^\s*[{\[]") & F.try_parse_json(whole).isNotNull()
    html = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1")).rlike(r"<html|<!doctype html")
    return F.coalesce(by_name, F.when(as_json, "application/json"), F.when(html, "text/html"), F.lit("text/plain"))


def sniff(content: Column, name: Column) -> Column:
    """struct<kind, mime> of bytes: magic numbers first, then mail, then text; the name only tells mail and kinds of text.

    Zip files come out as kind zip; what they are takes their members (typed()).
    """
    head = F.hex(F.substring(content, 1, 16))
    found = F.lit(None).cast("struct<kind:string,mime:string>")
    of = lambda kind, mime: F.struct(F.lit(kind).alias("kind"), (F.lit(mime) if isinstance(mime, str) else mime).alias("mime"))
    tests = [(F.lit(True), signs, of(kind, mime)) for signs, kind, mime in MAGIC]
    out = found
    for _, signs, said in tests:
        test = F.lit(True)
        for at, sign in signs.items():
            test = test & (F.substring(head, 2 * at - 1, len(sign)) == sign)
        out = F.when(test, said) if out is found else out.when(test, said)
    out = out.when(looks_like_mail(content, name), of("email", "message/rfc822"))
    return out.when(looks_like_text(content), of("text", text_type(content, name))).otherwise(of("unknown", NO_TYPE))


def zip_type(content: bytes) -> tuple[str, str]:
    """Kind and mime of a zip file by its members; a broken one is an archive still."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            if "[Content_Types].xml" in names:
                return "office", next((mime for folder, mime in OFFICE.items() if any(n.startswith(folder) for n in names)), NO_TYPE)
            said = z.read("mimetype").decode("ascii", "replace").strip() if "mimetype" in names else ""
    except (zipfile.BadZipFile, KeyError, NotImplementedError, RuntimeError, OSError, EOFError, ValueError):
        return "archive", "application/zip"
    return ("office", said) if said.startswith(OPEN_DOCUMENT) else ("archive", "application/zip")


def _rows(files: DataFrame, made: Callable[[tuple], list[tuple]], columns: str) -> DataFrame:
    """files through made(), row by row; columns: the result's schema.  Rows go on in pieces of some BATCH bytes, and memory that is free is given back."""
    ship(files.sparkSession)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows, size = [], 0
            for row in f.itertuples(index=False):
                for r in made(row):
                    rows.append(r)
                    size += 100 + sum(len(v) for v in r if isinstance(v, bytes | bytearray | str))
                    if size > BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)
            give_back()

    return files.mapInPandas(run, columns)


def typed(files: DataFrame) -> DataFrame:
    """files (name, content and more, all kept) with kind, mime, quarantine by size.  Only zip files pass through Python."""
    said = files.withColumn("_s", sniff(F.col("content"), F.col("name"))).withColumns({"kind": F.col("_s.kind"), "mime": F.col("_s.mime"), "quarantine": quarantine(F.octet_length("content"))}).drop("_s")
    bad = F.col("quarantine").isNotNull()
    said = said.withColumns({"kind": F.when(bad, "unknown").otherwise(F.col("kind")), "mime": F.when(bad, NO_TYPE).otherwise(F.col("mime"))})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in said.schema)
    zips = _rows(said.filter("kind = 'zip'"), lambda r: [(*r[:-3], *zip_type(bytes(r.content)), r.quarantine)], schema)
    out = said.filter("kind <> 'zip'").unionByName(zips)
    return out.withColumn("quarantine", F.coalesce("quarantine", F.when(F.col("kind") == "unknown", "unsupported_type")))


def quarantine(size: Column, most_mb: int = MOST_MB) -> Column:
    return F.when(size == 0, "empty").when(size > most_mb * 1024 * 1024, "too_large")


def fixed_lane(kind: Column, reason: Column) -> Column:
    """LQ for quarantined documents, L0 for text and office files, null for what is to be probed."""
    return F.when(reason.isNotNull() | (kind == "unknown"), "LQ").when(kind.isin("text", "office", "email"), "L0")


def fixed_reason(kind: Column, reason: Column) -> Column:
    return F.when(reason.isNotNull(), F.concat(F.lit("quarantined: "), reason)).when(kind.isin("text", "office"), F.concat(F.lit("native "), kind, F.lit(" format")))


def bombs(members: DataFrame) -> DataFrame:
    """archive, total, bomb of archive members (archive, size, packed): too large in all, or a large member packed a hundredfold."""
    large = (F.col("size") > BOMB_MEMBER) & (F.col("size") > BOMB_RATIO * F.greatest(F.col("packed"), F.lit(1)))
    return members.groupBy("archive").agg(F.sum("size").alias("total"), F.coalesce(F.bool_or(large), F.lit(False)).alias("large")).select("archive", "total", ((F.col("total") > BOMB_TOTAL) | F.col("large")).alias("bomb"))


class Unusable(Exception):
    """Why a container is quarantined."""


def _member_names(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """Members that are files, inside the archive's own folder, and no links."""
    keep = []
    for member in z.infolist():
        steps = member.filename.split("/")
        outside = member.filename.startswith("/") or ".." in steps
        if not (outside or member.filename.endswith("/") or (member.external_attr >> 28) == 0o12):
            keep.append(member)
    return keep


def archive_children(content: bytes, most: int = MOST_CHILDREN) -> list[tuple[str, bytes]]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            members = _member_names(z)
            if not members:
                raise Unusable("empty")
            if len(members) > most:
                raise Unusable("too_many_children")
            sizes = [(m.file_size, m.compress_size) for m in members]
            if sum(s for s, _ in sizes) > BOMB_TOTAL or any(s > BOMB_MEMBER and s > BOMB_RATIO * max(1, packed) for s, packed in sizes):
                raise Unusable("archive_bomb")
            return [(m.filename.rstrip("/").rsplit("/", 1)[-1], z.read(m)) for m in members]
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, EOFError, ValueError, struct.error) as e:
        raise Unusable("corrupt") from e


def mail_children(name: str, content: bytes, most: int = MOST_CHILDREN) -> list[tuple[str, bytes]]:
    """Body (plain before HTML) and attachments.  Whatever a malformed mail makes the parser raise, the mail is corrupt."""
    try:
        mail = email.message_from_bytes(content, policy=email.policy.default)
        body, attached = mail.get_body(("plain", "html")), list(mail.iter_attachments())
        out = []
        if body is not None:
            try:
                text = body.get_content()
            except Exception:  # noqa: BLE001 - an unknown character set, say
                text = (body.get_payload(decode=True) or b"").decode(body.get_content_charset() or "utf-8", "replace")
            out.append((f"{name}#body.txt", text.encode("utf-8", "replace")))
    except Exception as e:  # noqa: BLE001
        raise Unusable("corrupt") from e
    if len(out) + len(attached) > most:
        raise Unusable("too_many_children")
    try:
        out += [(a.get_filename() or "attachment", a.get_payload(decode=True) or b"") for a in attached]
    except Exception as e:  # noqa: BLE001
        raise Unusable("corrupt") from e
    if not out:
        raise Unusable("empty")
    return out


LEAF = "name string, content binary, kind string, mime string, quarantine string, parent_sha string, depth int"


def expand(files: DataFrame, depth: int = MOST_DEPTH, most: int = MOST_CHILDREN) -> DataFrame:
    """LEAF of the leaf documents of files (name, content): what isn't a container, and containers that have to be quarantined.

    Archives and mails give their members, nested `depth` deep at most.  Each level is one pass over the containers of
    the level before, whose members are written to the shared folder, so that no level is read twice.
    """
    def children(row: tuple) -> list[tuple]:
        try:
            made = archive_children(bytes(row.content), most) if row.kind == "archive" else mail_children(row.name, bytes(row.content), most)
            return [(n, c, None, None, None, row.sha, row.depth + 1) for n, c in made]
        except Unusable as e:
            return [(row.name, bytes(row.content), row.kind, row.mime, str(e), row.parent_sha, row.depth)]

    level = files.select("name", "content", F.lit(None).cast("string").alias("parent_sha"), F.lit(0).alias("depth"))
    leaves = None
    columns = [c.split()[0] for c in LEAF.split(", ")]
    for i in range(depth + 1):
        known = checkpoint(typed(level))
        box = known.filter("quarantine is null and kind in ('archive', 'email')")
        found = known.filter("quarantine is not null or kind not in ('archive', 'email')")
        if i == depth:
            found = found.unionByName(box.withColumn("quarantine", F.lit("too_deep")))
        leaves = found.select(*columns) if leaves is None else leaves.unionByName(found.select(*columns))
        if i == depth or box.isEmpty():
            return leaves
        made = checkpoint(_rows(box.select("name", "content", "kind", "mime", "parent_sha", "depth", F.sha2("content", 256).alias("sha")), children, LEAF))
        leaves = leaves.unionByName(made.filter("quarantine is not null"))
        level = made.filter("quarantine is null").select("name", "content", "parent_sha", "depth")
    return leaves


def shown_name(label: Column, name: Column, parent_sha: Column) -> Column:
    """What a manifest calls a document: the label that came with a top-level file, a child's own name."""
    return F.when(parent_sha.isNull(), label).otherwise(name)


def distinct_bytes(files: DataFrame) -> DataFrame:
    """One row for each distinct content: sha, size, copies."""
    return files.groupBy(F.sha2("content", 256).alias("sha")).agg(F.max(F.octet_length("content")).alias("size"), F.count("*").alias("copies"))


# Page limits: counts and sizes by headers alone, without a PDF or image library.


def _jpeg_size(data: bytes) -> tuple[int, int]:
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            high, wide = struct.unpack(">HH", data[at + 5 : at + 9])
            return wide, high
        at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD8 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    raise ValueError("no frame header")


def _tiff_pages(data: bytes) -> tuple[int, int, int]:
    order = "<" if data[:2] == b"II" else ">"
    at, pages, size = struct.unpack(order + "I", data[4:8])[0], 0, (0, 0)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack(order + "H", data[at : at + 2])
        tags = {}
        for i in range(n):
            tag, kind, _, value = struct.unpack(order + "HHI4s", data[at + 2 + 12 * i : at + 14 + 12 * i])
            tags[tag] = struct.unpack(order + ("H2x" if kind == 3 else "I"), value)[0]
        size = size if pages else (tags[256], tags[257])
        pages += 1
        (at,) = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])
    return pages, *size


def _gif_frames(data: bytes) -> int:
    colours = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    at, frames = 13 + colours(data[10]), 0
    while data[at] != 0x3B:
        if data[at] == 0x2C:
            frames += 1
            at += 10 + colours(data[at + 9]) + 1
        elif data[at] == 0x21:
            at += 2
        else:
            raise ValueError("no block")
        while data[at]:
            at += 1 + data[at]
        at += 1
    return frames


def image_header(data: bytes, mime: str) -> tuple[int, int]:
    """Pages (frames) and pixels of an image.  HEIC counts as one page of unknown size."""
    if mime == "image/png":
        wide, high = struct.unpack(">II", data[16:24])
    elif mime == "image/gif":
        wide, high = struct.unpack("<HH", data[6:10])
        return _gif_frames(data), wide * high
    elif mime == "image/bmp":
        wide, high = struct.unpack("<ii", data[18:26])
    elif mime == "image/jpeg":
        wide, high = _jpeg_size(data)
    elif mime == "image/tiff":
        pages, wide, high = _tiff_pages(data)
        return pages, wide * high
    elif mime == "image/webp" and data[12:16] == b"VP8X":
        wide, high = (1 + int.from_bytes(data[k : k + 3], "little") for k in (24, 27))
    elif mime == "image/webp" and data[12:16] == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        wide, high = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    elif mime == "image/webp":
        wide, high = (v & 0x3FFF for v in struct.unpack("<HH", data[26:30]))
    else:
        wide, high = 1, 0
    if not wide:
        raise ValueError("no size")
    return 1, abs(wide * high)


_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_ENCRYPTED = re.compile(rb"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<")


def pdf_header(data: bytes) -> tuple[int, str | None]:
    """Pages and fault of a PDF by its trailer and page objects, those in compressed streams included."""
    import zlib

    if b"startxref" not in data:
        return 0, "corrupt"
    if _ENCRYPTED.search(data):
        return 0, "encrypted"
    pages = len(_PAGE.findall(data))
    for m in re.finditer(rb"/Type\s*/ObjStm.*?stream\r?\n", data, re.S):
        try:
            pages += len(_PAGE.findall(zlib.decompressobj().decompress(data[m.end() :])))
        except zlib.error:
            return 0, "corrupt"
    return pages, None


def page_limits(files: DataFrame, most_pages: int = MOST_PAGES, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """name, kind, mime, page_count, quarantine of typed files; only PDFs and images are opened, office and text have no pages."""
    schema = "name string, kind string, mime string, page_count int, quarantine string"

    def probe(r: tuple) -> list[tuple]:
        data, pages, fault = bytes(r.content), 0, None
        try:
            if r.kind == "pdf":
                pages, fault = pdf_header(data)
                fault = fault or ("too_many_pages" if pages > most_pages else None)
            else:
                pages, pixels = image_header(data, r.mime)
                fault = "image_too_large" if pixels > most_pixels else None
        except (struct.error, IndexError, KeyError, ValueError):
            pages, fault = 0, "corrupt"
        return [(r.name, r.kind, r.mime, pages, fault)]

    opened = files.filter("quarantine is null and kind in ('pdf', 'image')")
    rest = files.filter("quarantine is not null or kind not in ('pdf', 'image')")
    return rest.select("name", "kind", "mime", F.lit(0).alias("page_count"), "quarantine").unionByName(_rows(opened.select("name", "kind", "mime", "content"), probe, schema))


def named_segments(jpeg: Column) -> Column:
    """Whether a JPEG's header holds segments that could name its source: comments, and application segments but the first."""
    data = F.hex(jpeg)
    size = F.length(data) / 2
    byte = lambda at: F.conv(F.substring(data, 2 * at + 1, F.lit(2)), 16, 10).cast("int")
    start = F.struct(F.lit(2).alias("at"), F.lit(False).alias("found"), F.lit(True).alias("on"))

    def step(s: Column, _: Column) -> Column:
        mark, length = byte(s["at"] + 1), byte(s["at"] + 2) * 256 + byte(s["at"] + 3)
        on = s["on"] & (s["at"] + 4 <= size) & (byte(s["at"]) == 255) & ~mark.isin(0xDA, 0xD9)
        found = on & ((mark == 0xFE) | mark.between(0xE1, 0xEF))
        return F.struct(F.when(on, s["at"] + 2 + length).otherwise(s["at"]).alias("at"), (s["found"] | F.coalesce(found, F.lit(False))).alias("found"), F.coalesce(on & ~found, F.lit(False)).alias("on"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step)["found"]  # 64 segments, far more than headers have
