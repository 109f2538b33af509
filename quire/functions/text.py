"""Text-layer measures of a page as Column expressions (built-ins only, so they stay in the JVM)."""

from __future__ import annotations

from string import ascii_letters

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space and the four separators that count as such, as Java regex.
SPACE = r"(?U)[\s\x1C-\x1F]+"
#: Ends of lines.
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
#: Scripts and their patterns.  Fixed values.
SCRIPTS = {"latin": r"\p{IsLatin}", "cjk": r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", "arabic": r"\p{IsArabic}", "cyrillic": r"\p{IsCyrillic}"}
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
#: Why a text can't be language.  Fixed phrases, which go into the evidence.
BAD_CHARACTERS, ONE_LETTER, RUN_TOGETHER, NO_LANGUAGE = "control or undefined characters", "many one-letter fragments", "words run together without spaces", "does not read as text in any language"
#: From what readability on a layer reads as text, and fewer letters than can be judged.  Fixed values.
READABLE, LEAST_LETTERS, CHUNK_LETTERS = 0.2, 20, 5
#: Stored text of a page at most; measures are taken of all of it.
STORED_CHARS = 50_000


def count_of(text: Column, kind: str) -> Column:
    """Number of characters of a class (what stands between its brackets): what is left without the runs of others.

    regexp_count makes a list of all matches, which costs most where a page is full of them; so does matching them one by one.
    """
    return F.length(F.regexp_replace(text, f"[^{kind}]+", ""))


def _count(text: Column, pattern: str) -> Column:
    """Matches of a pattern that is never empty."""
    return F.array_size(F.split(text, pattern, -1)) - 1


def _once(value: Column, use) -> Column:
    """use(value) with value computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _at_least_one(c: Column) -> Column:
    return F.greatest(c, F.lit(1))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def chars(text: Column) -> Column:
    return F.length(strip(text))


def cid_share(text: Column) -> Column:
    return _count(text, r"\(cid:[0-9]+\)") * 7 / _at_least_one(F.length(text))


def odd_char_share(text: Column) -> Column:
    return count_of(text, r"\p{Co}\p{Cn}\p{So}\x{FFFD}") / _at_least_one(F.length(text))


def short_token_share(text: Column) -> Column:
    return _once(tokens(text), lambda all_: F.size(F.filter(all_, lambda t: F.length(t) < 2)) / _at_least_one(F.size(all_)))


def math_share(text: Column) -> Column:
    return count_of(text, r"\p{Sm}\x{0370}-\x{03FF}\x{1D400}-\x{1D7FF}") / _at_least_one(F.length(F.regexp_replace(text, r"(?U)\s+", "")))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^" + SPACE, ""), SPACE + "$", "")


def script_shares(text: Column) -> Column:
    """array<struct<script, share>> of the scripts of a text's letters, shares to two places, the script seen first in front."""
    kinds = {k: rf"[{p}&&[\p{{L}}]]" for k, p in SCRIPTS.items()} | {"other": r"[\p{L}&&[^" + "".join(p.strip("[]") for p in SCRIPTS.values()) + "]]"}
    # a script's letters are counted only where there is one
    share = lambda at, p, letters: F.when(at > 0, F.round(count_of(text, p) / letters, 2))
    one = lambda k, p, letters: _once(F.regexp_instr(text, F.lit(p)), lambda at: F.struct(at.alias("at"), F.lit(k).alias("script"), share(at, p, letters).alias("share")))
    found = _once(_at_least_one(count_of(text, r"\p{L}")), lambda letters: F.array(*[one(k, p, letters) for k, p in kinds.items()]))
    return F.transform(F.array_sort(F.filter(found, lambda s: s["at"] > 0)), lambda s: F.struct(s["script"].alias("script"), s["share"].alias("share")))


def dominant_script(shares: Column) -> Column:
    """The script with the largest share, the one seen first on a tie; '' where there is none."""
    best = F.aggregate(shares, F.struct(F.lit("").alias("script"), F.lit(-1.0).alias("share")), lambda a, s: F.when(s["share"] > a["share"], s).otherwise(a))
    return best["script"]


def units(text: Column) -> Column:
    """Distinct words of three letters or more, and character pairs of scripts without spaces."""
    lowered = F.lower(text)
    among = rf"[[^\x00-\x7F]&&{UNSPACED}]"  # the scripts of each character are looked up one after the other
    words = F.filter(F.split(F.regexp_replace(lowered, among + "+", " "), r"[^a-z\p{L}\p{M}]+"), lambda w: F.length(w) >= 3)
    unspaced = F.regexp_extract_all(lowered, F.lit(among + "{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(unspaced, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_union(words, pairs)


def agreement(a: Column, b: Column) -> Column:
    """Jaccard likeness of the units of a layer and of a reading, to three places; null if the layer has none."""
    likeness = lambda x, y, both: F.when(x > 0, F.round(both / (x + y - both), 3))
    sizes = _once(F.struct(units(a).alias("a"), units(b).alias("b")), lambda u: F.struct(F.size(u["a"]).alias("a"), F.size(u["b"]).alias("b"), F.size(F.array_intersect(u["a"], u["b"])).alias("both")))
    return _once(sizes, lambda n: likeness(n["a"], n["b"], n["both"]))


def guard(text: Column) -> Column:
    """Why a text can't be language, or '': unusual characters, single letters, or runs without spaces."""
    bad = count_of(text, r"[\p{Cc}\p{Cn}\p{Cs}\x{FFFD}&&[^\t\n\r\f]]")
    # letters of each word: what is neither letter nor space goes first
    words = F.transform(tokens(F.regexp_replace(text, r"(?U)[^\p{L}\s\x1C-\x1F]+", "")), F.length)
    among = lambda words, least, most: F.filter(words, lambda n: n.between(least, most))
    in_all = lambda words: F.aggregate(words, F.lit(0), lambda s, n: s + n)
    made = lambda w: F.struct(F.size(w).alias("n"), F.size(among(w, 1, 1)).alias("singles"), in_all(w).alias("total"), in_all(among(w, 25, 2**31 - 1)).alias("long"))

    def told(w: Column) -> Column:
        spaced = w["unspaced"] <= 0.3 * w["c"]["total"]  # every letter is in a word
        one_letter = spaced & (w["c"]["n"] > 0) & (2 * w["c"]["singles"] >= w["c"]["n"])
        run_together = spaced & (w["c"]["total"] > 0) & (w["c"]["long"] >= 0.6 * w["c"]["total"])
        return F.when(one_letter, ONE_LETTER).when(run_together, RUN_TOGETHER).otherwise("")

    counted = F.struct(_once(words, made).alias("c"), count_of(text, UNSPACED[1:-1]).alias("unspaced"))
    return F.when(bad >= 0.02 * _at_least_one(F.length(text)), BAD_CHARACTERS).otherwise(_once(counted, told))


def chunks(text: Column, width: int = 80, tail: int = 40) -> Column:
    """Lines, stripped, joined by blanks until `width` characters; a last piece under `tail` joins the one before."""
    lines = F.filter(F.transform(F.split(text, BREAK), strip), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    join = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit(" "), b))

    def step(s: Column, line: Column) -> Column:
        grown = join(s["open"], line)
        full = F.length(grown) >= width
        return F.struct(F.when(full, F.array_append(s["done"], grown)).otherwise(s["done"]).alias("done"), F.when(full, F.lit("")).otherwise(grown).alias("open"))

    def close(s: Column) -> Column:
        short = (F.length(s["open"]) < tail) & (F.size(s["done"]) > 0)
        merged = F.array_append(F.slice(s["done"], F.lit(1), F.greatest(F.size(s["done"]) - 1, F.lit(0))), F.concat(F.element_at(s["done"], -1), F.lit(" "), s["open"]))
        return F.when(s["open"] == "", s["done"]).when(short, merged).otherwise(F.array_append(s["done"], s["open"]))

    return F.aggregate(lines, start, step, close)


def cleaned(chunk: Column) -> Column:
    """What a language model is shown of a chunk: lower case, letters, marks and single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(chunk, SPACE, " ")), r"(?U)[^\p{L}\p{M}\s]+", ""))  # blanks are the only space left


def with_language(rows: DataFrame, scored, text: str = "text") -> DataFrame:
    """rows with language, readability, unreadable of their text, by a vote of its chunks weighted by their letters.

    scored(cleaned chunk) -> struct<code, p> stands for the language model; code 'zxx' is no language.  Readability is
    the weight of real language, null if there are too few letters; a language needs half of that weight.  Each step is
    a column of its own, so that none is computed twice.
    """
    plain = F.translate(F.replace(F.col(text), F.lit("\uFFFE"), F.lit("")), "\u1361", " ")
    mass = lambda v: v["letters"] * F.least(F.lit(1.0), v["said"]["p"])
    judged = F.transform("_chunks", lambda c: F.struct(count_of(c, r"\p{L}").alias("letters"), cleaned(c).alias("clean")))
    votes = F.transform(F.filter("_judged", lambda c: (c["letters"] >= CHUNK_LETTERS) & (c["clean"] != "")), lambda c: F.struct(c["letters"].alias("letters"), scored(c["clean"]).alias("said")))
    real = F.transform(F.filter("_votes", lambda v: v["said"]["code"] != "zxx"), lambda v: F.struct(v["said"]["code"].alias("code"), mass(v).alias("mass")))
    of = lambda code: F.aggregate(F.filter("_real", lambda v: v["code"] == code), F.lit(0.0), lambda s, v: s + v["mass"])
    each = F.transform(F.array_distinct(F.transform("_real", lambda v: v["code"])), lambda c: F.struct(c.alias("code"), of(c).alias("mass")))
    steps = {
        "_plain": plain,
        "_why": guard(F.col("_plain")),
        "_chunks": chunks(F.col("_plain")),
        "_judged": judged,
        "_votes": votes,
        "_weight": F.aggregate("_votes", F.lit(0), lambda s, v: s + v["letters"]),
        "_real": real,
        "_total": F.aggregate("_real", F.lit(0.0), lambda s, v: s + v["mass"]),
        "_top": F.aggregate(each, F.struct(F.lit("").alias("code"), F.lit(0.0).alias("mass")), lambda a, c: F.when(c["mass"] > a["mass"], c).otherwise(a)),
        "_share": F.round(F.col("_total") / _at_least_one(F.col("_weight")), 3),
    }
    for name, step in steps.items():
        rows = rows.withColumn(name, step)
    why, few = F.col("_why"), F.col("_weight") < LEAST_LETTERS
    made = {
        "language": F.when((why != "") | few, F.lit("")).when(F.col("_top.mass") >= 0.5 * F.col("_total"), F.col("_top.code")).otherwise(""),
        "readability": F.when(why != "", F.lit(0.0)).when(few, F.lit(None).cast("double")).otherwise(F.col("_share")),
        "unreadable": F.when(why != "", why).when(few | (F.col("_share") >= READABLE), F.lit("")).otherwise(NO_LANGUAGE),
    }
    return rows.withColumns(made).drop(*steps)


def by_profile(profiles: dict[str, tuple[str, ...]]):
    """A small stand-in for a language model: the code whose frequent words make up most of a chunk's words, or zxx."""

    def scored(clean: Column) -> Column:
        among = lambda words, frequent: F.size(F.filter(words, lambda w: w.isin(*frequent)))
        best = lambda words: F.array_max(F.array(*[F.struct(among(words, frequent).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("code")) for i, (k, frequent) in enumerate(profiles.items())]))
        found = _once(F.split(clean, " "), lambda words: F.struct(best(words).alias("best"), F.size(words).alias("words")))
        said = lambda n, code, words: F.struct(F.when(n > 0, code).otherwise("zxx").alias("code"), F.least(F.lit(1.0), n * 4.0 / words).alias("p"))
        return _once(found, lambda f: said(f["best"]["n"], f["best"]["code"], f["words"]))

    return scored


def common_share(text: Column, common: tuple[str, ...]) -> Column:
    """Share of a text's words (letters and apostrophes) that are frequent words; 0 without words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z']+"), F.lit(0))
    return F.size(F.filter(words, lambda w: w.isin(*common))) / _at_least_one(F.size(words))


def odd_body_share(text: Column) -> Column:
    """Share of private-use, unassigned, control and replacement characters, white space left out."""
    body = F.regexp_replace(text, SPACE, "")
    return count_of(body, r"\p{Co}\p{Cn}\p{Cc}\x{FFFD}") / _at_least_one(F.length(body))


def stored(text: Column) -> Column:
    return F.left(text, F.lit(STORED_CHARS))


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def garble_cid(text: Column) -> Column:
    """A layer as some broken fonts give it: each ASCII letter as its code.  All are made one letter first, since a match for each costs more."""
    return F.replace(F.translate(text, ascii_letters[1:], "a" * 51), F.lit("a"), F.lit("(cid:12)"))


def garble_codes(text: Column) -> Column:
    """Every letter as a code that depends on it: its code point modulo 97, plus 3."""
    one = lambda c: F.when(c.rlike(r"^\p{L}$"), F.concat(F.lit("(cid:"), (F.ascii(c) % 97 + 3).cast("string"), F.lit(")"))).otherwise(c)
    return F.array_join(F.transform(characters(text), one), "")


def garble_shift(text: Column, by: int = 29) -> Column:
    """Every letter `by` code points further, as glyph numbers without a table of characters come out.  Letters of the basic plane."""
    code = lambda c: F.decode(F.unhex(F.lpad(F.hex(F.ascii(c) + by), 4, "0")), "UTF-16BE")
    return F.array_join(F.transform(characters(text), lambda c: F.when(c.rlike(r"^\p{L}$"), code(c)).otherwise(c)), "")


def garble_bytes(text: Column) -> Column:
    """UTF-8 read as Latin-1, each e doubled that way and each a lost."""
    read = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.replace(F.replace(read, F.lit("e"), F.lit("Ã©")), F.lit("a"), F.lit(""))
