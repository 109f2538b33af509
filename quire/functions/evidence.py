"""Measures put into words: frozen bins and phrases, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATH_SHARE = 0.008
#: Characters of a page's and of the previous page's text that are shown.  Fixed values.
SAMPLE_CHARS, PREVIOUS_CHARS = 1200, 600
#: Bounds of the bins (upper ones are exclusive) with their phrases, in order; the last has no bound.  Fixed values.
AMOUNT = [(100, "only a few words"), (500, "a short amount of text"), (None, "a full page of text")]
SHARPNESS = [(300, "very soft or blurry"), (1500, "somewhat soft"), (None, "sharp")]
CONTRAST = [(25, "low contrast"), (None, "normal contrast")]
BACKGROUND = [(235, "grey or tinted paper background"), (None, "white paper background")]
#: Bounds that a value has to exceed, or to reach where `reach` is said, from the highest; the last has no bound.  Fixed values.
COLOUR = [(15, "colourful"), (3, "some colour"), (None, "greyscale")]
COVERAGE = [(0.9, "the page is one full-page image"), (0.3, "images cover a large part of the page"), (None, "little or no image content")]
AGREEMENT = [
    (0.5, "The embedded text layer and a fresh OCR pass mostly agree."),
    (0.2, "The embedded text layer and a fresh OCR pass partly agree."),
    (None, "The embedded text layer and a fresh OCR pass mostly disagree, so the layer is probably not a faithful copy of the page."),
]
#: Phrases on page edges, on text layers and on PDFs.  Fixed values.
DARK_EDGES = "dark or coloured surroundings at the page edges, as when a page is photographed on a surface"
UNEVEN_EDGES, CLEAN_EDGES, NOISE, BILEVEL = "uneven or speckled page edges", "clean white page edges", "visible pixel noise", "almost only pure black and pure white pixels"
CODES, ODD, FRAGMENTS, MATHS = "contains encoding codes like (cid:NN)", "many unusual or private-use symbols", "many one-letter fragments", "frequent mathematical symbols or operators"
IMAGE_INPUT, PDF_INPUT = "Input: an image file (JPEG) with no embedded text.", "Input: a one-page PDF"
HIDDEN, SCANNED = "its text layer is hidden behind or under the page image, typical of an earlier OCR pass", "made by scanning or OCR software ("
MATH_FONTS, NO_MATHS, MONO_FONTS = "uses mathematical fonts", "no mathematical fonts or symbols", "uses monospaced fonts"
PRODUCERS = ("Tesseract", "ABBYY", "img2pdf")
TWO_COLUMNS, ONE_COLUMN = "text is laid out in two or more columns", "text is in a single column"
SCRIPT_NAMES = {"latin": "Latin letters", "cjk": "Chinese, Japanese or Korean characters", "arabic": "Arabic letters", "cyrillic": "Cyrillic letters", "other": "letters of another script"}
UNREADABLE = "does not read as text in any language"


def _named(names: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key), key)


def _sentence(head: str, parts: list[Column]) -> Column:
    """Parts that aren't null, joined by commas."""
    return F.concat(F.lit(head), F.concat_ws(", ", *parts), F.lit("."))


def _below(value: Column, bins: list) -> Column:
    """Phrase of the first bin whose bound value is below."""
    *bounded, (_, last) = bins
    out = F
    for bound, said in bounded:
        out = out.when(value < bound, F.lit(said))
    return out.otherwise(F.lit(last))


def _above(value: Column, bins: list, reach: bool = False) -> Column:
    """Phrase of the first bin whose bound value exceeds (or reaches)."""
    *bounded, (_, last) = bins
    out = F
    for bound, said in bounded:
        out = out.when(value >= bound if reach else value > bound, F.lit(said))
    return out.otherwise(F.lit(last))


def reads(unreadable: Column, readability: Column, language: Column) -> Column:
    known = language != ""
    return (
        F.when(unreadable != "", F.concat(F.lit(UNREADABLE), F.when(unreadable != UNREADABLE, F.concat(F.lit(": "), unreadable)).otherwise(F.lit(""))))
        .when(readability.isNull(), F.lit("mostly numbers and symbols"))
        .when((readability >= 0.5) & known, F.concat(F.lit("reads as "), language, F.lit(" text")))
        .when(readability >= 0.5, F.lit("reads as text in several languages"))
        .otherwise(F.concat(F.lit("partly reads as "), F.when(known, language).otherwise(F.lit("text")), F.lit(": names, numbers, table cells or fragments")))
    )


def describe_text(what: str, chars: Column, reading: Column, cid: Column, odd: Column, short: Column, math: Column, script: Column, unreadable: Column) -> Column:
    flags = [(cid > 0.05, CODES), (odd > 0.05, ODD), ((short > 0.35) & ~unreadable.contains("one-letter"), FRAGMENTS), (math >= MATH_SHARE, MATHS)]
    most = F.when(script != "", F.concat(F.lit("mostly "), _named(SCRIPT_NAMES, script)))
    parts = [_below(chars, AMOUNT), reading, *[F.when(test, F.lit(said)) for test, said in flags], most]
    return F.when(chars == 0, F.lit(f"{what}: none.")).otherwise(_sentence(f"{what}: ", parts))


def describe_image(sharpness: Column, contrast: Column, border_mean: Column, border_std: Column, background: Column, colour: Column, noise: Column, bilevel: Column) -> Column:
    edges = F.when(border_mean < 200, DARK_EDGES).when(border_std > 20, UNEVEN_EDGES).otherwise(CLEAN_EDGES)
    flags = [F.when(noise >= 2, F.lit(NOISE)), F.when((bilevel > 0.95) & (contrast < 30), F.lit(BILEVEL))]
    return _sentence("Page image: ", [_below(sharpness, SHARPNESS), _below(contrast, CONTRAST), edges, _below(background, BACKGROUND), _above(colour, COLOUR), *flags])


def coarse_count(n: Column, noun: str) -> Column:
    return F.when(n == 0, F.lit(f"no {noun}s")).when(n == 1, F.lit(f"1 {noun}")).when(n < 5, F.concat(n.cast("string"), F.lit(f" {noun}s"))).otherwise(F.lit(f"many {noun}s"))


def columns_phrase(columns: Column) -> Column:
    return F.when(columns == 2, F.lit(TWO_COLUMNS)).when(columns == 1, F.lit(ONE_COLUMN))


def describe_layout(tables: Column, formulas: Column, figures: Column, figure_area: Column, columns: Column) -> Column:
    figure = F.concat(coarse_count(figures, "figure"), F.when(figure_area >= 0.6, " covering most of the page").otherwise(""))
    return _sentence("Layout: ", [coarse_count(tables, "table"), coarse_count(formulas, "formula block"), figure, columns_phrase(columns)])


def describe_structure(is_pdf: Column, coverage: Column, hidden: Column, producer: Column, math_font: Column, mono_font: Column, chars: Column, math: Column, columns: Column) -> Column:
    """Sentence on a page's structure; columns is null where the layout's sentence tells them."""
    scanner = F.exists(F.array(*map(F.lit, PRODUCERS)), lambda p: producer.contains(p))
    parts = [
        F.lit(PDF_INPUT),
        _above(coverage, COVERAGE),
        F.when(hidden & (coverage > 0.9), F.lit(HIDDEN)),
        F.when(scanner, F.concat(F.lit(SCANNED), F.element_at(F.split(F.trim(producer), r"\s+"), 1), F.lit(")"))),
        F.when(math_font, F.lit(MATH_FONTS)).when((chars > 0) & (math < MATH_SHARE), F.lit(NO_MATHS)),
        F.when(mono_font, F.lit(MONO_FONTS)),
        columns_phrase(columns),
    ]
    return F.when(is_pdf, _sentence("", parts)).otherwise(F.lit(IMAGE_INPUT))


def describe_agreement(a: Column) -> Column:
    return F.when(a.isNotNull(), _above(a, AGREEMENT, reach=True))


def state(is_pdf: Column, sentences_: list[Column], text: Column, vision: Column, previous: Column) -> Column:
    """struct<page_evidence, embedded_text_sample, vision_check, previous_page_text_sample> that answers are asked on; null parts weren't shown."""
    return F.struct(
        F.concat_ws(" ", *sentences_).alias("page_evidence"),
        F.when(is_pdf, F.left(text, F.lit(SAMPLE_CHARS))).alias("embedded_text_sample"),
        vision.alias("vision_check"),
        F.when(previous != "", F.right(previous, F.lit(PREVIOUS_CHARS))).alias("previous_page_text_sample"),
    )


# The phrases of the vision check.
LEGIBILITY = {"clean": "every character is easy to read", "mild_issues": "some characters are harder to read", "hard_to_read": "much of the text is hard to read", "illegible": "the text is illegible", "unsure": "unclear"}
CAPTURE = {"digital_render": "a digital render, not a photo, scan or fax", "flatbed_scan": "a flatbed scan, not a camera photo or fax", "fax": "a fax", "camera_photo": "a camera photo of a physical page", "screenshot": "a screenshot, not a photo, scan or fax", "unsure": "unclear"}
HANDWRITING = {"none": "no handwriting", "annotations_only": "a printed page with only handwritten notes, marks or signatures", "fields_filled_by_hand": "a printed form whose fields are filled in by hand", "mostly_handwritten": "mostly handwritten", "unsure": "unclear"}
DEFECTS = {"photocopy": "photocopy artefacts", "bleed_through": "bleed-through from the reverse side", "curved_page": "curved or warped paper", "heavy_speckle": "heavy speckle", "faded_text": "faded or broken characters"}
SOFT_DEFECTS = ("photocopy", "bleed_through", "heavy_speckle", "faded_text")
CONTENT = ("table", "math", "form", "code", "chart", "photo")


def describe_vision(capture: Column, legibility: Column, handwriting: Column, defects: Column, content: Column, script: Column) -> Column:
    """Sentence on a vision check; defects and content are arrays of codes, null capture means that there was none.

    A page that reads as clean keeps only the defects that bend its lines.  Unknown codes stand for themselves.
    """
    found = [F.when(F.array_contains(defects, k) & (F.lit(k not in SOFT_DEFECTS) | (legibility != "clean")), F.lit(said)) for k, said in DEFECTS.items()]
    flags = [F.when(F.array_contains(content, k), F.lit(k)) for k in CONTENT]
    listed = lambda parts, none: F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit(none))
    said = F.concat(
        F.lit("Vision check of the page image: capture looks like "), _named(CAPTURE, capture),
        F.lit("; legibility: "), _named(LEGIBILITY, legibility),
        F.lit("; defects that make characters harder to read: "), listed(found, "none"),
        F.lit("; handwriting: "), _named(HANDWRITING, handwriting),
        F.lit("; contains "), listed(flags, "plain text only"),
        F.lit("; main script "), script, F.lit("."),
    )
    return F.when(capture.isNull(), "Vision check: unavailable.").otherwise(said)


def sentences(said: Column) -> Column:
    """Array of (topic, text): sentences of evidence; the topic is what stands before a colon, if short."""
    head = r"^([A-Z][A-Za-z ]{2,28}):\s+(.*)$"
    parts = F.filter(F.split(said, r"(?<=\.)\s+(?=[A-Z])"), lambda s: s != "")
    return F.transform(parts, lambda s: F.struct(F.regexp_extract(s, head, 1).alias("topic"), F.when(s.rlike(head), F.regexp_extract(s, head, 2)).otherwise(s).alias("text")))
