"""Measures of page pictures, of objects on a page and of fonts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.shipping import ship

#: Patterns of fonts; the second knows no case.  Fixed values.
MATH_FONT, MONO_FONT = r"CMMI|CMSY|CMEX|Math|STIX|MSBM", r"(?i)Courier|Mono|Consol|Menlo|CMTT"
#: Dark and light bounds of two-level pictures, the background's percentile, the border's share and least width.  Fixed values.
DARK, LIGHT, BACKGROUND, BORDER, LEAST_BORDER = 30, 225, 90, 0.03, 4
MEASURES = "sharpness double, contrast double, noise double, bilevel_share double, background_mean double, border_mean double, border_std double, colour double"


def grey_of(blue: np.ndarray, green: np.ndarray, red: np.ndarray) -> np.ndarray:
    return np.floor(0.114 * blue + 0.587 * green + 0.299 * red + 0.5)


def quality(blue: np.ndarray, green: np.ndarray, red: np.ndarray) -> tuple[float, ...]:
    """MEASURES of a picture (arrays of its height and width, 0 to 255)."""
    grey = grey_of(blue, green, red)
    mirrored = np.pad(grey, 1, mode="reflect")
    laplace = mirrored[:-2, 1:-1] + mirrored[2:, 1:-1] + mirrored[1:-1, :-2] + mirrored[1:-1, 2:] - 4 * grey
    held = np.lib.stride_tricks.sliding_window_view(np.pad(grey, 1, mode="edge"), (3, 3))
    noise = np.abs(grey - np.median(held.reshape(*grey.shape, 9), axis=2))
    wide = max(LEAST_BORDER, int(BORDER * min(grey.shape)))
    border = np.concatenate([part.ravel() for part in (grey[:wide], grey[-wide:], grey[:, :wide], grey[:, -wide:])])
    top, low = np.maximum(np.maximum(blue, green), red), np.minimum(np.minimum(blue, green), red)
    saturation = np.floor(np.where(top > 0, 255 * (top - low) / np.maximum(top, 1), 0) + 0.5)
    return tuple(float(x) for x in (laplace.var(), grey.std(), np.median(noise), ((grey <= DARK) | (grey >= LIGHT)).mean(), np.percentile(grey, BACKGROUND), border.mean(), border.std(), saturation.mean()))


def measured(pictures: DataFrame) -> DataFrame:
    """id and MEASURES of pictures (id, width, blue, green, red: arrays row by row); null where a picture can't be measured."""
    ship(pictures.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                try:
                    rows.append((r.id, *quality(*(np.asarray(c, dtype=float).reshape(-1, r.width) for c in (r.blue, r.green, r.red)))))
                except (ValueError, TypeError):  # no picture: measured as nothing, as a failed probe is
                    rows.append((r.id, *[None] * 8))
            yield pd.DataFrame(rows, columns=["id", *[m.split()[0] for m in MEASURES.split(", ")]])

    return pictures.select("id", "width", "blue", "green", "red").mapInPandas(run, f"id long, {MEASURES}")


def fonts(names: Column) -> Column:
    """struct<math_font, mono_font> of an array of font names."""
    return F.struct(F.exists(names, lambda f: f.rlike(MATH_FONT)).alias("math_font"), F.exists(names, lambda f: f.rlike(MONO_FONT)).alias("mono_font"))


def page_bounds(box: Column, forms: Column) -> Column:
    """struct<left, bottom, right, top> in the page's space of a box in its form's space.

    forms: array<struct<a, b, c, d, e, f>> of the matrices of the forms around the box, the innermost first; each
    takes (x, y) to (a x + c y + e, b x + d y + f).  The four corners go through all of them.
    """
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corners = F.array(*[point(box[x], box[y]) for x in ("left", "right") for y in ("bottom", "top")])
    through = lambda m, p: point(m["a"] * p["x"] + m["c"] * p["y"] + m["e"], m["b"] * p["x"] + m["d"] * p["y"] + m["f"])
    moved = F.aggregate(forms, corners, lambda at, m: F.transform(at, lambda p: through(m, p)))
    xs, ys = F.transform(moved, lambda p: p["x"]), F.transform(moved, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("bottom"), F.array_max(xs).alias("right"), F.array_max(ys).alias("top"))


def read_lines(lines: DataFrame) -> DataFrame:
    """page, text, confidence, lines of a reading's lines (page, at, text, confidence): the mean confidence, 0 without lines."""
    got = lines.groupBy("page").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text")))).alias("found"), F.avg(F.when(F.col("text").isNotNull(), F.col("confidence"))).alias("mean"))
    return got.select("page", F.array_join(F.transform("found", lambda x: x["text"]), "\n").alias("text"), F.coalesce("mean", F.lit(0.0)).alias("confidence"), F.size("found").alias("lines"))
