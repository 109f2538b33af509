"""Routing policy as Column expressions: trust gate, rule table, review, modifiers, calibrated lookup."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Questions whose answers make a page complex or degraded.  Fixed values.
COMPLEX = ("complex_layout", "has_code", "has_table", "is_form", "has_math")
DEGRADED = ("camera_or_fax", "heavily_degraded", "capture_defects")
#: Rank of lanes that a document can be sent to; review and quarantine have none.  Fixed values.
RANK = {"L0": 0, "L1": 1, "L2": 2, "L3": 3, "L4": 4, "L5": 5}
#: Scripts that are flagged, and what reasons say.  Fixed values.
FLAGGED_SCRIPTS = ("cjk", "arabic", "hebrew", "cyrillic", "greek")
TRUSTED, UNTRUSTED, COMPLEX_LAYOUT, SIMPLE_LAYOUT, HANDWRITTEN, DEGRADED_PAGE, CLEAN_PAGE = "trusted text layer", "no trusted text", "complex layout", "simple layout", "mostly handwritten", "degraded or photo/fax", "clean image"


def two_places(p: Column) -> Column:
    """p with two decimals, halves up."""
    n = F.floor(p * 100 + 0.5).cast("int")
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def trusted(chars: Column, unreadable: Column, cid: Column, odd: Column, hidden: Column, coverage: Column) -> Column:
    """Whether a PDF's text layer can be taken as it is."""
    return (chars > 50) & ~(hidden & (coverage > 0.9)) & (unreadable == "") & (cid < 0.05) & (odd < 0.05)


def best_of(answers, names: tuple[str, ...]) -> Column:
    return F.greatest(*[F.coalesce(answers(n), F.lit(0.0)) for n in names])


class Rules:
    """The rule table over an answer lookup (name -> Column): handwriting, then trust, then condition."""

    def __init__(self, answers):
        self.answers = answers
        self.hand, self.trust = F.coalesce(answers("mostly_handwritten"), F.lit(0.0)), F.coalesce(answers("text_layer_trustworthy"), F.lit(0.0))
        self.complexity, self.bad = best_of(answers, COMPLEX), best_of(answers, DEGRADED)

    def _branch(self, l5, l2, l1, l4, l3) -> Column:
        at_least = lambda c: c >= 0.5
        return F.when(at_least(self.hand), l5).when(at_least(self.trust) & at_least(self.complexity), l2).when(at_least(self.trust), l1).when(at_least(self.bad), l4).otherwise(l3)

    def lane(self) -> Column:
        return self._branch(*map(F.lit, ("L5", "L2", "L1", "L4", "L3")))

    def path(self) -> Column:
        """Product of the answers along the branch, not rounded."""
        printed = 1 - self.hand
        return self._branch(self.hand, printed * self.trust * self.complexity, printed * self.trust * (1 - self.complexity), printed * (1 - self.trust) * self.bad, printed * (1 - self.trust) * (1 - self.bad))

    def reasons(self) -> Column:
        say = lambda what, p: F.concat(F.lit(f"{what} ("), two_places(p), F.lit(")"))
        layer, none = say(TRUSTED, self.trust), say(UNTRUSTED, 1 - self.trust)
        return self._branch(
            F.array(say(HANDWRITTEN, self.hand)),
            F.array(layer, say(COMPLEX_LAYOUT, self.complexity)),
            F.array(layer, say(SIMPLE_LAYOUT, 1 - self.complexity)),
            F.array(none, say(DEGRADED_PAGE, self.bad)),
            F.array(none, say(CLEAN_PAGE, 1 - self.bad)),
        )

    def modifiers(self, lane: Column, columns: Column, script: Column) -> Column:
        """Sorted, distinct."""
        asked = [F.when(self.answers(k) >= 0.5, F.lit(v)) for k, v in (("has_table", "table"), ("has_math", "math"), ("has_code", "code"), ("is_form", "form"))]
        more = [
            F.when((lane != "L5") & (self.answers("has_handwriting") >= 0.5), F.lit("handwriting")),
            F.when(columns == 2, F.lit("multi_column")),
            F.when(script.isin(*FLAGGED_SCRIPTS), F.concat(F.lit("script_"), script)),
            F.when(script.isin("arabic", "hebrew"), F.lit("rtl")),
        ]
        return F.array_sort(F.array_distinct(F.array_compact(F.array(*asked, *more))))


def reviewed(lane: Column, p: Column, least) -> Column:
    """The final lane: LH where the probability is below the threshold."""
    return F.when(p < least, F.lit("LH")).otherwise(lane)


def confidence(curves: Column, lane: Column, p: Column) -> Column:
    """Calibrated probability by the lane's curve in a map of curves, or by the pooled one ('*') where it has none."""
    return interpolate(F.coalesce(F.try_element_at(curves, lane), F.element_at(curves, F.lit("*"))), p)


def review(candidate: Column, path: Column, calibrated: Column, threshold: Column, raw: float) -> tuple[Column, Column]:
    """Final lane, and why it is review (null if it isn't): by the calibrated probability where there is one, else by the raw path."""
    low = lambda how, p, least: F.concat(F.lit(f"low confidence ({how} "), two_places(p), F.lit(" < "), two_places(least), F.lit(")"))
    why = F.when(calibrated.isNotNull(), F.when(calibrated < threshold, low("calibrated", calibrated, threshold))).when(path < raw, low("path", path, F.lit(raw)))
    return F.when(why.isNotNull(), F.lit("LH")).otherwise(candidate), why


def interpolate(knots: Column, p: Column) -> Column:
    """Piecewise-linear curve through knots (array<struct<x, y>>, ascending x), level beyond both ends."""
    first, last = F.element_at(knots, 1), F.element_at(knots, -1)
    below = F.element_at(F.filter(knots, lambda k: k["x"] <= p), -1)
    above = F.element_at(F.filter(knots, lambda k: k["x"] > p), 1)
    between = below["y"] + (p - below["x"]) / (above["x"] - below["x"]) * (above["y"] - below["y"])
    return F.when(p <= first["x"], first["y"]).when(p >= last["x"], last["y"]).otherwise(between)


def rank(lane: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), lane)


def least_rank(gt: Column) -> Column:
    """Smallest rank in a set of lanes; null if none has one."""
    return F.array_min(F.array_compact(F.transform(gt, rank)))


def digest_of(parts: dict, length: int = 16) -> str:
    """Beginning of the SHA-256 of what decides a result, in canonical JSON; equal digests allow reuse."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:length]


def job_id(content: Column, route_key: str) -> Column:
    """Key of a job by content and configuration: 16 digits of the content's SHA-256 and 8 of the route's key."""
    return F.concat(F.left(F.sha2(content, 256), F.lit(16)), F.lit("-" + route_key[:8]))
