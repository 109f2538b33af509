"""Conversation structure repair: the cheapest edits that give a conversation legal turns.

Legal role initials are `(s?(ua)+)?`.  The repair is a subsequence of retained turns, each kept or
reroled.  What lies between two retained turns is deleted, at a price that is a difference of prefix
sums, and the roles of the two say how many turns have to be inserted there.  So one value for each
role that the last retained turn can have is enough: the running minimum of price up to that turn
less the deletions up to it, to which the deletions so far are added.  Equal prices are decided by
the smaller audit, the string of the edits' initials.

The values' audits soon agree on what lies behind.  That part is decided, written out and forgotten,
so that a conversation is read as a stream: what is held of it are the undecided turns (and of turns
that must go, nothing but their letter), 16 bytes of each different turn to tell duplicates, and the
audit, which is a result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.shipping import map_arrow

BLANK = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, RENAME, ADD, CUT_OFF = 4, 3, 3, 3
#: Pairs of neighbouring initials that are legal.
NEXT = {"su", "ua", "au"}
#: Turns to insert between two retained ones: (last role, next role) -> number.  "" is the beginning.
GAP = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "u"): 1, ("u", "a"): 0, ("a", "u"): 0, ("a", "a"): 1}
#: Turns to insert behind the last one.
TAIL = {"": 0, "s": 2, "u": 1, "a": 0}
#: Letters that may be undecided before the values are asked for what they have in common.
PENDING = 64
LONG = {"u": "user", "a": "assistant"}
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Repair:
    """One conversation's turns in order, and what has been decided of them.  `out(edit, role, text)` gets every edit once it is decided."""

    def __init__(self, out: Callable[[str, str, str], None]):
        self.out = out
        self.values: dict[str, tuple[int, str]] = {"": (0, "")}  # by last role: price, undecided end of the audit
        self.deleted = 0  # prefix sum of deletions
        self.waiting: list[tuple[str, str]] = []
        self.last, self.limit = "", PENDING
        self.seen: set[bytes] = set()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.before: str | None = None
        self.low = self.high = self.turn = None
        self.turns = 0

    def fault(self, role: str, text: str) -> str | None:
        """The first fault of a turn; it is seen from now on."""
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        again = mark in self.seen
        self.seen.add(mark)
        bare = text.strip(BLANK)
        return "blank" if not bare else "duplicate" if again else "truncated" if bare[-1] not in ENDS else None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += turn != self.turn
            self.turn = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in NEXT:
            self.counts["illegal"] += 1
        self.before = initial
        fault = self.fault(role, text)
        if fault:
            self.counts[fault] += 1
        found: dict[str, tuple[int, str]] = {}
        if fault in ("blank", "duplicate"):
            self.waiting.append(("", ""))
        else:
            self.waiting.append((role, text))
            # the values hold price less deletions before the turn; so does what is put into found
            for (last, this), gap in GAP.items():
                if last in self.values and (this != "s" or initial == "s"):
                    price, audit = self.values[last]
                    kept = initial == this
                    offer = price + ADD * gap + (0 if kept else RENAME) + (CUT_OFF if fault else 0), audit + "I" * gap + ("K" if kept else "R")
                    if this not in found or offer < found[this]:
                        found[this] = offer
        self.deleted += DELETE
        # running minima: go on with a deletion, or begin anew at this turn, whose own deletion isn't paid
        for last, (price, audit) in self.values.items():
            offer = price, audit + "D"
            mine = found.get(last)
            if mine is None or offer < (mine[0] - DELETE, mine[1]):
                found[last] = offer
            else:
                found[last] = mine[0] - DELETE, mine[1]
        for this in set(found) - set(self.values):
            found[this] = found[this][0] - DELETE, found[this][1]
        # From any role the rest costs at most a deletion and an insertion more than from another, so dearer values never win.
        least = min(price for price, _ in found.values())
        self.values = {k: v for k, v in found.items() if v[0] <= least + DELETE + 2 * ADD}
        if len(self.waiting) >= self.limit:
            self.decide(os.path.commonprefix([audit for _, audit in self.values.values()]))
            self.limit = 2 * len(self.waiting) + PENDING

    def decide(self, letters: str) -> None:
        """Write out the edits of letters, which all values begin with."""
        done = 0
        for x in letters:
            if x == "I":
                self.last = "a" if self.last == "u" else "u"
                self.out(x, LONG[self.last], "")
                continue
            role, text = self.waiting[done]
            done += 1
            if x == "K":
                self.last = role[:1]
                self.out(x, role, text)
            elif x == "R":
                self.last = "a" if self.last == "u" else "u"
                self.out(x, LONG[self.last], text)
            else:
                self.out(x, "", "")
        del self.waiting[:done]
        self.values = {k: (price, audit[len(letters) :]) for k, (price, audit) in self.values.items()}

    def finish(self) -> int:
        """Decide the rest; the price of all edits."""
        price, audit = min((price + ADD * TAIL[last], audit + "I" * TAIL[last]) for last, (price, audit) in self.values.items())
        self.decide(audit)
        return price + self.deleted

    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.turns


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows with the faults that crc32(`conv_id:turn`) % 20 names.

    0 drops the row (gone stays as its mark), 1 empties the text, 2 removes its `[.!?]`, 3 repeats the row, 4 makes
    it the user's.  Null roles and texts become one space, and null ids and turns are spaces in the key.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    changed = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return changed.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    ).drop("copy")


def _in_order(rows: DataFrame) -> DataFrame:
    """Each conversation whole in one task and sorted; rows of one turn come by role and text."""
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    kept = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, F.coalesce(gone, F.lit(False)).alias("gone"))
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _streamed(batches: Iterable[pa.RecordBatch], begin: Callable[[object], Callable[[str, str, str], None]], end: Callable[[object, Repair, int], None]) -> Iterator[pa.DataType]:
    """Feed sorted rows to one Repair after another; yields the type of conv_id after each batch."""
    now = held = ids = None
    for batch in batches:
        ids = batch.schema.field("conv_id").type
        for conv, turn, role, text, gone in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if now is None or conv != held:
                if now is not None:
                    end(held, now, now.finish())
                now, held = Repair(begin(conv)), conv
            if not gone:
                now.add(turn, role, text)
        yield ids
    if now is not None:
        end(held, now, now.finish())
        yield ids


def _kind(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, step, edit, role, text: the edits of each conversation of rows (conv_id, turn, role, text) in order.

    edit is K(eep), R(erole), D(elete) or I(nsert); role and text are those after the repair, empty for what is deleted.
    Conversations that end up empty have deletions alone.  See summaries for ties and nulls.
    """
    sorted_ = _in_order(rows)
    kind = pa.schema([("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []

        def begin(conv):
            step = iter(range(2**62))
            return lambda edit, role, text: made.append((conv, next(step), edit, role, text))

        for ids in _streamed(batches, begin, lambda *_: None):
            if made:
                columns = list(zip(*made, strict=True))
                made.clear()
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], ids), *[pa.array(c, t) for c, t in zip(columns[1:], kind.types, strict=True)]], names=["conv_id", *kind.names])

    return map_arrow(sorted_, run, f"conv_id {_kind(rows)}, step long, edit string, role string, text string")


def summaries(rows: DataFrame) -> DataFrame:
    """conv_id and SUMMARY of each conversation of rows (conv_id, turn, role, text and, for rows that only name their conversation, gone).

    Rows of a conversation are taken by turn, nulls first, equal turns by role and text.  A null conv_id is a
    conversation too; null roles and texts are one space.  gaps are the missing numbers between the least and the
    largest turn; a row's first fault counts; illegal are neighbouring initials other than su, ua and au.
    repaired_sha256 is that of the repaired `role:text`, joined by newlines.  Without rows all is zero or empty.
    The digest and the audit of a conversation are one value each, made from its first row to its last,
    so one task reads a conversation, as a stream.
    """
    sorted_ = _in_order(rows)
    names = [x.split()[0] for x in SUMMARY.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        audit: list[str] = []
        digest = [hashlib.sha256(), 0]

        def begin(conv):
            audit.clear()
            digest[:] = hashlib.sha256(), 0

            def out(edit: str, role: str, text: str) -> None:
                audit.append(edit)
                if edit != "D":
                    digest[0].update(f"{chr(10) if digest[1] else ''}{role}:{text}".encode())
                    digest[1] = 1

            return out

        def end(conv, r: Repair, cost: int) -> None:
            made.append((conv, r.gaps(), *(r.counts[k] for k in ("blank", "duplicate", "truncated", "illegal")), cost, "".join(audit), digest[0].hexdigest()))

        for ids in _streamed(batches, begin, end):
            if made:
                columns = list(zip(*made, strict=True))
                made.clear()
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], ids), *[pa.array(c, pa.int64()) for c in columns[1:7]], *[pa.array(c, pa.string()) for c in columns[7:]]], names=["conv_id", *names])

    return map_arrow(sorted_, run, f"conv_id {_kind(rows)}, {SUMMARY}")


