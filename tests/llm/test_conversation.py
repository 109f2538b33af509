"""Conversation repair against every possible repair of short conversations, and against SQL."""

import hashlib
import itertools
import random
import zlib

import duckdb
import pytest

from quire.llm import conversation, queries
from quire.llm.oracle_conversation import CONVERSATION_SQL

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(rows):
    """Cheapest price, least audit and what is left, over every choice of keeping, reroling and deleting, and every place of insertions."""
    found = faults(rows)
    best = None
    for choice in itertools.product("KuaD", repeat=len(rows)):
        price, parts, last, out, good, run = 0, [], "", [], True, 0
        for (role, text), fault, x in zip(rows, found, choice, strict=True):
            if x == "D":
                price += 4
                run += 1
                continue
            if fault in ("blank", "duplicate"):
                good = False
                break
            price += 3 * (fault == "truncated")
            to = role[:1] if x == "K" else x
            price += 3 * (x != "K")
            full = role if x == "K" else {"u": "user", "a": "assistant"}[x]
            if to == "s":
                good = last == "" and not out
                missing = []
            else:
                want = "ua" if last in ("", "s", "a") else "au"
                missing = [] if to == want[0] else [want[0]] if to == want[1] else None
            if not good or missing is None:
                good = False
                break
            parts.append((run, len(missing), "K" if x == "K" else "R"))
            out += [f"{ {'u': 'user', 'a': 'assistant'}[m] }:" for m in missing] + [f"{full}:{text}"]
            price += 3 * len(missing)
            last, run = to, 0
        if not good:
            continue
        tail = {"": [], "a": [], "u": ["assistant:"], "s": ["user:", "assistant:"]}[last]
        price += 3 * len(tail)
        parts.append((run, len(tail), ""))
        audits = [""]
        for deletions, insertions, letter in parts:
            mixes = {"".join(p) for p in itertools.permutations("D" * deletions + "I" * insertions)} if deletions + insertions < 6 else {"D" * deletions + "I" * insertions}
            audits = [min(a + m + letter for m in mixes) for a in audits]
        offer = price, min(audits), "\n".join(out + tail)
        if best is None or offer < best:
            best = offer
    return best


def conversations():
    rng = random.Random(5)
    out = {}
    for c in range(120):
        n = rng.randint(0, 6)
        roles = [rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u"]) for _ in range(n)]
        out[c] = [(r, rng.choice(["a.", "b!", "c?", "no end", "", " \n", "a.", f"t{c}{k}."])) for k, r in enumerate(roles)]
    return out


def test_against_every_repair(spark):
    made = conversations()
    rows = [(c, k, r, t) for c, turns in made.items() for k, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in conversation.summaries(df).collect()}
    edits = {}
    for r in sorted(conversation.repaired(df).collect(), key=lambda r: (r.conv_id, r.step)):
        edits.setdefault(r.conv_id, []).append(r)
    for c, turns in made.items():
        if not turns:
            assert c not in got
            continue
        price, audit, text = brute(turns)
        g = got[c]
        assert (g.cost, g.audit, g.repaired_sha256) == (price, audit, hashlib.sha256(text.encode()).hexdigest()), (turns, g, price, audit, text)
        assert "".join(e.edit for e in edits[c]) == audit and "\n".join(f"{e.role}:{e.text}" for e in edits[c] if e.edit != "D") == text
        found = faults(turns)
        assert [g.blank, g.duplicate, g.truncated] == [found.count(k) for k in ("blank", "duplicate", "truncated")]
        assert g.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False)) and g.gaps == 0


def plain(rows):
    """The recurrence with whole audits, nothing decided before the end."""
    state = {"": (0, "")}
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        new = {k: (p + 4, a + "D") for k, (p, a) in state.items()}
        if fault not in ("blank", "duplicate"):
            for (last, to), gap in conversation.GAP.items():
                if last in state and (to != "s" or role[:1] == "s"):
                    p, a = state[last]
                    kept = role[:1] == to
                    offer = p + 3 * gap + 3 * (not kept) + 3 * (fault == "truncated"), a + "I" * gap + ("K" if kept else "R")
                    new[to] = min(new.get(to, offer), offer)
        state = new
    return min((p + 3 * conversation.TAIL[k], a + "I" * conversation.TAIL[k]) for k, (p, a) in state.items())


@pytest.mark.parametrize("seed", range(6))
def test_long_streams_are_decided_early(seed):
    rng = random.Random(seed)
    weights = [(6, 6, 1, 1), (1, 1, 1, 1), (9, 1, 0, 0)][seed % 3]
    rows = [(rng.choices(["user", "assistant", "system", "tool"], weights)[0], rng.choice([f"t{k}.", f"t{k}", "", "again."]) if rng.random() < (0.3, 0.95)[seed % 2] else f"k{k}!") for k in range(3000)]
    out = []
    r = conversation.Repair(lambda edit, role, text: out.append(edit))
    held = 0
    for k, (role, text) in enumerate(rows):
        r.add(k, role, text)
        held = max(held, len(r.waiting))
    assert (r.finish(), "".join(out)) == plain(rows) and held < 400


def test_nulls_ties_and_dropped_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = [(None if c == 7 else c, rng.choice([None, 0, 1, 1, 2, 5]), rng.choice([None, "user", "assistant", "system"]), rng.choice([None, "", "x.", "y", "same.", "long " * 20000 + "."])) for c in range(60) for _ in range(rng.randint(1, 9))]
    rows += [(1000 + i, 0, "user", "hi.") for i in range(40)]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA + ", gone string, cost int")
    df.select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(f"{tmp_path}/c")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = sorted((tuple(r[c] for c in columns) for r in conversation.summaries(conversation.damaged(df)).collect()), key=repr)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/c/*.parquet'")
    assert got == sorted(con.sql(f"select {', '.join(columns)} from ({CONVERSATION_SQL})").fetchall(), key=repr)
    alone = [c for c in range(1000, 1040) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert alone and all(r == (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in alone for r in got if r[0] == c)
    assert conversation.summaries(conversation.damaged(df.filter("false"))).count() == 0 and len(got) == len({r[0] for r in rows})


def test_query_is_registered():
    assert "op12_conversation" in queries.QUERIES and "op12_conversation" in queries.ORACLE_SQL
