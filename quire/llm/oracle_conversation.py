"""DuckDB SQL of the conversation query: a recursion over the turns, with one value for each role of the last retained turn."""

from __future__ import annotations

from .conversation import ADD, CUT_OFF, DELETE, GAP, RENAME, TAIL


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def _plus(value: str, price: str, letters: str) -> str:
    """A value, as nine digits of price and the audit, with more of both."""
    return f"(lpad((left({value}, 9)::INT + {price})::VARCHAR, 9, '0') || substr({value}, 10) || '{letters}')"


def _state(this: str) -> str:
    """The least value whose last retained turn has this role, behind one more turn; roles are n(one), s, u, a."""
    offers = [_plus(f"v{this}", str(DELETE), "D")]
    if this != "n":
        for (last, to), gap in GAP.items():
            if to == this:
                v, ins = f"v{last or 'n'}", "I" * gap
                keep = _plus(v, f"{ADD * gap} + {CUT_OFF} * cut", f"{ins}K")
                rename = _plus(v, f"{ADD * gap + RENAME} + {CUT_OFF} * cut", f"{ins}R")
                offers.append(f"CASE WHEN must THEN NULL WHEN initial = '{this}' THEN {keep} ELSE {rename if this != 's' else 'NULL'} END")
    return f"least({', '.join(offers)})" if len(offers) > 1 else offers[0]


_B = r"[^\x20\x09-\x0D]"
_ENDS = ", ".join(_plus(f"v{last or 'n'}", str(ADD * n), "I" * n) for last, n in TAIL.items())

CONVERSATION_SQL = rf"""
    WITH RECURSIVE t AS (SELECT [{", ".join(f"{x}::BIGINT" for x in _crc_table())}] AS tab),
    k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    c AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: unicode(substr(key, i, 1))::BIGINT)),
                  lambda x, y: xor(tab[(xor(x, y) & 255) + 1], x >> 8)), 4294967295::BIGINT) % 20 AS kind FROM k, t),
    d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                 CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
          FROM c WHERE kind <> 0),
    o AS (SELECT *, left(role, 1) AS initial, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM d),
    f AS (SELECT *, NOT regexp_matches(text, '{_B}') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 AS again,
                 NOT coalesce(contains('.!?', regexp_extract(text, '({_B})[\x20\x09-\x0D]*$', 1)), false) AS open_, lag(initial) OVER (PARTITION BY conv ORDER BY n) || initial AS pair FROM o),
    r AS (SELECT *, blank OR again AS must, (NOT blank AND NOT again AND open_)::INT AS cut FROM f),
    s(conv, n, vn, vs, vu, va) AS (
        SELECT DISTINCT conv, 0::BIGINT, '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM r
        UNION ALL
        SELECT s.conv, r.n, {_state("n")}, {_state("s")}, {_state("u")}, {_state("a")} FROM s JOIN r ON r.conv = s.conv AND r.n = s.n + 1),
    e AS (SELECT conv, least({_ENDS}) AS best FROM s JOIN (SELECT conv, max(n) AS n FROM r GROUP BY conv) USING (conv, n)),
    a AS (SELECT conv, substr(best, 10) AS audit, unnest(string_split(substr(best, 10), '')) AS edit, unnest(range(1, length(best) - 8)) AS i FROM e),
    b AS (SELECT conv, edit, i, count(*) FILTER (edit <> 'I') OVER w AS n, count(*) FILTER (edit <> 'D') OVER w AS place FROM a WINDOW w AS (PARTITION BY conv ORDER BY i)),
    g AS (SELECT b.*, r.role, r.text, max((b.place = 1 AND b.edit = 'K' AND r.initial = 's')::INT) OVER (PARTITION BY b.conv) AS led
          FROM b LEFT JOIN r ON r.conv = b.conv AND r.n = b.n AND b.edit <> 'I' WHERE b.edit <> 'D'),
    h AS (SELECT conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS repaired FROM g GROUP BY conv),
    m AS (SELECT conv, any_value(conv_id) AS id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
                 sum(cut)::BIGINT AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv)
    SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(left(best, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) i
    LEFT JOIN (SELECT DISTINCT conv, conv_id FROM r) j ON j.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN m ON m.conv = j.conv LEFT JOIN e ON e.conv = j.conv LEFT JOIN h ON h.conv = j.conv"""
