"""DuckDB SQL for the queries in probes."""

from __future__ import annotations

from .probes import _REPLIES

_L = "li AS (SELECT l_orderkey, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS z, l_quantity::INT AS qty FROM lineitem)"
_REGIONS = _L + """, rg AS (SELECT l_orderkey AS page, ['text', 'text', 'formula', 'table'][(pk % 4 + 1)::INT] AS label, pk % 60 AS l, qty * 7 % 80 AS t, pk % 60 + 8 + sk % 30 AS r, qty * 7 % 80 + 3 + pk % 15 AS b, z FROM li)"""
_SPANS = lambda source: f"(SELECT page, sum(greatest(0, b - greatest(t, coalesce(reach, 0)))) AS len FROM (SELECT *, max(b) OVER (PARTITION BY page ORDER BY t, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}) GROUP BY page)"
_QUOTED = ", ".join("'" + r.replace("'", "''") + "'" for r in _REPLIES)
_ATTEMPTS = f"""a AS (SELECT doc_id AS key, attempt, [{_QUOTED}][((doc_id * 7 + attempt * 3 + doc_id // 5) % {len(_REPLIES)} + 1)::INT] AS content, 100 + (doc_id * 13 + attempt * 7) % 50 AS cost
    FROM labels, range(3) g(attempt))"""


def oracles(answered: str, measured: str, cases: str, events: str) -> dict[str, str]:
    """SQL by query name, on top of the shared table expressions."""
    return {
        "image_coverage": f"""WITH {_L}, o AS (SELECT *, min(CASE WHEN kind = 'text' THEN z END) OVER (PARTITION BY page) AS first_text FROM
                (SELECT l_orderkey AS page, z, CASE WHEN pk % 3 = 0 THEN 'text' ELSE 'image' END AS kind, sk % 11 = 0 AS invisible, pk % 30 - 5 AS l, qty % 40 - 10 AS b, pk % 30 + 15 + sk * 7 % 90 AS r, qty % 40 + 20 + pk % 90 AS t FROM li)),
            c AS (SELECT *, greatest(0, floor(l / 100 * 64))::INT AS a, least(64, ceil(r / 100 * 64))::INT AS e, greatest(0, floor(b / 100 * 64))::INT AS lo, least(64, ceil(t / 100 * 64))::INT AS hi FROM o),
            g AS (SELECT page, unnest(range(lo, hi)) AS row, ((1::HUGEINT << (e - a)) - 1) << a AS mask, coalesce(z > first_text, false) AS late FROM c WHERE kind = 'image' AND e > a),
            w AS (SELECT page, row, bit_or(mask) AS under, bit_or(CASE WHEN late THEN mask ELSE 0::HUGEINT END) AS over_ FROM g GROUP BY ALL),
            s AS (SELECT page, sum(bit_count(under))::BIGINT AS u, sum(bit_count(over_))::BIGINT AS v FROM w GROUP BY page)
            SELECT page, coalesce(any_value(u), 0) / 4096 AS coverage, bool_or(kind = 'text' AND invisible) OR coalesce(any_value(v), 0) / 4096 >= 0.9::DOUBLE AS hidden FROM o LEFT JOIN s USING (page) GROUP BY page""",
        "projection_columns": f"""WITH {_L}, x AS (SELECT l_orderkey // 5 AS page, CASE WHEN z % 2 = 1 THEN 55 ELSE 5 END + pk % 8 AS l, CASE WHEN sk % 9 = 0 THEN 92 WHEN z % 2 = 1 THEN 88 + pk % 5 ELSE 40 + pk % 5 END AS r, z AS size FROM li),
            y AS (SELECT *, floor(l / 100 * 100)::INT AS a, floor(r / 100 * 100)::INT AS e FROM x), n AS (SELECT page, count(*) AS n FROM y GROUP BY page),
            b AS (SELECT page, bin, sum(size)::BIGINT AS held FROM (SELECT page, size, unnest(range(a, greatest(a + 1, e))) AS bin FROM y) GROUP BY ALL),
            f AS (SELECT n.page, n.n, g.bin, coalesce(held, 0) AS held FROM n CROSS JOIN range(100) g(bin) LEFT JOIN b ON b.page = n.page AND b.bin = g.bin),
            k AS (SELECT page, n, max(held) AS most, min(held * 1000 + bin) FILTER (bin BETWEEN 30 AND 70) AS gut FROM f GROUP BY ALL),
            h AS (SELECT page, any_value(k.n) AS n, any_value(most) AS most, any_value(gut) // 1000 AS held, least(avg(f.held) FILTER (bin >= 10 AND bin < gut % 1000), avg(f.held) FILTER (bin > gut % 1000 AND bin < 90)) AS lower FROM f JOIN k USING (page) GROUP BY page)
            SELECT page, CASE WHEN n >= 10 AND most > 0 THEN CASE WHEN held < 0.3::DOUBLE * lower AND lower > 0.3::DOUBLE * most THEN 2 ELSE 1 END END::DOUBLE AS columns FROM h""",
        "region_facts": f"WITH {_REGIONS} SELECT page, label, count(*) AS n, least(1000, (sum((r - l) * (b - t)) + 5) // 10)::BIGINT / 1000 AS area FROM rg GROUP BY ALL",
        "region_columns": f"""WITH {_REGIONS}, w AS (SELECT page, t, b, l, r FROM rg WHERE label = 'text' AND r - l >= 15),
            m AS (SELECT p.page, greatest(p.t, q.t) AS t, least(p.b, q.b) AS b FROM w p JOIN w q ON p.page = q.page AND p.r <= q.l AND least(p.b, q.b) > greatest(p.t, q.t)),
            s AS {_SPANS('w')}, d AS {_SPANS('m')}
            SELECT page, CASE WHEN s.len IS NOT NULL THEN CASE WHEN coalesce(d.len, 0) >= 0.2::DOUBLE * s.len THEN 2 ELSE 1 END END::DOUBLE AS columns FROM (SELECT DISTINCT page FROM rg) LEFT JOIN s USING (page) LEFT JOIN d USING (page)""",
        "first_valid_answer": f"""WITH {_ATTEMPTS}, v AS (SELECT *, CASE WHEN json_valid(content) THEN CASE WHEN json_type(content) = 'ARRAY' AND json_array_length(content) = 1 THEN content::JSON->0 ELSE content::JSON END END AS j FROM a),
            u AS (SELECT *, j->>'$.code' AS code, trim(regexp_replace(j->>'$.why', '\\s+', ' ', 'g')) AS why, sum(cost) OVER (PARTITION BY key ORDER BY attempt)::BIGINT AS spent FROM v),
            w AS (SELECT key, min(attempt) FILTER (code IN ('simple', 'complex', 'borderline', 'unusable')) AS win, max(spent) AS total FROM u GROUP BY key)
            SELECT key, u.code, coalesce(u.why, '') AS why, coalesce(u.spent, w.total) AS cost FROM w LEFT JOIN u ON u.key = w.key AND u.attempt = w.win""".replace("SELECT key, u.code", "SELECT w.key, u.code"),
        "parse_modes": f"""WITH {_ATTEMPTS}, s AS (SELECT *, trim(regexp_replace(regexp_replace(content, '^\\s*```(json)?', ''), '```\\s*$', ''), E' \\n') AS bare FROM a)
            SELECT attempt::INT AS attempt, count(*) AS n, count(*) FILTER (CASE WHEN json_valid(content) THEN json_type(content) = 'OBJECT' END) AS strict,
                count(*) FILTER (CASE WHEN json_valid(bare) THEN json_type(bare) = 'OBJECT' OR (json_type(bare) = 'ARRAY' AND json_array_length(bare) = 1) END) AS lenient FROM s GROUP BY attempt""",
        "batch_cost": "SELECT l_orderkey AS batch, l_linenumber AS page, round(o_totalprice / count(*) OVER (PARTITION BY l_orderkey), 6) AS page_cost FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
        "five_question_rules": f"""WITH {answered}, q AS (SELECT doc_id, page, mostly_handwritten AS h, text_layer_trustworthy AS k, complex_layout AS y, greatest(camera_or_fax, heavily_degraded) AS g FROM r)
            SELECT doc_id, page, CASE WHEN h >= 0.5 THEN 'L5' WHEN k >= 0.5 THEN CASE WHEN y >= 0.5 THEN 'L2' ELSE 'L1' END WHEN g >= 0.5 THEN 'L4' ELSE 'L3' END AS lane,
                round(CASE WHEN h >= 0.5 THEN h WHEN k >= 0.5 THEN (1 - h) * k * CASE WHEN y >= 0.5 THEN y ELSE 1 - y END ELSE (1 - h) * (1 - k) * CASE WHEN g >= 0.5 THEN g ELSE 1 - g END END, 4) AS p FROM q""",
        "rules_without_model": rf"""WITH {answered} SELECT doc_id, page, CASE WHEN trusted THEN CASE WHEN has_math >= 0.5 OR len(regexp_extract_all(text, '\p{{Nd}}')) / greatest(length(text), 1) > 0.12::DOUBLE THEN 'L2' ELSE 'L1' END
            WHEN doc_id * 3 % 10 < 7 AND doc_id * 7 % 10 < 5 THEN 'L5' WHEN 150 + doc_id * 11 % 100 < 200 OR 200 + doc_id * 13 % 400 < 300 OR 220 + doc_id * 17 % 30 < 235 OR doc_id * 19 % 4 >= 2 THEN 'L4' ELSE 'L3' END AS lane FROM r""",
        "text_layer_class": rf"""WITH {measured}, k AS (SELECT doc_id, page, regexp_replace(CASE WHEN doc_id % 11 = 0 THEN text || repeat(chr(57344), (length(text) // 4)::BIGINT) ELSE text END, '\s', '', 'g') AS body FROM m)
            SELECT doc_id, page, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN length(body) > 50 THEN 'ocr' ELSE 'none' END WHEN length(body) >= 200 AND (contains(body, '(cid:') OR len(regexp_extract_all(body, '[\p{{Co}}\p{{Cc}}\x{{FFFD}}]')) / length(body) >= 0.2) THEN 'garbled' WHEN length(body) >= 20 THEN 'trusted' ELSE 'none' END AS layer FROM k""",
        "label_overrides": """WITH k AS (SELECT 'doc-' || doc_id AS id, quality, doc_id::VARCHAR AS s FROM labels)
            SELECT id, CASE WHEN s LIKE '%7' THEN 'again' WHEN s LIKE '1%' THEN 'seen' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS state, CASE WHEN s LIKE '%7' THEN 'yes' ELSE '?' END AS has_table, CASE WHEN s LIKE '1_' THEN 'no' ELSE '?' END AS has_math,
                concat_ws(',', CASE WHEN s LIKE '1%' THEN 'doc-1*' END, CASE WHEN s LIKE '%7' THEN 'doc-*7' END, CASE WHEN s LIKE '1_' THEN 'doc-1?' END) AS overrides FROM k""",
        "category_counts": f"WITH {cases} SELECT grp, category, count(*) AS n FROM (SELECT grp, unnest(gt) AS category FROM cases) GROUP BY ALL",
        "landed_counts": f"WITH {events} SELECT lane, count(*) AS n FROM (SELECT job, arg_max('L' || (ms % 5 + 1), id) AS lane FROM e GROUP BY job) GROUP BY lane",
        "activity_heat": f"WITH {events} SELECT type, round(exp((epoch_us(max(ts)) - 1706745600000000) / 1000000 / (1.4::DOUBLE * 86400)), 8) AS heat FROM e GROUP BY type",
        "capped_log": f"WITH {events} SELECT id, job, type FROM e ORDER BY id DESC LIMIT 20000",
        "status_backlog": f"""WITH {events}, k AS (SELECT job, arg_max(CASE type WHEN 'job.queued' THEN 'queued' WHEN 'job.started' THEN 'running' WHEN 'job.retry' THEN 'queued' WHEN 'job.done' THEN 'done' END, id) FILTER (type IN ('job.queued', 'job.started', 'job.retry', 'job.done')) AS status FROM e GROUP BY job)
            SELECT status, count(*) AS n FROM k GROUP BY status""",
        "latency_buckets": f"WITH {cases} SELECT grp, count(*) FILTER (latency_ms <= 100) AS le_100, count(*) FILTER (latency_ms <= 500) AS le_500, count(*) FILTER (latency_ms <= 1000) AS le_1000, count(*) FILTER (latency_ms <= 2500) AS le_2500, count(*) AS le_inf FROM cases GROUP BY grp",
    }
