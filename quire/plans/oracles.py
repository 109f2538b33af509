"""DuckDB SQL for the named queries."""

from __future__ import annotations

from quire.operators.lifecycle import EDGES
from quire.operators.pages import SCRIPTED

from . import asking, containers, decisions, jobs, language, live, review_oracles, scores, storage
from .probe_oracles import oracles
from .queries import KNOTS

_N = lambda s: f"((doc_id * 7919 + page * 104729 + {s} * 1299709) % 1000) / 1000.0::DOUBLE"
_COUNT = lambda p: f"len(regexp_extract_all(text, '{p}'))"

PAGES = """p AS (SELECT doc_id, source, lang, g.page::INT AS page, substr(coalesce(text, ''), (g.page * 1200 + 1)::BIGINT, 1200) AS text
    FROM documents, LATERAL (SELECT unnest(generate_series(0, greatest(0, ceil(length(coalesce(text, '')) / 1200)::BIGINT - 1))) AS page) g)"""
LAYERS = PAGES + """, l AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN regexp_replace(text, '[A-Za-z]', '(cid:12)', 'g') ELSE text END AS text) FROM p)"""
MEASURED = LAYERS + r""", m AS (SELECT *, length(trim(text, E' \t\n\r\f\x0b')) AS chars, len(regexp_extract_all(text, '\(cid:[0-9]+\)')) * 7 / greatest(length(text), 1) AS cid_share,
    len(regexp_extract_all(text, '[\p{Co}\p{So}\x{FFFD}]')) / greatest(length(text), 1) AS odd_char_share,
    len(list_filter(regexp_extract_all(text, '[^\s]+'), lambda t: length(t) < 2)) / greatest(len(regexp_extract_all(text, '[^\s]+')), 1) AS short_token_share,
    len(regexp_extract_all(text, '[\p{Sm}\x{0370}-\x{03FF}\x{1D400}-\x{1D7FF}]')) / greatest(len(regexp_extract_all(text, '[^\s]')), 1) AS math_share FROM l)"""
_ANSWERS = ", ".join(f"{_N(seed)} * {scale}::DOUBLE AS {k}" for k, (seed, scale) in SCRIPTED.items())
ANSWERED = MEASURED + rf""", t AS (SELECT *, chars > 50 AND cid_share < 0.05 AND odd_char_share < 0.05 AS trusted FROM m),
    a AS (SELECT *, {_ANSWERS}, CASE WHEN trusted THEN 0.5::DOUBLE + {_N(2)} * 0.5::DOUBLE ELSE {_N(2)} * 0.6::DOUBLE END AS text_layer_trustworthy,
          CASE WHEN {_COUNT(r'\|')} > 5 THEN 0.9::DOUBLE ELSE {_N(4)} * 0.4::DOUBLE END AS has_table, CASE WHEN math_share >= 0.008 THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS has_math, {_N(10)} AS continuation FROM t),
    x AS (SELECT *, mostly_handwritten AS hw, text_layer_trustworthy AS tl, greatest(complex_layout, has_code, has_table, is_form, has_math) AS cx, greatest(camera_or_fax, heavily_degraded, capture_defects) AS bad FROM a),
    r AS (SELECT *, CASE WHEN hw >= 0.5 THEN 'L5' WHEN tl >= 0.5 AND cx >= 0.5 THEN 'L2' WHEN tl >= 0.5 THEN 'L1' WHEN bad >= 0.5 THEN 'L4' ELSE 'L3' END AS candidate,
          CASE WHEN hw >= 0.5 THEN hw WHEN tl >= 0.5 AND cx >= 0.5 THEN (1 - hw) * tl * cx WHEN tl >= 0.5 THEN (1 - hw) * tl * (1 - cx) WHEN bad >= 0.5 THEN (1 - hw) * (1 - tl) * bad ELSE (1 - hw) * (1 - tl) * (1 - bad) END AS path_p FROM x),
    routed AS (SELECT *, CASE WHEN path_p < 0.35::DOUBLE THEN 'LH' ELSE candidate END AS lane FROM r)"""
CASES = ANSWERED + """, cases AS (SELECT routed.*, CASE WHEN toxic = 1 THEN ['L3', 'L4'] WHEN quality = 0 THEN ['L2'] WHEN doc_id % 3 = 0 THEN ['L1', 'L2'] ELSE ['L1'] END AS gt,
    ['img', 'pdf', 'ocr', 'garb'][doc_id % 4 + 1] AS grp, CASE doc_id % 3 WHEN 0 THEN 'tune' WHEN 1 THEN 'holdout' END AS split, (doc_id * 31 + page * 17) % 5000 AS latency_ms, chars::BIGINT * 3 AS cost_micro
    FROM routed JOIN labels USING (doc_id)),
    c AS (SELECT *, CASE WHEN lane IN ('L0', 'L1', 'L2', 'L3', 'L4', 'L5') THEN substr(lane, 2)::INT END AS lane_rank, substr(candidate, 2)::INT AS candidate_rank, list_min(list_transform(gt, lambda g: substr(g, 2)::INT)) AS gt_rank,
          list_max(list_transform(gt, lambda g: substr(g, 2)::INT)) AS most_rank, list_contains(gt, lane) AS ok_lane, list_contains(gt, candidate) AS ok FROM cases)"""
_P2 = lambda e: f"(floor(floor(({e}) * 100 + 0.5::DOUBLE) / 100)::INT::VARCHAR || '.' || lpad((floor(({e}) * 100 + 0.5::DOUBLE)::INT % 100)::VARCHAR, 2, '0'))"
_MODS = lambda extra: f"""list_sort(list_distinct(list_filter([CASE WHEN has_table >= 0.5 THEN 'table' END, CASE WHEN has_math >= 0.5 THEN 'math' END, CASE WHEN has_code >= 0.5 THEN 'code' END, CASE WHEN is_form >= 0.5 THEN 'form' END,
    CASE WHEN candidate <> 'L5' AND has_handwriting >= 0.5 THEN 'handwriting' END{extra}], lambda q: q IS NOT NULL)))"""  # noqa: E731
_KNOTS = ", ".join(f"({x}::DOUBLE, {y}::DOUBLE)" for x, y in KNOTS)
SEGMENTS = ANSWERED + f""", ro AS (SELECT doc_id, page, lane, continuation, {_MODS('')} AS modifiers, chars::BIGINT * 3 AS cost_micro FROM routed),
    s AS (SELECT doc_id, page, page AS start, lane, modifiers FROM ro WHERE page = 0 UNION ALL
          SELECT n.doc_id, n.page, CASE WHEN j THEN s.start ELSE n.page END, CASE WHEN j THEN greatest(s.lane, n.lane) ELSE n.lane END, CASE WHEN j THEN list_sort(list_distinct(list_concat(s.modifiers, n.modifiers))) ELSE n.modifiers END
          FROM s JOIN ro n ON n.doc_id = s.doc_id AND n.page = s.page + 1,
          LATERAL (SELECT n.lane = s.lane OR (n.lane IN ('L1', 'L2', 'L3', 'L4', 'L5') AND s.lane IN ('L1', 'L2', 'L3', 'L4', 'L5') AND n.continuation >= 0.5) AS j)),
    seg AS (SELECT doc_id, start, max(page) AS stop, arg_max(lane, page) AS lane, array_to_string(arg_max(modifiers, page), ',') AS modifiers FROM s GROUP BY doc_id, start)"""
EVENTS = """e AS (SELECT event_id AS id, ts, user_id AS job, CASE event_type WHEN 'signup' THEN 'job.queued' WHEN 'view' THEN 'job.started' WHEN 'click' THEN 'page.stage' WHEN 'error' THEN 'job.retry' WHEN 'purchase' THEN 'job.done' ELSE 'other' END AS type,
    (props::JSON->>'$.k')::BIGINT AS ms FROM events)"""
OPINIONS = """o AS (SELECT doc_id AS key, labeller, code FROM (SELECT doc_id, unnest([{'labeller': 'a', 'code': cs[((doc_id * 3 + quality) % 5 + 1)::INT]}, {'labeller': 'b', 'code': cs[((doc_id * 7 + quality) % 5 + 1)::INT]},
        {'labeller': 'c', 'code': CASE WHEN doc_id % 2 = 0 THEN cs[((doc_id * 11 + quality) % 5 + 1)::INT] END}], recursive := true) FROM (SELECT *, ['simple', 'complex', 'borderline', 'unusable', 'simple'] AS cs FROM labels)) WHERE code IS NOT NULL)"""
VERDICTS = OPINIONS + """, w AS (SELECT key, max(code) FILTER (labeller = 'a') AS a, max(code) FILTER (labeller = 'b') AS b, max(code) FILTER (labeller = 'c') AS c FROM o GROUP BY key),
    u AS (SELECT *, list_filter([a, b, c], lambda q: q IS NOT NULL AND q <> 'unusable') AS usable, len(list_filter([a, b, c], lambda q: q = 'unusable')) AS bad, CASE WHEN c = a OR c = b THEN c END AS major,
          MAP {'simple': ['L1'], 'complex': ['L2'], 'borderline': ['L1', 'L2'], 'unusable': []::VARCHAR[]} AS codes FROM w),
    v AS (SELECT key, CASE WHEN a IS NULL OR b IS NULL THEN 'pending' WHEN a = b THEN CASE WHEN a = 'unusable' THEN 'drop' ELSE 'final' END WHEN c IS NULL THEN 'needs_c' WHEN bad >= 2 THEN 'drop'
             WHEN len(list_distinct(usable)) > 1 THEN 'final' WHEN major IS NOT NULL AND major <> 'unusable' THEN 'final' ELSE 'drop' END AS state,
          CASE WHEN a = b THEN codes[a] WHEN len(list_distinct(usable)) > 1 THEN ['L1', 'L2'] ELSE codes[major] END AS found FROM u),
    verdicts AS (SELECT key, state, CASE WHEN state = 'final' THEN found ELSE []::VARCHAR[] END AS lanes FROM v)"""
_STRATA = """st AS (SELECT doc_id, concat_ws(' ', source, quality::VARCHAR) AS stratum FROM documents JOIN labels USING (doc_id))"""
_CLASSES = {"latin": r"\p{Latin}", "cjk": r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]", "arabic": r"\p{Arabic}", "cyrillic": r"\p{Cyrillic}"}
_SEEN = lambda cs: ", ".join(f"{{'at': list_position({cs}, list_filter({cs}, lambda c: regexp_matches(c, '{p}'))[1]), 'script': '{k}', 'n': len(list_filter({cs}, lambda c: regexp_matches(c, '{p}')))}}" for k, p in (*_CLASSES.items(), ("other", "^[^" + "".join(v.strip("[]") for v in _CLASSES.values()) + "]$")))
_HIST = lambda source: rf""", hh AS (SELECT doc_id, page, list_sort(list_filter([{_SEEN('cs')}], lambda s: s.n > 0)) AS s, greatest(len(cs), 1) AS letters FROM (SELECT doc_id, page, regexp_extract_all({source}, '\p{{L}}') AS cs FROM p)),
    sh AS (SELECT doc_id, page, list_transform(s, lambda q: {{'script': q.script, 'share': round(q.n / letters, 2)}}) AS s FROM hh)"""  # noqa: E731

_REASONS = f"""CASE WHEN hw >= 0.5 THEN 'mostly handwritten (' || {_P2('hw')} || ')' WHEN tl >= 0.5 THEN 'trusted text layer (' || {_P2('tl')} || '); ' || CASE WHEN cx >= 0.5 THEN 'complex layout (' || {_P2('cx')} || ')' ELSE 'simple layout (' || {_P2('1 - cx')} || ')' END
    ELSE 'no trusted text (' || {_P2('1 - tl')} || '); ' || CASE WHEN bad >= 0.5 THEN 'degraded or photo/fax (' || {_P2('bad')} || ')' ELSE 'clean image (' || {_P2('1 - bad')} || ')' END END"""

ORACLE_SQL = {
    "doc_pages": f"WITH {PAGES} SELECT doc_id, page, length(text) AS n FROM p",
    "text_stats": f"WITH {MEASURED} SELECT doc_id, page, chars, cid_share, odd_char_share, short_token_share, math_share FROM m",
    "trust_gate": f"WITH {ANSWERED} SELECT doc_id, page, trusted, NOT trusted AND chars > 0 AS needs_ocr FROM r",
    "lane_rule_table": f"WITH {ANSWERED} SELECT doc_id, page, candidate, round(path_p, 4) AS path_p FROM r",
    "reasons": f"WITH {ANSWERED} SELECT doc_id, page, {_REASONS} AS reasons FROM r",
    "modifiers": f"WITH {ANSWERED} SELECT doc_id, page, array_to_string({_MODS(', CASE WHEN doc_id % 5 = 0 THEN ' + chr(39) + 'multi_column' + chr(39) + ' END')}, ',') AS modifiers FROM r",
    "review_override": f"WITH {ANSWERED} SELECT doc_id, page, lane, candidate FROM routed",
    "lane_histogram": f"WITH {ANSWERED} SELECT lane, count(routed.lane) AS n FROM (VALUES ('L0'), ('L1'), ('L2'), ('L3'), ('L4'), ('L5'), ('LH'), ('LQ')) lanes(lane) LEFT JOIN routed USING (lane) GROUP BY lane",
    "calibrated_lookup": f"""WITH {ANSWERED}, k(x, y) AS (VALUES {_KNOTS}), kk AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM k)
        SELECT doc_id, page, round(CASE WHEN path_p <= {KNOTS[0][0]} THEN {KNOTS[0][1]} WHEN path_p >= {KNOTS[-1][0]} THEN {KNOTS[-1][1]} ELSE y + (path_p - x) / (x2 - x) * (y2 - y) END, 4)::DOUBLE AS confidence
        FROM r LEFT JOIN kk ON path_p > {KNOTS[0][0]} AND path_p < {KNOTS[-1][0]} AND x <= path_p AND path_p < x2""",
    "fixed_routes": """WITH k AS (SELECT *, strlen(coalesce(html, '')) = 0 AS bare FROM pages)
        SELECT page_id, CASE WHEN bare THEN 'unknown' ELSE 'text' END AS kind, CASE WHEN bare THEN 'application/octet-stream' WHEN regexp_matches(lower(substr(html, 1, 512)), '<html|<!doctype html') THEN 'text/html' ELSE 'text/plain' END AS mime,
        CASE WHEN bare THEN 'LQ' ELSE 'L0' END AS lane, CASE WHEN bare THEN 'quarantined: empty' ELSE 'native text format' END AS reason FROM k""",
    "describe_text": f"""WITH {MEASURED} SELECT doc_id, page, CASE WHEN chars = 0 THEN 'Embedded text layer: none.' ELSE 'Embedded text layer: ' || concat_ws(', ', CASE WHEN chars < 100 THEN 'only a few words' WHEN chars < 500 THEN 'a short amount of text' ELSE 'a full page of text' END,
        CASE WHEN cid_share > 0.3 THEN 'does not read as text in any language: encoding codes' WHEN chars < 20 THEN 'mostly numbers and symbols' ELSE 'reads as ' || lang || ' text' END,
        CASE WHEN cid_share > 0.05 THEN 'contains encoding codes like (cid:NN)' END, CASE WHEN odd_char_share > 0.05 THEN 'many unusual or private-use symbols' END, CASE WHEN short_token_share > 0.35 THEN 'many one-letter fragments' END,
        CASE WHEN math_share >= 0.008 THEN 'frequent mathematical symbols or operators' END, 'mostly Latin letters') || '.' END AS said FROM m""",
    "describe_layout": f"""WITH {PAGES}, k AS (SELECT *, {_COUNT(r'\|')} AS t, {_COUNT('=')} AS f, {_COUNT('!')} AS g FROM p)
        SELECT doc_id, page, 'Layout: ' || CASE WHEN t = 0 THEN 'no tables' WHEN t = 1 THEN '1 table' WHEN t < 5 THEN t || ' tables' ELSE 'many tables' END || ', ' || CASE WHEN f = 0 THEN 'no formula blocks' WHEN f = 1 THEN '1 formula block' WHEN f < 5 THEN f || ' formula blocks' ELSE 'many formula blocks' END
        || ', ' || CASE WHEN g = 0 THEN 'no figures' WHEN g = 1 THEN '1 figure' WHEN g < 5 THEN g || ' figures' ELSE 'many figures' END || ', ' || CASE WHEN doc_id % 2 = 0 THEN 'text is laid out in two or more columns' ELSE 'text is in a single column' END || '.' AS said FROM k""",
    "previous_tail": f"WITH {PAGES} SELECT doc_id, page, tail FROM (SELECT doc_id, page, right(lag(text) OVER (PARTITION BY doc_id ORDER BY page), 600) AS tail FROM p) WHERE tail <> ''",
    "script_histogram": f"WITH {PAGES}{_HIST('text')} SELECT doc_id, page, (i - 1)::INT AS place, s[i].script AS script, s[i].share AS share FROM (SELECT doc_id, page, s, unnest(range(1, len(s) + 1)) AS i FROM sh)",
    "dominant_script": f"WITH {PAGES}{_HIST("CASE WHEN doc_id % 8 = 0 THEN 'ддд abc' ELSE text END")} SELECT doc_id, page, coalesce(list_filter(s, lambda q: q.share = list_max(list_transform(s, lambda z: z.share)))[1].script, '') AS script FROM sh",
    "agreement_jaccard": f"""WITH {PAGES}, n AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY page) AS other FROM p),
        u AS (SELECT doc_id, page, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]{{3,}}')) AS a, list_distinct(regexp_extract_all(lower(other), '[\\p{{L}}\\p{{M}}]{{3,}}')) AS b FROM n WHERE other IS NOT NULL)
        SELECT doc_id, page, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 3) END AS agreement FROM u""",
    "guards": rf"""WITH {PAGES}, k AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, '[^\s]+'), lambda t: len(regexp_extract_all(t, '\p{{L}}'))), lambda n: n > 0) AS w FROM p)
        SELECT doc_id, page, CASE WHEN len(regexp_extract_all(text, '[\x00-\x08\x0b\x0e-\x1f\x7f-\x9f\x{{FFFD}}]')) >= 0.02 * greatest(length(text), 1) THEN 'control or undefined characters'
            WHEN len(w) > 0 AND 2 * len(list_filter(w, lambda n: n = 1)) >= len(w) THEN 'many one-letter fragments' WHEN list_sum(w) > 0 AND coalesce(list_sum(list_filter(w, lambda n: n >= 25)), 0) >= 0.6 * list_sum(w) THEN 'words run together without spaces' ELSE '' END AS guard FROM k""",
    "segment_runs": f"WITH RECURSIVE {SEGMENTS} SELECT * FROM seg",
    "segment_width": f"WITH RECURSIVE {SEGMENTS} SELECT doc_id, start, round((stop - start + 1) * 100.0::DOUBLE / (max(stop) OVER (PARTITION BY doc_id) + 1), 4) AS width FROM seg",
    "manifests": f"WITH RECURSIVE {SEGMENTS}, n AS (SELECT doc_id, count(*)::INT AS n_segments FROM seg GROUP BY doc_id) SELECT doc_id, count(*)::INT AS n_pages, any_value(n_segments) AS n_segments, string_agg(lane, ',' ORDER BY page) AS lanes, sum(cost_micro)::BIGINT AS cost_micro FROM ro JOIN n USING (doc_id) GROUP BY doc_id",
    "manifest_reuse": "SELECT doc_id, NOT (doc_id % 6 = 0) AS route FROM documents",
    "bomb_predicate": "SELECT archive, sum(size)::BIGINT AS total, sum(size) > 1000000000 OR bool_or(size > 10000000 AND size > 100 * greatest(packed, 1)) AS bomb FROM (SELECT l_orderkey AS archive, trunc(l_extendedprice * 1000)::BIGINT AS size, trunc(l_quantity * 5000)::BIGINT AS packed FROM lineitem) GROUP BY archive",
    "dedup_bytes": "SELECT sha256(coalesce(text, '')) AS sha, max(strlen(coalesce(text, '')))::INT AS size, count(*) AS copies FROM documents GROUP BY 1",
    "eval_metrics": f"""WITH {CASES} SELECT grp, count(*) AS n, avg(ok_lane::INT) AS accuracy, avg(ok::INT) AS candidate_accuracy, count(*) FILTER (lane_rank < gt_rank) AS under, count(*) FILTER (candidate_rank < gt_rank) AS candidate_under, count(*) FILTER (lane_rank > most_rank) AS over, avg((lane = 'LH')::INT) AS review_rate,
        list_sort(list(latency_ms))[least(count(*) - 1, floor(0.5 * count(*))::BIGINT) + 1] AS p50_ms, list_sort(list(latency_ms))[least(count(*) - 1, floor(0.95::DOUBLE * count(*))::BIGINT) + 1] AS p95_ms, sum(cost_micro)::BIGINT AS cost_micro, round(sum(cost_micro) / 1000 / count(*), 4) AS cost_per_1k FROM c GROUP BY grp""",
    "eval_report": f"""WITH {CASES}, grained AS (SELECT 'all' AS grain, '*' AS value, c.* FROM c UNION ALL SELECT 'group', grp, c.* FROM c WHERE grp IS NOT NULL UNION ALL SELECT 'split', split, c.* FROM c WHERE split IS NOT NULL),
        mm AS (SELECT grain, value, count(*) AS n, avg(ok_lane::INT) AS accuracy, avg(ok::INT) AS candidate_accuracy, count(*) FILTER (lane_rank < gt_rank) AS under, count(*) FILTER (candidate_rank < gt_rank) AS candidate_under, count(*) FILTER (lane_rank > most_rank) AS over, avg((lane = 'LH')::INT) AS review_rate,
            list_sort(list(latency_ms))[least(count(*) - 1, floor(0.5 * count(*))::BIGINT) + 1] AS p50_ms, list_sort(list(latency_ms))[least(count(*) - 1, floor(0.95::DOUBLE * count(*))::BIGINT) + 1] AS p95_ms, sum(cost_micro)::BIGINT AS cost_micro, round(sum(cost_micro) / 1000 / count(*), 4) AS cost_per_1k FROM grained GROUP BY grain, value),
        xx AS (SELECT DISTINCT 'group' AS grain, source AS value FROM documents WHERE source IS NOT NULL UNION ALL SELECT 'split', 'nowhere')
        SELECT coalesce(m.grain, x.grain) AS grain, coalesce(m.value, x.value) AS value, coalesce(n, 0) AS n, accuracy, candidate_accuracy, under, candidate_under, over, review_rate, p50_ms, p95_ms, cost_micro, cost_per_1k FROM mm m FULL JOIN xx x ON m.grain = x.grain AND m.value = x.value""",
    "eval_grouping_sets": f"""WITH {CASES}, g AS (SELECT grouping(grp, split) AS grain, grp, split, count(*) AS n, sum(ok::INT)::BIGINT AS "right" FROM c GROUP BY GROUPING SETS ((), (grp), (split)))
        SELECT CASE grain WHEN 3 THEN 'all' WHEN 1 THEN 'group' ELSE 'split' END AS grain, coalesce(grp, split, CASE WHEN grain = 3 THEN '*' END) AS value, n, "right" FROM g WHERE coalesce(grp, split, CASE WHEN grain = 3 THEN '*' END) IS NOT NULL""",
    "confusion_pivot": f"WITH {CASES} SELECT array_to_string(gt, '/') AS gt, " + ", ".join(f"count(*) FILTER (candidate = '{x}') AS {x}" for x in ("L1", "L2", "L3", "L4", "L5")) + " FROM c GROUP BY 1",
    "nearest_rank": f"""WITH {CASES} SELECT grp, list_sort(list(latency_ms))[least(count(*) - 1, floor(0.5 * count(*))::BIGINT) + 1] AS p50, list_sort(list(latency_ms))[least(count(*) - 1, floor(0.95::DOUBLE * count(*))::BIGINT) + 1] AS p95,
        list_sort(list(latency_ms))[greatest(floor(0.95::DOUBLE * count(*))::BIGINT, 1)] AS upper95, median(latency_ms) AS median FROM c GROUP BY grp""",
    "wrong_cases": f"WITH {CASES} SELECT doc_id, page, lane, array_to_string(gt, '/') AS gt FROM c WHERE NOT ok_lane",
    "route_once_per_file": "SELECT doc_id, min(doc_id) OVER w AS routed_as, count(*) OVER w AS cases FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))",
    "calibration_report": f"""WITH {CASES} SELECT count(*) AS n, count(*) FILTER (path_p < 0.5) AS reviewed, count(*) FILTER (path_p < 0.5 AND NOT ok) AS reviewed_wrong, count(*) FILTER (path_p >= 0.5 AND ok) AS kept_right, count(*) FILTER (path_p >= 0.5 AND NOT ok) AS silent_wrong,
        count(*) FILTER (path_p >= 0.5 AND candidate_rank < gt_rank) AS silent_under FROM c""",
    "selective_accuracy": f"WITH {CASES} SELECT tau, count(*) AS n, count(*) FILTER (path_p >= tau) AS covered, count(*) FILTER (path_p >= tau AND ok) AS \"right\" FROM c, (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE)) taus(tau) GROUP BY tau",
    "ece": f"""WITH {CASES}, b AS (SELECT least(9, floor(path_p * 10))::INT AS bin, count(*) AS n, count(*) FILTER (ok) AS good, sum(round(path_p * 1000000)::BIGINT) AS p_micro FROM c GROUP BY 1)
        SELECT round(sum(abs(p_micro / 1000000 - good)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b""",
    "isotonic_curves": f"""WITH {CASES}, u AS (SELECT unnest(['*', candidate]) AS curve, round(path_p, 4) AS x, ok::INT AS ok FROM c), e AS (SELECT curve, x, sum(ok) AS ok, count(*) AS n, row_number() OVER (PARTITION BY curve ORDER BY x) AS i FROM u GROUP BY curve, x),
        k AS (SELECT curve FROM e GROUP BY curve HAVING sum(n) >= 30 OR curve = '*'), q AS (SELECT *, sum(ok) OVER o AS co, sum(n) OVER o AS cn FROM e JOIN k USING (curve) WINDOW o AS (PARTITION BY curve ORDER BY i)),
        mn AS (SELECT a.curve, a.i AS j, b.i AS k, min((b.co - a.co + a.ok) / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.curve, a.i ORDER BY b.i DESC) AS low FROM q a JOIN q b ON a.curve = b.curve AND a.i <= b.i),
        f AS (SELECT curve, k AS i, max(low) AS y FROM mn GROUP BY curve, k), z AS (SELECT q.curve, q.x, f.y, lag(f.y) OVER o AS before, lead(f.y) OVER o AS after FROM q JOIN f USING (curve, i) WINDOW o AS (PARTITION BY q.curve ORDER BY q.x))
        SELECT curve, x, round(y, 4) AS y FROM z WHERE before IS NULL OR after IS NULL OR abs(y - before) > 1e-12 OR abs(y - after) > 1e-12""",
    "near_duplicates": """WITH g AS (SELECT vec_id AS v, list_transform(range(272), lambda i: embedding[i * 13 % 64 + 1]::DOUBLE) AS grey FROM embeddings),
        b AS (SELECT v + 100000 AS id, CASE WHEN v % 3 = 0 THEN v ELSE v + 100000 END AS doc, list_transform(range(272), lambda i: CASE WHEN i = v % 272 OR (v % 7 = 0 AND i = (v % 272 + 100) % 272) THEN 9.0 ELSE grey[i + 1] END) AS grey FROM g WHERE v % 5 = 0),
        h AS (SELECT id, doc, array_to_string(list_transform(range(256), lambda i: CASE WHEN grey[i // 16 * 17 + i % 16 + 2] > grey[i // 16 * 17 + i % 16 + 1] THEN '1' ELSE '0' END), '')::BIT AS h FROM (SELECT v AS id, v AS doc, grey FROM g UNION ALL SELECT * FROM b))
        SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON a.id < b.id AND a.doc <> b.doc WHERE bit_count(xor(a.h, b.h)) <= 2""",
    "disjoint_check": r"""SELECT doc_id AS key, CASE doc_id % 4 WHEN 0 THEN 'bench_data/pdfs/' || source || '-' || doc_id || '.pdf' WHEN 1 THEN 'Berzerker/gnhk_ocr_dataset ' || doc_id ELSE 'page_id=' || doc_id END AS found FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 < 3""",
    "label_verdicts": f"WITH {VERDICTS} SELECT key, state, array_to_string(lanes, '/') AS lanes FROM verdicts",
    "contradictions": f"WITH {VERDICTS} SELECT key, CASE WHEN key % 2 = 0 THEN 'L1' ELSE 'L2' END AS prior, array_to_string(lanes, '/') AS lanes FROM verdicts WHERE state = 'final' AND NOT list_contains(lanes, CASE WHEN key % 2 = 0 THEN 'L1' ELSE 'L2' END)",
    "conflict_append": f"""WITH {OPINIONS}, n AS (SELECT o.*, CASE WHEN key % 5 = 0 THEN 'complex' ELSE code END AS new, key % 3 = 0 AS fresh FROM o) SELECT CASE WHEN fresh THEN 'append' ELSE 'conflict' END AS what, labeller, count(*) AS n FROM n WHERE fresh OR new <> code GROUP BY ALL""",
    "bootstrap": f"""WITH {CASES}, bv AS (SELECT ok::INT AS value, count(*) AS n FROM c GROUP BY 1), bs AS (SELECT value, sum(n) OVER (ORDER BY value)::BIGINT AS upto, sum(n) OVER ()::BIGINT AS total FROM bv),
        bn AS (SELECT any_value(total) AS total, min(upto) FILTER (value = 0) AS zeros FROM bs), bk AS (SELECT unnest(range(1, 1001)) AS k), bj AS (SELECT unnest(range(1, total + 1)) AS j, total, coalesce(zeros, 0) AS zeros FROM bn),
        bm AS (SELECT k, avg((('0x' || md5('3:' || k || ':' || j)[1:15])::BIGINT % total >= zeros)::INT) AS mean FROM bk, bj GROUP BY k), br AS (SELECT mean, row_number() OVER (ORDER BY mean, k) - 1 AS i FROM bm)
        SELECT min(mean) FILTER (i = 25) AS low, min(mean) FILTER (i = 975) AS high, count(*) AS resamples FROM br""",
    "sticky_split": f"""WITH RECURSIVE st AS (SELECT doc_id, concat_ws(' ', source, quality::VARCHAR) AS stratum, ceil((coalesce(n_chars, 0) + 1) / 1200)::BIGINT AS weight, doc_id % 10 = 0 AS fixed, sha256('split:' || doc_id) AS digest FROM documents JOIN labels USING (doc_id)),
        o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY digest) AS i FROM st WHERE NOT fixed), b AS (SELECT stratum, coalesce(sum(weight) FILTER (fixed), 0)::BIGINT AS lead FROM st GROUP BY stratum),
        f AS (SELECT stratum, 0::BIGINT AS i, NULL::BIGINT AS doc_id, NULL::VARCHAR AS split, lead FROM b UNION ALL
            SELECT f.stratum, o.i, o.doc_id, CASE WHEN second THEN 'holdout' ELSE 'tune' END, f.lead + CASE WHEN second THEN -o.weight ELSE o.weight END FROM f JOIN o ON o.stratum = f.stratum AND o.i = f.i + 1,
            LATERAL (SELECT CASE WHEN f.lead = 0 THEN ('0x' || right(o.digest, 1))::INT % 2 = 1 ELSE f.lead > 0 END AS second))
        SELECT doc_id, stratum, split FROM f WHERE doc_id IS NOT NULL UNION ALL SELECT doc_id, stratum, 'tune' FROM st WHERE fixed""",
    "stratified_round_robin": f"WITH {_STRATA}, t AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('split:' || doc_id), doc_id)::INT AS turn FROM st) SELECT doc_id, stratum, turn FROM t ORDER BY turn, stratum LIMIT 50",
    "cross_tab": f"WITH {VERDICTS} SELECT key % 4 AS part, count(*) FILTER (state = 'final') AS final, count(*) FILTER (state = 'needs_c') AS needs_c, count(*) FILTER (state = 'drop') AS \"drop\" FROM verdicts GROUP BY 1",
    "axis_scores": f"""WITH {CASES}, s AS (SELECT split AS name, avg(ok::INT) AS lane, avg(((tl >= 0.5) = list_contains(gt, 'L1'))::INT) AS trust, avg(CASE WHEN doc_id % 6 <> 0 THEN ((has_table >= 0.5) = list_contains(gt, 'L2'))::INT END) AS table_ FROM c WHERE split IS NOT NULL GROUP BY split)
        SELECT name, round(lane, 6) AS lane, round(trust, 6) AS trust, round(table_, 6) AS table_, round((lane + trust + table_) / 3, 6) AS composite FROM s""",
    "shared_core": """WITH e AS (SELECT DISTINCT event_type AS name, floor(epoch(ts) / 21600)::BIGINT AS page FROM events), n AS (SELECT name, count(*) AS n FROM e GROUP BY name), k AS (SELECT name FROM n WHERE n >= 0.8 * (SELECT max(n) FROM n))
        SELECT page FROM e JOIN k USING (name) GROUP BY page HAVING count(*) = (SELECT count(*) FROM k)""",
    "pareto": "SELECT p_partkey AS name, p_size AS score, p_retailprice AS cost FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size >= p.p_size AND q.p_retailprice <= p.p_retailprice AND (q.p_size > p.p_size OR q.p_retailprice < p.p_retailprice))",
    "run_agreement": f"WITH {ANSWERED} SELECT count(*) AS n, count(*) FILTER (lane = candidate) AS same, sum(round(abs(path_p - path_p * 0.9::DOUBLE) * 1000000)::BIGINT)::BIGINT AS moved_micro FROM routed",
    "job_state": f"""WITH {EVENTS}, s AS (SELECT *, CASE type WHEN 'job.queued' THEN 'queued' WHEN 'job.started' THEN 'running' WHEN 'job.retry' THEN 'queued' WHEN 'job.done' THEN 'done' END AS status, coalesce(max(id) FILTER (type = 'job.retry') OVER (PARTITION BY job), -1) AS retry_id FROM e)
        SELECT job, arg_max(status, id) FILTER (status IS NOT NULL) AS status, count(*) FILTER (type = 'job.retry') AS retries, count(*) FILTER (type = 'page.stage' AND id > retry_id) AS pages FROM s GROUP BY job""",
    "dead_letters": f"WITH {EVENTS} SELECT id, job, delivery FROM (SELECT id, job, row_number() OVER (PARTITION BY job ORDER BY id)::INT AS delivery FROM e WHERE type = 'job.started') WHERE delivery > 3",
    "reclaims": f"WITH {EVENTS} SELECT id, job, gap_us FROM (SELECT id, job, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY job ORDER BY id) AS gap_us FROM e) WHERE gap_us > 36000000000",
    "newest_jobs": f"WITH {EVENTS} SELECT job, min(id) AS first_id FROM e GROUP BY job ORDER BY first_id DESC LIMIT 50",
    "recent_medians": f"WITH {EVENTS} SELECT type, median(ms) AS median_ms, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id DESC) AS k FROM e WHERE ms IS NOT NULL) WHERE k <= 256 GROUP BY type",
    "spend_cap": f"WITH {EVENTS} SELECT id, job, spent FROM (SELECT id, job, coalesce(sum(ms) OVER (PARTITION BY job ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM e WHERE ms IS NOT NULL) WHERE spent <= 1400",
    "shortest_path": "WITH RECURSIVE e(src, dst) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in EDGES) + """), w AS (SELECT 'intake' AS node, 0 AS hops, 'intake' AS path UNION ALL SELECT e.dst, w.hops + 1, w.path || '>' || e.dst FROM w JOIN e ON e.src = w.node WHERE w.hops < 10),
        k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops, path) AS k FROM w) SELECT node, hops, path FROM k WHERE k = 1""",
    "answers_cache": f"""WITH {PAGES}, c AS (SELECT DISTINCT text FROM p WHERE doc_id % 4 = 0), m AS (SELECT * FROM p WHERE text NOT IN (SELECT text FROM c))
        SELECT 'hit' AS what, (SELECT count(*) FROM p) - (SELECT count(*) FROM m) AS n UNION ALL SELECT 'miss', (SELECT count(*) FROM m) UNION ALL SELECT 'call', (SELECT count(DISTINCT text) FROM m)""",
    "daily_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}

ORACLE_SQL |= oracles(ANSWERED, MEASURED, CASES, EVENTS)
ORACLE_SQL |= storage.oracles(ANSWERED)
ORACLE_SQL |= scores.oracles(PAGES, ANSWERED, CASES, EVENTS, ORACLE_SQL["isotonic_curves"])
ORACLE_SQL |= asking.oracles(PAGES) | jobs.oracles(EVENTS)
ORACLE_SQL |= live.oracles(EVENTS, ORACLE_SQL)
ORACLE_SQL |= decisions.oracles(PAGES, MEASURED, ANSWERED, _REASONS, _P2)
ORACLE_SQL |= containers.ORACLE_SQL | language.oracles(PAGES, LAYERS, MEASURED)
ORACLE_SQL |= review_oracles.oracles(PAGES, ANSWERED, CASES, EVENTS, ORACLE_SQL["describe_text"])
