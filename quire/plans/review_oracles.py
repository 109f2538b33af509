"""DuckDB SQL for the queries in reviews."""

from __future__ import annotations

import json

from quire.functions import evidence
from quire.operators import dataset

from .reviews import BASIS, GROUPS

_list = lambda xs: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"
_pick = lambda key, xs: f"({_list(xs)})[(({key}) % {len(list(xs))} + 1)::INT]"
_case = lambda key, names: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {key} END"
_DEFECTS = ", ".join(f"CASE WHEN doc_id % {m} = 0" + (" AND legibility <> 'clean'" if k in evidence.SOFT_DEFECTS else "") + f" THEN '{v}' END" for (k, v), m in zip(evidence.DEFECTS.items(), (2, 3, 4, 5, 7), strict=True))
_CONTENT = ", ".join(f"CASE WHEN doc_id % {m} = 1 THEN '{k}' END" for k, m in zip(evidence.CONTENT, (2, 3, 4, 5, 6, 7), strict=True))
_TIMES = """tm AS (SELECT doc_id, page, CASE WHEN doc_id % 11 <> 0 THEN 20 + (doc_id * 3 + page) % 50 END AS probe, CASE WHEN doc_id % 11 <> 0 AND (doc_id + page) % 3 = 0 THEN 200 + doc_id % 90 END AS ocr,
    CASE WHEN doc_id % 11 <> 0 AND (doc_id + page) % 4 = 0 THEN 300 + page % 70 END AS vision, CASE WHEN doc_id % 13 <> 0 THEN 100 + doc_id * 7 % 200 END AS answers, (doc_id * 31 + page * 17) % 900 AS total, (doc_id + page) % 5 = 0 AS ocr_failed FROM p)"""
_CODES = "[" + ", ".join(_list(v) + "::VARCHAR[]" for v in dataset.CODES["capture"].values()) + "]"


def oracles(pages: str, answered: str, cases: str, events: str, described: str) -> dict[str, str]:
    """SQL by query name, on top of the shared table expressions."""
    basis = json.dumps(BASIS, sort_keys=True)
    return {
        "evidence_sentences": rf"""WITH k AS (SELECT doc_id, page, string_split(regexp_replace(said || ' Vision check: none. e.g. this. Page 2 follows.', '\.\s+([A-Z])', E'.\x01\\1', 'g'), E'\x01') AS parts FROM ({described})),
            u AS (SELECT doc_id, page, unnest(parts) AS s, unnest(range(len(parts)))::INT AS pos FROM k)
            SELECT doc_id, page, pos, regexp_extract(s, '^([A-Z][A-Za-z ]{{2,28}}):\s+(.*)$', 1) AS topic, CASE WHEN regexp_matches(s, '^[A-Z][A-Za-z ]{{2,28}}:\s+.*$') THEN regexp_extract(s, '^([A-Z][A-Za-z ]{{2,28}}):\s+(.*)$', 2) ELSE s END AS text FROM u""",
        "vision_sentence": f"""WITH v AS (SELECT doc_id, {_pick("doc_id", [*evidence.CAPTURE, "plotter", None])} AS capture, {_pick("doc_id // 2", [*evidence.LEGIBILITY, "odd"])} AS legibility, {_pick("doc_id // 3", evidence.HANDWRITING)} AS hand FROM labels)
            SELECT doc_id, CASE WHEN capture IS NULL THEN 'Vision check: unavailable.' ELSE 'Vision check of the page image: capture looks like ' || {_case("capture", evidence.CAPTURE)} || '; legibility: ' || {_case("legibility", evidence.LEGIBILITY)}
                || '; defects that make characters harder to read: ' || coalesce(nullif(concat_ws(', ', {_DEFECTS}), ''), 'none') || '; handwriting: ' || {_case("hand", evidence.HANDWRITING)}
                || '; contains ' || coalesce(nullif(concat_ws(', ', {_CONTENT}), ''), 'plain text only') || '; main script latin.' END AS said FROM v""",
        "stage_timeline": f"""WITH {pages}, {_TIMES}, w AS (SELECT *, greatest(total, coalesce(probe, 0) + greatest(coalesce(ocr, 0), coalesce(vision, 0)) + coalesce(answers, 0), 1) AS whole FROM tm),
            b AS (SELECT doc_id, page, whole, 'probe' AS stage, 0 AS begin, probe AS length FROM w UNION ALL SELECT doc_id, page, whole, 'ocr', coalesce(probe, 0), ocr FROM w UNION ALL SELECT doc_id, page, whole, 'vision', coalesce(probe, 0), vision FROM w
                  UNION ALL SELECT doc_id, page, whole, 'answers', whole - answers, answers FROM w)
            SELECT doc_id, page, stage, begin::BIGINT AS begin, round(begin / whole * 100, 6) AS begin_pct, round(greatest(0.6::DOUBLE, length / whole * 100), 6) AS width_pct FROM b WHERE length IS NOT NULL""",
        "replay_events": f"""WITH {pages}, {_TIMES}, s AS (SELECT *, page * 140 AS t0, page * 140 + probe AS t1, ocr IS NOT NULL OR vision IS NOT NULL AS read FROM tm),
            a AS (SELECT *, greatest(t1 + greatest(coalesce(ocr, 0), coalesce(vision, 0)), t0 + total - answers) AS asked FROM s),
            pe AS (SELECT doc_id, page, 'probe' AS stage, 'start' AS state, t0 AS at FROM a WHERE probe IS NOT NULL UNION ALL SELECT doc_id, page, 'probe', 'done', t1 FROM a WHERE probe IS NOT NULL
                UNION ALL SELECT doc_id, page, 'ocr', 'start', t1 FROM a WHERE ocr IS NOT NULL OR (probe IS NOT NULL AND read AND ocr_failed) UNION ALL SELECT doc_id, page, 'ocr', 'done', t1 + ocr FROM a WHERE ocr IS NOT NULL
                UNION ALL SELECT doc_id, page, 'ocr', 'fail', t1 FROM a WHERE probe IS NOT NULL AND ocr IS NULL AND read AND ocr_failed UNION ALL SELECT doc_id, page, 'ocr', 'skip', t1 FROM a WHERE probe IS NOT NULL AND ocr IS NULL AND NOT (read AND ocr_failed)
                UNION ALL SELECT doc_id, page, 'vision', 'start', t1 FROM a WHERE probe IS NOT NULL AND read UNION ALL SELECT doc_id, page, 'vision', CASE WHEN vision IS NULL THEN 'fail' ELSE 'done' END, t1 + coalesce(vision, 0) FROM a WHERE probe IS NOT NULL AND read
                UNION ALL SELECT doc_id, page, 'vision', 'skip', t1 FROM a WHERE probe IS NOT NULL AND NOT read
                UNION ALL SELECT doc_id, page, 'answers', 'start', asked FROM a WHERE probe IS NOT NULL AND answers IS NOT NULL UNION ALL SELECT doc_id, page, 'answers', 'done', asked + answers FROM a WHERE probe IS NOT NULL AND answers IS NOT NULL
                UNION ALL SELECT doc_id, page, 'policy', 'done', CASE WHEN probe IS NOT NULL AND answers IS NOT NULL THEN greatest(t0 + total, asked + answers) ELSE t0 + total END FROM a)
            SELECT doc_id, page, stage, state, pe.at::BIGINT AS at FROM pe UNION ALL SELECT DISTINCT doc_id, -1, 'doc', 'start', 0 FROM pe UNION ALL SELECT doc_id, -1, 'doc', 'done', max(pe.at) + 40 FROM pe WHERE stage = 'policy' GROUP BY doc_id""",
        "finished_recordings": f"""WITH {events}, f AS (SELECT DISTINCT job FROM e WHERE type = 'job.done'), n AS (SELECT arg_max(job, id) AS job FROM e WHERE type = 'job.queued' AND job IN (SELECT job FROM f) GROUP BY job % 20) SELECT id, job FROM e WHERE job IN (SELECT job FROM n)""",
        "live_or_past": f"WITH {events}, a AS (SELECT type, 1706572800000000 - 2000000 - epoch_us(ts) AS age FROM e) SELECT type, count(*) FILTER (age < 86400000000) AS live, count(*) FILTER (age >= 86400000000) AS past FROM a GROUP BY type",
        "route_summary": f"WITH {cases} SELECT count(DISTINCT doc_id) AS docs, count(lane) AS pages, sum(cost_micro)::BIGINT AS cost_micro, median(latency_ms) AS p50 FROM c",
        "answer_groups": f"WITH {answered} " + " UNION ALL ".join(f"SELECT '{g}' AS grp, '{k}' AS question, count(*) AS n, count(*) FILTER ({k} >= 0.5) AS yes FROM r" for k, g in GROUPS.items()),
        "system_lanes": f"""WITH {cases}, s AS (SELECT *, doc_id + page AS i FROM c), o AS (SELECT grp, gt_rank, most_rank, gt, CASE WHEN i % 17 = 0 OR i % 10 = 3 OR i % 10 = 1 THEN NULL WHEN path_p < 0.35::DOUBLE THEN 'uncertain' ELSE candidate END AS lane, candidate_rank FROM s),
            z AS (SELECT *, lane <> 'uncertain' AND NOT list_contains(gt, lane) AS wrong FROM o)
            SELECT grp, count(lane) AS n, count(*) - count(lane) AS errors, count(*) FILTER (list_contains(gt, lane)) AS "right", count(*) FILTER (lane = 'uncertain') AS abstained, count(*) FILTER (wrong AND candidate_rank < gt_rank) AS under, count(*) FILTER (wrong AND candidate_rank > most_rank) AS over FROM z GROUP BY grp""",
        "layer_accuracy": f"WITH {cases} SELECT count(*) AS n, count(*) FILTER ((text_layer_trustworthy >= 0.5) = (list_contains(gt, 'L1') OR list_contains(gt, 'L2'))) AS \"right\" FROM c WHERE doc_id % 6 <> 0",
        "mean_probability": f"WITH {cases}, q AS (SELECT ok, round(path_p * 1000000)::BIGINT AS micro FROM c) SELECT coalesce(round(avg(micro) FILTER (ok), 3), 0) AS right_micro, coalesce(round(avg(micro) FILTER (NOT ok), 3), 0) AS wrong_micro FROM q",
        "system_timing": f"""WITH {cases}, q AS (SELECT grp, page % 3 AS run, count(*) AS n, sum(cost_micro) AS cost, list_sort(list(latency_ms) FILTER (latency_ms > 0)) AS late FROM c GROUP BY ALL)
            SELECT grp, run, n, list_median(late)::DOUBLE AS p50, late[greatest(1, floor(0.95::DOUBLE * len(late)))::BIGINT] AS p95, round(cost * 1000 / n, 4) AS micro_per_1000 FROM q""",
        "truth_lanes": f"""WITH v AS (SELECT doc_id, quality = 1 AS born, {_pick("doc_id // 5", ["none", "some", "mostly", None])} AS hand, {_pick("doc_id // 4", ["clean", "degraded", None])} AS leg, doc_id % 4 AS cap, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 7 = 0 END AS cx FROM labels),
            g AS (SELECT *, CASE WHEN leg = 'degraded' OR cap IN (0, 3) THEN true WHEN leg = 'clean' AND cap = 2 THEN false END AS bad FROM v)
            SELECT doc_id, CASE WHEN hand = 'mostly' THEN 'L5' WHEN born THEN CASE WHEN cx IS NULL THEN 'L1/L2' WHEN cx THEN 'L2' ELSE 'L1' END WHEN bad IS NULL THEN 'L3/L4' WHEN bad THEN 'L4' ELSE 'L3' END AS lanes FROM g""",
        "vision_only_lanes": f"""WITH v AS (SELECT doc_id, quality, {_pick("doc_id", evidence.HANDWRITING)} AS hand, {_pick("doc_id // 2", evidence.CAPTURE)} AS cap, {_pick("doc_id // 3", evidence.LEGIBILITY)} AS leg FROM labels)
            SELECT doc_id, CASE WHEN quality = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'L2' ELSE 'L1' END WHEN hand = 'mostly_handwritten' THEN 'L5' WHEN cap IN ('camera_photo', 'fax') OR leg IN ('hard_to_read', 'illegible', 'mild_issues') THEN 'L4' ELSE 'L3' END AS lane FROM v""",
        "hash_parity": "SELECT doc_id, sha256('split:' || doc_id) AS rank, (strpos('0123456789abcdef', right(sha256('split:' || doc_id), 1)) - 1)::INT % 2 AS parity FROM labels",
        "case_build": """WITH b AS (SELECT 'i' || doc_id AS id, 'k' || doc_id AS key, CASE WHEN quality = 1 THEN 'L1' ELSE 'L3/L4' END AS gt, doc_id FROM labels WHERE toxic <> 1 AND doc_id % 3 <> 0)
            SELECT id, key, gt, NULL::VARCHAR AS variant FROM b UNION ALL SELECT id || '-fax', key, gt, 'fax' FROM b WHERE doc_id % 4 = 0""",
        "repeated_files": """WITH k AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL), a AS (SELECT digest, count(*) AS n FROM k WHERE doc_id % 2 = 0 GROUP BY digest)
            SELECT digest, 'twice' AS why FROM a WHERE n > 1 UNION ALL SELECT digest, 'shared' FROM a WHERE digest IN (SELECT digest FROM k WHERE doc_id % 2 = 1)""",
        "answer_faults": """SELECT doc_id % 50 AS batch, doc_id AS image, 'missing' AS fault FROM labels WHERE doc_id % 7 = 0 AND doc_id % 9 <> 0 UNION ALL SELECT doc_id % 50, doc_id, 'repeated' FROM labels WHERE doc_id % 7 <> 0 AND doc_id % 9 = 0
            UNION ALL SELECT doc_id % 50, doc_id + 1000000, 'unknown' FROM labels WHERE doc_id % 20 = 3""",
        "first_seen": "SELECT lang, sha256(coalesce(text, '')) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY ALL",
        "qualification": f"""WITH v AS (SELECT {_pick("doc_id", ["a", "b", "c"])} AS labeller, ({_CODES})[(doc_id // 3 % {len(dataset.CODES["capture"])} + 1)::INT] AS lanes, CASE WHEN quality = 1 THEN ['L3'] ELSE ['L3', 'L4'] END AS gt FROM labels)
            SELECT labeller, count(*) AS n, count(*) FILTER (len(lanes) > 0 AND list_has_all(gt, lanes)) AS inside, count(*) FILTER (lanes = gt) AS exact FROM v GROUP BY labeller""",
        "release_faults": "SELECT doc_id AS file, CASE WHEN doc_id % 10 = 4 THEN 'missing' ELSE 'changed' END AS fault FROM documents WHERE doc_id % 10 = 4 OR doc_id % 25 = 1",
        "holdout_report": f"""WITH {cases}, h AS (SELECT *, coalesce(split = 'holdout', false) AS held, path_p < 0.3::DOUBLE AS review FROM c)
            SELECT held, count(*) AS n, count(*) FILTER (review) AS reviewed, count(*) FILTER (review AND NOT ok) AS reviewed_wrong, count(*) FILTER (NOT review AND ok) AS kept_right, count(*) FILTER (NOT review AND NOT ok) AS silent_wrong, count(*) FILTER (NOT review AND candidate_rank < gt_rank) AS silent_under FROM h GROUP BY held""",
        "job_keys": f"""SELECT doc_id, left(sha256(coalesce(text, '')), 16) || '-' || left(sha256('{{"answers": "' || left(sha256('{basis}'), 16) || '", "calibration": null, "review": 0.35}}'), 8) AS job FROM documents""",
    }
