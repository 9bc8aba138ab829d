"""SQL for queries whose Spark side stands in words, sets, models and graph, where the SQL
is long: sentences, names, dials, abstention, removals."""

from __future__ import annotations

from linkscope.queries.registry import CC, F1, ORACLE_SQL, W
from linkscope.queries.sets import KIND, MIX, PARTS, QW, TG, WT
from linkscope.queries.words import HREF, PAIRS, SH, STOP, TOK

SPLIT = r"""string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])\s+([A-Z"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))"""
SEN = f"sen AS (SELECT doc_id, CAST(pos - 1 AS INT) AS pos, sentence FROM (SELECT doc_id, unnest({SPLIT}) AS sentence, generate_subscripts({SPLIT}, 1) AS pos FROM documents) WHERE trim(sentence) <> '')"
HITS = r"""regexp_extract_all(coalesce(text, ''), '(?:(?:^|[.!?:\n])[\s"''(\[]*)?[A-Za-z]+')"""
CAP = rf"""hits AS (SELECT regexp_extract(hit, '[A-Za-z]+$') AS word, regexp_matches(hit, '^[^A-Za-z]') OR i = 1 AS start FROM (SELECT unnest({HITS}) AS hit, generate_subscripts({HITS}, 1) AS i FROM documents)), cp0 AS (SELECT lower(word) AS token, count(*) AS uses, count(*) FILTER (regexp_matches(word, '^[A-Z]')) AS capitals, count(*) FILTER (NOT start) AS mid_uses, count(*) FILTER (NOT start AND regexp_matches(word, '^[A-Z]')) AS mid_capitals FROM hits GROUP BY 1)"""
NAMES = f"{HREF}, ti AS (SELECT DISTINCT lower(unnest(regexp_extract_all(target, '[A-Za-z]+'))) AS token FROM h), nw AS (SELECT token, CASE WHEN 2 * mid_capitals > mid_uses THEN 'capital' WHEN token IN (SELECT token FROM ti) AND (5 * capitals >= uses OR uses < 20) THEN 'title' END AS reason FROM cp0 WHERE token NOT IN ({STOP})), nk AS (SELECT token, reason FROM nw WHERE reason IS NOT NULL)"
CLEAN = r"""length(s) BETWEEN 40 AND 300 AND regexp_matches(s, '[.!?]["'')]?\n?$') AND regexp_matches(s, '^[A-Z"''(]') AND length(regexp_replace(s, '[^A-Za-z ]', '', 'g')) >= 0.72 * length(s) AND len(regexp_extract_all(s, '\(')) = len(regexp_extract_all(s, '\)')) AND len(regexp_extract_all(s, '\[')) = len(regexp_extract_all(s, '\]')) AND NOT regexp_matches(s, '\^|\[[0-9]|https?://|\{|\}|\|')"""

ORACLE_SQL |= {
    "tx9_sentences": f"WITH {SEN} SELECT doc_id, pos, sentence FROM sen",
    "tx10_clean_sentences": f"WITH {SEN} SELECT doc_id, pos, sentence FROM (SELECT *, trim(sentence) AS s FROM sen) WHERE pos > 0 AND {CLEAN}",
    "tx12_capitalisation": f"WITH {CAP} SELECT * FROM cp0",
    "tx13_name_words": f"WITH {CAP}, {NAMES} SELECT token, reason FROM nk",
    "tx14_term_kinds": f"WITH {TOK}, {CAP}, {NAMES}, df AS (SELECT token, count(DISTINCT doc_id) AS df FROM tok GROUP BY token) SELECT token, df, CASE WHEN token IN (SELECT token FROM nk) THEN 'name' WHEN token IN ({STOP}) OR df >= (SELECT ceil(count(*) / 3) FROM documents) THEN 'habit' ELSE 'other' END AS kind FROM df",
    "tx16_mask_terms": rf"WITH a AS (SELECT doc_id, lower(unnest(regexp_extract_all(split_part(text, chr(10), 1), '[A-Za-z]+'))) AS token FROM documents), b AS (SELECT doc_id, lower(unnest(regexp_extract_all({SPLIT}[1], '\b[A-Z][a-z]+'))) AS token FROM documents) SELECT doc_id, token FROM a UNION SELECT doc_id, token FROM b",
    "tx18_mention_report": f"WITH {TOK}, {CAP}, {NAMES} SELECT token, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM tok WHERE token IN (SELECT token FROM nk) GROUP BY token",
    "tx19_ngram_counts": f"WITH {SEN}, t AS (SELECT list_concat(['<s>'], list_concat(list_transform(regexp_extract_all(sentence, '[A-Za-z]+'), lambda x: lower(x)), ['</s>'])) AS t FROM sen), g AS (SELECT t, unnest(range(1, len(t))) AS i FROM t) SELECT t[i] || ' ' || t[i + 1] AS gram, count(*) AS count FROM g GROUP BY 1",
    "tx23_longest_shared_run": f"WITH {TOK}, {SH}, {PAIRS}, ps AS (SELECT doc_id, pos, s FROM (SELECT doc_id, pos, string_agg(token, ' ') OVER w AS s, count(*) OVER w AS n FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8), m AS (SELECT a, b, x.pos AS pa, x.pos - y.pos AS dg FROM cp JOIN ps x ON x.doc_id = a JOIN ps y ON y.doc_id = b AND y.s = x.s), l AS (SELECT a, b, dg, pa - row_number() OVER (PARTITION BY a, b, dg ORDER BY pa) AS i FROM m) SELECT a, b, max(n) + 7 AS run FROM (SELECT a, b, count(*) AS n FROM l GROUP BY a, b, dg, i) GROUP BY a, b",
    "tx26_similar_words": f"WITH {TOK}, c AS (SELECT DISTINCT word, l, r FROM (SELECT token AS word, lag(token) OVER w AS l, lead(token) OVER w AS r FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE l IS NOT NULL AND r IS NOT NULL), p AS (SELECT x.word, y.word AS other, count(*) AS contexts FROM c x JOIN c y ON y.l = x.l AND y.r = x.r AND y.word <> x.word GROUP BY 1, 2) SELECT word, other, contexts FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY contexts DESC, other) AS i FROM p) WHERE i <= 10",
}

KIND7 = "kd AS (SELECT token, CASE WHEN token IN (SELECT token FROM nk) THEN 'name' WHEN token IN ({}) OR df >= ceil(n / 3) THEN 'habit' ELSE 'other' END AS kind FROM df, nd)".format(STOP)
VERDICT = "CASE WHEN p_name + p_habit + p_other <= 0 THEN 'STORY' WHEN 2 * p_name >= p_name + p_habit + p_other THEN 'NAME' WHEN p_habit >= p_other THEN 'HABIT' ELSE 'STORY' END"
OWN = "ow AS (SELECT doc_id, " + ", ".join(f"sum(CASE WHEN kind = '{k}' THEN w * w ELSE 0 END) AS o_{k}" for k in ("name", "habit", "other")) + " FROM un JOIN kd USING (token) GROUP BY doc_id)"


def dial(wn: str, wh: str) -> str:
    a, b = (f"({wn} * {wn} * {x}.o_name + {wh} * {wh} * {x}.o_habit + {x}.o_other)" for x in "xy")
    return f"coalesce(({wn} * {wn} * p_name + {wh} * {wh} * p_habit + p_other) / nullif(sqrt({a} * {b}), 0), 0)"


NEAR = "(SELECT doc_id, other, row_number() OVER (PARTITION BY doc_id ORDER BY round(cos, 9) DESC, other) AS rank FROM (SELECT a AS doc_id, b AS other, cos FROM {0} UNION ALL SELECT b, a, cos FROM {0}))"
JUDGED = "o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS i FROM sc), g AS (SELECT qid, max(score) AS best, sum(score) / max(n) AS mean, greatest(sum(score * score) / max(n) - (sum(score) / max(n)) * (sum(score) / max(n)), 0) AS var FROM sc, nd GROUP BY qid), jd AS (SELECT o.qid, CASE WHEN target IS NULL THEN 'absent' ELSE 'page' END AS style, coalesce(doc_id = target, false) AS correct, round((best - mean) / CASE WHEN sqrt(var) > 1e-12 THEN sqrt(var) ELSE 1 END, 6) AS value FROM o JOIN g USING (qid) LEFT JOIN tg USING (qid) WHERE i = 1)"
WEIGH = "CASE style " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX.items()) + " ELSE 0 END"


def fitted(rows: str, by: str) -> str:
    """Thresholds with their score, for rows(by, style, correct, value), and the best of each by."""
    return f"vals AS (SELECT {by} AS k, value, lead(value) OVER (PARTITION BY {by} ORDER BY value) AS nx FROM (SELECT DISTINCT {by}, value FROM {rows})), th AS (SELECT k, (value + nx) / 2 AS t FROM vals WHERE nx IS NOT NULL), ac AS (SELECT k, t, style, avg(CAST(CASE WHEN style = 'absent' THEN value < t ELSE correct AND value >= t END AS INT)) AS acc FROM th JOIN {rows} r ON r.{by} = th.k GROUP BY 1, 2, 3), ft AS (SELECT k, t, round(sum(acc * {WEIGH}), 9) AS score FROM ac GROUP BY 1, 2), bf AS (SELECT k, max(score) AS score, first(t ORDER BY score DESC, t) AS threshold FROM ft GROUP BY k)"


BASE = f"WITH {WT}, {QW}"
EVERY = f"{BASE}, {TG}, {JUDGED}"
PTS = "pw AS (SELECT qw.qid, un.doc_id, un.token, qw.w * un.w AS part FROM qw JOIN un USING (token) WHERE qw.w <> 0 AND un.w <> 0)"
WORDS = "bq AS (SELECT DISTINCT qid, token FROM qt WHERE token IN (SELECT token FROM df)), bn AS (SELECT qid, count(*) AS n FROM bq GROUP BY qid), bs AS (SELECT qid, doc_id, sum(w) / sqrt(max(n)) AS score FROM bq JOIN un USING (token) JOIN bn USING (qid) GROUP BY 1, 2)"

ORACLE_SQL |= {
    "vs7_name_parts": f"WITH {WT}, {CAP}, {NAMES}, {KIND7}, {PARTS} SELECT a, b, round(cos, 6) AS cos, round(p_name, 6) AS p_name, round(p_habit, 6) AS p_habit, round(p_other, 6) AS p_other, {VERDICT} AS verdict FROM pt",
    "vs8_dial_cosine": f"WITH {WT}, {KIND}, {PARTS}, {OWN} SELECT wn, wh, a, b, round({dial('wn', 'wh')}, 6) AS cos FROM pt JOIN ow x ON x.doc_id = a JOIN ow y ON y.doc_id = b, (VALUES (CAST(1 AS DOUBLE), CAST(1 AS DOUBLE)), (0, 1), (0, 0)) v(wn, wh)",
    "vs10_neighbour_rank_shift": f"WITH {WT}, {KIND}, {PARTS}, {OWN}, dl AS (SELECT a, b, {dial('0', '0')} AS cos FROM pt JOIN ow x ON x.doc_id = a JOIN ow y ON y.doc_id = b), now AS {NEAR.format('dl')}, base AS {NEAR.format('pt')} SELECT now.doc_id, now.other, CAST(now.rank AS INT) AS rank, CAST(base.rank AS INT) AS base_rank FROM now LEFT JOIN base ON base.doc_id = now.doc_id AND base.other = now.other AND base.rank <= 10 WHERE now.rank <= 10",
    "vs17_single_term_oracle": f"WITH {WT}, t AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY w DESC, doc_id) AS i FROM un WHERE w > 0), b AS (SELECT token, max(doc_id) FILTER (i = 1) AS doc_id, max(w) - coalesce(max(w) FILTER (i = 2), 0) AS margin FROM t WHERE i <= 2 GROUP BY token), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(margin, 9) DESC, token) AS i FROM b WHERE margin > 1e-12) SELECT doc_id, token, round(margin, 6) AS margin FROM k WHERE i = 1",
    "vs26_expected_score": f"{EVERY} SELECT round(sum(acc * {WEIGH}), 6) AS score FROM (SELECT style, avg(CAST(CASE WHEN style = 'absent' THEN value < 10 ELSE correct AND value >= 10 END AS INT)) AS acc FROM jd GROUP BY style)",
    "vs27_fit_abstention": f"{EVERY}, ja AS (SELECT 1 AS one, * FROM jd), {fitted('ja', 'one')} SELECT threshold, score FROM bf",
    "vs28_loo_abstention": f"{EVERY}, lo AS (SELECT x.qid AS left_out, y.style, y.correct, y.value FROM jd x JOIN jd y ON y.qid <> x.qid), {fitted('lo', 'left_out')} SELECT qid, threshold, value < threshold AS abstains FROM jd JOIN bf ON bf.k = qid",
    "vs29_confidence_report": f"{EVERY}, rk AS (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rk FROM jd) SELECT CAST((sum(rk) FILTER (correct) - count(*) FILTER (correct) * (count(*) FILTER (correct) + 1) / 2.0) / nullif(count(*) FILTER (correct) * count(*) FILTER (NOT correct), 0) AS DOUBLE) AS auc, median(value) FILTER (correct) AS median_right, median(value) FILTER (NOT correct) AS median_wrong FROM rk",
    "vs30_carrier_word": f"{BASE}, {PTS}, s AS (SELECT qid, doc_id, sum(part) AS score FROM pw GROUP BY 1, 2), pk AS (SELECT qid, first(doc_id ORDER BY round(score, 9) DESC, doc_id) AS doc_id FROM s GROUP BY qid), c AS (SELECT qid, doc_id, token, part / sum(part) OVER (PARTITION BY qid) AS share, row_number() OVER (PARTITION BY qid ORDER BY round(part, 9) DESC, token) AS i FROM pw JOIN pk USING (qid, doc_id)) SELECT qid, doc_id, token, round(share, 6) AS share FROM c WHERE i = 1",
    "vs33_candidate_lineup": f"{BASE}, {TG}, {WORDS}, e AS (SELECT 'sparse' AS engine, qid, doc_id, score FROM sc UNION ALL SELECT 'words', qid, doc_id, score FROM bs), rk AS (SELECT engine, qid, doc_id, row_number() OVER (PARTITION BY engine, qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM e), ev AS (SELECT qid, target AS doc_id, 0 AS rank, '' AS engine FROM tg UNION ALL SELECT qid, doc_id, rank, engine FROM rk WHERE rank <= 6), o AS (SELECT qid, doc_id, min(struct_pack(r := rank, e := engine)) AS o FROM ev GROUP BY 1, 2) SELECT qid, doc_id, CAST(place AS INT) AS place FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY o.r, o.e, doc_id) AS place FROM o) WHERE place <= 6",
    "vs39_review_misses": f"{BASE}, {TG}, {WORDS}, pk AS (SELECT qid, first(doc_id ORDER BY round(score, 9) DESC, doc_id) AS now FROM sc GROUP BY qid), rv AS (SELECT qid, first(doc_id ORDER BY round(score, 9) DESC, doc_id) AS pick FROM bs GROUP BY qid), rk AS (SELECT tg.qid, CASE WHEN max(t.score) IS NOT NULL THEN count(*) FILTER (round(o.score, 9) >= round(t.score, 9)) END AS rank FROM tg LEFT JOIN sc t ON t.qid = tg.qid AND t.doc_id = target LEFT JOIN sc o ON o.qid = tg.qid GROUP BY 1), ms AS (SELECT qid, now, true AS miss FROM rk LEFT JOIN pk USING (qid) WHERE rank IS NULL OR rank > 1) SELECT qid, CASE WHEN miss IS NULL OR (pick IS NOT NULL AND pick IS DISTINCT FROM now) THEN 'stale' WHEN pick IS NULL THEN 'unreviewed' ELSE 'reviewed' END AS state FROM ms FULL JOIN rv USING (qid)",
}

#: Components of the graph without the nodes of a removal order, for every step of it.
TOP = "ord AS (SELECT node, row_number() OVER (ORDER BY degree DESC, node) AS step FROM deg)"
STEPS = "st AS (SELECT unnest(range(1, {0} + 1)) AS step), ln AS (SELECT st.step, n.node FROM st, nodes n JOIN ord o USING (node) WHERE o.step > st.step), le AS (SELECT st.step, src, dst FROM st, sym JOIN ord x ON x.node = src JOIN ord y ON y.node = dst WHERE x.step > st.step AND y.step > st.step), sc AS (SELECT step, node, min(m) AS component FROM (WITH RECURSIVE walk(step, node, m) AS (SELECT step, node, node FROM ln UNION SELECT w.step, e.dst, w.m FROM walk w JOIN le e ON e.step = w.step AND e.src = w.node WHERE w.m <= e.dst) SELECT * FROM walk) GROUP BY 1, 2), gi AS (SELECT step, max(k) AS giant FROM (SELECT step, component, count(*) AS k FROM sc GROUP BY 1, 2) GROUP BY step)"


def without(drop: str) -> str:
    """Components without the nodes of drop: a2(node, component)."""
    return f"gone AS ({drop}), a2 AS (SELECT node, min(m) AS component FROM (WITH RECURSIVE walk(node, m) AS (SELECT node, node FROM nodes WHERE node NOT IN (SELECT node FROM gone) UNION SELECT s.dst, w.m FROM walk w JOIN sym s ON s.src = w.node WHERE w.m <= s.dst AND s.dst NOT IN (SELECT node FROM gone)) SELECT * FROM walk) GROUP BY node), s2 AS (SELECT component, count(*) AS k FROM a2 GROUP BY component)"


SEEDED = "seeds AS (SELECT min(c_custkey) AS node FROM customer GROUP BY c_nationkey), lab AS (SELECT CAST(c_custkey AS BIGINT) AS node, c_nationkey AS c FROM customer), le AS (SELECT src, dst FROM sym JOIN lab x ON x.node = src JOIN lab y ON y.node = dst WHERE x.c = y.c), dd AS (WITH RECURSIVE walk(source, node, d) USING KEY (source, node) AS (SELECT CAST(node AS BIGINT), CAST(node AS BIGINT), 0 FROM seeds UNION SELECT w.source, e.dst, min(w.d + 1) FROM walk w JOIN le e ON e.src = w.node LEFT JOIN recurring.walk r ON r.source = w.source AND r.node = e.dst WHERE r.node IS NULL GROUP BY w.source, e.dst) SELECT * FROM walk)"

ORACLE_SQL |= {
    "rb5_evaluate_removal_set": f"{W}, {without('SELECT node FROM deg ORDER BY degree DESC, node LIMIT 20')} SELECT CAST(20 AS BIGINT) AS removed, max(k) AS giant FROM s2",
    "rb6_severed_nodes": f"{W}, {CC}, {without('SELECT node FROM deg ORDER BY degree DESC, node LIMIT 1')} SELECT node FROM big WHERE node NOT IN (SELECT node FROM gone) AND node NOT IN (SELECT node FROM a2 WHERE component = (SELECT component FROM s2 ORDER BY k DESC, component LIMIT 1))",
    "nu9_directed_battery": f"{W}, {CC}, r AS (SELECT count(b.src) / CAST(count(*) AS DOUBLE) AS v FROM edges e LEFT JOIN edges b ON b.src = e.dst AND b.dst = e.src) SELECT 'reciprocity' AS name, v AS value FROM r UNION ALL SELECT 'n_islands', CAST(count(*) FILTER (size > 1) - 1 AS DOUBLE) FROM sizes UNION ALL SELECT 'n_isolates', CAST(count(*) FILTER (size = 1) AS DOUBLE) FROM sizes",
    "nu13_random_neighbours": "WITH o AS (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY md5(CAST(doc_id AS VARCHAR) || ':' || CAST(k AS VARCHAR) || ':1')) AS i, count(*) OVER (PARTITION BY k) AS n FROM documents, range(5) t(k)) SELECT DISTINCT a.doc_id, b.doc_id AS other FROM o a JOIN o b ON b.k = a.k AND b.i = a.i % a.n + 1 WHERE a.doc_id <> b.doc_id",
    "cm12_nearest_seed": f"WITH {F1}, {SEEDED} SELECT node, first(source ORDER BY d, source) AS seed FROM dd GROUP BY node",
    "ext11_spread_sample": "WITH r AS (SELECT doc_id AS node, length(text) AS score, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS i, count(*) OVER () AS n FROM documents) SELECT node, CAST(score AS INT) AS score FROM r WHERE i <= 6 OR i > n - 2 OR i BETWEEN greatest(6, n // 2 - 2) + 1 AND greatest(6, n // 2 - 2) + 4",
}
