"""Oracle SQL in DuckDB's dialect for the registered queries."""

from __future__ import annotations

from gridmill.functions import text as T
from gridmill.sources.fixtures import CONFIGS, DOMAINS, HEADERS, ITEM_ORDER, REASONS, SOURCES, STRUCTURES

TOPIC = "CASE WHEN k % 3 = 0 THEN '部门预算支出' WHEN k % 3 = 1 THEN '项目进度跟踪' ELSE '区域网络覆盖' END"
_BODY = [
    "(CASE WHEN k % 5 = 0 THEN 'P' ELSE '项目' END) || l_partkey::VARCHAR",
    "CASE WHEN k % 31 = 0 THEN '很多' ELSE l_quantity::INTEGER::VARCHAR END",
    "l_extendedprice::DECIMAL(18,2)::VARCHAR",
    "(l_discount * 100)::DECIMAL(5,1)::VARCHAR || CASE WHEN k % 37 = 0 THEN '' ELSE '%' END",
    "CASE WHEN l_linestatus = 'F' THEN '已完成' ELSE '其他' END",
    "CASE WHEN k % 41 = 0 THEN '' WHEN k % 43 = 0 THEN '近期' ELSE strftime(l_shipdate, '%Y-%m-%d') END",
]
_HEAD = "CASE c " + " ".join(f"WHEN {c} THEN '{h}'" for c, h in enumerate(HEADERS)) + " END"
GRID = f"""
li AS (SELECT *, l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ITEM_ORDER)}) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
tab AS (SELECT DISTINCT k, n FROM li),
cells AS (
  SELECT k AS table_id, (n + 2)::INTEGER AS rows, 6 AS cols, 0 AS ordinal, 0 AS row, 0 AS col, 1 AS rowspan, 6 AS colspan, 'th' AS tag, 'title' AS role,
         CASE WHEN k % 23 = 0 THEN '' WHEN k % 29 = 0 THEN '天气' ELSE {TOPIC} END AS text FROM tab
  UNION ALL SELECT k, n + 2, 6, 1 + c, 1, c, CASE WHEN k % 19 = 0 AND c = 1 THEN 0 ELSE 1 END, 1, 'th', 'header', {_HEAD} FROM tab, range(6) t(c)
  UNION ALL SELECT k, n + 2, 6, 1000000, 1, 0, 1, 1, 'th', 'header', '{HEADERS[0]}' FROM tab WHERE k % 13 = 0
  UNION ALL SELECT k, n + 2, 6, 7 + 6 * (i - 1) + c, i + 1, c, CASE WHEN k % 7 = 0 AND n >= 2 AND i = 1 AND c = 0 THEN 2 ELSE 1 END,
         CASE WHEN k % 17 = 0 AND i = n AND c = 5 THEN 2 ELSE 1 END, 'td', 'body', CASE c {' '.join(f'WHEN {c} THEN {b}' for c, b in enumerate(_BODY))} END
  FROM li, range(6) t(c) WHERE NOT (k % 7 = 0 AND n >= 2 AND i = 2 AND c = 0) AND NOT (k % 11 = 0 AND i = n AND c = 5))"""
ISSUES = """
faults AS (SELECT *, CASE WHEN row < 0 OR col < 0 THEN 'negative_position' WHEN rowspan < 1 OR colspan < 1 THEN 'invalid_span'
                          WHEN row + rowspan > rows OR col + colspan > cols THEN 'out_of_range' END AS fault FROM cells),
slot AS (SELECT f.table_id, f.ordinal, r AS row, c AS col FROM faults f, LATERAL (SELECT unnest(range(f.row, f.row + f.rowspan)) AS r), LATERAL (SELECT unnest(range(f.col, f.col + f.colspan)) AS c) WHERE fault IS NULL),
placed AS (SELECT table_id, fault AS code, ordinal, row, col FROM faults WHERE fault IS NOT NULL
  UNION ALL SELECT table_id, 'overlap', ordinal, row, col FROM (SELECT *, row_number() OVER (PARTITION BY table_id, row, col ORDER BY ordinal) AS q FROM slot) WHERE q > 1),
cover AS (SELECT g.table_id, g.row, g.cols, count(DISTINCT s.col) AS covered FROM (SELECT table_id, cols, unnest(range(rows)) AS row FROM (SELECT DISTINCT table_id, rows, cols FROM cells)) g
          LEFT JOIN slot s ON s.table_id = g.table_id AND s.row = g.row GROUP BY ALL),
issues AS (SELECT * FROM placed UNION ALL SELECT table_id, 'uncovered_row', NULL, row, NULL FROM cover WHERE covered < cols AND table_id NOT IN (SELECT table_id FROM placed)),
valid AS (SELECT * FROM cells WHERE table_id NOT IN (SELECT table_id FROM issues))"""
REGIONS = """
bounds AS (SELECT table_id, unnest(range(rows + 1)) AS b FROM (SELECT DISTINCT table_id, rows FROM valid)),
safe AS (SELECT * FROM bounds x WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.table_id = x.table_id AND v.row < x.b AND x.b < v.row + v.rowspan)),
block AS (SELECT table_id, b AS start, lead(b) OVER (PARTITION BY table_id ORDER BY b) AS stop FROM safe),
regions AS (SELECT b.table_id, start, stop - start AS size FROM block b JOIN valid v ON v.table_id = b.table_id AND v.row >= start AND v.row + v.rowspan <= stop
            WHERE stop IS NOT NULL GROUP BY ALL HAVING bool_or(role = 'body') AND NOT bool_or(role = 'title')),
lastreg AS (SELECT table_id, max(start) AS start, arg_max(size, start) AS size FROM regions GROUP BY 1),
ends AS (SELECT table_id, min(start) AS s1, arg_min(size, start) AS z1, max(start) AS s2, arg_max(size, start) AS z2 FROM regions GROUP BY 1 HAVING min(start) < max(start))"""


def has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def numeric(x: str) -> str:
    return f"coalesce(regexp_matches(regexp_replace(regexp_replace(trim(replace({x}, ',', '')), '%+$', ''), '[\\p{{L}}\\s]+$', ''), '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$'), false)"


KIND = f"CASE WHEN {has('h', T.PERCENT_HINTS)} THEN 'percent' WHEN {has('h', T.NUMERIC_HINTS)} THEN 'numeric' WHEN {has('h', T.ENTITY_HINTS)} THEN 'entity' WHEN {has('h', T.STATUS_HINTS)} THEN 'status' ELSE 'text' END"
SUITS = f"""CASE WHEN {has('h', T.DATE_HINTS)} THEN regexp_matches(t, '[0-9]') AND {has('t', ('-', '/', '年', '月'))} WHEN {has('h', T.ID_HINTS)} THEN regexp_matches(t, '[0-9]') OR {has('t', ('BS', '单', '编号'))}
 WHEN {has('h', T.PERSON_HINTS)} THEN {has('t', ('工', '员', '经理', '主管', '张', '李', '王', '赵', '陈'))} WHEN {has('h', T.COMMENT_HINTS)} THEN length(t) > 2 AND NOT {numeric('t')}
 WHEN contains(h, '投诉类型') THEN {has('t', ('慢', '掉线', '计费', '延迟', '信号', '服务', '投诉'))} WHEN contains(h, '套餐') THEN {has('t', ('套餐', '流量包'))} WHEN contains(h, '时段') THEN {has('t', ('峰', '午', '夜', '节假日', '工作日', '时'))} ELSE true END"""
HEADS = """
over_col AS (SELECT table_id, ordinal, text, unnest(range(col, col + colspan)) AS col FROM cells WHERE role = 'header'),
heads AS (SELECT table_id, col, coalesce(arg_max(trim(text), ordinal) FILTER (trim(text) <> ''), arg_max(text, ordinal)) AS header FROM over_col GROUP BY ALL),"""
CELLSCORES = f"""{HEADS}
bodies AS MATERIALIZED (SELECT c.table_id, c.ordinal, c.row, c.col, coalesce(header, '') AS h, trim(text) AS t FROM cells c LEFT JOIN heads USING (table_id, col) WHERE role = 'body'),
kinds AS MATERIALIZED (SELECT *, {KIND} AS kind, {SUITS} AS suits, ends_with(t, '%') AND {numeric("trim(regexp_replace(t, '%$', ''))")} AS pct, {numeric('t')} AS num FROM bodies),
cs AS (SELECT table_id, ordinal, row, col, h AS header,
 CASE WHEN t = '' THEN 0.0 WHEN kind = 'percent' THEN CASE WHEN pct THEN 1.0 ELSE 0.0 END WHEN kind = 'numeric' THEN CASE WHEN num THEN 1.0 ELSE 0.0 END WHEN NOT suits THEN 0.35
  WHEN kind = 'entity' THEN CASE WHEN {has('t', T.ENTITY_WORDS)} THEN 0.95 ELSE 0.7 END WHEN kind = 'status' THEN CASE WHEN {has('t', T.STATUS_WORDS)} THEN 0.95 ELSE 0.75 END
  WHEN length(t) <= 2 THEN 0.6 WHEN t = h OR t IN {T.PLACEHOLDERS} THEN 0.55 ELSE 0.9 END::DOUBLE AS score,
 CASE WHEN t = '' THEN 'empty' WHEN kind = 'percent' THEN CASE WHEN pct THEN NULL ELSE 'percent' END WHEN kind = 'numeric' THEN CASE WHEN num THEN NULL ELSE 'numeric' END WHEN NOT suits THEN 'semantic_mismatch'
  WHEN kind = 'entity' THEN CASE WHEN {has('t', T.ENTITY_WORDS)} THEN NULL ELSE 'weak_text' END WHEN kind = 'status' THEN CASE WHEN {has('t', T.STATUS_WORDS)} THEN NULL ELSE 'weak_text' END
  WHEN length(t) <= 2 THEN 'weak_text' WHEN t = h OR t IN {T.PLACEHOLDERS} THEN 'weak_text' END AS issue FROM kinds)"""
_tok = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'))"
_jac = lambda a, b: f"(CASE WHEN len({_tok(a)}) = 0 OR len({_tok(b)}) = 0 THEN 0.0 ELSE len(list_intersect({_tok(a)}, {_tok(b)}))::DOUBLE / len(list_distinct(list_concat({_tok(a)}, {_tok(b)}))) END)"
_kw = lambda d: "[" + ", ".join(f"'{w}'" for w in T.KEYWORDS[d]) + "]"
SCORES = f"""{CELLSCORES},
planned AS (SELECT *, trim(text) AS t, {TOPIC.replace('k %', 'table_id %')} AS topic, table_id % 2 = 0 AS simple, list_distinct(list_concat(CASE table_id % 3 WHEN 0 THEN {_kw(DOMAINS[0])} WHEN 1 THEN {_kw(DOMAINS[1])} ELSE {_kw(DOMAINS[2])} END, {_tok(TOPIC.replace('k %', 'table_id %'))})) AS kws FROM cells),
hits AS (SELECT *, len(list_filter(kws, lambda w: contains(t, w))) > 0 AS hit FROM planned),
facts AS (SELECT table_id, any_value(simple) AS simple, any_value(topic) AS topic, any_value(kws) AS kws, count(*) FILTER (role = 'title') AS titles,
  coalesce(string_agg(t, ' ' ORDER BY ordinal) FILTER (role = 'title' AND t <> ''), '') AS title, coalesce(string_agg(t, ' ' ORDER BY ordinal) FILTER (t <> ''), '') AS corpus,
  count(*) FILTER (role = 'header') AS n, count(*) FILTER (role = 'header' AND t <> '') AS filled, count(DISTINCT t) FILTER (role = 'header' AND t <> '') AS uniq,
  count(*) FILTER (role = 'header' AND t IN {T.GENERIC_HEADERS}) AS generic, count(*) FILTER (role = 'header' AND t <> '' AND (hit OR {_jac('t', 'topic')} > 0)) AS semantic,
  count(*) FILTER (role = 'body' AND t <> '') AS nb, count(*) FILTER (role = 'body' AND t <> '' AND hit) AS hb FROM hits GROUP BY 1),
shown AS (SELECT f.table_id, count(DISTINCT trim(header)) AS shown, count(DISTINCT trim(header)) FILTER (len(list_filter(kws, lambda w: contains(trim(header), w))) > 0) AS shown_hits FROM heads JOIN facts f USING (table_id) WHERE trim(header) <> '' GROUP BY 1),
bs AS (SELECT table_id, avg(score) AS body, count(*) FILTER (issue IN ('empty', 'percent', 'numeric')) AS errs, count(*) FILTER (issue IN ('semantic_mismatch', 'weak_text')) AS weak FROM cs GROUP BY 1),
dims AS (SELECT table_id, simple, title AS title_text, n, filled, uniq, generic, semantic, coalesce(errs, 0) AS errs, coalesce(weak, 0) AS weak, body IS NULL AS bare, coalesce(body, 1.0) AS body,
  CASE WHEN simple THEN CASE WHEN title <> '' THEN 0.9 ELSE 1.0 END WHEN titles = 0 OR title = '' THEN 0.0 WHEN contains(title, topic) THEN 1.0 WHEN {_jac('title', 'topic')} >= 0.5 THEN 0.75 ELSE 0.0 END::DOUBLE AS title,
  CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 0.5 * filled / n + 0.25 * uniq / n + 0.25 * semantic / n - 0.08 * generic / n)) END::DOUBLE AS header,
  0.25 * CASE WHEN (simple OR title <> '') AND (contains(corpus, topic) OR {_jac('corpus', 'topic')} > 0) THEN 1.0 ELSE 0.45 END + 0.35 * least(1.0, len(list_filter(kws, lambda w: contains(corpus, w))) / 3.0)
   + 0.25 * least(1.0, coalesce(shown_hits, 0)::DOUBLE / greatest(1, least(3, coalesce(shown, 0)))) + 0.15 * least(1.0, hb::DOUBLE / greatest(1, least(4, nb))) AS topic
  FROM facts LEFT JOIN shown USING (table_id) LEFT JOIN bs USING (table_id)),
totals AS (SELECT *, round((0.18 * title + 0.27 * header + 0.40 * body + 0.15 * topic)::DOUBLE + 1e-9, 4) AS score,
  (errs + n - filled + CASE WHEN NOT simple AND title = 0 THEN 1 ELSE 0 END + CASE WHEN topic < 0.35 THEN 1 ELSE 0 END + CASE WHEN n = 0 THEN 1 ELSE 0 END)::BIGINT AS errors,
  weak + CASE WHEN simple AND title_text <> '' THEN 1 ELSE 0 END + CASE WHEN NOT simple AND title = 0.75 THEN 1 ELSE 0 END + CASE WHEN uniq < filled THEN 1 ELSE 0 END + CASE WHEN generic > 0 THEN 1 ELSE 0 END
   + CASE WHEN n > 0 AND semantic = 0 THEN 1 ELSE 0 END + CASE WHEN topic >= 0.35 AND topic < 0.6 THEN 1 ELSE 0 END + CASE WHEN bare THEN 1 ELSE 0 END AS noted FROM dims),
scores AS (SELECT table_id, round(title + 1e-9, 4) AS title_score, round(header + 1e-9, 4) AS header_score, round(body + 1e-9, 4) AS body_score, round(topic::DOUBLE + 1e-9, 4) AS topic_score, score, errors,
  (noted + CASE WHEN errors = 0 AND score < 0.58 THEN 1 ELSE 0 END)::BIGINT AS warnings, errors = 0 AND score >= 0.58 AS ok FROM totals)"""
POLICY = f"""{SCORES}, checked AS (SELECT table_id, table_id NOT IN (SELECT table_id FROM issues) AS sound FROM (SELECT DISTINCT table_id FROM cells)),
pol AS (SELECT table_id, CASE WHEN sound THEN 1.0 ELSE 0.0 END::DOUBLE AS structure, topic_score AS topic, least(header_score, body_score) AS semantic,
  least(CASE WHEN sound THEN 1.0 ELSE 0.0 END, topic_score, header_score, body_score) AS low, sound AND errors = 0 AND least(CASE WHEN sound THEN 1.0 ELSE 0.0 END, topic_score, header_score, body_score) >= 0.58 AS passed FROM scores JOIN checked USING (table_id)),
policy AS (SELECT table_id, structure, topic, semantic, round(low::DOUBLE + 1e-9, 4) AS overall, round((0.35 * structure + 0.25 * topic + 0.40 * semantic)::DOUBLE + 1e-9, 4) AS ranking, passed FROM pol)"""
_pick = lambda names, by: "CASE " + f"{by} % {len(names)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names)) + " END"
META = f"""meta AS (SELECT o_orderkey AS table_id, CASE WHEN o_orderkey % 61 = 0 THEN '' ELSE 'img/' || o_orderkey || '.jpg' END AS filename, 'img/' || o_orderkey || '.jpg' AS image,
  {_pick(CONFIGS, 'o_orderkey')} AS config_id, {_pick((*STRUCTURES, 'simple_single_header', 'title_header'), 'o_orderkey')} AS header_type, starts_with({_pick(CONFIGS, 'o_orderkey')}, 'simple') AS simple, contains({_pick(CONFIGS, 'o_orderkey')}, '_colored') AS colored, ends_with({_pick(CONFIGS, 'o_orderkey')}, '_lined') AS lined,
  o_orderkey % 4 = 0 AS has_rowspan, o_orderkey % 5 = 0 AS has_colspan, o_orderstatus AS status, o_totalprice AS price, line FROM orders, range(2) t(line) WHERE line = 0 OR o_orderkey % 59 = 0)"""
PRED = """pred AS (SELECT * REPLACE (CASE WHEN table_id % 3 = 0 AND colspan > 1 THEN colspan - 1 ELSE colspan END AS colspan, CASE WHEN table_id % 7 = 0 THEN 1 ELSE rowspan END AS rowspan,
  CASE WHEN table_id % 4 = 0 AND role = 'body' AND ordinal = 9 THEN text || 'x' ELSE text END AS text) FROM valid WHERE NOT (table_id % 5 = 0 AND ordinal = 8))"""
EVAL = f"""{PRED},
sa AS (SELECT DISTINCT table_id, row, col, rowspan, colspan FROM valid), sb AS (SELECT DISTINCT table_id, row, col, rowspan, colspan FROM pred),
ca AS (SELECT table_id, count(*) AS a FROM sa GROUP BY 1), cb AS (SELECT table_id, count(*) AS b FROM sb GROUP BY 1),
cab AS (SELECT table_id, count(*) AS common FROM (FROM sa INTERSECT FROM sb) GROUP BY 1),
ss AS (SELECT table_id, a::INTEGER AS ref_cells, coalesce(b, 0)::INTEGER AS pred_cells, coalesce(common, 0)::INTEGER AS common, round(2.0 * coalesce(common, 0) / (a + coalesce(b, 0)), 4)::DOUBLE AS structure_score FROM ca LEFT JOIN cb USING (table_id) LEFT JOIN cab USING (table_id)),
ta AS (SELECT v.table_id, count(*) AS n, (SELECT count(*) FROM pred p WHERE p.table_id = v.table_id) AS m, (SELECT count(*) FROM pred p JOIN valid w ON p.table_id = w.table_id AND p.row = w.row AND p.col = w.col AND trim(p.text) = trim(w.text) WHERE p.table_id = v.table_id) AS correct FROM valid v GROUP BY 1),
acc AS (SELECT table_id, correct, round(correct::DOUBLE / greatest(n, m), 4) AS cell_text_accuracy FROM ta),
res AS (SELECT * FROM ss JOIN acc USING (table_id))"""
MOVE = "CASE event_id % 4 WHEN 0 THEN 'copy' WHEN 1 THEN 'delete' WHEN 2 THEN 'swap' ELSE 'alter' END"
TRACES = f"""steps AS (SELECT user_id AS request_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'schema_attempt' WHEN 'view' THEN 'ordinary' WHEN 'click' THEN 'transformation' WHEN 'error' THEN 'reject' ELSE 'select' END AS action,
  CASE WHEN event_type = 'click' THEN {MOVE} END AS transformation, {_pick(SOURCES, 'event_id')} AS source, CASE WHEN event_type = 'error' THEN {_pick(REASONS, 'event_id')} END AS rejection_reason, value FROM events)"""
RATED = "rated AS (SELECT doc_id, quality::DOUBLE AS human, round(least(1.0, n_chars / 5000.0)::DOUBLE, 2) AS checker FROM labels JOIN documents USING (doc_id))"
MARK = """(CASE WHEN rowspan > 1 THEN ' rowspan="' || rowspan || '"' ELSE '' END || CASE WHEN colspan > 1 THEN ' colspan="' || colspan || '"' ELSE '' END)"""
ESC = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
MESSAGE = "CASE user_id % 9 WHEN 0 THEN 'Invalid table schema: row 2' WHEN 1 THEN 'empty header cell at (' || user_id % 7 || ', ' || event_id % 5 || ')' WHEN 2 THEN 'non-numeric value at (3, 2)' WHEN 3 THEN 'warning: header duplication' WHEN 4 THEN 'WebDriver lost' WHEN 5 THEN 'topic differs (a, b)' WHEN 6 THEN 'budget exhausted' WHEN 7 THEN 'empty body cell at (1,2,3)' ELSE 'text does not match header (' || event_id || ',1) twice (9, 9)' END"


def _sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(x.strip().rstrip(",") for x in ctes[:-1]) + "\n" + ctes[-1]


G, GI = (GRID,), (GRID, ISSUES)
VALIDCOLS = "table_id, rows, ordinal, row, col, rowspan, colspan, text"
COPY = """SELECT v.table_id, rows + size AS rows, ordinal, CASE WHEN row >= start + size THEN row + size ELSE row END AS row, col, rowspan, colspan, text FROM valid v JOIN lastreg USING (table_id)
 UNION ALL SELECT table_id, rows + size, nxt + row_number() OVER (PARTITION BY table_id ORDER BY ordinal), row + size, col, rowspan, colspan, text FROM (SELECT *, max(ordinal) OVER (PARTITION BY table_id) AS nxt FROM valid JOIN lastreg USING (table_id)) WHERE row >= start AND row + rowspan <= start + size"""
DELETE = "SELECT table_id, rows - size AS rows, ordinal, CASE WHEN row >= start + size THEN row - size ELSE row END AS row, col, rowspan, colspan, text FROM valid JOIN lastreg USING (table_id) WHERE NOT (row >= start AND row + rowspan <= start + size) AND size < rows"
SWAP = """SELECT table_id, rows, ordinal, CASE WHEN row >= s1 AND row < s1 + z1 THEN row + s2 - s1 + z2 - z1 WHEN row >= s2 AND row < s2 + z2 THEN row - s2 + s1 WHEN row >= s1 + z1 AND row < s2 THEN row + z2 - z1 ELSE row END AS row, col, rowspan, colspan, text
 FROM valid JOIN ends USING (table_id) WHERE s1 + z1 <= s2"""
PLAIN = "plain AS (SELECT table_id, arg_min(text, ordinal) AS t1, min(ordinal) AS o1, arg_max(text, ordinal) AS t2, max(ordinal) AS o2 FROM valid WHERE role = 'body' AND rowspan = 1 AND colspan = 1 AND table_id NOT IN (SELECT table_id FROM ends) GROUP BY 1 HAVING count(*) > 1)"
SWAP_CELLS = "SELECT table_id, rows, ordinal, row, col, rowspan, colspan, CASE ordinal WHEN o1 THEN t2 WHEN o2 THEN t1 ELSE text END AS text FROM valid JOIN plain USING (table_id)"

ORACLE: dict[str, str] = {
    "validate_tables": _sql(*GI, "SELECT table_id, code, ordinal, row, col FROM issues"),
    "table_validity": _sql(*GI, "SELECT table_id, count(i.code) = 0 AS ok, count(i.code) AS issues FROM (SELECT DISTINCT table_id FROM cells) LEFT JOIN issues i USING (table_id) GROUP BY 1"),
    "row_coverage": _sql(*GI, "SELECT table_id, row, covered, cols FROM cover"),
    "occupied_slots": _sql(*G, "SELECT table_id, count(*) AS slots FROM (SELECT table_id, unnest(range(rowspan * colspan)) FROM cells WHERE rowspan >= 1 AND colspan >= 1) GROUP BY 1"),
    "table_facts": _sql(*G, "SELECT table_id, count(*) AS cells, bool_or(rowspan > 1) AS has_rowspan, bool_or(colspan > 1) AS has_colspan, max(ordinal) + 1 AS next_ordinal FROM cells GROUP BY 1"),
    "structure_signature": _sql(*G, "SELECT table_id, string_agg(tag || '[' || row || ',' || col || '](' || rowspan || ',' || colspan || ')', '|' ORDER BY row, col, ordinal) AS signature FROM cells GROUP BY 1"),
    "safe_regions": _sql(*GI, REGIONS, "SELECT table_id, start, size FROM regions"),
    "copy_region": _sql(*GI, REGIONS, COPY),
    "delete_region": _sql(*GI, REGIONS, DELETE),
    "swap_regions": _sql(*GI, REGIONS, SWAP),
    "swap_cells": _sql(*GI, "pairs AS MATERIALIZED (SELECT table_id, max(text) FILTER (ordinal = 8) AS a, max(text) FILTER (ordinal = 9) AS b FROM valid WHERE ordinal IN (8, 9) GROUP BY 1)", "SELECT table_id, ordinal, CASE ordinal WHEN 8 THEN b WHEN 9 THEN a ELSE text END AS text FROM valid JOIN pairs USING (table_id)"),
    "alter_background": _sql(*GI, REGIONS, "SELECT table_id, ordinal, CASE WHEN row >= start AND row + rowspan <= start + size THEN '#eee' END AS background FROM valid JOIN lastreg USING (table_id)"),
    "augment": _sql(*GI, REGIONS, PLAIN, f"""SELECT 'copy' AS transformation, {VALIDCOLS} FROM ({COPY}) UNION ALL SELECT 'delete', {VALIDCOLS} FROM ({DELETE}) UNION ALL SELECT 'swap', {VALIDCOLS} FROM ({SWAP}) UNION ALL SELECT 'swap', {VALIDCOLS} FROM ({SWAP_CELLS}) UNION ALL SELECT 'alter', {VALIDCOLS} FROM valid JOIN lastreg USING (table_id)"""),
    "fallback_grid": _sql(*G, """titles AS (SELECT table_id, any_value(rows) AS rows, arg_min(text, ordinal) AS title, min(ordinal) AS source FROM cells WHERE role = 'title' GROUP BY 1)""", """slot AS (SELECT f.table_id, f.ordinal, f.role, f.text, r AS row, c AS col FROM cells f, LATERAL (SELECT unnest(range(f.row, f.row + greatest(1, f.rowspan))) AS r), LATERAL (SELECT unnest(range(f.col, f.col + greatest(1, f.colspan))) AS c) WHERE r < rows AND c < cols)""",
        """src AS (SELECT table_id, row, col, min(ordinal) AS source, arg_min(role, ordinal) AS role, arg_min(text, ordinal) AS text FROM slot GROUP BY ALL)""", """hrow AS (SELECT DISTINCT table_id, row FROM cells WHERE role = 'header')""",
        """SELECT g.table_id, 1 + (g.row - 1) * 6 + g.col AS ordinal, g.row, g.col, 1 AS colspan, CASE WHEN s.role IN ('header', 'body') THEN s.role WHEN h.row IS NOT NULL THEN 'header' ELSE 'body' END AS role, coalesce(text, '') AS text, source FROM (SELECT table_id, r AS row, c AS col FROM (SELECT DISTINCT table_id, rows, cols FROM cells) t, LATERAL (SELECT unnest(range(1, t.rows)) AS r), range(6) x(c)) g
           LEFT JOIN src s ON s.table_id = g.table_id AND s.row = g.row AND s.col = g.col LEFT JOIN hrow h ON h.table_id = g.table_id AND h.row = g.row
           UNION ALL SELECT table_id, 0, 0, 0, 6, 'title', title, source FROM titles"""),
    "structure_tokens": _sql(*G, f"rowsof AS (SELECT table_id, row, string_agg('<td' || {MARK} || '></td>', '' ORDER BY col, ordinal) AS s FROM cells GROUP BY ALL)", "SELECT table_id, string_agg('<tr>' || s || '</tr>', '' ORDER BY row) AS tokens FROM rowsof GROUP BY 1"),
    "build_html": _sql(*G, f"rowsof AS (SELECT table_id, row, string_agg('<' || tag || {MARK} || '>' || {ESC} || '</' || tag || '>', '' ORDER BY col, ordinal) AS s FROM cells GROUP BY ALL)", "SELECT table_id, '<table>' || string_agg('<tr>' || s || '</tr>', '' ORDER BY row) || '</table>' AS html FROM rowsof GROUP BY 1"),
    "parse_html": _sql(*GI, "SELECT table_id, row, col, rowspan, colspan, tag, text FROM valid"),
    "annotated_roles": _sql(*G, "SELECT role, row_role, count(*) AS n FROM (SELECT role, CASE WHEN role = 'title' THEN 'title' WHEN role = 'header' AND col < CASE WHEN table_id % 2 = 0 THEN 2 ELSE 1 END AND row > 1 THEN 'row_header' WHEN role = 'header' THEN 'column_header' ELSE 'body' END AS row_role FROM cells) GROUP BY ALL"),
    "cell_scores": _sql(*G, CELLSCORES, "SELECT * FROM cs"),
    "effective_headers": _sql(*G, HEADS, "SELECT * FROM heads"),
    "table_scores": _sql(*G, SCORES, "SELECT * FROM scores"),
    "score_policy": _sql(*GI, POLICY, "SELECT * FROM policy"),
    "select_best": _sql(*GI, POLICY, "SELECT request, table_id, ranking, overall FROM (SELECT *, table_id % 100 AS request, row_number() OVER (PARTITION BY table_id % 100 ORDER BY ranking DESC, overall DESC, table_id) AS q FROM policy WHERE passed) WHERE q = 1"),
    "repair_action": _sql(*G, SCORES, "located AS (SELECT table_id, count(*) AS t FROM (SELECT table_id FROM cs WHERE issue IS NOT NULL UNION ALL SELECT table_id FROM cells WHERE role = 'header' AND trim(text) = '') GROUP BY 1)", "decided AS (SELECT s.table_id, CASE WHEN title_score <= 0 THEN 'rebuild_schema' WHEN header_score <= 0 THEN 'repair_header' WHEN coalesce(t, 0) > 0 THEN 'repair_cells' ELSE 'repair_body' END AS action, coalesce(t, 0) AS t FROM scores s LEFT JOIN located USING (table_id))", "SELECT table_id, action, CASE WHEN action = 'repair_cells' THEN t ELSE 0 END AS targets FROM decided"),
    "low_dimensions": _sql(*G, SCORES, "low AS (SELECT table_id, unnest(['title', 'header', 'body', 'topic']) AS d, unnest([title_score, header_score, body_score, topic_score]) AS s FROM scores)", "SELECT t.table_id, coalesce(string_agg(d || ':' || s::DECIMAL(6,4)::VARCHAR, ',' ORDER BY s, d) FILTER (q <= 3), '') AS low FROM (SELECT DISTINCT table_id FROM scores) t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY s, d) AS q FROM low WHERE s < 0.6) USING (table_id) GROUP BY 1"),
    "structure_scores": _sql(*GI, EVAL, "SELECT * FROM ss"),
    "text_accuracy": _sql(*GI, EVAL, "SELECT * FROM acc"),
    "perturbed": _sql(*GI, META, "d AS (SELECT v.*, header_type AS h, simple AS wc FROM valid v JOIN (SELECT * FROM meta WHERE line = 0) m USING (table_id))",
        "SELECT table_id, ordinal, CASE WHEN h = 'simple_single_header' OR colspan <= 1 THEN colspan WHEN wc THEN greatest(1, colspan - 1) WHEN h IN ('grouped_columns', 'summary_row_colspan') THEN 1 ELSE colspan END AS colspan, CASE WHEN h = 'simple_single_header' OR rowspan <= 1 THEN rowspan WHEN wc OR h IN ('body_rowspan', 'multi_level_column_header') THEN 1 ELSE rowspan END AS rowspan FROM d WHERE NOT (NOT wc AND h = 'body_rowspan' AND row > 2 AND col = 0)"),
    "batch_report": _sql(META, "SELECT 'config' AS kind, config_id AS name, count(*) AS n, count(*) FILTER (NOT simple) AS complex_total, count(*) FILTER (NOT simple AND has_rowspan) AS complex_rowspan, count(*) FILTER (NOT simple AND has_colspan) AS complex_colspan FROM meta GROUP BY 2 UNION ALL SELECT 'header_type', header_type, count(*), count(*) FILTER (NOT simple), count(*) FILTER (NOT simple AND has_rowspan), count(*) FILTER (NOT simple AND has_colspan) FROM meta GROUP BY 2 UNION ALL SELECT 'status', status, count(*), count(*) FILTER (NOT simple), count(*) FILTER (NOT simple AND has_rowspan), count(*) FILTER (NOT simple AND has_colspan) FROM meta GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*), count(*) FILTER (NOT simple), count(*) FILTER (NOT simple AND has_rowspan), count(*) FILTER (NOT simple AND has_colspan) FROM meta"),
    "duplicate_files": _sql(META, "SELECT coalesce(nullif(filename, ''), nullif(image, '')) AS file, count(*) AS n FROM meta GROUP BY 1 HAVING count(*) > 1"),
    "meta_by_file": _sql(META, "SELECT file, config_id, line FROM (SELECT *, coalesce(nullif(filename, ''), nullif(image, '')) AS file, row_number() OVER (PARTITION BY coalesce(nullif(filename, ''), nullif(image, '')) ORDER BY line DESC) AS q FROM meta) WHERE q = 1"),
    "missing_rows": "WITH m AS (SELECT o_orderkey AS k, 'img/' || o_orderkey || '.jpg' AS file FROM orders) SELECT 'cells' AS source, file FROM m WHERE k % 47 = 0 UNION ALL SELECT 'gt', file FROM m WHERE k % 53 = 0",
    "export_join": "WITH m AS (SELECT o_orderkey AS k, 'img/' || o_orderkey || '.jpg' AS file FROM orders) SELECT file, k % 53 <> 0 AS has_gt FROM m WHERE k % 47 <> 0",
    "export_split": "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7' || o_orderkey), o_orderkey) AS p, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN p <= floor(n * 0.1) THEN 'test' WHEN p <= floor(n * 0.1) + floor(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM r",
    "split_manifest": "WITH n AS (SELECT count(*) AS n FROM orders) SELECT 'test' AS split, floor(n * 0.1)::BIGINT AS n FROM n UNION ALL SELECT 'val', floor(n * 0.2)::BIGINT FROM n UNION ALL SELECT 'train', (n - floor(n * 0.1) - floor(n * 0.2))::BIGINT FROM n",
    "box_issues": _sql(*G, "b AS (SELECT table_id, ordinal, (colspan * 80)::DOUBLE * rowspan * 24 AS area, (col + colspan) * 80 > 480 OR (row + rowspan) * 24 > rows * 24 AS outside FROM cells)", "SELECT table_id, ordinal, area, CASE WHEN area <= 0 THEN 'no_area' WHEN outside THEN 'out_of_image' END AS issue FROM b"),
    "pool_duplicates": "SELECT doc_id, source, row_number() OVER (PARTITION BY source, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY doc_id) > 1 AS duplicate FROM documents",
    "token_overlap": "WITH p AS (SELECT a.item_id, a.text, b.text AS other FROM benchmark a LEFT JOIN benchmark b ON b.item_id = a.item_id + 1) SELECT item_id, round(" + _jac("text", "other") + ", 6) AS overlap FROM p WHERE other IS NOT NULL",
    "message_classes": f"WITH m AS (SELECT event_id, {MESSAGE} AS message FROM events), l AS (SELECT *, lower(message) AS low, string_split(regexp_extract(message, '^[^(]*\\(([^)]*)\\)', 1), ',') AS parts FROM m) SELECT event_id, CASE WHEN contains(low, 'invalid table schema') THEN 'schema_invalid' WHEN contains(low, 'webdriver') OR contains(low, 'render') THEN 'render_failed' WHEN contains(low, 'budget exhausted') THEN 'budget_exhausted' ELSE 'generation_failed' END AS error_class, CASE WHEN contains(low, 'empty header') THEN 'header_incomplete' WHEN contains(low, 'empty body') THEN 'empty_cell' WHEN contains(low, 'non-numeric') THEN 'invalid_cell_type' WHEN contains(low, 'does not match header') THEN 'header_body_mismatch' WHEN contains(low, 'topic') THEN 'topic_mismatch' WHEN contains(low, 'duplication') THEN 'duplicate_content' ELSE 'semantic_conflict' END AS code, CASE WHEN len(parts) = 2 AND try_cast(trim(parts[1]) AS INTEGER) IS NOT NULL AND try_cast(trim(parts[2]) AS INTEGER) IS NOT NULL THEN trim(parts[1])::INTEGER END AS loc_row, CASE WHEN len(parts) = 2 AND try_cast(trim(parts[1]) AS INTEGER) IS NOT NULL AND try_cast(trim(parts[2]) AS INTEGER) IS NOT NULL THEN trim(parts[2])::INTEGER END AS loc_col FROM l",
    "trace_summary": _sql(TRACES, "one AS (SELECT request_id, bool_or(action = 'select') AS ok, count(*) FILTER (action = 'ordinary') AS o, count(*) FILTER (action = 'transformation') AS t, count(*) FILTER (action = 'schema_attempt') AS s, count(*) FILTER (action <> 'select') AS c, sum(value) AS e FROM steps GROUP BY 1)",
        "SELECT count(*) AS requests, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, round(avg(ok::INTEGER) + 1e-9, 4) AS success_rate, sum(o + t)::BIGINT AS candidates, sum(o)::BIGINT AS ordinary_candidates, sum(t)::BIGINT AS transformed_candidates, round(avg(o + t) + 1e-9, 4) AS average_candidates, round(avg(c) + 1e-9, 4) AS average_model_calls, round(avg(e) + 1e-9, 4) AS average_elapsed_seconds, round(avg(o) + 1e-9, 4) AS average_filling_attempts, round(avg(s) + 1e-9, 4) AS average_schema_attempts FROM one"),
    "trace_counters": _sql(TRACES, "SELECT 'action' AS kind, action AS name, count(*) AS n FROM steps GROUP BY 2 UNION ALL SELECT 'transformation', transformation, count(*) FROM steps WHERE transformation IS NOT NULL GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM steps WHERE source <> '' GROUP BY 2 UNION ALL SELECT 'rejection_reason', rejection_reason, count(*) FROM steps WHERE rejection_reason IS NOT NULL GROUP BY 2"),
    "over_budget": _sql(TRACES, "u AS (SELECT request_id, ts, seq, sum((action <> 'select')::INTEGER) OVER w AS mc, sum((action = 'schema_attempt')::INTEGER) OVER w AS sa, sum((action IN ('ordinary', 'transformation'))::INTEGER) OVER w AS ca, sum(value) OVER w AS el FROM steps WINDOW w AS (PARTITION BY request_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))",
        "o AS (SELECT *, CASE WHEN mc > 5 THEN 'model_calls' WHEN sa > 1 THEN 'schema_attempts' WHEN ca > 3 THEN 'candidates' WHEN el > 150 THEN 'elapsed_seconds' END AS resource, CASE WHEN mc > 5 THEN mc WHEN sa > 1 THEN sa WHEN ca > 3 THEN ca ELSE el END::DOUBLE AS used FROM u)",
        "SELECT request_id, arg_min(seq, (ts, seq)) AS seq, arg_min(resource, (ts, seq)) AS resource, round(arg_min(used, (ts, seq)), 4) AS used FROM o WHERE resource IS NOT NULL GROUP BY 1"),
    "correlations": _sql(RATED, "rk AS (SELECT *, rank() OVER (ORDER BY human) + (count(*) OVER (PARTITION BY human) - 1) / 2.0 AS rx, rank() OVER (ORDER BY checker) + (count(*) OVER (PARTITION BY checker) - 1) / 2.0 AS ry FROM rated)",
        "kp AS (SELECT count(*) FILTER ((a.human - b.human) * (a.checker - b.checker) > 0) AS c, count(*) FILTER ((a.human - b.human) * (a.checker - b.checker) < 0) AS d, count(*) FILTER (a.human = b.human AND a.checker <> b.checker) AS tx, count(*) FILTER (a.human <> b.human AND a.checker = b.checker) AS ty FROM rated a JOIN rated b ON a.doc_id < b.doc_id)",
        "SELECT round(corr(human, checker), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, (SELECT round((c - d) / (sqrt(c + d + tx) * sqrt(c + d + ty)), 6) FROM kp) AS kendall FROM rk"),
    "average_ranks": _sql(RATED, "SELECT doc_id, rank() OVER (ORDER BY checker) + (count(*) OVER (PARTITION BY checker) - 1) / 2.0 AS rank FROM rated"),
    "bounded_history": "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS q FROM conversations) WHERE q <= 2",
    "preferences": "SELECT conv_id, role, arg_max(text, turn) AS text FROM conversations GROUP BY 1, 2",
    "gen_requests": f"SELECT id, {_pick(CONFIGS, 'id')} AS config_id, CASE WHEN id % 8 >= 4 THEN {_pick(STRUCTURES, '((id // 8) * 4 + id % 8 - 4)')} END AS structure FROM range(1000) t(id)",
}
