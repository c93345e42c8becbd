"""Oracle SQL of the queries in ``more``."""

from __future__ import annotations

from gridmill.functions import text as T
from gridmill.operators import layouts as L
from gridmill.operators import legacy as Y
from gridmill.sources.fixtures import DOMAINS

from .more import CHINESE, ENGLISH, PROPOSALS, USED_TOPICS
from .oracle import ESC, GRID, ISSUES, META, PLAIN, POLICY, PRED, REGIONS, SCORES, TOPIC, _jac, _sql
from .oracle import has
from .oracle_made import CELLS, HEADED, PLAN, RULES, _made, draw, one_of

FLAT = """flat AS MATERIALIZED (SELECT table_id, rows - 1 AS rows, cols, ordinal, row - 1 AS row, col, rowspan, colspan, role, text FROM valid WHERE role <> 'title'),
edge AS (SELECT DISTINCT t.table_id, b FROM (SELECT DISTINCT table_id, cols FROM flat) t, range(7) r(b) WHERE b <= cols AND NOT EXISTS (SELECT 1 FROM flat f WHERE f.table_id = t.table_id AND f.col < b AND b < f.col + f.colspan)),
strip AS (SELECT table_id, b AS start, lead(b) OVER (PARTITION BY table_id ORDER BY b) AS stop FROM edge),
colreg AS MATERIALIZED (SELECT s.table_id, start, stop - start AS size FROM strip s JOIN flat f ON f.table_id = s.table_id AND f.col >= start AND f.col + f.colspan <= stop WHERE stop IS NOT NULL GROUP BY ALL HAVING bool_or(role = 'body')),
lastcol AS (SELECT table_id, max(start) AS start, arg_max(size, start) AS size, min(start) AS s1, arg_min(size, start) AS z1 FROM colreg GROUP BY 1)"""
FLATCOLS = "table_id, cols, ordinal, row, col, text"
JSON = "to_json({0})::VARCHAR"
NORMAL = "trim(lower(regexp_replace(text, '\\s+', ' ', 'g')))"
CELL_JSON = f"""'{{"col":' || col || ',"colspan":' || colspan || ',"role":"' || role || '","row":' || row || ',"rowspan":' || rowspan || ',"tag":"' || tag || '","text":' || to_json({NORMAL})::VARCHAR || ',"visual":{{}}}}'"""


def signed(cells: str) -> str:
    return f"""signed AS MATERIALIZED (SELECT table_id, sha256('{{"cells":[' || string_agg({CELL_JSON}, ',' ORDER BY row, col, role, tag, ordinal) || '],"cols":' || any_value(cols) || ',"header_type":"grid","rows":' || any_value(rows) || '}}') AS signature FROM {cells} GROUP BY 1)"""


HEAD_DUPLICATES = signed("(SELECT * FROM cells WHERE role = 'header')") + ", dups AS MATERIALIZED (SELECT table_id, row_number() OVER (PARTITION BY table_id % 100, signature ORDER BY table_id) > 1 AS duplicate FROM signed)"
_place = "'(' || row || ', ' || col || ')'"
MESSAGES = f"""
kw AS (SELECT DISTINCT table_id, simple, topic, kws FROM planned),
hd AS (SELECT table_id, count(*) AS n, count(*) FILTER (t <> '') AS m, count(DISTINCT t) FILTER (t <> '') AS d, count(*) FILTER (t IN {T.GENERIC_HEADERS}) AS g, count(*) FILTER (t <> '' AND (hit OR {_jac('t', 'topic')} > 0)) AS s FROM hits WHERE role = 'header' GROUP BY 1),
tt AS (SELECT table_id, count(*) AS n, count(*) FILTER (t <> '') AS m FROM hits WHERE role = 'title' GROUP BY 1),
bd AS (SELECT table_id, count(*) AS n FROM cells WHERE role = 'body' GROUP BY 1),
told AS (SELECT s.*, simple, coalesce(hd.n, 0) AS hn, coalesce(hd.m, 0) AS hm, coalesce(hd.d, 0) AS hdist, coalesce(hd.g, 0) AS hg, coalesce(hd.s, 0) AS hs, coalesce(tt.n, 0) AS tn, coalesce(tt.m, 0) AS tm, coalesce(bd.n, 0) AS bn
  FROM scores s JOIN kw USING (table_id) LEFT JOIN hd USING (table_id) LEFT JOIN tt USING (table_id) LEFT JOIN bd USING (table_id)),
raw AS (
  SELECT table_id, 1 AS phase, 0 AS ordinal, 'warning' AS severity, 'simple table unexpectedly contains a title row' AS message FROM told WHERE simple AND tm > 0
  UNION ALL SELECT table_id, 1, 0, 'error', CASE WHEN tn = 0 THEN 'complex table is missing a title cell' WHEN tm = 0 THEN 'complex table title is empty' ELSE 'complex table title does not contain or align with the planned topic' END FROM told WHERE NOT simple AND title_score = 0
  UNION ALL SELECT table_id, 1, 0, 'warning', 'complex table title is related to the planned topic but not exact' FROM told WHERE NOT simple AND title_score = 0.75
  UNION ALL SELECT table_id, 2, 0, 'error', 'table has no header cells' FROM told WHERE hn = 0
  UNION ALL SELECT table_id, 2, ordinal, 'error', 'empty header cell at ' || {_place} FROM cells WHERE role = 'header' AND trim(text) = ''
  UNION ALL SELECT table_id, 3, 0, 'warning', 'header duplication detected in ' || (hm - hdist) || ' header cells' FROM told WHERE hm > hdist
  UNION ALL SELECT table_id, 3, 1, 'warning', 'generic header text detected in ' || hg || ' header cells' FROM told WHERE hg > 0
  UNION ALL SELECT table_id, 3, 2, 'warning', 'headers do not contain topic or semantic scenario signals' FROM told WHERE hn > 0 AND hs = 0
  UNION ALL SELECT table_id, 4, 0, 'warning', 'table has no body cells' FROM told WHERE bn = 0
  UNION ALL SELECT table_id, 4, ordinal, CASE WHEN issue IN ('empty', 'percent', 'numeric') THEN 'error' ELSE 'warning' END, CASE issue WHEN 'empty' THEN 'empty body cell at ' || {_place} WHEN 'percent' THEN 'percentage-like column has non-percentage value at ' || {_place}
    WHEN 'numeric' THEN 'numeric-like column has non-numeric value at ' || {_place} WHEN 'semantic_mismatch' THEN 'body cell at ' || {_place} || ' does not match header ''' || header || '''' ELSE 'body cell at ' || {_place} || ' looks generic for header ''' || header || '''' END FROM cs WHERE issue IS NOT NULL
  UNION ALL SELECT table_id, 5, 0, CASE WHEN topic_score < 0.35 THEN 'error' ELSE 'warning' END, CASE WHEN topic_score < 0.35 THEN 'table content is not aligned with the planned topic or semantic scenario' ELSE 'weak topic or semantic scenario consistency' END FROM told WHERE topic_score < 0.6
  UNION ALL SELECT table_id, 6, 0, 'warning', printf('overall filling score %.3f below threshold 0.580', score + 1e-9) FROM told WHERE errors = 0 AND score < 0.58),
msgs AS MATERIALIZED (SELECT table_id, severity, (row_number() OVER (PARTITION BY table_id, severity ORDER BY phase, ordinal) - 1)::INTEGER AS seq, message FROM raw)"""
_low = " UNION ALL ".join(f"SELECT table_id, {i} AS i, '{d}' AS d, {c}_score AS s FROM scores" for i, (d, c) in enumerate((("title", "title"), ("header", "header"), ("body", "body"), ("topic_consistency", "topic"))))
ERRORS = f"""low AS (SELECT table_id, string_agg(d || ':' || printf('%.3f', s + 1e-9), ',' ORDER BY s, i) AS t FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY s, i) AS q FROM ({_low}) WHERE s < 0.6) WHERE q <= 3 GROUP BY 1),
first5 AS (SELECT table_id, string_agg(message, '; ' ORDER BY seq) FILTER (severity = 'error') AS e, string_agg(message, '; ' ORDER BY seq) FILTER (severity = 'warning') AS w FROM msgs WHERE seq < 5 GROUP BY 1)"""
DECISION = """coded AS (SELECT table_id, (severity <> 'error')::INTEGER AS r, seq, message, CASE WHEN message LIKE 'empty header%' OR message LIKE '%no header%' THEN 'header_incomplete' WHEN message LIKE 'empty body%' THEN 'empty_cell' WHEN message LIKE '%non-percentage%' OR message LIKE '%non-numeric%' THEN 'invalid_cell_type'
   WHEN message LIKE '%does not match header%' THEN 'header_body_mismatch' WHEN message LIKE '%topic%' OR message LIKE '%semantic scenario%' THEN 'topic_mismatch' WHEN message LIKE '%duplication%' THEN 'duplicate_content' ELSE 'semantic_conflict' END AS code,
   regexp_extract(message, '\\((\\d+), (\\d+)\\)', 1) AS r1, regexp_extract(message, '\\((\\d+), (\\d+)\\)', 2) AS c1 FROM msgs),
gathered AS (SELECT table_id, string_agg(code, ',' ORDER BY r, seq) AS codes, coalesce(string_agg(r1 || ':' || c1, ',' ORDER BY r, seq) FILTER (r1 <> ''), '') AS cells, coalesce(list_sort(list_distinct(list(c1::INTEGER) FILTER (c1 <> ''))), []) AS cols FROM (SELECT * REPLACE (nullif(c1, '') AS c1) FROM coded) GROUP BY 1)"""
SEEN = f"""{PRED},
pp AS MATERIALIZED (SELECT table_id, row, tag, rowspan, colspan, trim(text) AS text, (sum(colspan) OVER (PARTITION BY table_id, row ORDER BY col, ordinal) - colspan)::BIGINT AS col FROM pred),
width AS (SELECT table_id, row, sum(colspan) AS w FROM pp GROUP BY 1, 2),
size AS (SELECT table_id, max(row) + 1 AS parsed_rows, max(w) AS parsed_cols FROM width GROUP BY 1),
free AS (SELECT table_id, count(*) FILTER (w < parsed_cols) AS error_count FROM width JOIN size USING (table_id) GROUP BY 1),
rsig AS (SELECT table_id, count(*) AS ref, any_value(rows) AS rows, any_value(cols) AS cols, string_agg(tag || '[' || row || ',' || col || '](' || rowspan || ',' || colspan || ')', '|' ORDER BY row, col) AS sig FROM valid GROUP BY 1),
psig AS (SELECT table_id, count(*) AS pred, string_agg(tag || '[' || row || ',' || col || '](' || rowspan || ',' || colspan || ')', '|' ORDER BY row, col) AS sig FROM pp GROUP BY 1),
same AS (SELECT p.table_id, count(*) FILTER (p.rowspan = v.rowspan AND p.colspan = v.colspan) AS spans, count(*) FILTER (p.text = trim(v.text)) AS texts FROM pp p JOIN valid v ON p.table_id = v.table_id AND p.row = v.row AND p.col = v.col GROUP BY 1),
seen AS MATERIALIZED (SELECT table_id, error_count = 0 AS html_valid, parsed_rows, parsed_cols::BIGINT AS parsed_cols, error_count, r.sig = p.sig AS structure_signature_match, ref AS ref_cell_count, pred AS pred_cell_count, coalesce(texts, 0) AS correct_cell_text,
  round(coalesce(texts, 0)::DOUBLE / greatest(ref, pred), 4) AS cell_text_accuracy, round(2.0 * coalesce(spans, 0) / (ref + pred), 4)::DOUBLE AS structure_score,
  2 * coalesce(spans, 0) = ref + pred AND parsed_rows = rows AND parsed_cols = cols AND error_count = 0 AS exact_match, error_count = 0 AND parsed_rows = rows AND parsed_cols = cols AS structure_valid
  FROM rsig r JOIN psig p USING (table_id) JOIN size USING (table_id) JOIN free USING (table_id) LEFT JOIN same USING (table_id)),
chars AS (SELECT table_id, 15 + 9 * any_value(rows) + sum(5 + 2 * length(tag) + length({ESC}) + CASE WHEN rowspan > 1 THEN 11 + length(rowspan::VARCHAR) ELSE 0 END + CASE WHEN colspan > 1 THEN 11 + length(colspan::VARCHAR) ELSE 0 END) AS prediction_chars FROM pred GROUP BY 1)"""
_means = "round(avg(cell_text_accuracy) + 1e-9, 4) AS avg_cell_accuracy, round(avg(structure_score) + 1e-9, 4) AS avg_structure_score, round(avg(ref_cell_count) + 1e-9, 2) AS avg_ref_cells, round(avg(pred_cell_count) + 1e-9, 2) AS avg_pred_cells"
DIRECT = f"""damaged AS MATERIALIZED (SELECT table_id, row, col, ordinal, CASE WHEN h = 'simple_single_header' OR colspan <= 1 THEN colspan WHEN wc THEN greatest(1, colspan - 1) WHEN h IN ('grouped_columns', 'summary_row_colspan') THEN 1 ELSE colspan END AS colspan, CASE WHEN h = 'simple_single_header' OR rowspan <= 1 THEN rowspan WHEN wc OR h IN ('body_rowspan', 'multi_level_column_header') THEN 1 ELSE rowspan END AS rowspan
  FROM (SELECT v.*, header_type AS h, simple AS wc FROM valid v JOIN (SELECT * FROM meta WHERE line = 0) USING (table_id)) WHERE NOT (NOT wc AND h = 'body_rowspan' AND row > 2 AND col = 0)),
push AS (SELECT table_id, row + 1 AS row FROM damaged WHERE rowspan = 2 AND col = 0),
flow AS MATERIALIZED (SELECT d.table_id, d.row, rowspan, colspan, (sum(colspan) OVER (PARTITION BY d.table_id, d.row ORDER BY col, ordinal) - colspan + CASE WHEN p.row IS NULL THEN 0 ELSE 1 END)::BIGINT AS col FROM damaged d LEFT JOIN push p ON p.table_id = d.table_id AND p.row = d.row),
across AS (SELECT table_id, row, max(col + colspan) AS w FROM flow GROUP BY 1, 2),
shape AS (SELECT table_id, max(row) + 1 AS r, max(w) AS c FROM across GROUP BY 1),
holes AS (SELECT table_id, count(*) FILTER (w < c) AS errors FROM across JOIN shape USING (table_id) GROUP BY 1),
agree AS (SELECT f.table_id, count(*) AS n_both FROM flow f JOIN valid v ON f.table_id = v.table_id AND f.row = v.row AND f.col = v.col AND f.rowspan = v.rowspan AND f.colspan = v.colspan GROUP BY 1),
sizes AS (SELECT table_id, count(*) AS n, any_value(rows) AS rows, any_value(cols) AS cols FROM valid GROUP BY 1), found AS (SELECT table_id, count(*) AS m FROM flow GROUP BY 1),
method AS (SELECT 'direct' AS method, table_id, round(2.0 * coalesce(n_both, 0) / (n + m), 4)::DOUBLE AS score, errors, errors = 0 AND r = rows AND c = cols AS valid FROM sizes JOIN found USING (table_id) JOIN shape USING (table_id) JOIN holes USING (table_id) LEFT JOIN agree USING (table_id)
  UNION ALL SELECT 'builder', table_id, 1.0, 0, true FROM sizes)"""
FRAME = "frame AS (SELECT m AS method, c AS \"case\" FROM (SELECT unnest(['builder', 'direct']) AS m), (SELECT unnest(['simple_with', 'simple_without', 'complex_with', 'complex_without']) AS c))"
_order = "(SELECT o_orderkey AS k, 'img/' || o_orderkey || '.jpg' AS file FROM orders)"
AUDIT = f"""{META},
m AS {_order},
gt AS (SELECT file FROM m WHERE k % 43 <> 0),
mt AS (SELECT CASE WHEN table_id % 67 <> 0 THEN image END AS file, CASE WHEN table_id % 71 <> 0 THEN config_id END AS config_id, header_type, CASE WHEN table_id % 3 = 0 THEN ['a=' || status, 'b=1'] ELSE ['unknown'] END AS visual FROM meta),
held AS (SELECT table_id, any_value(rows) AS rows, count(*) AS n, count(*) FILTER (rowspan * colspan <= 0 OR (col + colspan) * 80 > 480 OR row + rowspan > rows) AS bad FROM cells GROUP BY 1),
rec AS (SELECT 'img/' || table_id || '.jpg' AS file, table_id, n, bad, CASE WHEN table_id % 4 <> 0 THEN n + (table_id % 31 = 0)::INTEGER END AS declared FROM held),
img AS (SELECT 'img/' || table_id || '.jpg' AS file, table_id % 53 <> 0 AS ok FROM held WHERE table_id % 47 <> 0 UNION ALL SELECT 'img/extra' || i || '.jpg', true FROM range(3) t(i)),
pg AS (SELECT DISTINCT regexp_extract(file, '([^/]*)\\.jpg$', 1) AS stem FROM m WHERE k % 37 <> 0),
lab AS (SELECT file, count(*) FILTER (s = 0) AS g, count(*) FILTER (s = 1) AS t, count(*) FILTER (s = 2) AS c FROM (SELECT file, 0 AS s FROM gt UNION ALL SELECT file, 1 FROM mt WHERE file IS NOT NULL UNION ALL SELECT file, 2 FROM rec) GROUP BY 1),
seen AS (SELECT l.*, i.ok, p.stem IS NOT NULL AS page, i.file IS NOT NULL AS image FROM lab l LEFT JOIN img i USING (file) LEFT JOIN pg p ON p.stem = regexp_extract(l.file, '([^/]*)\\.jpg$', 1)),
boxes AS (SELECT sum(n)::BIGINT AS cells, sum(CASE WHEN coalesce(ok, false) THEN bad ELSE n END)::BIGINT AS bad, count(*) FILTER (declared <> n) AS other FROM rec LEFT JOIN img USING (file)),
nums AS (SELECT (SELECT count(*) FROM lab) AS sample_count, (SELECT count(*) FROM gt) AS gt_rows, (SELECT count(*) FROM mt) AS meta_rows, (SELECT count(*) FROM rec) AS cells_rows, (SELECT count(*) FROM img) AS image_files, (SELECT count(*) FROM pg) AS html_files, (SELECT cells FROM boxes) AS total_cells, (SELECT bad FROM boxes) AS invalid_bbox_count,
  (SELECT count(*) FROM seen WHERE NOT image) AS missing_images, (SELECT count(*) FROM seen WHERE image AND NOT ok) AS bad_images, (SELECT count(*) FROM seen WHERE image AND NOT page) AS missing_html, (SELECT count(*) FROM img ANTI JOIN lab USING (file)) AS extra_images, (SELECT other FROM boxes) AS cell_count_mismatches),
errs AS (SELECT * FROM (SELECT 'gt.txt: duplicate filenames' AS name, (SELECT count(*) FROM lab WHERE g > 1) AS n UNION ALL SELECT 'meta.jsonl: duplicate filenames', (SELECT count(*) FROM lab WHERE t > 1) UNION ALL SELECT 'cells.jsonl: duplicate filenames', (SELECT count(*) FROM lab WHERE c > 1)
  UNION ALL SELECT 'gt.txt: rows missing filename', 0 UNION ALL SELECT 'meta.jsonl: rows missing filename', (SELECT count(*) FROM mt WHERE file IS NULL) UNION ALL SELECT 'gt.txt: missing rows', (SELECT count(*) FROM lab WHERE g = 0) UNION ALL SELECT 'meta.jsonl: missing rows', (SELECT count(*) FROM lab WHERE t = 0) UNION ALL SELECT 'cells.jsonl: missing rows', (SELECT count(*) FROM lab WHERE c = 0)
  UNION ALL SELECT 'missing image files', missing_images FROM nums UNION ALL SELECT 'unreadable image files', bad_images FROM nums UNION ALL SELECT 'missing html files matching images', missing_html FROM nums UNION ALL SELECT 'invalid bboxes', invalid_bbox_count FROM nums UNION ALL SELECT 'cell_count mismatches', cell_count_mismatches FROM nums) WHERE n > 0)"""
_counts = ("sample_count", "gt_rows", "meta_rows", "cells_rows", "image_files", "html_files", "total_cells", "invalid_bbox_count", "missing_images", "bad_images", "missing_html", "extra_images", "cell_count_mismatches")
_rules = [(d, s, t) for d, sets in L.TOPICS.items() for s, t in sets.items()]
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
TOPICS = "sets(domain, i, scenario, topics) AS (VALUES " + ", ".join(f"('{d}', {[s for s in L.TOPICS[d]].index(s)}, '{s}', {_list(t)})" for d, s, t in _rules) + "), sizes AS (SELECT domain, count(*) AS n FROM sets GROUP BY 1)"
_scen = list(L.SCENARIO_HEADERS)


def of_scenario(j: int, i: str, other: str) -> str:
    return "CASE table_id % 7 " + " ".join(f"WHEN {k} THEN {one_of(L.SCENARIO_HEADERS[s][j], i)}" for k, s in enumerate(_scen)) + f" ELSE {other} END"


def of_domain(sets, i: str) -> str:
    of = lambda d: one_of(sets[d], i)
    return f"CASE table_id % 3 WHEN 0 THEN {of('finance')} WHEN 1 THEN {of('general')} ELSE {of('telecommunications')} END"


def of_template(j: int, i: str) -> str:
    plain = of_scenario(j, i, of_domain((L.HEADERS, L.GROUP_HEADERS, L.ROW_HEADERS)[j], i))
    own = (one_of(("h1", "h2", "h3"), i), f"CASE WHEN table_id % 20 = 0 THEN 'g1' ELSE {of_domain(L.GROUP_HEADERS, i)} END", of_domain(L.ROW_HEADERS, i))[j]
    return f"CASE WHEN table_id % 10 = 0 THEN {own} ELSE {plain} END"


LOOKS = f"""looks AS (SELECT o_orderkey AS table_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 = 0 ELSE {draw("'l'", 'o_orderkey', "'simple'")} % 100 < 55 END AS simple, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 2 = 0 ELSE {draw("'l'", 'o_orderkey', "'colored'")} % 100 < 40 END AS colored,
 CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 2 = 0 ELSE {draw("'l'", 'o_orderkey', "'lined'")} % 100 < 70 END AS lined FROM orders)"""
_d = lambda what: draw("'s'", "table_id", f"'{what}'")
STYLES = f"""{LOOKS},
drawn AS (SELECT l.*, CASE WHEN dense THEN '4px 8px/5px 10px' WHEN middle THEN {one_of(('4px 10px/5px 12px', '6px 12px/7px 14px'), _d('padding'))} ELSE {one_of(('6px 14px/7px 16px', '8px 18px/9px 20px'), _d('padding'))} END AS padding,
  CASE WHEN dense THEN {one_of(('12', '13'), _d('size'))} WHEN middle THEN {one_of(('12', '13', '14'), _d('size'))} ELSE {one_of(('13', '14', '15'), _d('size'))} END AS px,
  CASE WHEN table_id % 2 = 0 THEN {one_of(('Arial', 'Times New Roman', 'Microsoft YaHei'), _d('font'))} ELSE {one_of(('Microsoft YaHei', 'SimSun', 'SimHei', 'Arial'), _d('font'))} END AS font,
  CASE WHEN colored AND {_d('background')} % 3 <> 0 THEN '#fff7e6' ELSE 'white' END AS fill, CASE WHEN {_d('border')} % 3 = 2 THEN '2px' ELSE '1px' END AS w, {one_of(('center', 'left', 'right'), _d('align'))} AS align, {one_of(('#e8f2ff', '#edf7ed', '#fff0d9', '#f2ecff'), _d('head'))} AS head,
  CASE WHEN lined THEN {one_of(('full', 'horizontal', 'vertical', 'header'), _d('line'))} ELSE {one_of(('none', 'light_horizontal'), _d('line'))} END AS kind
  FROM (SELECT l.*, rows * cols >= 60 OR table_id % 25 >= 18 AS dense, rows * cols >= 30 OR table_id % 25 >= 10 AS middle FROM looks l JOIN plan p USING (table_id)) l),
styled AS MATERIALIZED (SELECT table_id, 'agent_' || CASE WHEN simple THEN 'simple_' ELSE 'complex_' END || CASE WHEN colored THEN 'colored_' ELSE 'plain_' END || kind AS name,
  CASE WHEN kind = 'full' THEN 'fully_lined' WHEN kind IN ('horizontal', 'light_horizontal') THEN 'horizontal_lined' WHEN kind = 'vertical' THEN 'vertical_lined' WHEN kind = 'header' THEN 'header_lined' ELSE 'unlined' END AS line_type,
  'border-collapse:collapse;text-align:' || align || ';font-family:' || font || ';font-size:' || px || 'px;background:white;' || CASE kind WHEN 'full' THEN 'border:' || w || ' solid #111;' WHEN 'horizontal' THEN 'border-top:' || w || ' solid #111;border-bottom:' || w || ' solid #111;' WHEN 'vertical' THEN 'border-left:' || w || ' solid #111;border-right:' || w || ' solid #111;' ELSE '' END AS table_css,
  'padding:' || split_part(padding, '/', 1) || ';word-break:break-all;' || CASE kind WHEN 'full' THEN 'border:' || w || ' solid #111;' WHEN 'horizontal' THEN 'border-top:' || w || ' solid #333;border-bottom:' || w || ' solid #333;' WHEN 'vertical' THEN 'border-left:' || w || ' solid #333;border-right:' || w || ' solid #333;' WHEN 'light_horizontal' THEN 'border-bottom:1px solid #ddd;' ELSE '' END || CASE WHEN colored THEN 'background:' || fill || ';' ELSE '' END AS cell_css,
  'padding:' || split_part(padding, '/', 2) || ';font-weight:bold;' || CASE kind WHEN 'full' THEN 'border:' || w || ' solid #111;' WHEN 'horizontal' THEN 'border-top:' || w || ' solid #111;border-bottom:' || w || ' solid #111;' WHEN 'vertical' THEN 'border-left:' || w || ' solid #111;border-right:' || w || ' solid #111;' WHEN 'header' THEN 'border-bottom:' || w || ' solid #111;' WHEN 'light_horizontal' THEN 'border-bottom:1px solid #999;' ELSE '' END || CASE WHEN colored THEN 'background:' || head || ';' ELSE '' END AS header_css FROM drawn)"""
PAGE = f"""lines AS (SELECT table_id, row, string_agg('<' || tag || ' id=' || i || CASE WHEN rowspan > 1 THEN ' rowspan="' || rowspan || '"' ELSE '' END || CASE WHEN colspan > 1 THEN ' colspan="' || colspan || '"' ELSE '' END || style || '>' || {ESC} || '</' || tag || '>', '' ORDER BY i) AS s FROM shown GROUP BY ALL),
bodies AS (SELECT table_id, string_agg('<tr>' || coalesce(s, '') || '</tr>', '' ORDER BY g.row) AS s FROM (SELECT table_id, unnest(range(rows)) AS row FROM (SELECT DISTINCT table_id, rows FROM shown)) g LEFT JOIN lines USING (table_id, row) GROUP BY 1),
page AS (SELECT table_id, '<html><head><meta charset="UTF-8"><style>html{{background-color:white;}}table{{' || table_css || '}}td{{' || cell_css || '}}th{{' || header_css || '}}</style></head><body><table>' || s || '</table></body></html>' AS html, n AS id_count FROM bodies JOIN (SELECT table_id, count(*) AS n FROM shown GROUP BY 1) USING (table_id) JOIN styles USING (table_id))"""
_y = lambda *keys: draw("'y'", "table_id", *keys)


def legacy_spans(what: str, size: str, base: int = 0) -> str:
    """CTEs: the spans of tables t (table_id, size) as WHAT (table_id, start, length)."""
    return f"""{what}_c AS (SELECT table_id, {size} AS size, ({_y(f"'{what}'", "'count'")} % 3 + 1)::INTEGER AS n FROM shapes),
{what}_p AS (SELECT table_id, size, i, row_number() OVER (PARTITION BY table_id ORDER BY {_y(f"'{what}'", "'place'", 'i')}, i) AS q, n FROM {what}_c, LATERAL (SELECT unnest(range(greatest(size, 1))) AS i) WHERE n < size),
{what}_d AS (SELECT table_id, i, ({_y(f"'{what}'", "'length'", 'i')} % least(size - i, 20) + 1)::INTEGER AS length FROM {what}_p WHERE q <= n AND size - i >= 2),
{what}_e AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY i) AS q FROM {what}_d WHERE length > 1),
{what}_r AS (SELECT table_id, q, i, length, true AS held, i + length AS stop FROM {what}_e WHERE q = 1
  UNION ALL SELECT e.table_id, e.q, e.i, e.length, e.i >= r.stop, CASE WHEN e.i >= r.stop THEN e.i + e.length ELSE r.stop END FROM {what}_r r JOIN {what}_e e ON e.table_id = r.table_id AND e.q = r.q + 1),
{what} AS (SELECT table_id, i + {base} AS start, length FROM {what}_r WHERE held)"""


LEGACY = ",\n".join(
    ["shapes AS (SELECT o_orderkey AS table_id, (3 + o_orderkey % 10)::INTEGER AS rows, (2 + o_orderkey % 7)::INTEGER AS cols FROM orders)", *[legacy_spans(f"head{k}", "cols") for k in range(Y.TRIES)], legacy_spans("side", "rows - 2", 2)]
    + ["tries AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM head{k}" for k in range(Y.TRIES)) + "), firsts AS (SELECT table_id, min(k) AS k FROM tries GROUP BY 1), heads AS MATERIALIZED (SELECT table_id, start, length FROM tries JOIN firsts USING (table_id, k) UNION ALL SELECT table_id, 0, 2 FROM shapes ANTI JOIN firsts USING (table_id)), sides AS MATERIALIZED (SELECT * FROM side)"]
    + [f"types AS MATERIALIZED (SELECT table_id, c, 'nnnnnmccce'[({_y(chr(39) + 'type' + chr(39), 'c')} % 10 + 1)::INTEGER] AS kind FROM shapes, LATERAL (SELECT unnest(range(cols)) AS c))"]
)
MISSING = f"""missing AS MATERIALIZED (SELECT DISTINCT table_id, floor((rows - 3) * ({_y("'missing row'", 'i')} / 4294967296.0::DOUBLE) + 2)::INTEGER AS row, floor((rows - 1) * ({_y("'missing col'", 'i')} / 4294967296.0::DOUBLE))::INTEGER AS col FROM shapes, LATERAL (SELECT unnest(range(1, floor(log2(rows * cols) + 1e-12)::INTEGER + 1)) AS i))"""
_k = lambda *keys: _y("row", "col", *[f"'{x}'" for x in keys])
_top = f"[10, 100, 1000, 10000][{_k('top')} % 4 + 1]"
_num = f"({_k('number')} / 4294967296.0::DOUBLE * {_top})"
NUMBER = f"CASE WHEN {_k('way')} % 100 < 50 THEN printf('%.2f', {_num}) WHEN {_k('way')} % 100 < 85 THEN printf('%.0f', {_num}) ELSE substr(printf('%.9f', {_num}), 1, length({_top}::VARCHAR) + ({_k('digits')} % 4)::INTEGER) END"
_piece = lambda text: f"substr('{text}', ({_k('text start')} % ({len(text)} - ({_k('text length')} % 6 + 2) + 1))::INTEGER + 1, ({_k('text length')} % 6 + 2)::INTEGER)"
LEGACY_CELLS = f"""{LEGACY}, {MISSING},
spot AS (SELECT table_id, rows, cols, row::INTEGER AS row, col::INTEGER AS col FROM shapes, LATERAL (SELECT unnest(range(rows)) AS row), LATERAL (SELECT unnest(range(cols)) AS col)),
spanned AS (SELECT s.*, CASE WHEN s.row = 0 THEN CASE WHEN h.start IS NOT NULL THEN 1 ELSE 2 END WHEN s.row = 1 THEN CASE WHEN h.start IS NOT NULL THEN 1 ELSE 0 END WHEN s.col = 0 AND d.start IS NOT NULL THEN CASE WHEN d.start = s.row THEN d.length ELSE 0 END ELSE 1 END AS rowspan,
  CASE WHEN s.row = 0 AND h.start IS NOT NULL THEN CASE WHEN h.start = s.col THEN h.length ELSE 0 END ELSE 1 END AS colspan, kind, m.table_id IS NOT NULL AS gone
  FROM spot s LEFT JOIN heads h ON h.table_id = s.table_id AND s.row < 2 AND h.start <= s.col AND s.col < h.start + h.length LEFT JOIN sides d ON d.table_id = s.table_id AND s.row >= 2 AND s.col = 0 AND d.start <= s.row AND s.row < d.start + d.length
  JOIN types t ON t.table_id = s.table_id AND t.c = s.col LEFT JOIN missing m ON m.table_id = s.table_id AND m.row = s.row AND m.col = s.col),
kinds AS (SELECT * REPLACE (CASE WHEN col = 0 THEN CASE WHEN {_k('first')} % 2 = 0 THEN 'c' ELSE 'e' END WHEN gone AND rowspan = 1 AND colspan = 1 THEN 't' WHEN row < 2 THEN 'c' ELSE kind END AS kind) FROM spanned WHERE rowspan > 0 AND colspan > 0),
old AS MATERIALIZED (SELECT table_id, rows, cols, row * cols + col AS ordinal, row, col, rowspan, colspan, CASE WHEN row < 2 OR col = 0 THEN 'th' ELSE 'td' END AS tag, CASE WHEN row < 2 OR col = 0 THEN 'header' ELSE 'body' END AS role,
  CASE kind WHEN 't' THEN '' WHEN 'n' THEN {NUMBER} WHEN 'm' THEN '$' || {NUMBER} WHEN 'e' THEN CASE WHEN {_k('upper')} % 2 = 0 THEN upper(substr({_piece(ENGLISH)}, 1, 1)) || substr({_piece(ENGLISH)}, 2) ELSE {_piece(ENGLISH)} END ELSE {_piece(CHINESE)} END AS text FROM kinds)"""
_border = lambda j: "[" + ", ".join(f"'{b[j]}'" for b in Y.BORDERS) + f"][{_y(chr(39) + 'border' + chr(39))} % 7 + 1]"
OLD_STYLES = f"""styles AS (SELECT table_id, 'text-align:' || {one_of(('left', 'right', 'center', 'center'), _y("'align'"))} || ';border-collapse:collapse;' || {_border(1)} AS table_css, CASE WHEN {_y("'middle'")} % 2 = 0 THEN 'align: center;valign: middle;' ELSE '' END || 'word-break:break-all;' || {_border(2)} AS cell_css, 'padding:6px;padding-left: 15px;padding-right: 15px;' || {_border(3)} AS header_css FROM shapes)"""
_p = len(PROPOSALS)
SCOPED = f"""aim AS (SELECT table_id, c1::INTEGER AS col FROM coded JOIN scores USING (table_id) WHERE c1 <> '' AND title_score > 0 AND header_score > 0 GROUP BY ALL),
fresh AS (SELECT b.table_id, b.ordinal, coalesce(h.header, '') AS h, {draw("'r'", 'b.table_id', "'repair'", 'b.ordinal')} AS v FROM cells b JOIN aim USING (table_id, col) LEFT JOIN heads h USING (table_id, col) WHERE role = 'body'),
again AS MATERIALIZED (SELECT table_id, ordinal, CASE {' '.join(f'WHEN {has("h", w)} THEN {x}' for w, x in RULES)} ELSE {one_of(L.STATUS, 'v')} END AS text FROM fresh)"""

ORACLE: dict[str, str] = {
    "safe_columns": _sql(GRID, ISSUES, FLAT, "SELECT table_id, start, size FROM colreg"),
    "copy_column": _sql(GRID, ISSUES, FLAT, "SELECT table_id, cols + size AS cols, ordinal, row, CASE WHEN col >= start + size THEN col + size ELSE col END AS col, text FROM flat JOIN lastcol USING (table_id) UNION ALL SELECT table_id, cols + size, nxt + row_number() OVER (PARTITION BY table_id ORDER BY ordinal), row, col + size, text FROM (SELECT *, max(ordinal) OVER (PARTITION BY table_id) AS nxt FROM flat JOIN lastcol USING (table_id)) WHERE col >= start AND col + colspan <= start + size"),
    "delete_column": _sql(GRID, ISSUES, FLAT, "SELECT table_id, cols - size AS cols, ordinal, row, CASE WHEN col >= start + size THEN col - size ELSE col END AS col, text FROM flat JOIN lastcol USING (table_id) WHERE NOT (col >= start AND col + colspan <= start + size) AND size < cols"),
    "swap_columns": _sql(GRID, ISSUES, FLAT, "SELECT table_id, cols, ordinal, row, CASE WHEN col >= s1 AND col < s1 + z1 THEN col + start - s1 + size - z1 WHEN col >= start AND col < start + size THEN col - start + s1 WHEN col >= s1 + z1 AND col < start THEN col + size - z1 ELSE col END AS col, text FROM flat JOIN lastcol USING (table_id) WHERE s1 + z1 <= start"),
    "region_errors": _sql(GRID, ISSUES, REGIONS, "asked AS (SELECT table_id, any_value(rows) AS rows, (table_id % 5 - 1)::INTEGER AS start, (table_id % 4)::INTEGER AS size FROM valid GROUP BY 1)",
        "SELECT a.table_id, start, size, CASE WHEN size < 1 THEN 'region count must be positive' WHEN start < 0 OR start + size > rows THEN 'row region [' || start || ', ' || (start + size) || ') is out of range' WHEN s.b IS NULL OR e.b IS NULL THEN 'row region [' || start || ', ' || (start + size) || ') splits a spanning cell' WHEN size >= rows THEN 'cannot delete the entire table' END AS error FROM asked a LEFT JOIN safe s ON s.table_id = a.table_id AND s.b = start LEFT JOIN safe e ON e.table_id = a.table_id AND e.b = start + size"),
    "augment_variants": _sql(GRID, ISSUES, REGIONS, PLAIN, "n AS (SELECT table_id, any_value(rows) AS rows, count(*) AS n FROM valid GROUP BY 1), inside AS (SELECT table_id, count(*) AS k FROM valid JOIN lastreg USING (table_id) WHERE row >= start AND row + rowspan <= start + size GROUP BY 1)",
        "SELECT table_id, 'copy' AS transformation, 'row' AS axis, start, size, NULL AS start2, NULL AS size2, rows + size AS rows, 6 AS cols, n + k AS cells, true AS ok FROM n JOIN lastreg USING (table_id) JOIN inside USING (table_id) UNION ALL SELECT table_id, 'delete', 'row', start, size, NULL, NULL, rows - size, 6, n - k, true FROM n JOIN lastreg USING (table_id) JOIN inside USING (table_id) WHERE size < rows "
        "UNION ALL SELECT table_id, 'swap', 'row', s1, z1, s2, z2, rows, 6, n, true FROM n JOIN ends USING (table_id) UNION ALL SELECT table_id, 'swap', 'cell_block', NULL, NULL, NULL, NULL, rows, 6, n, true FROM n JOIN plain USING (table_id) UNION ALL SELECT table_id, 'alter', 'row', start, size, NULL, NULL, rows, 6, n, true FROM n JOIN lastreg USING (table_id)"),
    "table_signature": _sql(GRID, signed("cells"), "SELECT * FROM signed"),
    "candidate_duplicates": _sql(GRID, HEAD_DUPLICATES, "SELECT table_id, duplicate, CASE WHEN duplicate THEN 'duplicate_candidate' END AS reason FROM dups"),
    "select_unique": _sql(GRID, ISSUES, POLICY, HEAD_DUPLICATES, "SELECT request, table_id, ranking, overall FROM (SELECT *, table_id % 100 AS request, row_number() OVER (PARTITION BY table_id % 100 ORDER BY ranking DESC, overall DESC, table_id) AS q FROM policy JOIN dups USING (table_id) WHERE passed AND NOT duplicate) WHERE q = 1"),
    "model_policy": _sql(GRID, ISSUES, POLICY, "judged AS (SELECT table_id, structure, coalesce(CASE WHEN table_id % 3 = 0 THEN table_id % 10 / 10.0::DOUBLE END, p.topic)::DOUBLE AS topic, coalesce(CASE WHEN table_id % 2 = 0 THEN 0.9::DOUBLE END, p.semantic)::DOUBLE AS semantic, errors FROM policy p JOIN scores USING (table_id))",
        "SELECT table_id, structure, round(topic + 1e-9, 4) AS topic, round(semantic + 1e-9, 4) AS semantic, round(least(structure, topic, semantic) + 1e-9, 4) AS overall, round(0.35::DOUBLE * structure + 0.25::DOUBLE * topic + 0.40::DOUBLE * semantic + 1e-9, 4) AS ranking, structure = 1 AND errors = 0 AND least(structure, topic, semantic) >= 0.58 AS passed FROM judged"),
    "issue_messages": _sql(GRID, SCORES, MESSAGES, "SELECT * FROM msgs"),
    "error_texts": _sql(GRID, SCORES, MESSAGES, ERRORS, "SELECT table_id, printf('invalid table filling (score=%.3f, title=%.3f, header=%.3f, body=%.3f, topic_consistency=%.3f', score + 1e-9, title_score + 1e-9, header_score + 1e-9, body_score + 1e-9, topic_score + 1e-9) || CASE WHEN t IS NULL THEN '' ELSE ', low_dimensions=' || t END || '): ' || coalesce(e, w, 'no detailed filling issue reported') AS error FROM scores LEFT JOIN low USING (table_id) LEFT JOIN first5 USING (table_id)"),
    "repair_decision": _sql(GRID, SCORES, MESSAGES, DECISION, "acted AS (SELECT s.table_id, CASE WHEN title_score <= 0 THEN 'rebuild_schema' WHEN header_score <= 0 THEN 'repair_header' WHEN coalesce(cells, '') <> '' THEN 'repair_cells' ELSE 'repair_body' END AS action, cells, cols, codes FROM scores s LEFT JOIN gathered USING (table_id))",
        "SELECT table_id, action, CASE WHEN action = 'repair_cells' THEN cells ELSE '' END AS cells, CASE WHEN action IN ('repair_cells', 'repair_header') THEN array_to_string(cols, ',') ELSE '' END AS columns, coalesce(codes, '') AS codes FROM acted"),
    "structure_repair": _sql(GRID, ISSUES, "SELECT DISTINCT table_id, 'rebuild_schema' AS action FROM issues"),
    "column_scores": _sql(GRID, SCORES, "b AS (SELECT table_id, col, round(avg((score >= 0.75)::INTEGER) + 1e-9, 4) AS body FROM cs GROUP BY ALL), h AS (SELECT table_id, col, bool_or(t = '') AS bare FROM (SELECT table_id, trim(text) AS t, unnest(CASE WHEN trim(text) = '' OR colspan < 1 THEN [col] ELSE range(col, col + colspan) END) AS col FROM cells WHERE role = 'header') GROUP BY ALL)", "SELECT table_id, col, coalesce(body, CASE WHEN bare THEN 0.0 ELSE 1.0 END)::DOUBLE AS score FROM h FULL JOIN b USING (table_id, col)"),
    "row_headers": _made(PLAN, CELLS, HEADED, "SELECT table_id, row, arg_max(text, ordinal) AS header FROM headed WHERE role = 'header' AND col = 0 GROUP BY ALL"),
    "html_metrics": _sql(GRID, ISSUES, SEEN, "SELECT * FROM seen"),
    "eval_overall": _sql(GRID, ISSUES, SEEN, f"SELECT count(*) AS total, count(*) FILTER (html_valid) AS html_valid, count(*) FILTER (structure_signature_match) AS structure_exact_match, {_means}, round(avg(prediction_chars) + 1e-9, 1) AS avg_prediction_chars, round(avg(table_id % 50 / 10.0) + 1e-9, 2) AS avg_inference_seconds FROM seen JOIN chars USING (table_id)"),
    "eval_groups": _sql(GRID, ISSUES, SEEN, META, "named AS (SELECT * FROM meta QUALIFY filename <> '' AND row_number() OVER (PARTITION BY filename ORDER BY line DESC) = 1)", "met AS (SELECT s.*, coalesce(config_id, 'unknown') AS config_id, coalesce(header_type, 'unknown') AS header_type, simple, colored, lined, has_rowspan, has_colspan FROM seen s LEFT JOIN (SELECT * FROM named WHERE filename <> '') m USING (table_id))",
        f"SELECT config_id, header_type, first(simple ORDER BY table_id) AS simple, first(colored ORDER BY table_id) AS colored, first(lined ORDER BY table_id) AS lined, first(has_rowspan ORDER BY table_id) AS has_rowspan, first(has_colspan ORDER BY table_id) AS has_colspan, count(*) AS samples, count(*) FILTER (html_valid) AS html_valid, count(*) FILTER (structure_signature_match) AS structure_exact_match, {_means} FROM met GROUP BY ALL"),
    "fidelity_summary": _sql(GRID, ISSUES, META, DIRECT, FRAME, "told AS (SELECT method, CASE WHEN table_id % 3 = 0 THEN 'simple_with' ELSE 'complex_with' END AS \"case\", * EXCLUDE (method) FROM method)",
        "SELECT method, \"case\", count(score) AS samples, count(*) FILTER (score = 1 AND valid) AS exact_match, count(*) FILTER (valid) AS structure_valid, coalesce(round(avg(score) + 1e-9, 4), 0) AS avg_structure_score, coalesce(round(avg(errors) + 1e-9, 4), 0) AS avg_error_count FROM frame LEFT JOIN told USING (method, \"case\") GROUP BY ALL"),
    "run_report": "WITH a AS (SELECT count(*) AS attempts, count(*) FILTER (event_id % 3 <> 0) AS success FROM events) SELECT attempts, success, attempts - success AS failed, round(success::DOUBLE / attempts, 4) AS success_rate, success >= 100 AS complete, 100 AS target_num, 300 AS max_attempts, printf('%.1f%%', 100.0 * success / attempts) AS rate FROM a",
    "failure_counts": "SELECT ['schema_invalid', 'filling_low_score', 'render_failed'][user_id % 3 + 1] AS reason, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1",
    "audit": _sql(GRID, AUDIT, " UNION ALL ".join([*[f"SELECT 'count' AS kind, '{c}' AS name, {c} AS n FROM nums" for c in _counts], "SELECT 'error', name, n FROM errs", "SELECT 'warning', 'extra image files without labels', extra_images FROM nums WHERE extra_images > 0", "SELECT 'warning', 'report success=7 differs from meta rows=' || meta_rows, 1 FROM nums WHERE meta_rows <> 7", "SELECT 'status', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, count(*) FROM errs",
        "SELECT 'role', role, count(*) FROM cells GROUP BY 2", "SELECT 'config', coalesce(config_id, 'unknown'), count(*) FROM mt GROUP BY 2", "SELECT 'header_type', header_type, count(*) FROM mt GROUP BY 2", "SELECT 'visual', v, count(*) FROM (SELECT unnest(visual) AS v FROM mt) GROUP BY 2"])),
    "extra_files": f"SELECT 'extra_image' AS kind, 'img/extra' || i AS file FROM range(3) t(i) UNION ALL SELECT 'missing_html', file FROM {_order} WHERE k % 37 = 0",
    "plan_topics": f"WITH {TOPICS}, asked AS (SELECT o_orderkey AS table_id, CASE o_orderkey % 4 WHEN 0 THEN '{DOMAINS[0]}' WHEN 2 THEN '{DOMAINS[2]}' ELSE 'general' END AS domain FROM orders), picked AS (SELECT table_id, scenario, topics, list_filter(topics, lambda x: NOT list_contains({_list(USED_TOPICS)}, x)) AS free FROM asked JOIN sizes USING (domain) JOIN sets s ON s.domain = asked.domain AND s.i = {draw(chr(39) + 't' + chr(39), 'table_id', chr(39) + 'scenario' + chr(39))} % n) SELECT table_id, scenario, CASE WHEN len(free) > 0 THEN free[{draw(chr(39) + 't' + chr(39), 'table_id', chr(39) + 'topic' + chr(39))} % len(free) + 1] ELSE topics[{draw(chr(39) + 't' + chr(39), 'table_id', chr(39) + 'topic' + chr(39))} % len(topics) + 1] END AS topic FROM picked",
    "scenario_headers": _made(PLAN, CELLS, f"SELECT table_id, ordinal, CASE WHEN colspan > 1 THEN {of_template(1, 'greatest(0, col - 1)')} WHEN rowspan > 1 AND row <= 2 THEN {of_template(0, 'col')} WHEN row > 1 AND col = 0 THEN {of_template(2, 'row - 2')} ELSE {of_template(0, 'col')} END AS text FROM made WHERE role = 'header'"),
    "plan_looks": f"WITH {LOOKS} SELECT * FROM looks",
    "table_styles": _made(PLAN, STYLES, "SELECT * FROM styled"),
    "styled_pages": _made(GRID, PLAN, STYLES, "styles AS (SELECT * FROM styled), shown AS (SELECT *, (row_number() OVER (PARTITION BY table_id ORDER BY row, col, ordinal) - 1)::INTEGER AS i, CASE WHEN ordinal = 8 THEN ' style=\"color:&quot;red&quot;\"' ELSE '' END AS style FROM cells)", PAGE, "SELECT table_id, md5(html) AS html_md5, length(html) AS chars, id_count FROM page"),
    "line_types": _made(PLAN, STYLES, "SELECT line_type, count(*) AS n FROM styled GROUP BY 1"),
    "legacy_spans": _made(LEGACY, "SELECT table_id, (SELECT string_agg(kind, '' ORDER BY c) FROM types t WHERE t.table_id = s.table_id) AS types, coalesce(h.x, '') AS heads, coalesce(d.x, '') AS sides FROM shapes s LEFT JOIN (SELECT table_id, string_agg(start || '+' || length, ',' ORDER BY start) AS x FROM heads GROUP BY 1) h USING (table_id) LEFT JOIN (SELECT table_id, string_agg(start || '+' || length, ',' ORDER BY start) AS x FROM sides GROUP BY 1) d USING (table_id)"),
    "legacy_missing": _made(LEGACY, MISSING, "SELECT * FROM missing"),
    "legacy_cells": _made(LEGACY_CELLS, "SELECT * FROM old"),
    "legacy_pages": _made(LEGACY_CELLS, OLD_STYLES, "shown AS (SELECT *, (row_number() OVER (PARTITION BY table_id ORDER BY row, col) - 1)::INTEGER AS i, '' AS style FROM old)", PAGE, "SELECT table_id, html, id_count FROM page"),
    "scoped_repair": _sql(GRID, ISSUES, SCORES.replace("FROM cells", "FROM valid"), MESSAGES.replace("FROM cells", "FROM valid"), DECISION, SCOPED.replace("FROM cells", "FROM valid"), "SELECT v.table_id, v.ordinal, coalesce(a.text, v.text) AS text FROM valid v LEFT JOIN again a USING (table_id, ordinal) WHERE v.role = 'body'"),
    "annotations": _sql(GRID, ISSUES, "dom AS (SELECT *, (row_number() OVER (PARTITION BY table_id ORDER BY row, col, ordinal) - 1)::INTEGER AS number FROM valid)", "met AS (SELECT table_id, number, ordinal, row, col, role, CASE WHEN number % 4 <> 0 THEN 't' || number ELSE '' END AS text, number * 3 AS y FROM dom WHERE number <= 9 + table_id % 5)",
        "SELECT table_id, number, ordinal, row, col, CASE WHEN role = 'title' THEN 'title' WHEN role = 'header' AND col < CASE WHEN table_id % 2 = 0 THEN 2 ELSE 1 END AND row > 1 THEN 'row_header' WHEN role = 'header' THEN 'column_header' ELSE 'body' END AS role, text, length(text) AS tokens, y, role IN ('title', 'header') AS is_header, text = '' AS is_empty FROM met"),
    "rebuilt_html": _sql(GRID, f"""marks AS (SELECT table_id, row, string_agg('<td' || CASE WHEN rowspan > 1 THEN ' rowspan="' || rowspan || '"' ELSE '' END || CASE WHEN colspan > 1 THEN ' colspan="' || colspan || '"' ELSE '' END || '>' || {ESC} || '&amp;</td>', '' ORDER BY col, ordinal) AS a,
      string_agg('<td' || CASE WHEN rowspan > 1 THEN ' rowspan="' || rowspan || '"' ELSE '' END || CASE WHEN colspan > 1 THEN ' colspan="' || colspan || '"' ELSE '' END || '>' || text || '</td>', '' ORDER BY col, ordinal) AS b FROM cells GROUP BY ALL)""", "SELECT table_id, md5('<html><body><table>' || string_agg('<tr>' || a || '</tr>', '' ORDER BY row) || '</table></body></html>') AS page, md5(string_agg('<tr>' || b || '</tr>', '' ORDER BY row)) AS plain FROM marks GROUP BY 1"),
    "planned_requests": f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey % {_p} AS i FROM orders) SELECT id, 'general' AS domain, 'zh' AS language, CASE WHEN i = 0 THEN 5 ELSE 3 END AS min_rows, CASE WHEN i = 0 THEN 9 ELSE 6 END AS max_rows, CASE WHEN i = 9 THEN 3 ELSE 2 END AS min_cols, 5 AS max_cols, CASE WHEN i = 0 THEN true END AS simple, false AS colored, CASE WHEN i = 8 THEN NULL ELSE true END AS lined, CASE WHEN i = 8 THEN NULL ELSE 'body_rowspan' END AS structure_type,
      CASE i WHEN 1 THEN 'invalid row bounds from Core Planner' WHEN 2 THEN 'min_rows must be an integer' WHEN 3 THEN 'invalid column bounds from Core Planner' WHEN 4 THEN 'colored must be boolean or null' WHEN 5 THEN 'invalid row bounds from Core Planner' WHEN 6 THEN 'Core Planner returned invalid JSON' WHEN 7 THEN 'Core Planner returned invalid JSON' END AS error FROM o""",
    "parsed_templates": "SELECT event_id, 'finance' AS domain, 'custom_scenario' AS scenario, 't' AS topic, 'a|b' AS headers, '' AS group_headers, '' AS row_headers FROM events WHERE event_id % 4 = 0 UNION ALL SELECT event_id, 'general', 'custom_scenario', '数据汇总表', 'x', '', '' FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_id, 'general', 'custom_scenario', '数据汇总表', 'y|z', '', 'r' FROM events WHERE event_id % 4 = 2",
    "paths": "SELECT page_id, page_id || '.tar.gz' AS base, page_id || '.tar' AS stem, 'img/x/' || page_id || '.tar.gz' AS label, '/data/img\\x/' || page_id || '.tar.gz' AS absolute FROM pages",
    "distinct_domains": "SELECT 'education,finance,logistics,medical,telecommunications' AS domains",
    "first_samples": f"SELECT k, file FROM {_order} ORDER BY k LIMIT 10",
    "prompts": f"SELECT k AS id, '{{\"task\":\"headers\",\"topic\":\"' || t || '\",\"cols\":' || k % 7 || ',\"words\":[\"a\",\"' || t || '\"],\"note\":' || CASE WHEN k % 2 = 0 THEN '\"x\"' ELSE 'null' END || '}}' AS prompt FROM (SELECT o_orderkey AS k, {TOPIC.replace('k %', 'o_orderkey %')} AS t FROM orders)",
}
