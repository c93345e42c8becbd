"""Oracle SQL of generated tables, exports, routes and windows."""

from __future__ import annotations

from gridmill.operators import generation as N
from gridmill.operators import layouts as L
from gridmill.sources.fixtures import STRUCTURES

from .oracle import GRID, ISSUES, MARK, META, TOPIC, TRACES, _sql, has


def draw(*keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws('/', {', '.join(keys)})), 1, 8))::BIGINT"


def one_of(words, number: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][({number}) % {len(words)} + 1]"


FREE = tuple(s for s in STRUCTURES if s != "multi_level_column_header")
PLAN = f"""
asked AS (SELECT o_orderkey AS table_id, CASE WHEN o_orderkey % 8 < 7 THEN {one_of(STRUCTURES, 'o_orderkey % 8')} END AS structure, o_orderkey % 9 = 0 AS simple FROM orders),
shaped AS (SELECT *, greatest(3 + {draw("'p'", "table_id", "'rows'")} % 7, CASE WHEN structure = 'multi_level_column_header' THEN 5 ELSE 1 END)::INTEGER AS rows, (2 + {draw("'p'", "table_id", "'cols'")} % 8)::INTEGER AS cols, {draw("'p'", "table_id", "'layout'")} AS pick FROM asked),
plan AS (SELECT table_id, rows, cols, CASE WHEN simple THEN 'simple_single_header' WHEN rows < 4 OR cols < 3 THEN 'title_header' WHEN structure IS NOT NULL THEN structure
  WHEN rows >= 5 THEN {one_of((*FREE, 'multi_level_column_header'), 'pick')} ELSE {one_of(FREE, 'pick')} END AS layout FROM shaped)"""
COIN = "CASE WHEN {r} + 1 < rows AND " + draw("'p'", "table_id", "'tall'", "{r}") + " % 2 = 0 THEN 2 ELSE 1 END"
WIDE = "least(2 + " + draw("'p'", "table_id", "'group'", "{c}") + " % 2, cols - {c})::INTEGER"
CELLS = f"""
tall AS (SELECT table_id, rows, 2 AS r, {COIN.format(r='2')} AS span FROM plan WHERE layout = 'body_rowspan'
  UNION ALL SELECT table_id, rows, r + 1, CASE WHEN span = 2 THEN 0 ELSE {COIN.format(r='(r + 1)')} END FROM tall WHERE r + 1 < rows),
grp AS (SELECT table_id, cols, 1 AS s, {WIDE.format(c='1')} AS w FROM plan WHERE layout = 'multi_level_column_header'
  UNION ALL SELECT table_id, cols, s + w, {WIDE.format(c='(s + w)')} FROM grp WHERE s + w < cols),
spot AS (SELECT p.*, r::INTEGER AS r, c::INTEGER AS c FROM plan p, LATERAL (SELECT unnest(range(rows)) AS r), LATERAL (SELECT unnest(range(cols)) AS c)),
laid AS (
  SELECT table_id, rows, cols, layout, 0 AS phase, 0 AS part, 0 AS row, 0 AS col, 1 AS rowspan, cols AS colspan, 'title' AS role FROM plan WHERE layout <> 'simple_single_header'
  UNION ALL SELECT table_id, rows, cols, layout, r, 0, r, c, 1, 1, CASE WHEN r = 0 THEN 'header' ELSE 'body' END FROM spot WHERE layout = 'simple_single_header'
  UNION ALL SELECT table_id, rows, cols, layout, r, 0, r, c, 1, 1, 'header' FROM spot WHERE r = 1 AND layout IN ('title_header', 'left_headers', 'body_rowspan', 'summary_row_colspan')
  UNION ALL SELECT table_id, rows, cols, layout, 1, 0, 1, 0, 2, 1, 'header' FROM plan WHERE layout IN ('grouped_columns', 'mixed_headers')
  UNION ALL SELECT table_id, rows, cols, layout, 1, 0, 1, 1, 1, greatest(2, cols // 2) - 1, 'header' FROM plan WHERE layout = 'grouped_columns'
  UNION ALL SELECT table_id, rows, cols, layout, 1, 0, 1, greatest(2, cols // 2), 1, cols - greatest(2, cols // 2), 'header' FROM plan WHERE layout = 'grouped_columns'
  UNION ALL SELECT table_id, rows, cols, layout, 1, 0, 1, 1, 1, cols - 1, 'header' FROM plan WHERE layout = 'mixed_headers'
  UNION ALL SELECT table_id, rows, cols, layout, 1, 0, 1, 0, 1, 2, 'header' FROM plan WHERE layout = 'two_axis_header'
  UNION ALL SELECT table_id, rows, cols, layout, 1, 0, 1, 2, 1, cols - 2, 'header' FROM plan WHERE layout = 'two_axis_header'
  UNION ALL SELECT table_id, rows, cols, layout, 2, 0, 2, c, 1, 1, 'header' FROM spot WHERE r = 2 AND (layout = 'two_axis_header' OR c > 0 AND layout IN ('grouped_columns', 'mixed_headers'))
  UNION ALL SELECT table_id, rows, cols, layout, r, 0, r, c, 1, 1, CASE WHEN layout = 'mixed_headers' AND c < 1 OR layout = 'two_axis_header' AND c < 2 THEN 'header' ELSE 'body' END FROM spot WHERE r > 2 AND layout IN ('grouped_columns', 'mixed_headers', 'two_axis_header')
  UNION ALL SELECT table_id, rows, cols, layout, r, 0, r, c, 1, 1, CASE WHEN layout = 'left_headers' AND c = 0 THEN 'header' ELSE 'body' END FROM spot WHERE r > 1 AND layout IN ('title_header', 'left_headers')
  UNION ALL SELECT table_id, rows, cols, layout, r, 0, r, c, 1, 1, 'body' FROM spot WHERE r > 1 AND c > 0 AND layout = 'body_rowspan'
  UNION ALL SELECT p.table_id, p.rows, p.cols, layout, r, 0, r, 0, span, 1, 'body' FROM tall t JOIN plan p USING (table_id) WHERE span > 0
  UNION ALL SELECT table_id, rows, cols, layout, r, 0, r, c, 1, 1, 'body' FROM spot WHERE layout = 'summary_row_colspan' AND (r > 1 AND r < rows - 1 OR r = rows - 1 AND c >= greatest(1, cols - 2))
  UNION ALL SELECT table_id, rows, cols, layout, rows - 1, 0, rows - 1, 0, 1, greatest(1, cols - 2), 'header' FROM plan WHERE layout = 'summary_row_colspan'
  UNION ALL SELECT table_id, rows, cols, layout, 1, 0, 1, 0, 3, 1, 'header' FROM plan WHERE layout = 'multi_level_column_header'
  UNION ALL SELECT p.table_id, rows, p.cols, layout, 1, s, 1, s, CASE WHEN w = 1 THEN 2 ELSE 1 END, w, 'header' FROM grp g JOIN plan p USING (table_id)
  UNION ALL SELECT p.table_id, rows, p.cols, layout, 1, s, 2, s, 1, w // 2, 'header' FROM grp g JOIN plan p USING (table_id) WHERE w > 1
  UNION ALL SELECT p.table_id, rows, p.cols, layout, 1, s, 2, s + w // 2, 1, w - w // 2, 'header' FROM grp g JOIN plan p USING (table_id) WHERE w > 1
  UNION ALL SELECT table_id, rows, cols, layout, r, 0, r, c, 1, 1, CASE WHEN r = 3 THEN 'header' ELSE 'body' END FROM spot WHERE layout = 'multi_level_column_header' AND (r = 3 AND c > 0 OR r > 3)),
made AS (SELECT table_id, rows, cols, layout, (row_number() OVER (PARTITION BY table_id ORDER BY phase, part, row, col) - 1)::INTEGER AS ordinal, row::INTEGER AS row, col::INTEGER AS col, rowspan::INTEGER AS rowspan, colspan::INTEGER AS colspan,
  CASE WHEN role = 'body' THEN 'td' ELSE 'th' END AS tag, role FROM laid)"""


def by_domain(sets, i: str) -> str:
    """The word at index ``i`` of the list of the table's domain."""
    of = lambda d: one_of(sets[d], i)
    return f"CASE table_id % 3 WHEN 0 THEN {of('finance')} WHEN 1 THEN {of('general')} ELSE {of('telecommunications')} END"


HEADED = f"""
headed AS (SELECT *, CASE WHEN role = 'title' THEN {TOPIC.replace('k %', 'table_id %')} WHEN role = 'header' THEN CASE WHEN colspan > 1 THEN {by_domain(L.GROUP_HEADERS, 'greatest(0, col - 1)')} WHEN rowspan > 1 AND row <= 2 THEN {by_domain(L.HEADERS, 'col')}
  WHEN row > 1 AND col = 0 THEN {by_domain(L.ROW_HEADERS, 'row - 2')} ELSE {by_domain(L.HEADERS, 'col')} END END AS text FROM made)"""
RULES = [
    (("区域",), one_of(L.REGIONS, "v")),
    (("投诉类型",), one_of(L.ORDER_TYPES, "v")),
    (("套餐名称",), one_of(L.PACKAGES, "v")),
    (("时段",), one_of(L.TIME_WINDOWS, "v")),
    (("部门",), one_of(L.DEPARTMENTS, "v")),
    (L.VALUE_PERCENT, "((v % 300 + 700) // 10) || '.' || ((v % 300 + 700) % 10) || '%'"),
    (("日期",), "'2026-' || lpad((v % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad(((v // 12) % 28 + 1)::VARCHAR, 2, '0')"),
    (("编号",), "'BS-' || (v % 9000 + 1000)"),
    (("建议", "意见", "备注"), one_of(L.SUGGESTIONS, "v")),
    (L.VALUE_COUNT, "(v % 990 + 10)::VARCHAR"),
    (("负责人", "维护人员", "装维人员"), one_of(L.PEOPLE, "v")),
    (("状态", "类型", "偏好", "设备"), one_of(L.STATUS, "v")),
]
FILLED = f"""
filled AS (SELECT table_id, ordinal, CASE WHEN role <> 'body' THEN text {' '.join(f'WHEN {has("h", w)} THEN {x}' for w, x in RULES)} ELSE {one_of(L.STATUS, 'v')} END AS text
  FROM (SELECT b.*, {draw("'p'", 'b.table_id', "'value'", 'b.ordinal')} AS v, coalesce((SELECT arg_max(h.text, h.ordinal) FROM headed h WHERE h.table_id = b.table_id AND h.role = 'header' AND b.col >= h.col AND b.col < h.col + h.colspan), '') AS h FROM headed b))"""


def _made(*ctes: str) -> str:
    return _sql(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


_names = list(N.TEMPLATES)
_rows = ", ".join(f"({i}, {j}, {len(ts)}, '{d}', '{t[0]}', '{t[1]}', '{','.join(t[2])}')" for i, (d, ts) in enumerate(N.TEMPLATES.items()) for j, t in enumerate(ts))
CLEAN = "trim(replace(replace(replace(replace(text, '<b>', ''), '</b>', ''), '<i>', ''), '</i>', ''))"
TOKENS = f"marked AS (SELECT table_id, row, string_agg('<td' || {MARK} || '>' || {CLEAN} || '</td>', '' ORDER BY col, ordinal) AS s FROM {{cells}} GROUP BY ALL), html AS (SELECT table_id, '<table>' || string_agg('<tr>' || s || '</tr>', '' ORDER BY row) || '</table>' AS html FROM marked GROUP BY 1)"

ORACLE: dict[str, str] = {
    "plan_shapes": _made(PLAN, "SELECT table_id, rows, cols, layout, '' AS layout_error FROM plan"),
    "layout_cells": _made(PLAN, CELLS, "SELECT * FROM made"),
    "header_texts": _made(PLAN, CELLS, HEADED, "SELECT table_id, ordinal, text FROM headed WHERE role <> 'body'"),
    "body_values": _made(PLAN, CELLS, HEADED, FILLED, "SELECT * FROM filled"),
    "generated_validity": _made(PLAN, CELLS, "cells AS (SELECT * FROM made)", ISSUES, "SELECT table_id, code, ordinal, row, col FROM issues"),
    "fallback_templates": f"WITH t(d, j, n, domain, scenario, topic, headers) AS (VALUES {_rows}) SELECT id, domain, scenario, topic || CASE WHEN (id // {len(_names)}) // n > 0 THEN '（' || ((id // {len(_names)}) // n + 1) || '）' ELSE '' END AS topic, headers FROM range(1000) r(id) JOIN t ON d = id % {len(_names)} AND j = (id // {len(_names)}) % n",
    "ablation_requests": "WITH k(configuration, candidates, augmentations) AS (VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in N.ABLATION) + ") SELECT configuration, sample, candidates, augmentations, sample % 2 = 0 AS simple FROM k, range(200) s(sample)",
    "token_html": _sql(GRID, TOKENS.format(cells="cells"), "SELECT * FROM html"),
    "chat_samples": _sql(GRID, ISSUES, META, TOKENS.format(cells="valid"), "SELECT table_id, '<image>' || chr(10) || 'Read the table.' AS ask, html AS answer, image FROM html JOIN (SELECT * FROM meta WHERE line = 0) USING (table_id)"),
    "clip_frames": _sql(GRID, "f AS (SELECT table_id, min(col) AS x, min(row) AS y, max(col + colspan) AS x2, max(row + rowspan) AS y2 FROM cells GROUP BY 1)",
        "SELECT table_id, ordinal, (col - x) * 80 + 5 AS x1, (row - y) * 24 + 5 AS y1, (col + colspan - x) * 80 + 5 AS x2, (row + rowspan - y) * 24 + 5 AS y2, (f.x2 - x) * 80 + 10 AS width, (f.y2 - y) * 24 + 10 AS height FROM cells JOIN f USING (table_id)"),
    "routed_values": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'm' || event_id WHEN event_id % 7 <> 0 THEN 'r' || event_id END AS value, CASE WHEN event_id % 3 = 0 THEN 'model' WHEN event_id % 7 <> 0 THEN 'rule' END AS backend, CASE WHEN event_id % 3 = 0 THEN 'success' WHEN event_id % 7 <> 0 THEN 'fallback' ELSE 'failed' END AS status, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 3 END AS attempts FROM events",
    "attempts_needed": "WITH n AS (SELECT user_id, event_id % 3 <> 0 AS ok, row_number() OVER w AS i, count(*) FILTER (event_id % 3 <> 0) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, max(i) AS attempts, max(s) AS successes, max(s) >= 4 AS complete FROM n WHERE i <= 12 AND (s < 4 OR ok AND s = 4) GROUP BY 1",
    "image_issues": "WITH m AS (SELECT o_orderkey AS k, 'img/' || o_orderkey || '.jpg' AS file FROM orders) SELECT file, k % 3 + 1 AS cells, CASE WHEN k % 47 = 0 THEN 'image size unavailable' WHEN k % 11 = 0 THEN 'broken image' ELSE 'empty image' END AS issue FROM m WHERE k % 47 = 0 OR k % 11 = 0 OR k % 5 = 0",
    "count_mismatches": _sql(GRID, "n AS (SELECT table_id, count(*) AS n FROM cells GROUP BY 1)", "SELECT table_id, n + table_id % 3 AS declared, n AS actual FROM n WHERE table_id % 4 <> 0 AND table_id % 3 <> 0"),
    "trace_windows": _sql(TRACES, "SELECT date_trunc('hour', ts) AS window_start, action, count(*) AS n, round(sum(value), 4) AS total FROM steps GROUP BY ALL"),
}
