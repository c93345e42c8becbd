"""Header layouts, header texts and body values of planned tables.

Every choice is a digest of seed, table and place, so a lost task builds the same cells again.  A table's cells are
an array built within its own row: no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions.text import has_any, leading_number, line_type
from gridmill.sources.fixtures import STRUCTURES

# Header sets by domain, value pools, header hints of the value rules in their order.
HEADERS = {
    "telecommunications": ("区域", "站点数", "用户数", "故障数", "完成率", "收入", "同比", "备注"),
    "finance": ("部门", "预算", "支出", "收入", "利润", "同比", "状态", "备注"),
    "general": ("项目", "负责人", "数量", "进度", "状态", "评分", "日期", "备注"),
}
GROUP_HEADERS = {
    "telecommunications": ("基础信息", "网络规模", "服务质量", "经营指标"),
    "finance": ("组织信息", "预算执行", "收益指标", "风险状态"),
    "general": ("基础信息", "执行情况", "质量指标", "补充说明"),
}
ROW_HEADERS = {
    "telecommunications": ("东区", "西区", "南区", "北区", "中心区", "新区"),
    "finance": ("研发部", "市场部", "运营部", "财务部", "客服部", "采购部"),
    "general": ("阶段一", "阶段二", "阶段三", "阶段四", "阶段五", "阶段六"),
}
REGIONS = ("东区", "西区", "南区", "北区", "中心区", "新区")
STATUS = ("正常", "待优化", "已完成", "跟进中", "需复核")
PEOPLE = ("张工", "李工", "王工", "赵工", "陈工")
DEPARTMENTS = ("网络部", "市场部", "客服中心", "装维中心", "政企部", "运维部")
SUGGESTIONS = ("扩容小区", "优化参数", "安排复测", "跟进回访", "升级设备", "保持观察")
ORDER_TYPES = ("网络慢", "频繁掉线", "计费疑问", "装维延迟", "信号弱", "服务咨询")
PACKAGES = ("畅享套餐", "融合套餐", "校园套餐", "政企套餐", "家庭套餐", "流量包")
TIME_WINDOWS = ("早高峰", "午间", "晚高峰", "夜间", "节假日", "工作日")
VALUE_PERCENT = ("率", "同比", "进度", "占比", "满意度", "评分", "覆盖率")
VALUE_COUNT = ("站点数", "用户数", "故障数", "数量", "预算", "支出", "收入", "利润", "流量", "时长", "速度", "次数", "频次", "投诉", "延迟", "覆盖", "活跃", "告警", "受理", "完结", "响应", "订购", "新增", "退订", "带宽", "拥塞", "预约", "完成", "超时", "修复", "ARPU")
#: Header sets of scenarios: headers, group headers, row headers.
SCENARIO_HEADERS = {
    "base_station_maintenance": (("基站编号", "所属区域", "巡检日期", "告警次数", "处理时长", "维护人员", "维护状态", "备注"), ("站点信息", "巡检记录", "告警处理", "维护结果"), ("宏站A", "宏站B", "室分点", "边缘站", "核心站", "应急站")),
    "network_coverage": (("区域", "覆盖率", "弱覆盖点", "平均速率", "掉线率", "优化次数", "验收状态", "优化建议"), ("覆盖范围", "质量指标", "优化动作", "验收结果"), ("东区", "西区", "南区", "北区", "中心区", "新区")),
    "customer_complaints": (("投诉类型", "受理量", "完结量", "平均响应时长", "满意度", "责任部门", "处理状态", "复核意见"), ("投诉来源", "处理效率", "客户反馈", "闭环状态"), ("网络慢", "频繁掉线", "计费疑问", "装维延迟", "信号弱", "服务态度")),
    "package_revenue": (("套餐名称", "订购用户", "新增用户", "退订用户", "月收入", "ARPU", "转化率", "同比"), ("套餐信息", "用户规模", "收入表现", "增长趋势"), ("畅享套餐", "融合套餐", "校园套餐", "政企套餐", "家庭套餐", "流量包")),
    "traffic_monitoring": (("监控时段", "总流量", "峰值带宽", "活跃用户", "拥塞小区", "平均时延", "丢包率", "扩容建议"), ("时段信息", "流量负载", "网络质量", "容量规划"), ("早高峰", "午间", "晚高峰", "夜间", "节假日", "工作日")),
    "broadband_installation": (("装机区域", "预约量", "完成量", "超时单", "修复时长", "装维人员", "客户评分", "工单状态"), ("区域信息", "装机进度", "修复效率", "服务评价"), ("东区", "西区", "南区", "北区", "老城区", "新小区")),
}
#: Topics by domain and scenario.
TOPICS = {
    "telecommunications": {
        "base_station_maintenance": ("5G基站月度维护统计", "基站巡检与告警处理记录", "无线站点维护工单汇总"),
        "network_coverage": ("区域网络覆盖质量评估", "弱覆盖小区优化跟踪", "城区网络覆盖提升分析"),
        "customer_complaints": ("客户投诉受理与闭环统计", "服务工单处理效率分析", "网络质量投诉趋势跟踪"),
        "package_revenue": ("套餐收入与用户规模对比", "移动套餐订购转化统计", "宽带融合套餐经营分析"),
        "traffic_monitoring": ("移动数据流量高峰监控", "核心网流量负载日报", "用户上网行为流量分析"),
        "broadband_installation": ("宽带装机与故障修复统计", "家庭宽带开通进度跟踪", "装维人员服务质量评估"),
    },
    "finance": {
        "budget_execution": ("部门预算执行情况", "季度费用支出跟踪"),
        "revenue_profit": ("季度营收与成本分析", "利润指标完成情况"),
        "risk_status": ("资产负债摘要", "风险事项处置进展"),
    },
    "general": {
        "project_tracking": ("项目进度统计", "阶段任务完成情况"),
        "inspection": ("设备巡检记录", "问题整改跟踪表"),
        "business_metrics": ("业务指标汇总", "运营数据日报"),
    },
}
#: Header hints of the value rules that no list above holds, in their order.
REGION_HINTS, ORDER_HINTS, PACKAGE_HINTS, WINDOW_HINTS, DEPARTMENT_HINTS = ("区域",), ("投诉类型",), ("套餐名称",), ("时段",), ("部门",)
DATE_HINTS, CODE_HINTS, ADVICE_HINTS, PERSON_HINTS, STATE_HINTS = ("日期",), ("编号",), ("建议", "意见", "备注"), ("负责人", "维护人员", "装维人员"), ("状态", "类型", "偏好", "设备")
#: Value kinds of the filler, which asks for another list of numbers than the checker.
FILL_NUMERIC = ("站点数", "用户数", "故障数", "数量", "预算", "支出", "收入", "利润", "流量", "时长", "速度", "次数", "频次", "投诉", "延迟", "覆盖", "活跃", "容量", "告警", "受理", "完结", "响应", "订购", "新增", "退订", "带宽", "拥塞", "预约", "完成", "超时", "修复", "ARPU")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
STATUS_LIKE = ("状态", "备注", "类型", "时段", "偏好", "设备")
REGION_LIKE = ("区域", "部门", "项目", "用户类型", "客户类型", "群体")

CELL = "struct<phase:int,part:int,row:int,col:int,rowspan:int,colspan:int,tag:string,role:string>"


def draw(*keys: Column | str) -> Column:
    """A long of 32 bits from the digest of the keys joined by strokes."""
    parts = [F.lit(k) if isinstance(k, str) else k.cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 8), 16, 10).cast("long")


def one_of(words: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(number, F.lit(len(words))) + 1).cast("int"))


def plan_shapes(requests: DataFrame, seed: str, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Adds rows and cols drawn from the inclusive bounds to requests (table_id, structure).

    A structure of several header levels gets at least five rows; where the bounds forbid these, ``error`` says so.
    """
    between = lambda name, lo, hi: (F.lit(lo) + draw(seed, F.col("table_id"), name) % (hi - lo + 1)).cast("int")
    deep = F.coalesce(F.col("structure") == "multi_level_column_header", F.lit(False))
    least = F.when(deep, 5).otherwise(1)
    return requests.select(
        "*",
        F.greatest(between("rows", *rows), F.least(least, F.lit(rows[1]))).cast("int").alias("rows"),
        between("cols", *cols).alias("cols"),
        F.when(deep & (F.lit(rows[1]) < 5), "unsupported request: too few rows for several header levels").alias("error"),
    )


def chosen_layout(plans: DataFrame, seed: str) -> DataFrame:
    """Adds ``layout`` and ``layout_error`` to plans (table_id, rows, cols, simple, structure).

    Simple tables have one header row; small complex ones a title and a header; a named structure is taken as named;
    else one of six (seven from five rows on) is drawn.
    """
    name, rows = F.col("structure"), F.col("rows")
    free = tuple(s for s in STRUCTURES if s != "multi_level_column_header")
    pick = draw(seed, F.col("table_id"), "layout")
    drawn = F.when(rows >= 5, one_of((*free, "multi_level_column_header"), pick)).otherwise(one_of(free, pick))
    layout = F.when(F.col("simple"), "simple_single_header").when((rows < 4) | (F.col("cols") < 3), "title_header").when(name.isNull(), drawn).otherwise(name)
    wrong = F.when((layout == "multi_level_column_header") & (rows < 5), "unsupported request: too few rows for several header levels")
    wrong = wrong.when(~layout.isin("simple_single_header", "title_header", *STRUCTURES), F.concat(F.lit("unsupported request: unknown structure "), layout))
    return plans.withColumn("layout", layout).withColumn("layout_error", wrong)


def _tall(seed: str) -> Column:
    """Row spans of the first column from row 2 on: 2, 1, or 0 where a span from above covers the row."""
    coin = lambda r: (r + 1 < F.col("rows")) & (draw(seed, F.col("table_id"), "tall", r) % 2 == 0)
    step = lambda acc, r: F.concat(acc, F.array(F.when(F.try_element_at(acc, F.lit(-1)) == 2, 0).when(coin(r), 2).otherwise(1)))
    return F.when(F.col("rows") > 2, F.aggregate(F.sequence(F.lit(2), F.col("rows") - 1), F.array().cast("array<int>"), step))


def _groups(seed: str) -> Column:
    """(start, width) of the header group over each column from 1 on; widths of 2 or 3, the rest at the end."""
    wide = lambda c: F.least((F.lit(2) + draw(seed, F.col("table_id"), "group", c) % 2).cast("int"), F.col("cols") - c).cast("int")
    here = lambda start, width: F.struct(start.cast("int").alias("start"), width.alias("width"))

    def step(acc, c):
        last = F.try_element_at(acc, F.lit(-1))
        return F.concat(acc, F.array(F.when(last["start"] + last["width"] > c, last).otherwise(here(c, wide(c)))))

    return F.when(F.col("cols") > 1, F.aggregate(F.sequence(F.lit(1), F.col("cols") - 1), F.array().cast("array<struct<start:int,width:int>>"), step))


def _cell(r: Column, c: Column) -> Column:
    """The cell anchored in a slot, null where the slot belongs to another cell."""
    rows, cols, kind = F.col("rows"), F.col("cols"), F.col("layout")
    nothing = F.lit(None).cast(CELL)

    def cell(role, rowspan=1, colspan=1, part=0, phase=None):
        whole = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
        tag = "td" if role == "body" else "th"
        return F.struct(whole(r if phase is None else phase), whole(part), whole(r), whole(c), whole(rowspan), whole(colspan), F.lit(tag), F.lit(role)).cast(CELL)

    head, body = cell("header"), cell("body")
    left = lambda n: F.when(c < n, head).otherwise(body)
    split = F.greatest(F.lit(2), F.floor(cols / 2)).cast("int")
    grouped = F.when(r == 1, F.when(c == 0, cell("header", 2)).when(c == 1, cell("header", 1, split - 1)).when((c == split) & (split < cols), cell("header", 1, cols - split)).otherwise(nothing))
    grouped = grouped.when(r == 2, F.when(c > 0, head).otherwise(nothing)).otherwise(body)
    span = F.try_element_at(F.col("_tall"), (r - 1).cast("int"))
    tall = F.when(r == 1, head).when(c > 0, body).when(span == 0, nothing).otherwise(cell("body", span))
    mixed = F.when(r == 1, F.when(c == 0, cell("header", 2)).when(c == 1, cell("header", 1, cols - 1)).otherwise(nothing)).when(r == 2, F.when(c > 0, head).otherwise(nothing)).otherwise(left(1))
    axes = F.when(r == 1, F.when(c == 0, cell("header", 1, 2)).when(c == 2, cell("header", 1, cols - 2)).otherwise(nothing)).when(r == 2, head).otherwise(left(2))
    label = F.greatest(F.lit(1), cols - 2)
    summed = F.when(r == 1, head).when(r < rows - 1, body).when(c == 0, cell("header", 1, label)).when(c >= label, body).otherwise(nothing)
    group = F.try_element_at(F.col("_groups"), F.greatest(c, F.lit(1)).cast("int"))
    start, width = group["start"], group["width"]
    half = F.floor(width / 2).cast("int")
    level = lambda rowspan, colspan: cell("header", rowspan, colspan, start, 1)
    deep = (
        F.when((r == 1) & (c == 0), cell("header", 3))
        .when((r == 1) & (c == start), F.when(width == 1, level(2, 1)).otherwise(level(1, width)))
        .when((r == 2) & (c == start) & (c > 0) & (width > 1), level(1, half))
        .when((r == 2) & (c == start + half) & (c > 0) & (width > 1), level(1, width - half))
        .when((r == 3) & (c > 0), head)
        .when(r > 3, body)
        .otherwise(nothing)
    )
    named = F.when(kind == "grouped_columns", grouped).when(kind == "left_headers", F.when(r == 1, head).otherwise(left(1))).when(kind == "body_rowspan", tall).when(kind == "mixed_headers", mixed)
    named = named.when(kind == "two_axis_header", axes).when(kind == "summary_row_colspan", summed).when(kind == "multi_level_column_header", deep).otherwise(F.when(r == 1, head).otherwise(body))
    title = F.when(c == 0, cell("title", 1, cols)).otherwise(nothing)
    return F.when(kind == "simple_single_header", F.when(r == 0, head).otherwise(body)).when(r == 0, title).otherwise(named)


def layout_cells(plans: DataFrame, seed: str) -> DataFrame:
    """table_id, rows, cols, layout, ordinal, row, col, rowspan, colspan, tag, role of plans with a ``layout``.

    Plans with a layout_error, or without rows or columns, have no cells.
    """
    right = plans.where(F.col("layout_error").isNull() & (F.col("rows") > 0) & (F.col("cols") > 0))
    held = right.withColumn("_tall", F.when(F.col("layout") == "body_rowspan", _tall(seed))).withColumn("_groups", F.when(F.col("layout") == "multi_level_column_header", _groups(seed)))
    line = lambda r: F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda c: _cell(r, c))
    found = F.array_sort(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.col("rows") - 1), line))))
    return held.select("table_id", "rows", "cols", "layout", F.posexplode(found).alias("ordinal", "c")).select("table_id", "rows", "cols", "layout", "ordinal", "c.row", "c.col", "c.rowspan", "c.colspan", "c.tag", "c.role")


def merged(fallback: Column, generated: Column) -> Column:
    """The generated texts, then those of the fallback that they lack; the fallback alone where none were generated."""
    return F.when(F.coalesce(F.size(generated), F.lit(0)) <= 0, fallback).otherwise(F.concat(generated, F.array_except(fallback, generated)))


class Own:
    """The columns of a row by name, as the fields of a struct are."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


OWN = Own()


def header_text(headers: Column, groups: Column, row_headers: Column, c=OWN) -> Column:
    """Text of a header cell (row, col, rowspan, colspan): by group, column or row."""
    row, col = c["row"], c["col"]
    at = lambda words, i: F.element_at(words, (F.pmod(i, F.size(words)) + 1).cast("int"))
    return (
        F.when(c["colspan"] > 1, at(groups, F.greatest(F.lit(0), col - 1)))
        .when((c["rowspan"] > 1) & (row <= 2), at(headers, col))
        .when((row > 1) & (col == 0), at(row_headers, row - 2))
        .otherwise(at(headers, col))
    )


def domain_words(sets: dict[str, tuple[str, ...]], domain: Column) -> Column:
    """The word list of a domain; unknown domains and null take the general one."""
    words = lambda d: F.array(*map(F.lit, sets[d]))
    return F.when(domain == "telecommunications", words("telecommunications")).when(domain == "finance", words("finance")).otherwise(words("general"))


def scenario_words(i: int, scenario: Column) -> Column:
    """The i-th header set of a scenario, null for scenarios without one."""
    out = F.lit(None).cast("array<string>")
    for name, sets in SCENARIO_HEADERS.items():
        out = F.when(scenario == name, F.array(*map(F.lit, sets[i]))).otherwise(out)
    return out


def header_sets(df: DataFrame) -> tuple[Column, Column, Column]:
    """(headers, group headers, row headers) of a row: its template's, else its scenario's, else its domain's.

    A template (template_headers, template_group_headers, template_row_headers) without group or row headers takes those of
    the domain.  Columns that are missing count as null.
    """
    domain = F.col("domain")
    sets = [domain_words(x, domain) for x in (HEADERS, GROUP_HEADERS, ROW_HEADERS)]
    plain = sets
    if "scenario" in df.columns:
        plain = [F.coalesce(scenario_words(i, F.col("scenario")), x) for i, x in enumerate(sets)]
    if "template_headers" not in df.columns:
        return tuple(plain)
    given = lambda name: F.when(F.size(name) > 0, F.col(name)) if name in df.columns else F.lit(None).cast("array<string>")
    own = given("template_headers")
    rest = [F.coalesce(given(f"template_{k}_headers"), x) for k, x in zip(("group", "row"), sets[1:], strict=True)]
    return tuple(F.when(own.isNotNull(), t).otherwise(p) for t, p in zip((own, *rest), plain, strict=True))


def with_headers(cells: DataFrame) -> DataFrame:
    """Adds ``text`` to cells (…, domain, topic and what ``header_sets`` reads): titles take the topic, headers a text of their set."""
    text = header_text(*header_sets(cells))
    return cells.withColumn("text", F.when(F.col("role") == "title", F.col("topic")).when(F.col("role") == "header", text))


def plan_topics(requests: DataFrame, seed: str, used: DataFrame | None = None) -> DataFrame:
    """Adds scenario and topic to requests (table_id, domain): a scenario of the domain, then one of its topics not used yet,
    or any of them where all are; unknown domains and null take the general one.

    ``used``: topic.  Only topics of the rules matter, so what every row gets of it is bounded by these.
    """
    known = F.array(*[F.struct(F.lit(d).alias("domain"), F.array(*[F.struct(F.lit(k).alias("scenario"), F.array(*map(F.lit, v)).alias("topics")) for k, v in sets.items()]).alias("sets")) for d, sets in TOPICS.items()])
    of = lambda d: F.get(F.filter(known, lambda x: x["domain"] == d), F.lit(0))["sets"]
    t = requests.withColumn("__sets", F.coalesce(of(F.col("domain")), of(F.lit("general"))))
    t = t.withColumn("__set", F.element_at("__sets", (draw(seed, F.col("table_id"), "scenario") % F.size("__sets") + 1).cast("int")))
    rules = [x for sets in TOPICS.values() for topics in sets.values() for x in topics]
    if used is None:
        t = t.withColumn("__used", F.array().cast("array<string>"))
    else:
        t = t.join(F.broadcast(used.where(F.col("topic").isin(*rules)).agg(F.collect_set("topic").alias("__used"))))  # one row
    free = F.array_except("__set.topics", "__used")
    t = t.withColumn("__free", F.when(F.size(free) > 0, free).otherwise(F.col("__set.topics")))
    topic = F.element_at("__free", (draw(seed, F.col("table_id"), "topic") % F.size("__free") + 1).cast("int"))
    return t.withColumns({"scenario": F.col("__set.scenario"), "topic": topic}).drop("__sets", "__set", "__used", "__free")


def plan_looks(requests: DataFrame, seed: str) -> DataFrame:
    """Requests with simple, colored and lined where they are null drawn with chances of 0.55, 0.4 and 0.7."""
    drawn = lambda name, share: F.coalesce(F.col(name), draw(seed, F.col("table_id"), name) % 100 < share).alias(name)
    looks = {"simple": 55, "colored": 40, "lined": 70}
    return requests.select(*[drawn(c, looks[c]) if c in looks else F.col(c) for c in requests.columns])


def styles(plans: DataFrame, seed: str) -> DataFrame:
    """table_id, name, line_type, table_css, cell_css, header_css, visual (a map) of plans (table_id, rows, cols, language, simple,
    colored, lined, max_text: the longest text): paddings and sizes by how dense a table is, all else drawn.
    """
    pick = lambda what, words: one_of(words, draw(seed, F.col("table_id"), what))
    density = F.col("rows") * F.col("cols")
    dense = (density >= 60) | (F.col("max_text") >= 18)
    middle = (density >= 30) | (F.col("max_text") >= 10)
    tight, usual, wide = "compact/4px 10px/5px 12px", "regular/6px 12px/7px 14px", "loose/8px 18px/9px 20px"
    padding = F.split(F.when(dense, "compact/4px 8px/5px 10px").when(middle, pick("padding", (tight, usual))).otherwise(pick("padding", ("regular/6px 14px/7px 16px", wide))), "/")
    size = F.when(dense, pick("size", ("12", "13"))).when(middle, pick("size", ("12", "13", "14"))).otherwise(pick("size", ("13", "14", "15")))
    font = F.when(F.col("language") == "en", pick("font", ("Arial", "Times New Roman", "Microsoft YaHei"))).otherwise(pick("font", ("Microsoft YaHei", "SimSun", "SimHei", "Arial")))
    mode = F.when(F.col("colored"), pick("background", ("plain", "zebra", "soft_fill"))).otherwise("plain")
    weight = pick("border", ("thin", "regular", "strong"))
    line = F.when(F.col("lined"), pick("line", ("full", "horizontal", "vertical", "header"))).otherwise(pick("line", ("none", "light_horizontal")))
    t = plans.withColumns({"__padding": padding, "__size": size, "__font": font, "__mode": mode, "__weight": weight, "__line": line, "__align": pick("align", ("center", "left", "right")), "__head": pick("head", ("#e8f2ff", "#edf7ed", "#fff0d9", "#f2ecff")), "__zebra": pick("zebra", ("#f7fbff", "#f8f8f8", "#fffaf0"))})
    t = t.withColumn("__body", F.when(F.col("__mode") != "plain", "#fff7e6").otherwise("white"))
    width = F.when(F.col("__weight") == "strong", "2px").otherwise("1px")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    sides = lambda names, color: text(*[x for n in names for x in (f"border{n}:", width, f" solid {color};")])
    across, down = ("-top", "-bottom"), ("-left", "-right")
    kind = F.col("__line")
    table_border = F.when(kind == "full", sides(("",), "#111")).when(kind == "horizontal", sides(across, "#111")).when(kind == "vertical", sides(down, "#111")).otherwise("")
    cell_border = F.when(kind == "full", sides(("",), "#111")).when(kind == "horizontal", sides(across, "#333")).when(kind == "vertical", sides(down, "#333")).when(kind == "light_horizontal", "border-bottom:1px solid #ddd;").otherwise("")
    head_border = F.when(kind == "full", sides(("",), "#111")).when(kind == "horizontal", sides(across, "#111")).when(kind == "vertical", sides(down, "#111")).when(kind == "header", sides(("-bottom",), "#111")).when(kind == "light_horizontal", "border-bottom:1px solid #999;").otherwise("")
    fill = lambda color: F.when(F.col("colored"), text("background:", F.col(color), ";")).otherwise("")
    name = F.concat_ws("_", F.lit("agent"), F.when(F.col("simple"), "simple").otherwise("complex"), F.when(F.col("colored"), "colored").otherwise("plain"), kind)
    table_css = text("border-collapse:collapse;text-align:", F.col("__align"), ";font-family:", F.col("__font"), ";font-size:", F.col("__size"), "px;background:white;", table_border)
    cell_css = text("padding:", F.col("__padding")[1], ";word-break:break-all;", cell_border, fill("__body"))
    header_css = text("padding:", F.col("__padding")[2], ";font-weight:bold;", head_border, fill("__head"))
    told = {"font_family": F.col("__font"), "font_size": F.col("__size"), "padding_mode": F.col("__padding")[0], "cell_padding": F.col("__padding")[1], "header_padding": F.col("__padding")[2], "align": F.col("__align"), "background_mode": F.col("__mode"), "table_background": F.lit("white"), "header_background": F.col("__head"), "body_background": F.col("__body"), "zebra_background": F.col("__zebra"), "border_weight": F.col("__weight"), "density": density.cast("string"), "max_text_length": F.col("max_text").cast("string")}
    return t.select("table_id", name.alias("name"), line_type(name).alias("line_type"), table_css.alias("table_css"), cell_css.alias("cell_css"), header_css.alias("header_css"), F.create_map(*[x for k, v in told.items() for x in (F.lit(k), v)]).alias("visual"))


def body_value(header: Column, number: Column, other: Column) -> Column:
    """A value for a header by the first rule it fits; ``number`` (a long) decides, ``other`` serves the rest."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    date = F.concat(F.lit("2026-"), two(number % 12 + 1), F.lit("-"), two(F.floor(number / 12) % 28 + 1))
    return (
        F.when(has_any(header, REGION_HINTS), one_of(REGIONS, number))
        .when(has_any(header, ORDER_HINTS), one_of(ORDER_TYPES, number))
        .when(has_any(header, PACKAGE_HINTS), one_of(PACKAGES, number))
        .when(has_any(header, WINDOW_HINTS), one_of(TIME_WINDOWS, number))
        .when(has_any(header, DEPARTMENT_HINTS), one_of(DEPARTMENTS, number))
        .when(has_any(header, VALUE_PERCENT), percent_value(number))
        .when(has_any(header, DATE_HINTS), date)
        .when(has_any(header, CODE_HINTS), F.concat(F.lit("BS-"), (number % 9000 + 1000).cast("string")))
        .when(has_any(header, ADVICE_HINTS), one_of(SUGGESTIONS, number))
        .when(has_any(header, VALUE_COUNT), (number % 990 + 10).cast("string"))
        .when(has_any(header, PERSON_HINTS), one_of(PEOPLE, number))
        .when(has_any(header, STATE_HINTS), one_of(STATUS, number))
        .otherwise(other)
    )


def fill_kind(header: Column) -> Column:
    """The kind of value that the filler asks for below a header: percent, numeric or text."""
    return F.when(has_any(header, VALUE_PERCENT), "percent").when(has_any(header, FILL_NUMERIC), "numeric").otherwise("text")


def free_text(language: Column | None, number: Column) -> Column:
    """A text for headers that no rule fits: a state, for English tables a piece of the alphabet of 3 to 10 letters."""
    state = one_of(STATUS, number)
    if language is None:
        return state
    start = (number % 24).cast("int")
    length = (3 + F.floor(number / 24) % (F.least(F.lit(10), 26 - start) - 2)).cast("int")
    return F.when(language == "en", F.substring(F.lit(ALPHABET), start + 1, length)).otherwise(state)


def percent_value(number: Column) -> Column:
    """70.0% to 99.9%."""
    tenths = number % 300 + 700
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


def normalized_value(kind: Column, header: Column, value: Column, number: Column) -> Column:
    """A model's value made fit for its column: per cent sign added, leading number kept, blanks filled."""
    text = F.trim(F.coalesce(value, F.lit("")))
    lead = leading_number(text)
    filled = F.when(has_any(header, STATUS_LIKE), one_of(STATUS, number)).when(has_any(header, REGION_LIKE), one_of(REGIONS, number)).otherwise(one_of(STATUS, number))
    return (
        F.when((kind == "percent") & text.endswith("%"), text)
        .when(kind == "percent", F.coalesce(F.concat(lead, F.lit("%")), percent_value(number)))
        .when(kind == "numeric", F.coalesce(lead, (number % 990 + 10).cast("string")))
        .when(text == "", filled)
        .otherwise(text)
    )


def with_body(cells: DataFrame, seed: str) -> DataFrame:
    """Fills ``text`` of the body cells by the last header over their column; cells may have a language.

    Headers meet the cells by table and column after their spans are spread, not by a range.
    """
    over = cells.where("role = 'header'").withColumn("__over", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)))
    last = over.groupBy(F.col("table_id").alias("__t"), "__over").agg(F.max_by("text", "ordinal").alias("__header"))
    met = cells.join(last, (cells["table_id"] == last["__t"]) & (cells["col"] == last["__over"]), "left")
    number = draw(seed, F.col("table_id"), "value", F.col("ordinal"))
    value = body_value(F.coalesce("__header", F.lit("")), number, free_text(F.col("language") if "language" in cells.columns else None, number))
    return met.withColumn("text", F.when(F.col("role") == "body", value).otherwise(F.col("text"))).drop("__t", "__over", "__header")
