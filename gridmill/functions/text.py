"""Column functions over cell texts, headers, messages and file names; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hints in headers and texts, scenario keywords, generic words.
NUMERIC_HINTS = ("数", "收入", "预算", "支出", "利润", "同比", "完成率", "评分", "流量", "时长", "速度", "次数", "频次", "投诉", "覆盖", "用户", "容量")
PERCENT_HINTS = ("率", "同比", "进度", "占比", "满意度", "覆盖率")
STATUS_HINTS = ("状态", "备注", "类型", "时段", "偏好", "设备")
ENTITY_HINTS = ("区域", "部门", "项目", "用户类型", "客户类型", "群体", "负责人")
DATE_HINTS, ID_HINTS, PERSON_HINTS, COMMENT_HINTS = ("日期", "时间"), ("编号", "工单"), ("人员", "负责人"), ("备注", "建议", "意见")
KEYWORDS = {
    "base_station_maintenance": ("基站", "站点", "巡检", "告警", "处理", "维护", "区域"),
    "network_coverage": ("区域", "覆盖", "弱覆盖", "速率", "掉线", "优化", "验收"),
    "customer_complaints": ("投诉", "受理", "完结", "响应", "满意", "部门", "复核"),
    "package_revenue": ("套餐", "订购", "新增", "退订", "收入", "ARPU", "转化", "同比"),
    "traffic_monitoring": ("监控", "流量", "带宽", "活跃", "拥塞", "时延", "丢包", "扩容"),
    "broadband_installation": ("装机", "预约", "完成", "超时", "修复", "装维", "评分", "工单"),
    "telecommunications": ("区域", "站点", "用户", "故障", "完成率", "收入", "网络", "覆盖", "流量"),
    "finance": ("部门", "预算", "支出", "收入", "利润", "同比", "风险", "状态"),
    "general": ("项目", "负责人", "数量", "进度", "状态", "评分", "日期", "备注"),
}
GENERIC_HEADERS = ("字段", "名称", "指标", "数据", "内容", "说明", "项目一", "项目二", "项目三")
PLACEHOLDERS = ("数据", "内容", "示例", "待填", "未知", "暂无")
ENTITY_WORDS = ("区", "部", "组", "项目", "部门", "中心", "站", "工")
STATUS_WORDS = ("正常", "完成", "待", "进行", "复核", "优化", "跟进", "异常")

# What a text below a header must hold, phrases of messages by class and by code.
DATE_MARKS, ID_MARKS, PERSON_MARKS = ("-", "/", "年", "月"), ("BS", "单", "编号"), ("工", "员", "经理", "主管", "张", "李", "王", "赵", "陈")
COMPLAINT_HEADER, COMPLAINT_MARKS = "投诉类型", ("慢", "掉线", "计费", "延迟", "信号", "服务", "投诉")
PACKAGE_HEADER, PACKAGE_MARKS = "套餐", ("套餐", "流量包")
PERIOD_HEADER, PERIOD_MARKS = "时段", ("峰", "午", "夜", "节假日", "工作日", "时")
ERROR_CLASSES = {
    "schema_invalid": ("invalid table schema",),
    "filling_low_score": ("invalid table filling",),
    "render_failed": ("render", "selenium", "webdriver"),
    "unsupported_request": ("unsupported request",),
    "budget_exhausted": ("budget exhausted",),
}
ISSUE_CODES = {
    "header_incomplete": ("empty header", "no header"),
    "empty_cell": ("empty body",),
    "invalid_cell_type": ("non-percentage", "non-numeric"),
    "header_body_mismatch": ("does not match header",),
    "topic_mismatch": ("topic", "semantic scenario"),
    "duplicate_content": ("duplication", "duplicate"),
}


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of some words: one pattern, as a chain of tests makes methods too large to be compiled."""
    return text.rlike("|".join(f"\\Q{w}\\E" for w in words))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it: lambdas work out again what they enclose."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_filled(*cols: Column) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def label_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalized(text: Column) -> Column:
    """Trimmed, lower-cased, each run of white space one blank."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def cleaned(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "</?[bi]>| ", ""))


#: What a style leaves in a cell's text that shows nothing.
STYLE_MARKS = ("<b>", "</b>", "\u2028", " ", "<i>", "</i>")


def without(text: Column, marks: tuple[str, ...] = STYLE_MARKS) -> Column:
    """A text without some marks, taken out one after the other."""
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def tokens(text: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{IsAlphabetic}\p{N}]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    share = lambda x: F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x["a"], x["b"])) / F.size(F.array_union(x["a"], x["b"])))
    return let(F.struct(a.alias("a"), b.alias("b")), share)


def numeric_like(text: Column) -> Column:
    """A number after dropping commas, trailing per cent signs and trailing letters."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.replace(text, F.lit(","), F.lit(""))), "%+$", ""), r"(?U)[\p{IsAlphabetic}\s]+$", "")
    return F.coalesce(bare.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.lit(False))


def percent_like(text: Column) -> Column:
    return text.endswith("%") & numeric_like(F.trim(F.regexp_replace(text, "%$", "")))


def leading_number(text: Column) -> Column:
    """The number a text begins with (signs, digits, points), null if that is none."""
    found = F.regexp_extract(F.trim(F.replace(text, F.lit(","), F.lit(""))), r"^([+-]*[0-9][0-9.]*)", 1)
    return F.when(found.rlike(r"^[+-]?[0-9]+\.?[0-9]*$"), found)


def expected_type(header: Column) -> Column:
    return F.when(has_any(header, PERCENT_HINTS), "percent").when(has_any(header, NUMERIC_HINTS), "numeric").when(has_any(header, ENTITY_HINTS), "entity").when(has_any(header, STATUS_HINTS), "status").otherwise("text")


def suits_header(header: Column, text: Column) -> Column:
    """Whether a text may stand below a header: the first rule whose hint the header has decides."""
    digit = text.rlike(r"\p{N}")
    return (
        F.when(has_any(header, DATE_HINTS), digit & has_any(text, DATE_MARKS))
        .when(has_any(header, ID_HINTS), digit | has_any(text, ID_MARKS))
        .when(has_any(header, PERSON_HINTS), has_any(text, PERSON_MARKS))
        .when(has_any(header, COMMENT_HINTS), (F.length(text) > 2) & ~numeric_like(text))
        .when(header.contains(COMPLAINT_HEADER), has_any(text, COMPLAINT_MARKS))
        .when(header.contains(PACKAGE_HEADER), has_any(text, PACKAGE_MARKS))
        .when(header.contains(PERIOD_HEADER), has_any(text, PERIOD_MARKS))
        .otherwise(F.lit(True))
    )


def score_cell(header: Column, text: Column) -> Column:
    """struct(score, issue) of a body cell below a header."""
    t, of = F.trim(text), lambda hints: has_any(header, hints)
    out = lambda score, issue=None: F.struct(F.lit(score).alias("score"), F.lit(issue).cast("string").alias("issue"))
    # In the order of ``expected_type``, each kind in one branch, so that a kind is found once.
    return (
        F.when(t == "", out(0.0, "empty"))
        .when(of(PERCENT_HINTS), F.when(percent_like(t), out(1.0)).otherwise(out(0.0, "percent")))
        .when(of(NUMERIC_HINTS), F.when(numeric_like(t), out(1.0)).otherwise(out(0.0, "numeric")))
        .when(~suits_header(header, t), out(0.35, "semantic_mismatch"))
        .when(of(ENTITY_HINTS), F.when(has_any(t, ENTITY_WORDS), out(0.95)).otherwise(out(0.7, "weak_text")))
        .when(of(STATUS_HINTS), F.when(has_any(t, STATUS_WORDS), out(0.95)).otherwise(out(0.75, "weak_text")))
        .when(F.length(t) <= 2, out(0.6, "weak_text"))
        .when((t == header) | t.isin(*PLACEHOLDERS), out(0.55, "weak_text"))
        .otherwise(out(0.9))
    )


def annotated_role(role: Column, header_type: Column, row: Column, col: Column) -> Column:
    left = F.when(header_type == "two_axis_header", 2).otherwise(1)
    return F.when(role == "title", "title").when((role == "header") & (col < left) & (row > 1), "row_header").when(role == "header", "column_header").otherwise("body")


def line_type(style: Column) -> Column:
    return F.when(style.endswith("_full"), "fully_lined").when(style.endswith("_horizontal"), "horizontal_lined").when(style.endswith("_vertical"), "vertical_lined").when(style.endswith("_header"), "header_lined").otherwise("unlined")


def first_class(message: Column, classes: dict[str, tuple[str, ...]], other: str) -> Column:
    """The first class with a phrase that the message holds, in any case of letters."""
    low = F.lower(message)
    return F.coalesce(*[F.when(has_any(low, phrases), name) for name, phrases in classes.items()], F.lit(other))


def error_class(message: Column) -> Column:
    """Six classes of failure by the first phrase that a message holds."""
    return first_class(message, ERROR_CLASSES, "generation_failed")


def issue_code(message: Column) -> Column:
    return first_class(message, ISSUE_CODES, "semantic_conflict")


def issue_severity(message: Column) -> Column:
    return F.when(F.lower(message).contains("warning"), "warning").otherwise("error")


def issue_location(message: Column) -> Column:
    """struct(row, col) of the first bracketed pair of whole numbers, else null."""
    inner = F.split(F.regexp_extract(message, r"^[^(]*\(([^)]*)\)", 1), ",")
    number = lambda k: F.trim(F.get(inner, F.lit(k))).try_cast("int")
    return F.when((F.size(inner) == 2) & number(0).isNotNull() & number(1).isNotNull(), F.struct(number(0).alias("row"), number(1).alias("col")))


def escaped(text: Column) -> Column:
    """HTML escapes, the ampersand first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
