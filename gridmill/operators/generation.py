"""Synthetic requests: balanced configurations and structures, a row an id, no state between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.sources.fixtures import CONFIGS, STRUCTURES

PER_CYCLE = sum(not c.startswith("simple") for c in CONFIGS)
FIRST_COMPLEX = len(CONFIGS) - PER_CYCLE


def requests(spark: SparkSession, n: int, structure: str | None = None) -> DataFrame:
    """id, config_id, structure: the eight configurations in turn; complex ones take the seven structures in turn.

    With a structure of its own a request keeps it, and ``error`` tells that a simple table can't take one.
    """
    i = F.col("id")
    ordinal = F.floor(i / len(CONFIGS)) * PER_CYCLE + i % len(CONFIGS) - FIRST_COMPLEX
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (F.pmod(by, F.lit(len(names))) + 1).cast("int"))
    config = pick(CONFIGS, i)
    simple = config.startswith("simple")
    if structure is None:
        return spark.range(n).select("id", config.alias("config_id"), F.when(~simple, pick(STRUCTURES, ordinal)).alias("structure"))
    return spark.range(n).select("id", config.alias("config_id"), F.when(~simple, structure).alias("structure"), F.when(simple, "unsupported request: simple tables take no structure").alias("error"))


# Fallback templates by domain (scenario, topic, headers, group headers, row headers).
TEMPLATES = {
    "telecommunications": (
        ("base_station_maintenance", "基站巡检与告警处理记录", ("基站编号", "所属区域", "巡检日期", "告警次数", "处理时长", "维护人员", "维护状态"), ("站点信息", "巡检记录", "告警处理"), ("宏站A", "宏站B", "室分点", "边缘站")),
        ("broadband_installation", "宽带装机与故障修复统计", ("装机区域", "预约量", "完成量", "超时单", "修复时长", "客户评分"), ("区域信息", "装机进度", "服务评价"), ("东区", "西区", "南区", "北区")),
    ),
    "medical": (
        ("outpatient_records", "门诊就诊记录汇总", ("患者ID", "诊断结果", "科室", "主治医生", "医疗费用", "报销比例"), ("患者信息", "诊疗信息", "费用信息"), ("P001", "P002", "P003", "P004")),
        ("drug_inventory", "药品库存与消耗统计", ("药品编码", "药品名称", "库存数量", "月消耗量", "供应商", "有效期"), ("药品信息", "库存信息", "供应信息"), ("D001", "D002", "D003", "D004")),
    ),
    "finance": (("budget_execution", "部门预算执行情况表", ("部门", "年度预算", "已支出", "执行率", "剩余额度", "负责人"), ("部门信息", "预算信息", "执行情况"), ("研发部", "市场部", "运营部", "财务部")),),
    "education": (("exam_scores", "期末考试成绩汇总表", ("学号", "姓名", "班级", "语文", "数学", "英语", "总分", "排名"), ("基本信息", "各科成绩", "综合"), ("S001", "S002", "S003", "S004")),),
    "logistics": (("warehouse_inventory", "仓库库存与周转统计", ("仓库编号", "存储区域", "货品种类", "库存量", "周转率", "盘点日期"), ("仓库信息", "库存信息", "运营数据"), ("WH001", "WH002", "WH003", "WH004")),),
}
ABLATION = (("single", 1, 0), ("multi", 5, 0), ("paper_5_plus_4", 5, 4))


def fallback_templates(spark: SparkSession, n: int, domain: str | None = None) -> DataFrame:
    """id, domain, scenario, topic, headers, group_headers, row_headers: domains in turn, then a domain's templates in turn.

    After each full cycle of a domain the topic carries the number of the cycle.  An unknown domain takes the first
    domain's templates under its own name.
    """
    names = [domain] if domain else list(TEMPLATES)
    words = lambda v: F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)
    keys = ("scenario", "topic", "headers", "group_headers", "row_headers")
    one = lambda t: F.struct(*[words(v).alias(k) for k, v in zip(keys, t, strict=True)])
    listed = F.array(*[F.struct(F.lit(d).alias("domain"), F.array(*map(one, TEMPLATES.get(d, TEMPLATES["telecommunications"]))).alias("templates")) for d in names])
    turn = F.floor(F.col("id") / len(names)).cast("int")
    picked = spark.range(n).select("id", turn.alias("turn"), F.element_at(listed, (F.col("id") % len(names) + 1).cast("int")).alias("d"))
    t = F.element_at(F.col("d.templates"), F.col("turn") % F.size("d.templates") + 1)
    cycle = F.floor(F.col("turn") / F.size("d.templates")) + 1
    topic = F.when(cycle > 1, F.concat(t["topic"], F.lit("（"), cycle.cast("string"), F.lit("）"))).otherwise(t["topic"])
    return picked.select("id", F.col("d.domain").alias("domain"), t["scenario"].alias("scenario"), topic.alias("topic"), *[t[k].alias(k) for k in keys[2:]])


def ablation_requests(spark: SparkSession, samples: int) -> DataFrame:
    """configuration, sample, candidates, augmentations, simple: every configuration with every sample."""
    kinds = F.array(*[F.struct(F.lit(a).alias("configuration"), F.lit(b).alias("candidates"), F.lit(c).alias("augmentations")) for a, b, c in ABLATION])
    return spark.range(samples).select(F.col("id").alias("sample"), F.explode(kinds).alias("k")).select("k.configuration", "sample", "k.candidates", "k.augmentations", (F.col("sample") % 2 == 0).alias("simple"))
