"""Table corpora derived from the driver's star schema: cells, metadata, boxes, predictions, traces, sessions, ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLS = 6
ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
HEADERS = ("项目", "数量", "收入", "占比", "状态", "日期")
DOMAINS = ("finance", "general", "telecommunications")
CONFIGS = ("simple_colored_lined", "simple_colored_unlined", "simple_plain_lined", "simple_plain_unlined", "complex_colored_lined", "complex_colored_unlined", "complex_plain_lined", "complex_plain_unlined")
SOURCES = ("rule", "api", "local_model", "")
REASONS = ("quality_gate_failed", "duplicate_candidate", "structure_validation_failed")
STRUCTURES = ("grouped_columns", "left_headers", "body_rowspan", "mixed_headers", "two_axis_header", "summary_row_colspan", "multi_level_column_header")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def topic_of(k):
    return F.when(k % 3 == 0, "部门预算支出").when(k % 3 == 1, "项目进度跟踪").otherwise("区域网络覆盖")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items numbered within their order."""
    own = Window.partitionBy("l_orderkey")
    return load(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(own.orderBy(*ITEM_ORDER))).withColumn("n", F.count(F.lit(1)).over(own)).withColumnRenamed("l_orderkey", "table_id")


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table an order, a row a cell; one exchange by order, cells exploded from an array of structs.

    Every table gets a title, six headers and six cells an item; some get a legal row span or a defect.
    """
    k, n, i = F.col("table_id"), F.col("n"), F.col("i")

    def cell(ordinal, row, col, rowspan, colspan, tag, role, text):
        lit = lambda x, kind: (x if hasattr(x, "cast") else F.lit(x)).cast(kind)
        return F.struct(*[lit(v, t).alias(a) for v, t, a in ((ordinal, "int", "ordinal"), (row, "int", "row"), (col, "int", "col"), (rowspan, "int", "rowspan"), (colspan, "int", "colspan"), (tag, "string", "tag"), (role, "string", "role"), (text, "string", "text"))])

    title = F.when(k % 23 == 0, "").when(k % 29 == 0, "天气").otherwise(topic_of(k))
    top = [cell(0, 0, 0, 1, COLS, "th", "title", title)]
    top += [cell(1 + c, 1, c, F.when((k % 19 == 0) & (F.lit(c) == 1), 0).otherwise(1), 1, "th", "header", HEADERS[c]) for c in range(COLS)]
    top.append(F.when(k % 13 == 0, cell(1_000_000, 1, 0, 1, 1, "th", "header", HEADERS[0])))
    share = (F.col("l_discount") * 100).cast("decimal(5,1)").cast("string")
    body_text = [
        F.concat(F.when(k % 5 == 0, "P").otherwise("项目"), F.col("l_partkey").cast("string")),
        F.when(k % 31 == 0, "很多").otherwise(F.col("l_quantity").cast("int").cast("string")),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
        F.when(k % 37 == 0, share).otherwise(F.concat(share, F.lit("%"))),
        F.when(F.col("l_linestatus") == "F", "已完成").otherwise("其他"),
        F.when(k % 41 == 0, "").when(k % 43 == 0, "近期").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")),
    ]
    tall = (k % 7 == 0) & (n >= 2)
    last = i == n
    body = [
        F.when(
            ~((F.lit(c) == 0) & tall & (i == 2)) & ~((F.lit(c) == COLS - 1) & (k % 11 == 0) & last),
            cell(7 + 6 * (i - 1) + c, i + 1, c, F.when(tall & (i == 1) & (F.lit(c) == 0), 2).otherwise(1), F.when((k % 17 == 0) & last & (F.lit(c) == COLS - 1), 2).otherwise(1), "td", "body", body_text[c]),
        )
        for c in range(COLS)
    ]
    parts = F.when(i == 1, F.array_compact(F.array(*top, *body))).otherwise(F.array_compact(F.array(*body)))
    return items(spark, sf_dir).select(k, (n + 2).cast("int").alias("rows"), F.lit(COLS).alias("cols"), F.explode(parts).alias("c")).select("table_id", "rows", "cols", "c.*")


def with_plan(cells: DataFrame) -> DataFrame:
    """Adds domain, topic, simple to cells (or tables) by table_id."""
    k = F.col("table_id")
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (k % 3 + 1).cast("int"))
    return cells.withColumn("domain", domain).withColumn("topic", topic_of(k)).withColumn("simple", k % 2 == 0)


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metadata row an order (some twice, some without a file name)."""
    k = F.col("o_orderkey")
    structures = (*STRUCTURES, "simple_single_header", "title_header")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    config = pick(CONFIGS, k)
    rows = load(spark, sf_dir, "orders").select(
        k.alias("table_id"),
        F.when(k % 61 == 0, "").otherwise(F.concat(F.lit("img/"), k.cast("string"), F.lit(".jpg"))).alias("filename"),
        F.concat(F.lit("img/"), k.cast("string"), F.lit(".jpg")).alias("image"),
        config.alias("config_id"),
        pick(structures, k).alias("header_type"),
        config.startswith("simple").alias("simple"),
        config.contains("_colored").alias("colored"),
        config.endswith("_lined").alias("lined"),
        (k % 4 == 0).alias("has_rowspan"),
        (k % 5 == 0).alias("has_colspan"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
    )
    return rows.withColumn("_copy", F.explode(F.when(F.col("table_id") % 59 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumnRenamed("_copy", "line")


def untitled(cells: DataFrame) -> DataFrame:
    """Tables without their title row."""
    return cells.where("role <> 'title'").withColumn("row", F.col("row") - 1).withColumn("rows", F.col("rows") - 1)


def _damage(k, c):
    """Whether a cell is kept, and its fields that change; ``c`` gives its fields by name."""
    body = c("role") == "body"
    changed = {
        "colspan": F.when((k % 3 == 0) & (c("colspan") > 1), c("colspan") - 1).otherwise(c("colspan")),
        "rowspan": F.when(k % 7 == 0, F.lit(1)).otherwise(c("rowspan")),
        "text": F.when((k % 4 == 0) & body & (c("ordinal") == 9), F.concat(c("text"), F.lit("x"))).otherwise(c("text")),
    }
    return ~((k % 5 == 0) & (c("ordinal") == 8)), changed


def predictions(cells: DataFrame) -> DataFrame:
    """A damaged copy of each table: spans shrunk, a cell dropped, a text changed, by table_id."""
    kept, changed = _damage(F.col("table_id"), F.col)
    return cells.where(kept).withColumns(changed)


def predicted_cells(array: str):
    """``predictions`` of the cells in an array of a table's row."""

    def damaged(c):
        for name, value in _damage(F.col("table_id"), lambda n: c[n])[1].items():
            c = c.withField(name, value)
        return c

    return F.transform(F.filter(array, lambda c: _damage(F.col("table_id"), lambda n: c[n])[0]), damaged)


def traces(events: DataFrame) -> DataFrame:
    """Generation events by request: user_id is the request, (ts, event_id) the order."""
    kind = F.col("event_type")
    move = F.element_at(F.array(*map(F.lit, ("copy", "delete", "swap", "alter"))), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select(
        F.col("user_id").alias("request_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(kind == "signup", "schema_attempt").when(kind == "view", "ordinary").when(kind == "click", "transformation").when(kind == "error", "reject").otherwise("select").alias("action"),
        F.when(kind == "click", move).alias("transformation"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("event_id") % len(SOURCES) + 1).cast("int")).alias("source"),
        F.when(kind == "error", F.element_at(F.array(*map(F.lit, REASONS)), (F.col("event_id") % len(REASONS) + 1).cast("int"))).alias("rejection_reason"),
        F.col("value"),
    )


def rounded(x, places: int):
    """A double rounded as C's round does on the product with a power of ten, halves away from zero: Spark's own ``round`` goes by
    the decimal digits that the number shows, so 0.145 (a product of 14.499999999999998) is another number there.
    """
    scaled = F.abs(x) * float(10**places)
    whole = F.floor(scaled).cast("double")
    return F.signum(x) * (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / float(10**places)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """human: the quality label; checker: a score from the length of the document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    score = rounded(F.least(F.lit(1.0), F.col("n_chars") / 5000.0), 2)
    return load(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").cast("double").alias("human"), score.alias("checker"))
