"""The registered queries over the derived table corpora, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import text as T
from gridmill.operators import analysis as A
from gridmill.operators import evaluation as E
from gridmill.operators import export as O
from gridmill.operators import generation as N
from gridmill.operators import layouts as L
from gridmill.operators import routing as R
from gridmill.operators import scoring as S
from gridmill.operators import structure as G
from gridmill.sources import fixtures as X
from gridmill.sources.html import parse_tables
from gridmill.streaming import traces as V

from . import oracle, oracle_made

Query = Callable[[SparkSession, str], DataFrame]
SHOWN = ["table_id", "rows", "ordinal", "row", "col", "rowspan", "colspan", "text"]


def on_cells(f) -> Query:
    return lambda spark, d: f(X.grid_cells(spark, d))


def on_valid(f) -> Query:
    return lambda spark, d: f(G.valid_cells(X.grid_cells(spark, d)))


def on_planned(f) -> Query:
    return lambda spark, d: f(X.with_plan(X.grid_cells(spark, d)))


def last_region(cells: DataFrame) -> DataFrame:
    ends = G.safe_regions(cells).groupBy("table_id").agg(F.max(F.struct("start", "size")).alias("l"))
    return ends.select("table_id", "l.start", "l.size")


def end_regions(cells: DataFrame) -> DataFrame:
    ends = G.safe_regions(cells).groupBy("table_id").agg(F.min(F.struct("start", "size")).alias("f"), F.max(F.struct("start", "size")).alias("l"))
    return ends.where("f.start < l.start").select("table_id", "f.start", "f.size", F.col("l.start").alias("start2"), F.col("l.size").alias("size2"))


def swap_first_body(cells: DataFrame) -> DataFrame:
    pairs = cells.select("table_id").distinct().select("table_id", F.lit(8).alias("a"), F.lit(9).alias("b"))
    return G.swap_cells(cells, pairs).select("table_id", "ordinal", "text")


def policies(cells: DataFrame) -> DataFrame:
    return S.policy(S.table_scores(cells), G.validity(cells))


def one_meta(spark: SparkSession, d: str) -> DataFrame:
    return X.meta(spark, d).where("line = 0")


def perturbed(spark: SparkSession, d: str) -> DataFrame:
    named = one_meta(spark, d).select("table_id", "header_type", F.col("simple").alias("with_content"))
    return E.perturb(G.valid_cells(X.grid_cells(spark, d)).join(named, "table_id")).select("table_id", "ordinal", "colspan", "rowspan")


def files(spark: SparkSession, d: str) -> DataFrame:
    return X.load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("img/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file"))


def missing(spark: SparkSession, d: str) -> DataFrame:
    m = files(spark, d)
    return E.missing_rows(meta=m, cells=m.where("k % 47 <> 0"), gt=m.where("k % 53 <> 0"))


def export_join(spark: SparkSession, d: str) -> DataFrame:
    m = files(spark, d)
    gt = m.where("k % 53 <> 0").select("file", F.lit(True).alias("_gt"))
    return m.select("file").join(m.where("k % 47 <> 0").select("file"), "file").join(gt, "file", "left").select("file", F.coalesce("_gt", F.lit(False)).alias("has_gt"))


def split(spark: SparkSession, d: str) -> DataFrame:
    return E.split_of(X.load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2, 0.1, "7")


def boxes(cells: DataFrame) -> DataFrame:
    x, y, x2, y2 = (F.col("col") * 80.0, F.col("row") * 24.0, (F.col("col") + F.col("colspan")) * 80.0, (F.col("row") + F.col("rowspan")) * 24.0)
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    poly = F.array(point(x, y), point(x2, y), point(x2, y2), point(x, y2))
    return cells.select("table_id", "ordinal", E.area(poly).alias("area"), E.box_issue(poly, F.lit(480.0), F.col("rows") * 24.0).alias("issue"))


def roles(cells: DataFrame) -> DataFrame:
    kind = F.when(F.col("table_id") % 2 == 0, "two_axis_header").otherwise("left_headers")
    return cells.select("role", T.annotated_role(F.col("role"), kind, F.col("row"), F.col("col")).alias("row_role")).groupBy("role", "row_role").agg(F.count(F.lit(1)).alias("n"))


def pool(spark: SparkSession, d: str) -> DataFrame:
    docs = X.load(spark, d, "documents").select("doc_id", "source", T.normalized(F.col("text")).alias("t"))
    return S.first_of_signature(docs, "source", "t", "doc_id").select("doc_id", "source", "duplicate")


def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    items = X.load(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("other"))
    return items.join(after, "item_id").select("item_id", F.round(T.jaccard(F.col("t"), F.col("other")), 6).alias("overlap"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    s = lambda c: c.cast("string")
    texts = [
        F.lit("Invalid table schema: row 2"),
        F.concat(F.lit("empty header cell at ("), s(u % 7), F.lit(", "), s(e % 5), F.lit(")")),
        F.lit("non-numeric value at (3, 2)"),
        F.lit("warning: header duplication"),
        F.lit("WebDriver lost"),
        F.lit("topic differs (a, b)"),
        F.lit("budget exhausted"),
        F.lit("empty body cell at (1,2,3)"),
        F.concat(F.lit("text does not match header ("), s(e), F.lit(",1) twice (9, 9)")),
    ]
    m = X.load(spark, d, "events").withColumn("message", F.element_at(F.array(*texts), (u % 9 + 1).cast("int")))
    at = T.issue_location(F.col("message"))
    return m.select("event_id", T.error_class(F.col("message")).alias("error_class"), T.issue_code(F.col("message")).alias("code"), at["row"].alias("loc_row"), at["col"].alias("loc_col"))


def steps(spark: SparkSession, d: str) -> DataFrame:
    return X.traces(X.load(spark, d, "events"))


def round_trip(cells: DataFrame) -> DataFrame:
    return parse_tables(G.build_html(cells), "table_id", "html").select("table_id", "row", "col", "rowspan", "colspan", "tag", "text")


def planned(spark: SparkSession, d: str) -> DataFrame:
    """A plan an order: every structure, none, and simple tables in turn."""
    k = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, (*X.STRUCTURES, None)))
    asked = X.load(spark, d, "orders").select(k.alias("table_id"), F.element_at(kinds, (k % 8 + 1).cast("int")).alias("structure"), (k % 9 == 0).alias("simple"))
    return L.chosen_layout(L.plan_shapes(asked, "p", (3, 9), (2, 9)), "p")


def generated(spark: SparkSession, d: str) -> DataFrame:
    return L.with_body(L.with_headers(X.with_plan(L.layout_cells(planned(spark, d), "p"))), "p")


def token_html(cells: DataFrame) -> DataFrame:
    return O.token_cells(cells).select("table_id", O.markup(F.col("tokens"), F.col("texts")).alias("html"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    held = token_html(G.valid_cells(X.grid_cells(spark, d)))
    m = one_meta(spark, d).select("table_id", "image").join(held, "table_id")
    out = O.chat_samples(m, "Read the table.", O.target_text("html", F.col("html"), F.lit("[]"), F.lit("{}")), F.col("image"))
    return out.select("table_id", F.col("messages")[0]["content"].alias("ask"), F.col("messages")[1]["content"].alias("answer"), F.col("images")[0].alias("image"))


def clip_frames(cells: DataFrame) -> DataFrame:
    b = cells.select("table_id", "ordinal", (F.col("col") * 80 + 30).alias("x1"), (F.col("row") * 24 + 40).alias("y1"), ((F.col("col") + F.col("colspan")) * 80 + 30).alias("x2"), ((F.col("row") + F.col("rowspan")) * 24 + 40).alias("y2"))
    return O.clipped(b, "table_id", 5)


def routed(spark: SparkSession, d: str) -> DataFrame:
    result = lambda ok, name: F.struct(ok.alias("ok"), F.concat(F.lit(name), F.col("event_id").cast("string")).alias("value"), F.when(~ok, "no answer").alias("reason"))
    b = R.Backends()
    b.register("model", ("body_generation",), lambda df: result(F.col("event_id") % 3 == 0, "m"))
    b.register("judge", ("semantic_judging",), lambda df: result(F.lit(True), "j"))
    b.register("rule", ("body_generation",), lambda df: result(F.col("event_id") % 7 != 0, "r"))
    told = b.route(X.load(spark, d, "events").select("event_id"), "body_generation", "model", "judge", "rule")
    return told.select("event_id", "value", "backend", "status", F.size("attempts").alias("attempts"))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    e = X.load(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 3 != 0).alias("ok"))
    return R.attempts_needed(e, "user_id", "event_id", 4, 12)


def images(spark: SparkSession, d: str) -> DataFrame:
    m = files(spark, d)
    cells = m.select("file", F.explode(F.sequence(F.lit(1), F.col("k") % 3 + 1)).alias("i"))
    sizes = m.where("k % 47 <> 0").select("file", (F.col("k") % 11 != 0).alias("ok"), F.when(F.col("k") % 5 == 0, 0).otherwise(480).alias("width"), F.lit(240).alias("height"))
    return O.image_issues(cells, sizes)


def declared(spark: SparkSession, d: str) -> DataFrame:
    cells = X.grid_cells(spark, d)
    n = cells.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))
    return O.count_mismatches(n.select("table_id", F.when(F.col("table_id") % 4 != 0, F.col("n") + F.col("table_id") % 3).alias("declared")), cells)


QUERIES: dict[str, Query] = {
    "validate_tables": on_cells(G.validate),
    "table_validity": on_cells(G.validity),
    "row_coverage": on_cells(G.row_coverage),
    "occupied_slots": on_cells(lambda c: G.slots(c).groupBy("table_id").agg(F.count(F.lit(1)).alias("slots"))),
    "table_facts": on_cells(G.table_facts),
    "structure_signature": on_cells(G.signature),
    "safe_regions": on_valid(G.safe_regions),
    "copy_region": on_valid(lambda c: G.copy_region(c, last_region(c)).select(SHOWN)),
    "delete_region": on_valid(lambda c: G.delete_region(c, last_region(c)).select(SHOWN)),
    "swap_regions": on_valid(lambda c: G.swap_regions(c, end_regions(c)).select(SHOWN)),
    "swap_cells": on_valid(swap_first_body),
    "alter_background": on_valid(lambda c: G.alter_background(c, last_region(c), "#eee").select("table_id", "ordinal", F.col("visual")["background-color"].alias("background"))),
    "augment": on_valid(lambda c: G.augment(c).select("transformation", *SHOWN)),
    "fallback_grid": on_cells(lambda c: G.fallback(c).select("table_id", "ordinal", "row", "col", "colspan", "role", "text", "source")),
    "structure_tokens": on_cells(G.structure_tokens),
    "build_html": on_cells(G.build_html),
    "parse_html": on_valid(round_trip),
    "annotated_roles": on_cells(roles),
    "cell_scores": on_cells(S.cell_scores),
    "effective_headers": on_cells(S.effective_headers),
    "table_scores": on_planned(S.table_scores),
    "score_policy": on_planned(policies),
    "select_best": on_planned(lambda c: S.select_best(policies(c).withColumn("request", F.col("table_id") % 100), "request", "table_id")),
    "repair_action": on_planned(lambda c: S.repair_action(S.table_scores(c, told=True), c)),
    "low_dimensions": on_planned(lambda c: S.low_dimensions(S.table_scores(c))),
    "structure_scores": on_valid(lambda c: E.structure_scores(c, X.predictions(c))),
    "text_accuracy": on_valid(lambda c: E.text_accuracy(c, X.predictions(c))),
    "perturbed": perturbed,
    "batch_report": lambda s, d: E.batch_report(X.meta(s, d)),
    "duplicate_files": lambda s, d: E.duplicate_files(X.meta(s, d)),
    "meta_by_file": lambda s, d: E.keyed(X.meta(s, d)).select("file", "config_id", "line"),
    "missing_rows": missing,
    "export_join": export_join,
    "export_split": split,
    "split_manifest": lambda s, d: split(s, d).groupBy("split").agg(F.count(F.lit(1)).alias("n")),
    "box_issues": on_cells(boxes),
    "pool_duplicates": pool,
    "token_overlap": token_overlap,
    "message_classes": messages,
    "trace_summary": lambda s, d: A.trace_summary(steps(s, d)),
    "trace_counters": lambda s, d: A.counters(steps(s, d)),
    "over_budget": lambda s, d: A.over_budget(steps(s, d), {"model_calls": 5, "schema_attempts": 1, "filling_attempts": -1, "candidates": 3, "elapsed_seconds": 150}),
    "correlations": lambda s, d: A.correlations(X.ratings(s, d), "human", "checker"),
    "average_ranks": lambda s, d: A.average_ranks(X.ratings(s, d), "checker", "rank").select("doc_id", "rank"),
    "bounded_history": lambda s, d: A.last_entries(X.load(s, d, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn"),
    "preferences": lambda s, d: A.latest_values(X.load(s, d, "conversations"), ["conv_id", "role"], "text", "turn"),
    "gen_requests": lambda s, d: N.requests(s, 1000),
    "plan_shapes": lambda s, d: planned(s, d).select("table_id", "rows", "cols", "layout", F.coalesce("layout_error", F.lit("")).alias("layout_error")),
    "layout_cells": lambda s, d: L.layout_cells(planned(s, d), "p"),
    "header_texts": lambda s, d: L.with_headers(X.with_plan(L.layout_cells(planned(s, d), "p"))).where("role <> 'body'").select("table_id", "ordinal", "text"),
    "body_values": lambda s, d: generated(s, d).select("table_id", "ordinal", "text"),
    "generated_validity": lambda s, d: G.validate(generated(s, d)),
    "fallback_templates": lambda s, d: N.fallback_templates(s, 1000).select("id", "domain", "scenario", "topic", F.array_join("headers", ",").alias("headers")),
    "ablation_requests": lambda s, d: N.ablation_requests(s, 200),
    "token_html": on_cells(token_html),
    "chat_samples": samples,
    "clip_frames": on_cells(clip_frames),
    "routed_values": routed,
    "attempts_needed": attempts,
    "image_issues": images,
    "count_mismatches": declared,
    "trace_windows": lambda s, d: V.windowed(steps(s, d)),
}


def queries() -> dict[str, Query]:
    from . import more

    return QUERIES | more.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import oracle_more

    known = queries()
    return {k: v for k, v in (oracle.ORACLE | oracle_made.ORACLE | oracle_more.ORACLE).items() if k in known}
