"""Registered queries against their oracles on the smallest data, and small literal cases."""

import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from gridmill.functions import text as T
from gridmill.operators import structure as G
from gridmill.plans import registry
from gridmill.sources.html import parse

SMALL = "/root/testdata/sf0.001"
FAST = ["validate_tables", "table_facts", "structure_signature", "fallback_grid", "build_html", "cell_scores", "batch_report", "missing_rows", "export_split", "box_issues", "message_classes", "trace_summary", "over_budget", "correlations", "gen_requests", "layout_cells", "body_values", "fallback_templates", "token_html", "routed_values", "attempts_needed", "image_issues", "trace_windows"]


def same(value):
    return None if value is None or value != value else round(float(value), 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1].split('.')[0]} AS SELECT * FROM '{path}'")
    got = registry.queries()[name](spark, SMALL)
    names = sorted(got.columns)
    want = con.sql(registry.oracle_sql()[name]).select(*[duckdb.ColumnExpression(n) for n in names]).fetchall()
    rows = [tuple(same(float(x) if x.__class__.__name__ == "Decimal" else x) for x in r) for r in got.select(*[f"`{n}`" for n in names]).collect()]
    assert sorted(rows, key=str) == sorted((tuple(same(float(x) if x.__class__.__name__ == "Decimal" else x) for x in r) for r in want), key=str)


def cells(spark, rows, n_rows, n_cols):
    kind = "table_id int, rows int, cols int, ordinal int, row int, col int, rowspan int, colspan int, tag string, role string, text string"
    return spark.createDataFrame([(1, n_rows, n_cols, i, *r, "td", "body", "x") for i, r in enumerate(rows)], kind)


def test_out_of_range_and_overlap(spark):
    assert [r.code for r in G.validate(cells(spark, [(0, 0, 1, 3)], 2, 2)).collect()] == ["out_of_range"]
    assert [r.code for r in G.validate(cells(spark, [(0, 0, 1, 2), (0, 1, 1, 1)], 2, 2)).collect()] == ["overlap"]


def test_html_spans_flow():
    assert parse("<table><tr><th colspan='2'>A</th></tr><tr><td>B</td><td>C</td></tr></table>")[0] == [(0, 0, 1, 2, "th", "A"), (1, 0, 1, 1, "td", "B"), (1, 1, 1, 1, "td", "C")]
    assert parse(None)[0] == []


def test_numbers_and_locations(spark):
    rows = [("1,234.5%", True), ("12台", True), ("很多", False), ("-3.", True), (None, False)]
    df = spark.createDataFrame(rows, "t string, want boolean").select("want", T.numeric_like(F.col("t")).alias("got"))
    assert all(r.want == r.got for r in df.collect())
    at = spark.createDataFrame([("bad value at (3, 2) and (4, 5)",)], "m string").select(T.issue_location(F.col("m")).alias("l")).first().l
    assert (at.row, at.col) == (3, 2)
