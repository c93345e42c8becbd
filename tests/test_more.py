"""Readers, scores, regions, ranks, splits and the generation loop against literal cases and plain replays."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.operators import analysis, evaluation, generation, layouts, legacy, loop, routing, scoring, structure
from gridmill.plans import more
from gridmill.sources import fixtures, html

CELL = "table_id long, rows int, cols int, ordinal int, row int, col int, rowspan int, colspan int, tag string, role string, text string"


def cells(spark, rows, size=(3, 2), table=1):
    return spark.createDataFrame([(table, *size, i, *r) for i, r in enumerate(rows)], CELL)


def head(c, text):
    return (1, c, 1, 1, "th", "header", text)


TITLE = (0, 0, 1, 2, "th", "title", "部门预算支出")


def test_html_reader_keeps_to_its_rules():
    place = lambda text, **k: html.parse(text, **k)
    got, n_rows, n_cols, errors = place("<table><tr><td rowspan='+3'>a</th>b</td><th>c</th></tr><tr><td colspan='²'>d</td></tr></table>")
    assert [c[:4] for c in got] == [(0, 0, 3, 1), (0, 1, 1, 1), (1, 1, 1, 1)] and got[0][5] == "ab"
    assert (n_rows, n_cols) == (3, 2) and errors == [("uncovered", 2, 0, 1), ("expanded", 2, 3, 1)]
    got, n_rows, _, errors = place(f"<table><tr><td rowspan='{10**30}'>a</td></tr><tr><td>b</td></tr></table>")
    assert n_rows == html.MOST and errors[0] == ("uncovered", 0, 0, 1) and errors[1][0] == "uncovered" and errors[1][3] == html.MOST - 2
    got, _, _, errors = place("<table><tr><td>a</td><td rowspan=2>b</td></tr><tr><td colspan=2>c</td></tr></table>")
    assert got[2][:4] == (1, 0, 1, 2) and errors[0] == ("overlap", 1, 0, 1)
    text = "<table><tr><td>a</td></tr><tr><td>b</td></tr></table>"
    assert [c[5] for c in place(text)[0]] == ["a", "b"] and [(c[0], c[5]) for c in place(text, first_row_lost=True)[0]] == [(0, "b")]
    assert place(None)[0] == [] and place("<td>x</td>")[0] == [] and place("<table><tr><td>a<td>b</td></tr>")[0][0][5] == "b"


def test_warnings_are_no_errors(spark):
    body = [(2, 0, 1, 1, "td", "body", "研发部"), (2, 1, 1, 1, "td", "body", "100")]
    odd = [(2, 0, 1, 1, "td", "body", "xyz"), (2, 1, 1, 1, "td", "body", "100")]
    bad = [(2, 0, 1, 1, "td", "body", "研发部"), (2, 1, 1, 1, "td", "body", "many")]
    made = None
    for k, b in enumerate((body, odd, bad)):
        one = cells(spark, [TITLE, head(0, "部门"), head(1, "预算"), *b], table=k)
        made = one if made is None else made.unionByName(one)
    planned = made.withColumns({"domain": F.lit("finance"), "topic": F.lit("部门预算支出"), "simple": F.lit(False)})
    got = {r.table_id: r for r in scoring.table_scores(planned).collect()}
    assert [got[k].errors for k in range(3)] == [0, 0, 1] and got[0].ok and got[1].ok and not got[2].ok
    assert got[0].title_score == 1 and got[0].body_score == 0.975 and got[1].body_score == 0.85 and got[2].body_score == 0.475
    passed = {r.table_id: r.passed for r in scoring.policy(scoring.table_scores(planned), structure.validity(planned)).collect()}
    assert passed == {0: True, 1: True, 2: False}
    told = {(r.table_id, r.severity, r.message) for r in scoring.messages(planned).collect()}
    assert (1, "warning", "body cell at (2, 0) looks generic for header '部门'") in told and (2, "error", "numeric-like column has non-numeric value at (2, 1)") in told
    pool = spark.createDataFrame([(1, 5, 0.9, 0.8, True, True), (1, 6, 0.7, 0.7, True, False), (1, 7, 0.95, 0.9, False, False)], "request long, table_id long, ranking double, overall double, passed boolean, duplicate boolean")
    assert [r.table_id for r in scoring.select_best(pool, "request", "table_id").collect()] == [6]


def test_regions_of_columns_and_their_errors(spark):
    rows = [head(0, "a"), head(1, "b"), (0, 0, 1, 2, "th", "header", "t"), (2, 0, 1, 1, "td", "body", "x"), (2, 1, 1, 1, "td", "body", "y")]
    t = cells(spark, rows)
    asked = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 5), (1, 0, 0)], "table_id long, start int, size int")
    got = {(r.start, r.size): r.error for r in structure.region_errors(t, asked, "column", "delete").collect()}
    assert got == {(0, 1): "column region [0, 1) splits a spanning cell", (0, 2): "cannot delete the entire table", (1, 5): "column region [1, 6) is out of range", (0, 0): "region count must be positive"}
    with pytest.raises(ValueError):
        structure.safe_regions(t, "diagonal")


def test_augmented_swaps_cells_where_no_blocks_fit(spark):
    t = cells(spark, [TITLE, head(0, "a"), head(1, "b"), (2, 0, 1, 1, "td", "body", "x"), (2, 1, 1, 1, "td", "body", "y")]).withColumn("visual", F.create_map(F.lit("k"), F.col("text")))
    made = {r.transformation: r for r in structure.augmented(t).collect()}
    assert set(made) == {"copy", "delete", "swap", "alter"} and made["swap"]["axis"] == "cell_block"
    assert [(c["text"], c["visual"][0]["value"]) for c in made["swap"]["cells"][3:]] == [("y", "y"), ("x", "x")]
    assert {e["key"]: e["value"] for e in made["alter"]["cells"][4]["visual"]} == {"k": "y", "background-color": structure.COLOR}
    assert made["copy"]["rows"] == 4 and len(made["copy"]["cells"]) == 7 and made["copy"]["__sound"]
    assert structure.augmented(t, 0).count() == 0


def test_content_signature_ignores_order_and_case(spark):
    rows = [head(0, "A  b"), head(1, "c")]
    one = structure.content_signature(cells(spark, rows).withColumn("header_type", F.lit("x"))).first().signature
    two = structure.content_signature(cells(spark, [rows[1], (*rows[0][:6], " a B ")]).withColumn("header_type", F.lit("x"))).first().signature
    import hashlib
    import json

    want = {"rows": 3, "cols": 2, "header_type": "x", "cells": [{"row": 1, "col": c, "rowspan": 1, "colspan": 1, "role": "header", "tag": "th", "text": t, "visual": {}} for c, t in enumerate(("a b", "c"))]}
    assert one == two == hashlib.sha256(json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@pytest.mark.parametrize("kinds", [(5, 7), (1000, 1000), (2, 1000), (1, 3)])
def test_kendall_is_exact(spark, kinds):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, kinds[0], 500).astype(float), rng.integers(0, kinds[1], 500).astype(float)
    y[:200] = x[:200]
    s = np.sign(x[:, None] - x[None]) * np.sign(y[:, None] - y[None])
    a, b = (np.sign(v[:, None] - v[None]) != 0 for v in (x, y))
    base = np.sqrt(a.sum() * float(b.sum()))
    want = s.sum() / base if base else 0.0
    got = analysis.kendall(spark.createDataFrame([*zip(x.tolist(), y.tolist(), strict=True)], "x double, y double"), "x", "y").first().kendall
    assert abs(got - want) < 1e-6


def test_average_ranks_of_many_ties(spark):
    v = [float(k % 300) for k in range(900)] + [7.0] * 500 + [None]
    got = {r.v: r.rank for r in analysis.average_ranks(spark.createDataFrame([(x,) for x in v], "v double"), "v", "rank").distinct().collect()}
    there = sorted(x for x in v if x is not None)
    assert got == {x: (there.index(x) + 1 + there.index(x) + there.count(x)) / 2 for x in set(there)}


def test_split_sizes_and_ratios(spark):
    n = spark.range(997).withColumnRenamed("id", "k")
    got = {r.split: r["count"] for r in evaluation.split_of(n, "k", 0.2, 0.1, "s").groupBy("split").count().collect()}
    assert got == {"test": 99, "val": 199, "train": 699}
    with pytest.raises(ValueError):
        evaluation.split_of(n, "k", 0.6, 0.4, "s")
    assert evaluation.attempt_limits(None, 5, None, True) == (5, 15) and evaluation.attempt_limits(4, 5, 9, False) == (4, 9)


def test_boxes_that_are_no_numbers(spark):
    boxes = [[["0", "0"], ["4", "0"], ["4", "4"], ["0", "4"]], [["0", "0"], ["nan", "0"], ["4", "4"], ["0", "4"]], [["0", "0"], ["4", "0"], ["4"], ["0", "4"]], [["0", "0"], ["9", "0"], ["9", "4"], ["0", "4"]]]
    p = spark.createDataFrame([(i, b) for i, b in enumerate(boxes)], "i int, b array<array<string>>").withColumn("p", evaluation.box_points(F.col("b")))
    got = p.select("i", evaluation.box_message(F.col("p"), F.lit(5), F.lit(5)).alias("m"), evaluation.first_outside(F.col("p"), F.lit(5), F.lit(5)).alias("o")).orderBy("i").collect()
    wrong = "bbox must be a polygon with numeric points"
    assert [r.m for r in got] == [None, wrong, wrong, "bbox point out of image bounds (5x5)"] and got[3].o == (9.0, 0.0)


def test_loop_is_what_a_step_by_step_run_gives(spark):
    k = F.col("table_id")
    asked = spark.range(60).select(F.col("id").alias("table_id"), F.lit(None).cast("string").alias("structure"), (F.col("id") % 9 == 0).alias("simple"))
    plans = fixtures.with_plan(layouts.plan_shapes(asked, "p", (3, 6), (2, 5)).drop("error").withColumnRenamed("simple", "own")).withColumn("simple", F.col("own")).drop("own")
    fault = lambda text, key, ordinal: F.when(layouts.draw("fault", key, ordinal) % 4 == 0, "").otherwise(text)
    steps = loop.candidate_steps(plans, "g", layouts.chosen_layout, 2, 2, None, fault).collect()
    by = defaultdict(dict)
    for s in steps:
        by[s.request][s.schema, s.candidate] = s
    want = {}
    for request, own in by.items():
        pool = {}
        for schema in (1, 2):
            for candidate in (1, 2):
                s = own.get((schema, candidate))
                if s is None:
                    continue
                if s.ends:
                    break
                if s.passed and s.signature not in {x.signature for x in pool.values()}:
                    pool[candidate] = s
            if pool:
                break
        if pool:
            best = min(pool, key=lambda c: (-pool[c].ranking, -pool[c].overall, c))
            want[request] = (pool[best].schema, best, len(pool))
    got = {r.request: r for r in loop.generation_loop(plans, "g", layouts.chosen_layout, 2, 2, 0, None, fault).collect()}
    assert len(got) == 60 and {r: (x.schema, x.candidate, x.pool) for r, x in got.items() if x.outcome == "success"} == want
    assert 5 < len(want) < 60 and k is not None


def test_requests_with_a_structure_of_their_own(spark):
    got = generation.requests(spark, 16, "left_headers").collect()
    assert all((r.structure == "left_headers") == (r.error is None) for r in got) and sum(r.error is not None for r in got) == 8
    assert legacy.spans("s", "w", F.lit(1)) is not None and len(more.QUERIES) > 40


def test_model_calls_in_batches_and_their_failures(spark):
    def make():
        import time

        def answer(questions):
            if "late" in questions:
                time.sleep(5)
            if "bad" in questions:
                raise KeyError("bad")
            return [None if q == "none" else q.upper() for q in questions]

        return answer

    asked = spark.createDataFrame([(0, "a"), (1, "none"), (2, None), (3, "bad"), (4, "late")], "i int, q string").repartition(1).sortWithinPartitions("i")
    got = {r.i: tuple(r.r) for r in asked.withColumn("r", routing.model_call(make, F.col("q"), 1, 1.0)).collect()}
    assert got == {0: (True, "A", None), 1: (True, None, None), 2: (False, None, "no question"), 3: (False, None, "KeyError: 'bad'"), 4: (False, None, "timeout")}
    ends = routing.Backends()
    give = lambda ok, value: lambda df: F.struct(F.lit(ok).alias("ok"), F.lit(value).cast("string").alias("value"), F.lit(None).cast("string").alias("reason"))
    ends.register("plain", ("x",), give(True, None), plain=True)
    ends.register("strict", ("x",), give(True, None))
    ends.register("last", ("x",), give(True, "v"))
    r = ends.route(spark.range(1), "x", "plain", "strict", "last").first()
    assert (r.value, r.backend, r.status, [a.status for a in r.attempts]) == ("v", "last", "fallback", ["success", "failed", "success"])
