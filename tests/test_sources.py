"""Readers, writers, answers, exports, streams on small files."""

import struct

import pytest
from pyspark.sql import functions as F

from gridmill.functions import answers as A
from gridmill.operators import export as O
from gridmill.operators import layouts as L
from gridmill.operators import routing as R
from gridmill.sources import files, sinks
from gridmill.streaming import traces as V


def test_jsonl_errors_carry_their_line(spark, tmp_path):
    lines = [f'{{"a": {i}, "b": "{"x" * (i % 50)}"}}' for i in range(3000)]
    lines[7], lines[1500], lines[2999], lines[20] = "{broken", "[1]", "nothing", ""
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows, errors = files.read_jsonl(spark, str(tmp_path), "a int, b string")
        assert rows.count() == 2996
        assert sorted((r.line_no, r.line) for r in errors.collect()) == [(8, "{broken"), (1501, "[1]"), (3000, "nothing")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_empty_jsonl_has_no_rows_and_no_errors(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("")
    rows, errors = files.read_jsonl(spark, str(tmp_path), "a int")
    assert rows.count() == 0 and errors.count() == 0


def test_strict_jsonl_fails(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{bad\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl_strict(spark, str(tmp_path), "a int").collect()


def test_ratings_need_their_columns(spark, tmp_path):
    (tmp_path / "r.csv").write_text("sample_id,checker_score\n1,0.5\n")
    with pytest.raises(ValueError, match="human_score"):
        files.read_ratings(spark, str(tmp_path / "r.csv"))
    (tmp_path / "e.csv").write_text("sample_id,checker_score,human_score\n")
    with pytest.raises(ValueError, match="no ratings"):
        files.read_ratings(spark, str(tmp_path / "e.csv"))


def test_image_heads(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 70) + b"\x03"
    (tmp_path / "a.jpg").write_bytes(jpeg)
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 5, 6))
    (tmp_path / "c.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 7, 8))
    (tmp_path / "d.jpg").write_bytes(b"\xff\xd8\xff")
    (tmp_path / "e.jpg").write_bytes(b"")
    got = {r.path[-5:]: (r.ok, r.width, r.height) for r in files.image_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": (True, 70, 30), "b.png": (True, 5, 6), "c.gif": (True, 7, 8), "d.jpg": (False, 0, 0)}
    assert files.list_files(spark, str(tmp_path), "*.jpg").count() == 2


def test_snippets_lie_within_their_line(spark, tmp_path):
    (tmp_path / "c.txt").write_text("ab\nabc\n一二三四五六七八九十甲乙丙丁\n\n")
    got = files.corpus_snippets(spark, str(tmp_path)).collect()
    assert len(got) == 2 and all(r.snippet in r.line and 3 <= len(r.snippet) <= 10 for r in got)


def test_split_and_report_are_written(spark, tmp_path):
    samples = spark.range(10).withColumn("split", F.when(F.col("id") < 2, "test").otherwise("train"))
    assert {(r.split, r.n) for r in sinks.write_split(samples, str(tmp_path / "s")).collect()} == {("test", 2), ("train", 8)}
    assert spark.read.json(str(tmp_path / "s/samples")).count() == 10
    table = spark.createDataFrame([("b|c", 2), (None, 1)], "name string, n int")
    sinks.write_report(table, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r/markdown")).collect()] == ["| name | n |", "|---|---|", "|  | 1 |", "| b\\|c | 2 |"]
    sinks.append_trace(samples, str(tmp_path / "t"))
    sinks.append_trace(samples, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 20


def test_texts_pair_with_openers_from_the_right(spark):
    rows = [(["<tr>", "<td>", "</td>", "<td", ">", "</td>", "</tr>"], ["<b>x</b> ", "y"], "<table><tr><td>x</td><td>y</td></tr></table>"), (["<td>", "</td>", "<td>", "</td>"], ["z"], "<table><td></td><td>z</td></table>"), (["<td>", "</td>"], ["lost", "k"], "<table><td>k</td></table>"), (["<br>"], ["k"], "<table><br></table>"), ([], [], "")]
    df = spark.createDataFrame(rows, "t array<string>, x array<string>, want string").select("want", O.markup(F.col("t"), F.col("x")).alias("got"))
    assert [r.got for r in df.collect()] == [r[2] for r in rows]


def test_targets(spark):
    df = spark.createDataFrame([("", "[1]"), ("<p>", "[2]"), (None, "[3]")], "h string, c string")
    take = lambda kind: [r.t for r in df.select(O.target_text(kind, F.col("h"), F.col("c"), F.lit("{}")).alias("t")).collect()]
    assert take("html") == ["[1]", "<p>", "[3]"] and take("cells") == ["[1]", "[2]", "[3]"]
    assert take("json")[1] == '{"meta":{},"cells":[2],"html":"<p>"}'
    with pytest.raises(ValueError, match="unknown target"):
        O.target_text("xml", F.col("h"), F.col("c"), F.lit("{}"))


def test_characters(spark):
    df = spark.createDataFrame([("ab",), ("",), (None,)], "t string").select(O.characters(F.col("t")).alias("c"))
    assert [r.c for r in df.collect()] == [["a", "b"], [], []]


def test_answers(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert one('Here:\n```json\n{"a": 1}\n```', A.json_in) == '{"a": 1}'
    assert one('so {"a": [1]} it is', A.json_in) == '{"a": [1]}'
    assert one("none", A.json_in) is None and one(None, A.json_in) is None
    assert one('```json\n{"a": 1}\n```', A.json_object) == '{"a": 1}'
    assert one('{"cells": 1}', lambda c: A.json_object(c, ("cells",))) is None and one("[1]", A.json_object) is None
    assert one('[" a ", "", "b"]', A.text_list) == ["a", "b"]
    assert one('["a"]', lambda c: A.text_list(c, F.lit(2))) is None
    assert one('{"1,2": "x", "3:4": " y "}', A.text_mapping) == {"1,2": "x", "3,4": "y"}
    assert one('{"1,2": ""}', A.text_mapping) is None and one('{"a": "x"}', A.text_mapping) is None
    assert one('{"1,2": "x", "1:2": "y"}', A.text_mapping) is None
    assert [one(t, A.unit_score) for t in ("1.5", "-2", "0.25", "x", "NaN", None)] == [1.0, 0.0, 0.25, None, None, None]


def test_values_fit_their_column(spark):
    rows = [("percent", "率", "12,5", "125%"), ("percent", "率", "8%", "8%"), ("numeric", "数", "3台", "3"), ("text", "备", " x ", "x")]
    df = spark.createDataFrame(rows, "k string, h string, v string, want string").select("want", L.normalized_value(F.col("k"), F.col("h"), F.col("v"), F.lit(5).cast("long")).alias("got"))
    assert all(r.want == r.got for r in df.collect())
    assert spark.range(1).select(L.merged(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"), F.lit("a"))).alias("m")).first().m == ["c", "a", "b"]


def test_unsupported_structures_have_no_cells(spark):
    asked = spark.createDataFrame([(1, "multi_level_column_header", False), (2, "spiral", False), (3, None, True)], "table_id long, structure string, simple boolean")
    plans = L.chosen_layout(asked.selectExpr("*", "4 AS rows", "3 AS cols"), "s")
    assert {r.table_id: r.layout_error is None for r in plans.collect()} == {1: False, 2: False, 3: True}
    assert {r.table_id for r in L.layout_cells(plans, "s").collect()} == {3}


def test_back_ends_are_known_by_name():
    b = R.Backends()
    b.register("a", (), lambda df: F.lit(None))
    with pytest.raises(ValueError, match="twice"):
        b.register("a", (), lambda df: F.lit(None))
    with pytest.raises(KeyError):
        b.supports("z", "x")


def steps(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", F.col("event_type").alias("action"), "value")


def test_stream_rolls_up_as_the_batch(spark, tmp_path):
    source = steps(spark)
    source.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    end = source.agg(F.max("ts")).first()[0]
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        V.run_rollup(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in V.windowed(source).collect()}
    assert got <= want and len(got) == len(spark.read.parquet(str(tmp_path / "out")).collect())
    closed = {w for w in want if (end.replace(tzinfo=None) - w[0].replace(tzinfo=None)).total_seconds() > 4 * 3600}
    assert closed and closed <= got


def test_memory_takes_new_entries_once(spark, tmp_path):
    first = spark.createDataFrame([("topics", "a", 1), ("topics", "a", 2), ("topics", " ", 3), ("topics", None, 4), ("failure_reasons", "f", 5)], "category string, value string, seq long")
    second = spark.createDataFrame([("topics", "a", 6), ("topics", "b", 7), ("failure_reasons", "f", 8)], first.schema)
    for k, batch in enumerate((first, second, second)):
        V.remember(batch, min(k, 1), str(tmp_path / "m"), "seq")
    got = sorted((r.category, r.value, r.seq) for r in spark.read.parquet(str(tmp_path / "m")).collect())
    assert got == [("failure_reasons", "f", 5), ("failure_reasons", "f", 8), ("topics", "a", 1), ("topics", "b", 7)]
