"""What a review found, each on small tables."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.llm import context_mixing, neardup
from gridmill.operators import export as O
from gridmill.operators import layouts, loop, structure
from gridmill.plans import registry
from gridmill.sources import fixtures, html


@pytest.mark.parametrize("name", ["average_ranks", "correlations"])
def test_ratings_round_as_the_sql_does(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT i AS doc_id, 25 * i + 0 AS n_chars FROM range(260) t(i)")
    con.execute("CREATE TABLE labels AS SELECT doc_id, (doc_id * 7 % 3 = 0)::INT AS quality, 0 AS toxic FROM documents")
    for table in ("documents", "labels"):
        con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    names = sorted(got.columns)
    want = con.sql(registry.oracle_sql()[name]).select(*[duckdb.ColumnExpression(n) for n in names]).fetchall()
    assert sorted(tuple(round(float(x), 6) for x in r) for r in got.select(*names).collect()) == sorted(tuple(round(float(x), 6) for x in r) for r in want)


def test_markup_of_a_large_table_is_linear(spark):
    n = 4000
    held = spark.range(1).select(F.flatten(F.array_repeat(F.array(F.lit("<td>"), F.lit("</td>")), n)).alias("tokens"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")).alias("texts"))
    began = time.time()
    got = held.select(O.markup(F.col("tokens"), F.col("texts")).alias("m"), O.rebuilt(F.col("tokens"), F.transform("texts", O.characters), "plain").alias("p")).first()
    assert time.time() - began < 15
    plain = "".join(f"<td>{i}</td>" for i in range(1, n + 1))
    assert (got.m, got.p) == (f"<table>{plain}</table>", plain)



@pytest.mark.parametrize("name", ["issue_messages", "error_texts", "repair_decision", "eval_overall", "eval_groups", "chat_samples", "variant_lineage", "scoped_repair"])
def test_line_items_are_read_once_a_corpus(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("l_orderkey" in line and line.strip(" :+-").startswith("Relation") for line in plan.splitlines()) <= (2 if name.startswith("eval") or name == "scoped_repair" else 1)


def test_legacy_pages_broadcast_no_styles(spark):
    plan = registry.queries()["legacy_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_lm_weights_are_fitted_on_all_training_rows():
    words = [b"a", b"b"]
    hashes = context_mixing.word_hashes(words)
    order = np.argsort(hashes)
    model = context_mixing.Model(hashes[order], np.array([40, 40]), 80, 80, np.ones(256, np.int64), 14)
    n, pack = 40, context_mixing.shrunk
    ids = np.stack([np.ones(n, np.int64), np.arange(n)])
    row = {"ids": ids.tobytes(), "held": (np.arange(n) % 4 == 0).tobytes(), "lengths": np.ones(n, np.int64).tobytes(), "sizes": np.ones(n, np.int64).tobytes(), "words": pack(b"\n".join(words[k] for k in order)), "hashes": hashes[order].tobytes(), "tally": pack(np.full(2, 40, np.uint32).tobytes()), "place": pack(np.arange(2, dtype=np.uint32).tobytes()), "tokens": pack((np.arange(n) % 2).astype(np.uint32).tobytes()), "counts": pack(np.full(2, 40, np.int64).tobytes())}
    assert context_mixing.Texts(row, model, few=True).ids[1].tolist() == [k for k in range(n) if k % 4]


def test_neardup_sets_travel_without_their_texts(spark):
    """Texts are read and filtered where they lie; no join or exchange stands below the step that makes sets of them."""
    texts = ["a b c d e f", "a b c d e f", "g h i j k", "a b c d e f g", ""]
    docs = spark.createDataFrame([(-5 + 7 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = neardup.document_sets(docs).where("set_key IS NOT NULL")
    classes = sets.groupBy("set_key").agg(F.min("doc_id").alias("doc_id")).withColumn("rep", F.xxhash64("set_key"))
    some = classes.where("doc_id IN (-5, 16)")
    plan = neardup.full_sets(some.select("rep"), classes, docs)
    below = plan._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow", 1)[1]
    assert "Join" not in below and "Aggregate" not in below
    got = {r.rep: np.frombuffer(r.codes, np.uint64).tolist() for r in plan.collect()}
    want = {r.rep: neardup.shingles(texts[(r.doc_id + 5) // 7]).tolist() for r in some.collect()}
    assert want.items() <= got.items()


def test_ids_of_wanted_classes_are_found_in_the_bitmap(spark):
    classes = spark.range(-3000, 57_000).select(F.col("id").alias("doc_id"), (F.col("id") * 31).alias("rep"))
    docs = spark.range(-3000, 57_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).unionByName(spark.createDataFrame([(None, "y")], "doc_id long, text string"))
    wanted = classes.where("doc_id % 100 = 0")
    got = {r.doc_id for r in neardup.among(docs, wanted.select("rep"), classes).collect()}
    assert set(range(-3000, 57_000, 100)) <= got and len(got) < 700


def test_lm_chunks_go_on_without_hashes(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} again W{i}") for i in range(60)], "doc_id long, text string")
    parts = context_mixing.chunked(docs.coalesce(1), F.col("doc_id") % 7 != 2)
    held = np.frombuffer(parts.first()["hashes"], np.uint64)
    whole = context_mixing.with_counts(parts, context_mixing.merged_counts(parts, 3))
    assert "hashes" not in whole.columns
    model = context_mixing.Model(held[:5], np.full(5, 9), 100, 45, np.ones(256, np.int64), 14)
    assert context_mixing.Texts(whole.first().asDict(), model).hashes.tolist() == held.tolist()


def test_lm_tells_words_of_one_checksum_apart(spark):
    """Both pairs have equal checksums, from any start: only one word of each stands in a training row."""
    docs = spark.createDataFrame([(1, "bldlehbk bldlehbk nxbeewbz"), (2, "yyoqrlev joczsizx")], "doc_id long, text string")
    got = {r.doc_id: r for r in context_mixing.score_texts(docs, F.col("doc_id") == 1).collect()}
    assert [(got[i].n_tokens, got[i].n_known, got[i].train_tokens) for i in (1, 2)] == [(4, 4, 4), (3, 1, 4)]
    assert abs(got[1].base_score - np.log10([3 / 8, 3 / 8, 2 / 8, 2 / 8]).sum()) < 1e-9
    assert abs(got[2].base_score - np.log10([1 / 8, 1 / 8, 2 / 8]).sum()) < 1e-9


@pytest.mark.parametrize("name", ["eval_groups", "eval_overall"])
def test_both_pages_of_a_table_come_from_one_row(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("l_orderkey" in line and line.strip(" :+-").startswith("Relation") for line in plan.splitlines()) == 1
    assert plan.count("MapInArrow") == 1


def test_plain_documents_are_read_as_the_parser_reads_them():
    rng = np.random.default_rng(7)
    parts = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", '<td rowspan="2">', '<th colspan="3">', '<td rowspan="0" colspan="2">', "a", " b ", "&amp;", "&lt", "x>y", "<b>", "<TD>", "<!-- c -->", '</td rowspan="2">', '<td rowspan="²">', "<"]
    for k in range(3000):
        text = "".join(rng.choice(parts[: 16 if k % 2 else None], rng.integers(0, 30)))
        for lost in (False, True):
            told, read = html.TableReader(lost), html.TableReader(lost)
            told.feed(text)
            read.read(text)
            assert told.rows == read.rows, text


def test_predictions_of_arrays_are_those_of_cells(spark):
    cells = fixtures.grid_cells(spark, "/root/testdata/sf0.001").where("table_id < 1000")
    fields = ("ordinal", "row", "col", "rowspan", "colspan", "tag", "role", "text")
    one = structure.folded(cells).withColumn("cells", fixtures.predicted_cells("cells")).select("table_id", F.inline("cells")).select("table_id", *fields)
    want = fixtures.predictions(cells).select("table_id", *fields)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_lineage_makes_no_slots_of_structs(spark):
    plan = registry.queries()["variant_lineage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "named_struct(slot," not in plan


def test_base_schemas_are_made_once(spark):
    held = spark.range(1, 4).select(F.col("id").alias("table_id"), F.lit(5).alias("rows"), F.lit(4).alias("cols"), F.lit(True).alias("simple"), F.lit(None).cast("string").alias("structure"), F.lit("finance").alias("domain"), F.lit("部门预算支出").alias("topic"))
    made = loop.base_schemas(held, "g", 2, layouts.chosen_layout)
    assert "Range (" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.request, r.schema) for r in made.collect()} == {(i, k) for i in (1, 2, 3) for k in (1, 2)}
