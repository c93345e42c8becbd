"""Comparing predicted with expected tables; audits, reports, exports over metadata.

Both tables of a comparison are rows with an array of cells (folded or parsed), so a pair costs one join by its key;
spans, texts and signatures are compared within the row.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.text import basename, first_filled, stem
from gridmill.operators.structure import folded

TABLE = "table_id"


def code_of(*parts: Column) -> Column:
    """One text of some values: equal for equal values only, where at most the last is a text.  Sets of texts are hashed, sets of
    structs are compared pair by pair.
    """
    return F.concat(*chain.from_iterable((F.coalesce(p.cast("string"), F.lit("-")), F.lit(",")) for p in parts))


def spans_of(cells: Column) -> Column:
    """The distinct (row, col, rowspan, colspan) of an array of cells, each as ``code_of``."""
    return F.array_distinct(F.transform(cells, lambda c: code_of(*[c[k].cast("long") for k in ("row", "col", "rowspan", "colspan")])))


def placed_texts(cells: Column) -> Column:
    """(row, col, text) of each position that has a cell, the last cell's text where there are several, each as ``code_of``."""
    one = F.array_sort(F.transform(cells, lambda c, i: F.struct(c["row"].cast("long").alias("row"), c["col"].cast("long").alias("col"), i.alias("i"), F.trim(F.coalesce(c["text"], F.lit(""))).alias("text"))))
    at = lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col"))
    # A later cell at the same position stands next to it once sorted.
    pairs = F.arrays_zip(one.alias("x"), F.slice(one, 2, F.greatest(F.size(one), F.lit(1))).alias("y"))
    last = F.filter(pairs, lambda p: p["y"].isNull() | (at(p["x"]) != at(p["y"])))
    return F.transform(last, lambda p: code_of(p["x"]["row"], p["x"]["col"], p["x"]["text"]))


def signature_of(cells: Column) -> Column:
    """tag[row,col](rowspan,colspan) of all cells by row and column, joined by strokes."""
    one = lambda c: F.concat(c["tag"], F.lit("["), c["row"].cast("string"), F.lit(","), c["col"].cast("string"), F.lit("]("), c["rowspan"].cast("string"), F.lit(","), c["colspan"].cast("string"), F.lit(")"))
    listed = F.array_sort(F.transform(cells, lambda c, i: F.struct(c["row"].cast("long").alias("row"), c["col"].cast("long").alias("col"), i.alias("i"), one(c).alias("s"))))
    return F.array_join(F.transform(listed, lambda x: x["s"]), "|")


def score_of(ref: Column, pred: Column, common: Column) -> Column:
    """Twice the common spans over all; 1 where there are none."""
    n = ref + pred
    return F.round(F.when(n == 0, 1.0).otherwise(2 * common / F.when(n > 0, n)), 4)


def structure_scores(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """table_id, ref_cells, pred_cells, common, structure_score: twice the common spans over all distinct spans."""
    t = folded(expected).select(TABLE, spans_of(F.col("cells")).alias("a")).join(folded(predicted).select(TABLE, spans_of(F.col("cells")).alias("b")), TABLE, "full")
    none = F.array().cast("array<string>")
    t = t.withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)})
    a, b, both = F.size("a"), F.size("b"), F.size(F.array_intersect("a", "b"))
    return t.select(TABLE, a.alias("ref_cells"), b.alias("pred_cells"), both.alias("common"), score_of(a, b, both).alias("structure_score"))


def text_accuracy(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """table_id, correct, cell_text_accuracy: equal texts at equal positions over the larger number of cells."""
    told = lambda df, n, x: folded(df).select(TABLE, F.size("cells").alias(n), placed_texts(F.col("cells")).alias(x))
    t = told(expected, "n", "a").join(told(predicted, "m", "b"), TABLE, "left")
    correct = F.coalesce(F.size(F.array_intersect("a", "b")), F.lit(0))
    correct = F.when(F.col("b").isNull(), 0).otherwise(correct)
    return t.select(TABLE, correct.cast("long").alias("correct"), F.round(correct / F.greatest("n", F.coalesce("m", F.lit(0))), 4).alias("cell_text_accuracy"))


def html_metrics(predicted: DataFrame, expected: DataFrame, key: str = TABLE, *keep: str) -> DataFrame:
    """Metrics of predicted against expected documents, both parsed (``sources.html.parsed``), a row a predicted one.

    html_valid (no errors), parsed_rows, parsed_cols, error_count, and structure_signature_match, ref_cell_count,
    pred_cell_count, correct_cell_text, cell_text_accuracy, structure_score, which are all zero or false where the
    expected document has no cells; then the columns of ``predicted`` to keep.
    """
    ref = expected.select(F.col(key).alias("__key"), F.col("cells").alias("__ref"), F.col("rows").alias("__rows"), F.col("cols").alias("__cols"))
    t = predicted.join(ref, predicted[key] == ref["__key"], "left")
    none = F.array().cast("array<struct<row:long,col:long,rowspan:long,colspan:long,tag:string,text:string>>")
    return compared(t.withColumn("__ref", F.coalesce("__ref", none)), key, *keep)


def compared(t: DataFrame, key: str, *keep: str) -> DataFrame:
    """``html_metrics`` of predicted documents that stand beside the expected: __ref (cells, never null), __rows, __cols."""
    pred, want = F.col("cells"), F.col("__ref")
    some = F.size(want) > 0
    t = t.withColumns({"__a": spans_of(want), "__b": spans_of(pred), "__correct": F.size(F.array_intersect(placed_texts(want), placed_texts(pred)))})
    score = score_of(F.size("__a"), F.size("__b"), F.size(F.array_intersect("__a", "__b")))
    zero = lambda x: F.when(some, x).otherwise(0)
    return t.select(
        key,
        (F.col("error_count") == 0).alias("html_valid"),
        F.col("rows").alias("parsed_rows"),
        F.col("cols").alias("parsed_cols"),
        "error_count",
        (some & (signature_of(pred) == signature_of(want))).alias("structure_signature_match"),
        F.size(want).alias("ref_cell_count"),
        zero(F.size(pred)).alias("pred_cell_count"),
        zero(F.col("__correct")).alias("correct_cell_text"),
        F.when(some, F.round(F.col("__correct") / F.greatest(F.size(want), F.size(pred)), 4)).otherwise(0.0).alias("cell_text_accuracy"),
        F.when(some, score).otherwise(0.0).alias("structure_score"),
        (some & (score == 1) & (F.col("rows") == F.col("__rows")) & (F.col("cols") == F.col("__cols")) & (F.col("error_count") == 0)).alias("exact_match"),
        ((F.col("error_count") == 0) & F.coalesce((F.col("rows") == F.col("__rows")) & (F.col("cols") == F.col("__cols")), F.lit(False))).alias("structure_valid"),
        *keep,
    )


def mean(column: str, places: int) -> Column:
    return F.round(F.coalesce(F.avg(column), F.lit(0.0)) + 1e-9, places)


AVERAGES = {"cell_text_accuracy": ("avg_cell_accuracy", 4), "structure_score": ("avg_structure_score", 4), "ref_cell_count": ("avg_ref_cells", 2), "pred_cell_count": ("avg_pred_cells", 2)}


def overall_summary(results: DataFrame) -> DataFrame:
    """One row over evaluated tables (``html_metrics`` with prediction_chars and inference_seconds)."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("html_valid").alias("html_valid"),
        F.count_if("structure_signature_match").alias("structure_exact_match"),
        *[mean(c, places).alias(name) for c, (name, places) in AVERAGES.items()],
        mean("prediction_chars", 1).alias("avg_prediction_chars"),
        mean("inference_seconds", 2).alias("avg_inference_seconds"),
    )


def with_metadata(results: DataFrame, meta: DataFrame, image: str) -> DataFrame:
    """Results with the metadata of their image: joined by the last part of the path, of several the last line's.

    ``meta``: filename, line and what is to be added; rows without a name are never met.
    """
    named = meta.withColumn("__name", basename(F.coalesce("filename", F.lit("")))).where("__name <> ''")
    rest = [c for c in meta.columns if c not in ("filename", "line", *results.columns)]
    last = named.groupBy("__name").agg(F.max_by(F.struct(*rest), "line").alias("__m"))
    met = results.withColumn("__name", basename(F.col(image))).join(last, "__name", "left")
    return met.select(*results.columns, *[F.col(f"__m.{c}").alias(c) for c in rest])


def group_summary(results: DataFrame, order: str = TABLE) -> DataFrame:
    """By config_id and header_type (``unknown`` where missing), sorted by them; attributes are those of the first result."""
    first = lambda c: F.min_by(F.struct(c), order)[c].alias(c)
    known = results.withColumns({k: F.coalesce(k, F.lit("unknown")) for k in ("config_id", "header_type")})
    return known.groupBy("config_id", "header_type").agg(
        *[first(c) for c in ("simple", "colored", "lined", "has_rowspan", "has_colspan")],
        F.count(F.lit(1)).alias("samples"),
        F.count_if("html_valid").alias("html_valid"),
        F.count_if("structure_signature_match").alias("structure_exact_match"),
        *[mean(c, places).alias(name) for c, (name, places) in AVERAGES.items()],
    ).orderBy("config_id", "header_type")


def percent(n: Column, total: Column) -> Column:
    """A share as a per cent text with one digit; 0.0% of nothing."""
    return F.when(total > 0, F.format_string("%.1f%%", 100.0 * n / F.when(total > 0, total))).otherwise("0.0%")


def fidelity_summary(results: DataFrame) -> DataFrame:
    """Two methods by four cases, empty groups as zeros (``html_metrics`` with method and case)."""
    spark = results.sparkSession
    frame = spark.createDataFrame([(m, c) for m in ("builder", "direct") for c in ("simple_with", "simple_without", "complex_with", "complex_without")], "method string, case string")
    told = results.groupBy("method", "case").agg(F.count(F.lit(1)).alias("samples"), F.count_if("exact_match").alias("exact_match"), F.count_if("structure_valid").alias("structure_valid"), mean("structure_score", 4).alias("avg_structure_score"), mean("error_count", 4).alias("avg_error_count"))
    return frame.join(told, ["method", "case"], "left").na.fill({"samples": 0, "exact_match": 0, "structure_valid": 0, "avg_structure_score": 0.0, "avg_error_count": 0.0})


def perturb(cells: DataFrame) -> DataFrame:
    """A deterministic damage by header type and whether texts count (columns header_type, with_content)."""
    kind, content = F.col("header_type"), F.col("with_content")
    plain = kind == "simple_single_header"
    drop = F.when(plain, False).when(content & kind.isin("mixed_headers", "two_axis_header"), (F.col("role") == "header") & (F.col("row") > 2) & (F.col("col") == 1)).when(~content & (kind == "body_rowspan"), (F.col("row") > 2) & (F.col("col") == 0)).otherwise(False)
    colspan = F.when(plain | (F.col("colspan") <= 1), F.col("colspan")).when(content, F.greatest(F.lit(1), F.col("colspan") - 1)).when(kind.isin("grouped_columns", "summary_row_colspan"), F.lit(1)).otherwise(F.col("colspan"))
    rowspan = F.when(plain | (F.col("rowspan") <= 1), F.col("rowspan")).when(content | kind.isin("body_rowspan", "multi_level_column_header"), F.lit(1)).otherwise(F.col("rowspan"))
    return cells.where(~drop).withColumn("colspan", colspan).withColumn("rowspan", rowspan)


def keyed(rows: DataFrame) -> DataFrame:
    """Adds file: the first of filename and image that is filled; of several rows of a file the last line stays."""
    order = Window.partitionBy("file").orderBy(F.col("line").desc())
    return rows.withColumn("file", first_filled(F.col("filename"), F.col("image"))).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def duplicate_files(rows: DataFrame) -> DataFrame:
    named = rows.withColumn("file", first_filled(F.col("filename"), F.col("image")))
    return named.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("file", "n")


def missing_rows(**parts: DataFrame) -> DataFrame:
    """source, file: files that some part has and this one lacks; each part has a column file."""
    every = None
    for df in parts.values():
        every = df.select("file") if every is None else every.union(df.select("file"))
    every = every.distinct()
    out = None
    for name, df in parts.items():
        lacks = every.join(df.select("file").distinct(), "file", "left_anti").select(F.lit(name).alias("source"), "file")
        out = lacks if out is None else out.union(lacks)
    return out


def batch_report(rows: DataFrame) -> DataFrame:
    """Counts by config, by header type, by status and of spans, in one pass of grouping sets."""
    sets = [[F.col("config_id")], [F.col("header_type")], [F.col("status")], []]
    kind = F.when(F.grouping("config_id") == 0, "config").when(F.grouping("header_type") == 0, "header_type").when(F.grouping("status") == 0, "status").otherwise("all")
    complex_ = ~F.col("simple")
    told = rows.groupingSets(sets, F.col("config_id"), F.col("header_type"), F.col("status")).agg(
        kind.alias("kind"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(complex_).alias("complex_total"),
        F.count_if(complex_ & F.col("has_rowspan")).alias("complex_rowspan"),
        F.count_if(complex_ & F.col("has_colspan")).alias("complex_colspan"),
    )
    return told.select("kind", F.coalesce("config_id", "header_type", "status", F.lit("all")).alias("name"), "n", "complex_total", "complex_rowspan", "complex_colspan")


def run_report(attempts: DataFrame, target: int, limit: int) -> DataFrame:
    """One row on a run's attempts (ok, reason): attempts, success, failed, success_rate, complete, target_num, max_attempts."""
    told = attempts.agg(F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("success"))
    rate = F.when(F.col("attempts") > 0, F.round(F.col("success") / F.when(F.col("attempts") > 0, F.col("attempts")), 4)).otherwise(0.0)
    return told.select("attempts", "success", (F.col("attempts") - F.col("success")).alias("failed"), rate.alias("success_rate"), (F.col("success") >= target).alias("complete"), F.lit(target).alias("target_num"), F.lit(limit).alias("max_attempts"))


def failure_counts(attempts: DataFrame) -> DataFrame:
    """reason, n of the attempts that failed, by reason."""
    return attempts.where("NOT ok").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy("reason")


def attempt_limits(target: int | None, number: int, explicit: int | None, retry: bool) -> tuple[int, int]:
    """(target, most attempts): the target or else the number; the explicit limit, else three times the target with retries."""
    wanted = number if target is None else target
    return wanted, explicit if explicit is not None else wanted * 3 if retry else wanted


def split_of(rows: DataFrame, key: str, val: float, test: float, seed: str) -> DataFrame:
    """Adds split: by a seeded hash order, the first floor(n * test) are test, then val, the rest train.

    The first four digits of the hash tell the split of all rows but those of the two groups of digits that a limit falls
    into; only these, one in 65,536 each, are ranked.  ValueError where a ratio is negative or nothing is left to train on.
    """
    if val < 0 or test < 0 or val + test >= 1:
        raise ValueError("val and test must be non-negative and sum to less than 1")
    h = rows.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).withColumn("__s", F.substring("__h", 1, 4))
    sizes = h.groupBy("__s").agg(F.count(F.lit(1)).alias("__c"))
    so_far = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over 65,536 rows at most
    before = sizes.withColumn("__end", F.sum("__c").over(so_far)).withColumn("__n", F.sum("__c").over(Window.partitionBy(F.lit(1))))
    tests, vals = F.floor(F.col("__n") * test), F.floor(F.col("__n") * test) + F.floor(F.col("__n") * val)
    begin = F.col("__end") - F.col("__c")
    inside = lambda limit: (begin < limit) & (limit < F.col("__end"))
    told = before.select("__s", begin.alias("__begin"), tests.alias("__tests"), vals.alias("__vals"), (inside(tests) | inside(vals)).alias("__edge"))
    met = h.join(F.broadcast(told), "__s")
    name = lambda place: F.when(place <= F.col("__tests"), "test").when(place <= F.col("__vals"), "val").otherwise("train")
    plain = met.where("NOT __edge").withColumn("split", name(F.col("__begin") + 1))
    rank = F.row_number().over(Window.partitionBy("__s").orderBy("__h", key))
    edge = met.where("__edge").withColumn("split", name(F.col("__begin") + rank))
    return plain.unionByName(edge).drop("__h", "__s", "__begin", "__tests", "__vals", "__edge")


def area(points):
    """Of a polygon (array of x, y structs) by the shoelace formula."""
    turned = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, b: a + b)) / 2


def box_points(box) -> Column:
    """The points (x, y) of a box (array of arrays of numbers): null unless there are four or more, each of two finite numbers."""
    number = lambda p, k: F.get(p, F.lit(k)).try_cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.forall(box, lambda p: p.isNotNull() & F.coalesce(finite(number(p, 0)) & finite(number(p, 1)), F.lit(False)))
    return F.when((F.size(box) >= 4) & sound, F.transform(box, lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y"))))


def box_issue(points, width, height):
    """Null if a box is sound, else what is wrong first; ``points``: an array of (x, y), null where they are not numbers."""
    wrong = lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]) | (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf"))
    outside = F.exists(points, lambda p: (p["x"] < 0) | (p["y"] < 0) | (p["x"] > width) | (p["y"] > height))
    return F.when(points.isNull() | (F.size(points) < 4) | F.exists(points, wrong), "invalid").when(area(points) <= 0, "no_area").when(outside, "out_of_image")


def first_outside(points, width, height) -> Column:
    """The first point that lies outside of the image, else null."""
    return F.get(F.filter(points, lambda p: (p["x"] < 0) | (p["y"] < 0) | (p["x"] > width) | (p["y"] > height)), F.lit(0))


def box_message(points, width, height) -> Column:
    """What is wrong with a box as a text, else null."""
    issue = box_issue(points, width, height)
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    return F.when(issue == "invalid", "bbox must be a polygon with numeric points").when(issue == "no_area", "bbox area must be positive").when(issue == "out_of_image", F.concat(F.lit("bbox point out of image bounds ("), size, F.lit(")")))


def visual_names(visual: Column) -> Column:
    """The values of a visual map as key=value in order of the keys; ``unknown`` where there are none."""
    entries = F.array_sort(F.map_entries(F.coalesce(visual, F.create_map().cast("map<string,string>"))))
    named = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("unknown")))


def audit(gt: DataFrame, meta: DataFrame, cells: DataFrame, images: DataFrame, pages: DataFrame, report_success: int | None = None) -> DataFrame:
    """kind, name, n: the whole audit of a corpus, long form.

    gt: file.  meta: file, config_id, header_type, visual (map).  cells: file, declared (cell_count or null), cells (array
    of role, points).  images: file, ok, width, height.  pages: stem.  ``file`` is null where a record names none.

    kind ``count``: rows of each part, sample_count, image_files, html_files, total_cells, invalid_bbox_count, and how many
    files fail each check; ``role``, ``config``, ``header_type``, ``visual``: counters
    row); ``error`` and ``warning``: messages with the number they tell; ``status``: pass or fail with the number of
    error messages.  All sums are partial before any exchange; nothing is collected.
    """
    spark = gt.sparkSession
    parts = {"gt.txt": gt, "meta.jsonl": meta, "cells.jsonl": cells}
    named = {k: df.where("file IS NOT NULL").select("file") for k, df in parts.items()}
    marks = [df.select("file", *[F.lit(k == other).alias(f"__{i}") for i, other in enumerate(parts)]) for k, df in named.items()]
    files = reduce(DataFrame.unionByName, marks).groupBy("file").agg(*[F.bool_or(f"__{i}").alias(f"__{i}") for i in range(3)], *[F.count_if(f"__{i}").alias(f"__n{i}") for i in range(3)])
    seen = files.join(images.select("file", F.struct("ok", "width", "height").alias("__image")), "file", "full")
    seen = seen.withColumn("__label", F.col("__0").isNotNull())
    stems = pages.select(F.col("stem").alias("__stem"), F.lit(True).alias("__page")).distinct()
    seen = seen.withColumn("__stem", stem(F.col("file"))).join(stems, "__stem", "left")
    label, image = F.col("__label"), F.col("__image")
    told = seen.agg(
        F.count_if(label).alias("sample_count"),
        F.count_if(image.isNotNull()).alias("image_files"),
        F.count_if(label & image.isNull()).alias("missing_images"),
        F.count_if(label & image.isNotNull() & ~F.col("__image.ok")).alias("bad_images"),
        F.count_if(label & image.isNotNull() & F.col("__page").isNull()).alias("missing_html"),
        F.count_if(~label).alias("extra_images"),
        *[F.count_if(label & ~F.col(f"__{i}")).alias(f"missing rows:{k}") for i, k in enumerate(parts)],
        *[F.count_if(F.col(f"__n{i}") > 1).alias(f"duplicates:{k}") for i, k in enumerate(parts)],
    )
    per = cells.join(images.select("file", F.col("width").alias("__w"), F.col("height").alias("__h"), F.col("ok").alias("__ok")), "file", "left")
    known = F.coalesce((F.col("__w") > 0) & (F.col("__h") > 0) & F.col("__ok"), F.lit(False))
    bad = F.when(known, F.size(F.filter("cells", lambda c: box_issue(c["points"], F.col("__w"), F.col("__h")).isNotNull()))).otherwise(F.size("cells"))
    per = per.select(F.size("cells").alias("n"), bad.alias("bad"), (F.col("declared").isNotNull() & (F.col("declared") != F.size("cells"))).alias("other"))
    boxes = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_cells"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_bbox_count"), F.count_if("other").alias("cell_count_mismatches"))
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    rows = size(gt, "gt_rows").join(size(meta, "meta_rows")).join(size(cells, "cells_rows")).join(pages.agg(F.count_distinct("stem").alias("html_files")))
    bare = reduce(DataFrame.join, [df.agg(F.count_if(F.col("file").isNull()).alias(f"unnamed:{k}")) for k, df in parts.items()])
    one = told.join(boxes).join(rows).join(bare)  # rows of one line each
    counts = ["sample_count", "gt_rows", "meta_rows", "cells_rows", "image_files", "html_files", "total_cells", "invalid_bbox_count", "missing_images", "bad_images", "missing_html", "extra_images", "cell_count_mismatches"]
    line = lambda kind, name, n: F.struct(F.lit(kind).alias("kind"), (name if isinstance(name, Column) else F.lit(name)).alias("name"), n.cast("long").alias("n"))
    found = lambda column, text: F.when(F.col(column) > 0, line("error", text, F.col(column)))
    errors = [
        *[found(f"`duplicates:{k}`", f"{k}: duplicate filenames") for k in parts],
        *[found(f"`unnamed:{k}`", f"{k}: rows missing filename") for k in parts],
        *[found(f"`missing rows:{k}`", f"{k}: missing rows") for k in parts],
        found("missing_images", "missing image files"),
        found("bad_images", "unreadable image files"),
        found("missing_html", "missing html files matching images"),
        found("invalid_bbox_count", "invalid bboxes"),
        found("cell_count_mismatches", "cell_count mismatches"),
    ]
    warnings = [F.when(F.col("extra_images") > 0, line("warning", "extra image files without labels", F.col("extra_images")))]
    if report_success is not None:
        warnings.append(F.when(F.col("meta_rows") != report_success, line("warning", F.concat(F.lit(f"report success={report_success} differs from meta rows="), F.col("meta_rows").cast("string")), F.lit(1))))
    one = one.withColumn("__errors", F.array_compact(F.array(*errors)))
    status = line("status", F.when(F.size("__errors") == 0, "pass").otherwise("fail"), F.size("__errors"))
    lines = F.concat(F.array(*[line("count", c, F.col(c)) for c in counts]), F.col("__errors"), F.array_compact(F.array(*warnings)), F.array(status))
    summary = one.select(F.inline(lines))
    counter = lambda df, kind, name: df.groupBy(F.coalesce(name, F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    role = counter(cells.select(F.explode("cells.role").alias("role")), "role", F.col("role"))
    pairs = F.array(F.struct(F.lit("config").alias("kind"), F.col("config_id").alias("name")), F.struct(F.lit("header_type").alias("kind"), F.col("header_type").alias("name")))
    visual = F.transform(visual_names(F.col("visual")), lambda v: F.struct(F.lit("visual").alias("kind"), v.alias("name")))
    rest = meta.select(F.inline(F.concat(pairs, visual))).groupBy("kind", F.coalesce("name", F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return summary.unionByName(role).unionByName(rest.select("kind", "name", "n"))
