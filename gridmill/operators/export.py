"""Texts into structure tokens, targets and chat samples, label characters, joins of cells with images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.text import annotated_role, cleaned, escaped, let, without


def inserted(tokens: Column, texts: Column, openers: tuple[str, ...] = ("<td>", "<th>", ">")) -> Column:
    """Structure tokens with texts put behind the tokens that open a cell, matched from the right.

    ``tokens``, ``texts``: arrays of strings.  Where the numbers differ the leading openers or texts stay unmatched.
    The tokens are cut into runs that each end with an opener, so the work grows with their number only.
    """
    def told(held):
        own, shown, opens = held["tokens"], held["texts"], held["opens"]
        n, m = F.size(opens), F.size(shown)

        def run(end, k):
            begin = F.when(k == 0, F.lit(0)).otherwise(F.try_element_at(opens, k))
            text = F.when(k - (n - m) >= 0, F.try_element_at(shown, F.greatest(k - (n - m) + 1, F.lit(1))))
            return F.concat(F.array_join(F.slice(own, begin + 1, end - begin), ""), F.coalesce(text, F.lit("")))

        last = F.coalesce(F.try_element_at(opens, F.lit(-1)), F.lit(0))
        tail = F.slice(own, last + 1, F.size(own) - last)
        return F.concat(F.array_join(F.transform(opens, run), ""), F.array_join(tail, ""))

    # Tokens, texts and openers are bound once: named within ``run`` as they are, each run would work all of them out again.
    opens = F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(*openers), i + 1)), lambda i: i.isNotNull())
    return let(F.struct(tokens.alias("tokens"), texts.alias("texts"), opens.alias("opens")), told)


def markup(tokens: Column, texts: Column) -> Column:
    """Trimmed HTML of structure tokens and cell texts, in a <table> unless it has one; empty where nothing is left."""
    whole = lambda html: F.when((html == "") | F.lower(html).contains("<table"), html).otherwise(F.concat(F.lit("<table>"), html, F.lit("</table>")))
    return let(F.trim(inserted(tokens, F.transform(texts, cleaned))), whole)


def target_text(target: str, html: Column, cells_json: Column, meta_json: Column) -> Column:
    """What a model is to answer: ``html`` (the cells where it is missing or empty), ``cells``, or ``json`` with both."""
    if target == "html":
        return F.coalesce(F.nullif(html, F.lit("")), cells_json)
    if target == "cells":
        return cells_json
    if target != "json":
        raise ValueError(f"unknown target: {target}")
    extra = F.coalesce(F.concat(F.lit(',"html":'), F.to_json(F.array(html)).substr(F.lit(2), F.length(F.to_json(F.array(html))) - 2)), F.lit(""))
    return F.concat(F.lit('{"meta":'), meta_json, F.lit(',"cells":'), cells_json, extra, F.lit("}"))


def chat_samples(joined: DataFrame, prompt: str, answer: Column, image: Column) -> DataFrame:
    """Adds ``messages`` (user with image mark and prompt, assistant with the answer) and ``images``."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return joined.withColumn("messages", F.array(say("user", F.lit(f"<image>\n{prompt}")), say("assistant", answer))).withColumn("images", F.array(F.replace(image, F.lit("\\"), F.lit("/"))))


def characters(text: Column) -> Column:
    """The characters of a text; none for an empty or missing one."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def token_cells(cells: DataFrame) -> DataFrame:
    """table_id, tokens (structure), texts of tables in the order of the markup."""
    listed = F.array_sort(F.collect_list(F.struct("row", "col", "ordinal", "rowspan", "colspan", "text")))
    span = lambda c, name: F.when(c[name] > 1, F.concat(F.lit(f' {name}="'), c[name].cast("string"), F.lit('"')))
    plain = lambda c: (c["rowspan"] <= 1) & (c["colspan"] <= 1)
    spans = lambda c: F.array_compact(F.array(span(c, "rowspan"), span(c, "colspan")))
    marks = lambda c: F.when(plain(c), F.array(F.lit("<td>"), F.lit("</td>"))).otherwise(F.concat(F.array(F.lit("<td")), spans(c), F.array(F.lit(">"), F.lit("</td>"))))
    follows = lambda c, i: (i > 0) & ~F.get(F.col("c"), i - 1)["row"].eqNullSafe(c["row"])
    one = lambda c, i: F.when(follows(c, i), F.concat(F.array(F.lit("</tr>"), F.lit("<tr>")), marks(c))).otherwise(marks(c))
    tables = cells.groupBy("table_id").agg(listed.alias("c"))
    return tables.select("table_id", F.concat(F.array(F.lit("<tr>")), F.flatten(F.transform("c", one)), F.array(F.lit("</tr>"))).alias("tokens"), F.col("c.text").alias("texts"))


def image_issues(cells: DataFrame, images: DataFrame) -> DataFrame:
    """file, cells, issue: files whose image has no size, is broken or is missing; ``images``: file, ok, width, height."""
    per = cells.groupBy("file").agg(F.count(F.lit(1)).alias("cells"))
    issue = F.when(F.col("ok").isNull(), "image size unavailable").when(~F.col("ok"), "broken image").when((F.col("width") <= 0) | (F.col("height") <= 0), "empty image")
    return per.join(images, "file", "left").select("file", "cells", issue.alias("issue")).where("issue IS NOT NULL")


def count_mismatches(meta: DataFrame, cells: DataFrame) -> DataFrame:
    """table_id, declared, actual where metadata declare another number of cells than there are."""
    actual = cells.groupBy("table_id").agg(F.count(F.lit(1)).alias("actual"))
    return meta.where("declared IS NOT NULL").join(actual, "table_id").where("declared <> actual").select("table_id", "declared", "actual")


def clipped(boxes: DataFrame, key: str, margin: int) -> DataFrame:
    """Boxes (x1, y1, x2, y2) moved so that the frame around all of a key begins ``margin`` before them; adds its size as width
    and height, in place of columns of these names.
    """
    frame = boxes.groupBy(key).agg(F.min("x1").alias("__x"), F.min("y1").alias("__y"), (F.max("x2") - F.min("x1") + 2 * margin).alias("__width"), (F.max("y2") - F.min("y1") + 2 * margin).alias("__height"))
    moved = lambda c, base: (F.col(c) - F.col(base) + margin).alias(c)
    rest = [c for c in boxes.columns if c not in ("x1", "y1", "x2", "y2", "width", "height")]
    return boxes.join(frame, key).select(*rest, moved("x1", "__x"), moved("y1", "__y"), moved("x2", "__x"), moved("y2", "__y"), F.col("__width").alias("width"), F.col("__height").alias("height"))


def rebuilt(tokens: Column, texts: Column, mode: str = "page") -> Column:
    """Structure tokens with the characters of the cells put behind what opens a cell, matched from the right.

    ``texts``: an array of arrays of characters.  ``page``: single characters are escaped, and the whole is a page with one
    table.  ``plain``: not escaped; a text of nothing but style marks and blanks is left out; no page around it.
    """
    if mode == "page":
        own = F.transform(texts, lambda t: F.array_join(F.transform(t, lambda x: F.when(F.length(x) == 1, escaped(x)).otherwise(x)), ""))
        return F.concat(F.lit("<html><body><table>"), inserted(tokens, own, ("<td>", ">")), F.lit("</table></body></html>"))
    if mode != "plain":
        raise ValueError(f"unknown mode: {mode}")
    own = F.transform(texts, lambda t: F.array_join(t, ""))
    return inserted(tokens, F.transform(own, lambda t: F.when(without(t) == "", "").otherwise(t)), ("<td>", ">"))


def label_record(file: Column, tokens: Column, texts: Column, boxes: Column) -> Column:
    """struct(filename, html(structure(tokens), cells(tokens, bbox)), gt) of a table: its structure, the characters and the box of
    each cell, and the page rebuilt from them; ``texts`` and ``boxes`` are zipped to the shorter.
    """
    n = F.least(F.size(texts), F.size(boxes))
    cells = F.zip_with(F.slice(texts, 1, n), F.slice(boxes, 1, n), lambda t, b: F.struct(characters(t).alias("tokens"), b.alias("bbox")))
    page = rebuilt(tokens, F.transform(F.slice(texts, 1, n), characters))
    return F.struct(file.alias("filename"), F.struct(F.struct(tokens.alias("tokens")).alias("structure"), cells.alias("cells")).alias("html"), page.alias("gt"))


def read_label(record: Column) -> Column:
    """struct(filename, tokens, cells(tokens, bbox)) of a label's JSON text, null if it is none."""
    kind = "struct<filename:string,html:struct<structure:struct<tokens:array<string>>,cells:array<struct<tokens:array<string>,bbox:array<array<array<double>>>>>>>"
    found = F.from_json(record, kind)
    return F.when(found["filename"].isNotNull(), F.struct(found["filename"].alias("filename"), found["html"]["structure"]["tokens"].alias("tokens"), found["html"]["cells"].alias("cells")))


def annotations(cells: DataFrame, boxes: DataFrame, header_type: str = "header_type") -> DataFrame:
    """Cells in the order of the page zipped with the texts and boxes found there: table_id, number, ordinal, row, col, rowspan,
    colspan, tag, role, text, tokens, bbox, is_header, is_empty.

    ``boxes``: table_id, number (from 0, in the order of the page), text, bbox.  Cells without a box and boxes without a cell
    are left out, as zipping to the shorter does.
    """
    order = Window.partitionBy("table_id").orderBy("row", "col", "ordinal")
    own = cells.drop("text").withColumn("number", F.row_number().over(order) - 1)
    met = own.join(boxes.select("table_id", "number", "text", "bbox"), ["table_id", "number"])
    role = annotated_role(F.col("role"), F.col(header_type), F.col("row"), F.col("col"))
    return met.select("table_id", "number", "ordinal", "row", "col", "rowspan", "colspan", "tag", role.alias("role"), "text", characters(F.col("text")).alias("tokens"), "bbox", F.col("role").isin("title", "header").alias("is_header"), (F.col("text") == "").alias("is_empty"))


def image_path(folder: str, path: Column, absolute: bool) -> Column:
    """Where a sample's image is: below a folder, or relative with forward strokes."""
    if absolute:
        return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))
    return F.replace(path, F.lit("\\"), F.lit("/"))


def prompt(task: str, **parts: Column) -> Column:
    """A prompt as JSON: the task, then the parts by name; texts, numbers, arrays, structs and maps keep their kind, nulls stay."""
    return F.to_json(F.struct(F.lit(task).alias("task"), *[c.alias(k) for k, c in parts.items()]), {"ignoreNullFields": "false"})


def json_value(value: Column, kind: str) -> Column:
    """A value as a trace holds it: texts as they are, all that is nested as JSON, the rest as text."""
    return value if kind == "string" else F.to_json(value) if kind.startswith(("struct", "array", "map")) else value.cast("string")
