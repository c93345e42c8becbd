"""Rule scores of filled tables, the gate on them, selection and repair.

A table is scored from its folded row; only its body cells are spread once more, so that their scores are generated
code.  Sums are rounded as double precision gives them, after adding 1e-9, so that the order of adding never decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions.text import GENERIC_HEADERS, KEYWORDS, issue_code, issue_location, jaccard, score_cell, tokens
from gridmill.operators.structure import TABLE, folded

MINIMUM = 0.58
DIMENSIONS = ("title", "header", "body", "topic")


def keyword_array(domain: Column, topic: Column, scenario: Column | None = None) -> Column:
    """Keywords of a domain and of a scenario, then the tokens of a topic."""
    known = F.create_map(*[x for k, words in KEYWORDS.items() for x in (F.lit(k), F.array(*map(F.lit, words)))])
    none = F.array().cast("array<string>")
    of = lambda name: F.coalesce(known[F.coalesce(name, F.lit(""))], none)
    found = of(domain) if scenario is None else F.array_union(of(domain), of(scenario))
    return F.array_union(found, tokens(F.coalesce(topic, F.lit(""))))


def with_headers_by_column(tables: DataFrame) -> DataFrame:
    """Adds to folded tables __first (the leftmost column of any header) and __headers: for each column from there on the header
    over it, of the header cells over a column the last with a text (trimmed), else the last; null where there is none.
    """
    t = tables.withColumn("__heads", F.filter("cells", lambda c: (c["role"] == "header") & (c["colspan"] >= 1)))
    t = t.withColumn("__first", F.coalesce(F.array_min(F.transform("__heads", lambda c: c["col"])), F.lit(0)))
    end = F.coalesce(F.array_max(F.transform("__heads", lambda c: c["col"] + c["colspan"])), F.lit(0))
    over = lambda k: F.filter("__heads", lambda c: (c["col"] <= k) & (k < c["col"] + c["colspan"]))
    last = lambda a: F.get(a, F.size(a) - 1)["text"]
    text = lambda k: F.coalesce(F.trim(last(F.filter(over(k), lambda c: F.trim(c["text"]) != ""))), last(over(k)))
    columns = F.when(end > F.col("__first"), F.transform(F.sequence(F.col("__first"), end - 1), text)).otherwise(F.array().cast("array<string>"))
    return t.withColumn("__headers", columns).drop("__heads")


def effective_headers(cells: DataFrame) -> DataFrame:
    """table_id, col, header: the header over each column that has one."""
    t = with_headers_by_column(folded(cells)).select(TABLE, "__first", F.posexplode_outer("__headers").alias("i", "header"))
    return t.where("header IS NOT NULL").select(TABLE, (F.col("i") + F.col("__first")).cast("int").alias("col"), "header")


def row_headers(cells: DataFrame) -> DataFrame:
    """table_id, row, header: the last header cell in column 0 that begins in a row."""
    return cells.where("role = 'header' AND col = 0").groupBy(TABLE, "row").agg(F.max_by("text", "ordinal").alias("header"))


def spread_body(tables: DataFrame, *keep: str, whole: str | None = None) -> DataFrame:
    """A row a body cell of tables of ``with_headers_by_column``: keep, ordinal, row, col, text, header.  ``whole``: a column that
    a row more of each table, without an ordinal, has as ``whole``.
    """
    own = [] if whole is None else [F.lit(None).cast(tables.schema[whole].dataType).alias("whole")]
    body = F.transform(F.filter("cells", lambda c: c["role"] == "body"), lambda c: F.struct(c["ordinal"].alias("ordinal"), c["row"].alias("row"), c["col"].alias("col"), c["text"].alias("text"), F.coalesce(F.get(F.col("__headers"), c["col"] - F.col("__first")), F.lit("")).alias("header"), *own))
    if whole is not None:
        cell = {f.name: f.dataType for f in tables.schema["cells"].dataType.elementType.fields}
        none = [F.lit(None).cast(cell[n]).alias(n) for n in ("ordinal", "row", "col", "text")]
        body = F.concat(F.array(F.struct(*none, F.lit(None).cast("string").alias("header"), F.col(whole).alias("whole"))), body)
    return tables.select(TABLE, *keep, F.inline_outer(body))


def cell_scores(cells: DataFrame) -> DataFrame:
    """table_id, ordinal, row, col, header, score, issue of every body cell."""
    body = spread_body(with_headers_by_column(folded(cells))).where("ordinal IS NOT NULL")
    return body.withColumn("s", score_cell(F.col("header"), F.col("text"))).select(TABLE, "ordinal", "row", "col", "header", F.col("s.score").alias("score"), F.col("s.issue").alias("issue"))


def column_scores(cells: DataFrame) -> DataFrame:
    """table_id, col, score: the share of a column's body cells that score 0.75 or more; columns without a body cell have 1 under a header with a text."""
    scored = cell_scores(cells).groupBy(TABLE, "col").agg(F.round(F.avg((F.col("score") >= 0.75).cast("double")) + 1e-9, 4).alias("body"))
    heads = cells.where("role = 'header'").withColumn("text", F.trim("text"))
    over = heads.select(TABLE, "ordinal", "text", F.explode(F.when((F.col("text") == "") | (F.col("colspan") < 1), F.array("col")).otherwise(F.sequence(F.col("col"), F.greatest(F.col("col"), F.col("col") + F.col("colspan") - 1)))).alias("col"))
    # An empty header sets its own column to 0, whatever came before; a filled one only columns not yet set.
    first = over.groupBy(TABLE, "col").agg(F.bool_or(F.col("text") == "").alias("bare"))
    return first.join(scored, [TABLE, "col"], "full").select(TABLE, "col", F.coalesce("body", F.when(F.col("bare"), 0.0).otherwise(1.0)).alias("score"))


#: Body issues that are errors; all others are warnings.
ERRORS = ("empty", "percent", "numeric")


def scored_tables(tables: DataFrame, *keep: str, told: bool = False) -> DataFrame:
    """Scores of folded tables with domain, topic, simple (and scenario, if there is one): see ``table_scores``."""
    scenario = F.col("scenario") if "scenario" in tables.columns else None
    t = with_headers_by_column(tables).withColumns({"__k": keyword_array(F.col("domain"), F.col("topic"), scenario), "__topic": tokens(F.coalesce("topic", F.lit("")))})
    texts = lambda role: F.transform(F.filter("cells", lambda c: c["role"] == role), lambda c: F.trim(c["text"]))
    filled = lambda a: F.filter(a, lambda x: x != "")
    t = t.withColumns({"__titles": texts("title"), "__heads": texts("header"), "__bodies": filled(texts("body"))})
    t = t.withColumns({"__title": F.array_join(filled("__titles"), " "), "__named": filled("__heads"), "__corpus": F.array_join(filled(F.transform("cells", lambda c: F.trim(c["text"]))), " "), "__shown": filled(F.array_distinct(F.transform(F.filter("__headers", lambda x: x.isNotNull()), lambda x: F.trim(x))))})
    has_key = lambda x: F.exists("__k", lambda k: F.contains(x, k))
    count = lambda a, cond: F.size(F.filter(a, cond))
    topic = F.coalesce("topic", F.lit(""))
    overlap = jaccard(tokens(F.col("__title")), F.col("__topic"))
    title = (
        F.when(F.col("simple"), F.when(F.col("__title") != "", 0.9).otherwise(1.0))
        .when(F.col("__title") == "", 0.0)
        .when(F.contains("__title", topic), 1.0)
        .when(overlap >= 0.5, 0.75)
        .otherwise(0.0)
    )
    n = F.size("__heads")
    semantic = count("__named", lambda x: has_key(x) | (jaccard(tokens(x), F.col("__topic")) > 0))
    generic = count("__named", lambda x: x.isin(*GENERIC_HEADERS))
    t = t.withColumns({"title_raw": title, "__semantic": semantic, "__generic": generic, "__n": n, "__m": F.size("__named"), "__distinct": F.size(F.array_distinct("__named"))})
    parts = 0.5 * F.col("__m") / F.col("__n") + 0.25 * F.col("__distinct") / F.col("__n") + 0.25 * F.col("__semantic") / F.col("__n") - 0.08 * F.col("__generic") / F.col("__n")
    header = F.when(F.col("__n") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), parts)))
    topic_hit = ((topic != "") & F.contains("__corpus", topic)) | (jaccard(tokens(F.col("__corpus")), F.col("__topic")) > 0)
    title_part = F.when((F.col("simple") | (F.col("__title") != "")) & topic_hit, 1.0).otherwise(0.45)
    keyword_part = F.when(F.size("__k") == 0, 0.7).otherwise(F.least(F.lit(1.0), count("__k", lambda k: F.contains("__corpus", k)) / 3))
    header_part = F.least(F.lit(1.0), count("__shown", has_key) / F.greatest(F.lit(1), F.least(F.lit(3), F.size("__shown"))))
    body_part = F.least(F.lit(1.0), count("__bodies", has_key) / F.greatest(F.lit(1), F.least(F.lit(4), F.size("__bodies"))))
    consistent = 0.25 * title_part + 0.35 * keyword_part + 0.25 * header_part + 0.15 * body_part
    one = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    t = t.withColumns({"header_raw": header, "topic_raw": consistent})
    errors = (F.col("__n") - F.col("__m")) + one(F.col("__n") == 0) + one(~F.col("simple") & (F.col("title_raw") <= 0)) + one(F.col("topic_raw") < 0.35)
    warnings = (
        one(F.col("simple") & (F.col("__title") != ""))
        + one(~F.col("simple") & (F.col("title_raw") == 0.75))
        + one(F.col("__distinct") < F.col("__m"))
        + one(F.col("__generic") > 0)
        + one((F.col("__n") > 0) & (F.col("__semantic") == 0) & (F.size("__k") > 0))
        + one((F.col("topic_raw") >= 0.35) & (F.col("topic_raw") < 0.6))
    )
    raw = ["title_raw", "header_raw", "topic_raw"]
    t = t.withColumns({"__errors": errors, "__warnings": warnings})
    plain = (*keep, *raw, "__errors", "__warnings")
    if told:
        t = t.withColumn("__whole", F.array_compact(F.array(*whole_messages())))
        t = t.withColumn("__whole", F.concat("__whole", bare_headers()))
    body = spread_body(t.select(TABLE, *plain, "cells", "__headers", "__first", *(["__whole"] if told else [])), *plain, whole="__whole" if told else None)
    body = body.withColumn("__s", F.when(F.col("ordinal").isNotNull(), score_cell(F.col("header"), F.col("text"))))
    issue = F.col("__s.issue")
    by = [TABLE, *[k for k in keep if k != TABLE]]
    listed = [F.first("whole", ignorenulls=True).alias("__whole"), F.collect_list(body_message(issue)).alias("__listed")] if told else []
    told_of = body.groupBy(*by).agg(
        *[F.first(c).alias(c) for c in (*raw, "__errors", "__warnings")],
        F.count("ordinal").alias("__bodies"),
        F.coalesce(F.avg("__s.score"), F.lit(1.0)).alias("body_raw"),
        F.count_if(issue.isin(*ERRORS)).alias("__body_errors"),
        F.count_if(issue.isNotNull() & ~issue.isin(*ERRORS)).alias("__body_warnings"),
        *listed,
    )
    r = lambda c: F.round(c + 1e-9, 4)
    score = r(0.18 * F.col("title_raw") + 0.27 * F.col("header_raw") + 0.40 * F.col("body_raw") + 0.15 * F.col("topic_raw"))
    told_of = told_of.withColumns({"score": score, "errors": (F.col("__errors") + F.col("__body_errors")).cast("long")})
    low = (F.col("errors") == 0) & (F.col("score") < MINIMUM)
    warned = F.col("__warnings") + F.col("__body_warnings") + (F.col("__bodies") == 0).cast("int") + low.cast("int")
    dims = [r(F.col(f"{d}_raw")).alias(f"{d}_score") for d in DIMENSIONS]
    out = [*by, *dims, "score", "errors", warned.cast("long").alias("warnings"), ((F.col("errors") == 0) & (F.col("score") >= MINIMUM)).alias("ok")]
    if not told:
        return told_of.select(*out)
    weak = F.when(low, message_at(6, F.lit(0), "warning", F.format_string("overall filling score %.3f below threshold %.3f", F.col("score") + 1e-9, F.lit(MINIMUM))))
    every = told_of.select(*out, F.array_sort(F.concat("__whole", "__listed", F.array_compact(F.array(weak)))).alias("__m"))
    of = lambda severity: F.transform(F.filter("__m", lambda x: x["severity"] == severity), lambda x, i: F.struct(x["severity"].alias("severity"), i.alias("seq"), x["message"].alias("message")))
    return every.withColumn("messages", F.concat(of("error"), of("warning"))).drop("__m")


def table_scores(cells: DataFrame, told: bool = False) -> DataFrame:
    """table_id, title_score, header_score, body_score, topic_score, score, errors, warnings, ok of every table.

    Cells have domain, topic, simple and, if wanted, scenario.  ``ok``: no errors and a score of 0.58 or more.  Body cells
    that are empty, or of another kind than their header asks for, are errors; those that only look odd are warnings.
    ``told``: adds ``messages`` (severity, seq, message), errors before warnings, each in the order found.
    """
    keep = ["domain", "topic", "simple", *(["scenario"] if "scenario" in cells.columns else [])]
    return scored_tables(folded(cells, *keep), told=told)


def phrase(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def message_at(phase: int, ordinal: Column, severity: str, message: Column) -> Column:
    return F.struct(F.lit(phase).alias("phase"), ordinal.cast("int").alias("ordinal"), F.lit(severity).alias("severity"), message.alias("message"))


def place_of(row: Column, col: Column) -> Column:
    return phrase("(", row.cast("string"), ", ", col.cast("string"), ")")


def whole_messages() -> list[Column]:
    """What is wrong with a table as a whole, from the columns that ``scored_tables`` has before it spreads the body."""
    one = lambda phase, n, severity, *parts: message_at(phase, F.lit(n), severity, phrase(*parts))
    simple, titled = F.col("simple"), F.col("__title") != ""
    title_score, topic_score = (F.round(F.col(f"{d}_raw") + 1e-9, 4) for d in ("title", "topic"))
    twice = F.col("__m") - F.col("__distinct")
    return [
        F.when(simple & titled, one(1, 0, "warning", "simple table unexpectedly contains a title row")),
        F.when(~simple & (F.size("__titles") == 0), one(1, 0, "error", "complex table is missing a title cell"))
        .when(~simple & ~titled, one(1, 0, "error", "complex table title is empty"))
        .when(~simple & (title_score == 0), one(1, 0, "error", "complex table title does not contain or align with the planned topic"))
        .when(~simple & (title_score == 0.75), one(1, 0, "warning", "complex table title is related to the planned topic but not exact")),
        F.when(F.col("__n") == 0, one(2, 0, "error", "table has no header cells")),
        F.when(twice > 0, one(3, 0, "warning", "header duplication detected in ", twice.cast("string"), " header cells")),
        F.when(F.col("__generic") > 0, one(3, 1, "warning", "generic header text detected in ", F.col("__generic").cast("string"), " header cells")),
        F.when((F.col("__n") > 0) & (F.col("__semantic") == 0) & (F.size("__k") > 0), one(3, 2, "warning", "headers do not contain topic or semantic scenario signals")),
        F.when(~F.exists("cells", lambda c: F.coalesce(c["role"] == "body", F.lit(False))), one(4, 0, "warning", "table has no body cells")),
        F.when(topic_score < 0.35, one(5, 0, "error", "table content is not aligned with the planned topic or semantic scenario")).when(topic_score < 0.6, one(5, 0, "warning", "weak topic or semantic scenario consistency")),
    ]


def bare_headers() -> Column:
    """A message for each header cell without a text."""
    bare = F.filter("cells", lambda c: (c["role"] == "header") & (F.trim(c["text"]) == ""))
    return F.transform(bare, lambda c: message_at(2, c["ordinal"], "error", phrase("empty header cell at ", place_of(c["row"], c["col"]))))


def body_message(issue: Column) -> Column:
    """The message on a spread body cell, null where it has no issue."""
    place = place_of(F.col("row"), F.col("col"))
    named = {
        "empty": ("error", phrase("empty body cell at ", place)),
        "percent": ("error", phrase("percentage-like column has non-percentage value at ", place)),
        "numeric": ("error", phrase("numeric-like column has non-numeric value at ", place)),
        "semantic_mismatch": ("warning", phrase("body cell at ", place, " does not match header '", F.col("header"), "'")),
        "weak_text": ("warning", phrase("body cell at ", place, " looks generic for header '", F.col("header"), "'")),
    }
    out = None
    for name, (severity, message) in named.items():
        one = message_at(4, F.col("ordinal"), severity, message)
        out = F.when(issue == name, one) if out is None else out.when(issue == name, one)
    return out


def messages(cells: DataFrame) -> DataFrame:
    """table_id, severity, seq, message: what is wrong with a table as texts, errors and warnings each in the order found.

    They are told in the pass that scores the tables.
    """
    return table_scores(cells, told=True).select(TABLE, F.inline_outer("messages")).where("severity IS NOT NULL")


def policy(scores: DataFrame, valid: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """structure, topic, semantic, overall, ranking, passed from table scores and validity (ok).

    ``model``: table_id, topic_model, semantic_model; a model's score that is there takes the place of the rule's.
    """
    t = scores.drop("ok").join(valid.select(TABLE, "ok"), TABLE)
    if model is not None:
        t = t.join(model.select(TABLE, "topic_model", "semantic_model"), TABLE, "left")
    else:
        none = F.lit(None).cast("double")
        t = t.withColumns({"topic_model": none, "semantic_model": none})
    t = t.select("*", F.when(F.col("ok"), 1.0).otherwise(0.0).alias("structure"), F.coalesce("topic_model", "topic_score").alias("topic"), F.coalesce("semantic_model", F.least("header_score", "body_score")).alias("semantic"))
    low = F.least("structure", "topic", "semantic")
    return t.select(
        TABLE,
        "structure",
        F.round(F.col("topic") + 1e-9, 4).alias("topic"),
        F.round(F.col("semantic") + 1e-9, 4).alias("semantic"),
        F.round(low + 1e-9, 4).alias("overall"),
        F.round(0.35 * F.col("structure") + 0.25 * F.col("topic") + 0.40 * F.col("semantic") + 1e-9, 4).alias("ranking"),
        (F.col("ok") & (F.col("errors") == 0) & (low >= MINIMUM)).alias("passed"),
    )


def select_best(candidates: DataFrame, request: str, key: str) -> DataFrame:
    """The best candidate of each request that passes and is no duplicate: ranking, overall, then the smaller key.

    An aggregate rather than a window: map-side partial, so a hot request is no bottleneck.  Without a column
    ``duplicate`` none is one.
    """
    fit = F.col("passed")
    if "duplicate" in candidates.columns:
        fit = fit & ~F.coalesce("duplicate", F.lit(False))
    best = candidates.where(fit).groupBy(request).agg(F.max(F.struct("ranking", "overall", (-F.col(key)).alias("__k"))).alias("b"))
    return best.select(request, (-F.col("b.__k")).alias(key), F.col("b.ranking").alias("ranking"), F.col("b.overall").alias("overall"))


def repair_decision(scores: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """table_id, action, cells, columns, codes: what to do about a table that does not pass.

    ``told``: ``messages``; without them the scores have a column of them.  Located messages name the cells to repair, errors
    before warnings, and their columns.
    """
    none = F.array().cast("array<struct<row:int,col:int>>")
    at = lambda message: F.struct(issue_location(message).alias("at"), issue_code(message).alias("code"))
    if told is None:
        t = scores.select(TABLE, "title_score", "header_score", F.transform("messages", lambda x: at(x["message"])).alias("m"))
    else:
        rank = F.when(F.col("severity") == "error", 0).otherwise(1)
        one = told.select(TABLE, F.struct(rank.alias("r"), "seq", at(F.col("message")).alias("m")).alias("m"))
        listed = one.groupBy(TABLE).agg(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["m"]).alias("m"))
        t = scores.select(TABLE, "title_score", "header_score").join(listed, TABLE, "left")
    where = F.transform(F.filter("m", lambda x: x["at"].isNotNull()), lambda x: x["at"])
    t = t.withColumns({"cells": F.coalesce(where, none), "codes": F.coalesce(F.transform("m", lambda x: x["code"]), F.array().cast("array<string>"))})
    action = F.when(F.col("title_score") <= 0, "rebuild_schema").when(F.col("header_score") <= 0, "repair_header").when(F.size("cells") > 0, "repair_cells").otherwise("repair_body")
    columns = F.array_sort(F.array_distinct(F.transform("cells", lambda x: x["col"])))
    t = t.withColumns({"action": action, "columns": columns})
    return t.select(TABLE, "action", F.when(F.col("action") == "repair_cells", F.col("cells")).otherwise(none).alias("cells"), F.when(F.col("action").isin("repair_cells", "repair_header"), F.col("columns")).otherwise(F.array().cast("array<int>")).alias("columns"), "codes")


def repair_action(scores: DataFrame, cells: DataFrame) -> DataFrame:
    """table_id, action, targets (how many cells): ``repair_decision`` in short."""
    return repair_decision(scores, None if "messages" in scores.columns else messages(cells)).select(TABLE, "action", F.size("cells").alias("targets"))


def structure_repair(valid: DataFrame) -> DataFrame:
    """table_id, action of tables that are not valid: their schema is always built anew."""
    return valid.where("NOT ok").select(TABLE, F.lit("rebuild_schema").alias("action"))


def low_dimensions(scores: DataFrame, limit: int = 3, below: float = 0.6) -> DataFrame:
    """table_id, low: the weakest dimensions as name:score, ascending."""
    return scores.select(TABLE, low_text(limit, below, 4).alias("low"))


def low_text(limit: int, below: float, places: int) -> Column:
    named = lambda d: "topic_consistency" if d == "topic" and places == 3 else d
    dims = F.array(*[F.struct(F.col(f"{d}_score").alias("s"), F.lit(i if places == 3 else 0).alias("i"), F.lit(named(d)).alias("d")) for i, d in enumerate(DIMENSIONS)])
    low = F.slice(F.array_sort(F.filter(dims, lambda x: x["s"] < below)), 1, limit)
    shown = (lambda x: F.format_string("%.3f", x["s"] + 1e-9)) if places == 3 else (lambda x: x["s"].cast("decimal(6,4)").cast("string"))
    return F.array_join(F.transform(low, lambda x: F.concat(x["d"], F.lit(":"), shown(x))), ",")


def error_texts(scores: DataFrame, told: DataFrame | None = None, most: int = 5) -> DataFrame:
    """table_id, error: one line on a table that failed: scores, low dimensions, then the first errors (else warnings).

    ``told``: ``messages``; without them the scores have a column of them.
    """
    if told is None:
        of = lambda severity: F.nullif(F.array_join(F.transform(F.filter("messages", lambda x: (x["severity"] == severity) & (x["seq"] < most)), lambda x: x["message"]), "; "), F.lit(""))
        t = scores.withColumns({"e": of("error"), "w": of("warning")})
    else:
        listed = told.where(F.col("seq") < most).groupBy(TABLE, "severity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda x: x["message"]), "; ").alias("t"))
        both = listed.groupBy(TABLE).agg(F.max(F.when(F.col("severity") == "error", F.col("t"))).alias("e"), F.max(F.when(F.col("severity") == "warning", F.col("t"))).alias("w"))
        t = scores.join(both, TABLE, "left")
    t = t.withColumn("__low", low_text(3, 0.6, 3))
    head = F.format_string("invalid table filling (score=%.3f, title=%.3f, header=%.3f, body=%.3f, topic_consistency=%.3f", *[F.col(c) + 1e-9 for c in ("score", "title_score", "header_score", "body_score", "topic_score")])
    low = F.when(F.col("__low") != "", F.concat(F.lit(", low_dimensions="), F.col("__low"))).otherwise("")
    return t.select(TABLE, F.concat(head, low, F.lit("): "), F.coalesce("e", "w", F.lit("no detailed filling issue reported"))).alias("error"))


def first_of_signature(pool: DataFrame, request: str, text: str, key: str) -> DataFrame:
    """Adds signature, duplicate and reason: whether an earlier row of the request has the same signature."""
    return with_duplicates(pool.withColumn("signature", F.sha2(F.col(text), 256)), request, key)


def with_duplicates(pool: DataFrame, request: str, key: str) -> DataFrame:
    """Adds duplicate and reason to rows with a signature: the first row of a request's signature wins.

    The first key of a signature is an aggregate, joined back, so a signature that many rows share is no hot window.
    """
    first = pool.groupBy(request, "signature").agg(F.min(key).alias("__first"))
    met = pool.join(first, [request, "signature"]).withColumn("duplicate", F.col(key) > F.col("__first")).drop("__first")
    return met.withColumn("reason", F.when(F.col("duplicate"), "duplicate_candidate"))
