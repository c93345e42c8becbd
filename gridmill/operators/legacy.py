"""The older generator of tables: random spans, column types, cell texts, missing cells, border styles, pages.

As in ``layouts`` every choice is a digest of seed, table and place; a table is built within its own row.  Where the older
generator draws until a draw fits, the first fitting one of TRIES is taken, then a fixed one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.operators.layouts import draw, one_of

# The border styles (name, css of table, td and th).
BORDERS = (
    ("border", "border:1px solid black;", "border:1px solid black;", "border:1px solid black;"),
    ("border_top", "border-top:1px solid black;", "border-top:1px solid black;", "border-top:1px solid black;"),
    ("border_bottom", "border-bottom:1px solid black;", "border-bottom:1px solid black;", "border-bottom:1px solid black;"),
    ("head_border_bottom", "", "", "border-bottom: 1px solid black;"),
    ("no_border", "", "", ""),
    ("border_left", "border-left:1px solid black;", "border-left:1px solid black;", "border-left:1px solid black;"),
    ("border_right", "border-right:1px solid black;", "border-right:1px solid black;", "border-right:1px solid black;"),
)
HEADER_ROWS, MOST_SPANS, LONGEST_SPAN, TRIES = 2, 3, 20, 4
SHORTEST_TEXT, LONGEST_TEXT = 2, 7
SPAN = "struct<start:int,length:int>"


def column_types(seed: str) -> Column:
    """n (numbers, 0.5), m (money, 0.1), c (Chinese, 0.3) or e (English, 0.1) for each column."""
    kind = lambda c: F.element_at(F.array(*map(F.lit, "nnnnnmccce")), (draw(seed, F.col("table_id"), "type", c) % 10 + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.col("cols") - 1), kind)


def spans(seed: str, what: str, size: Column, most: int = MOST_SPANS, longest: int = LONGEST_SPAN) -> Column:
    """Spans (start, length of 2 or more) that do not overlap, over ``size`` places: up to ``most`` distinct places are drawn,
    each with a length, from left to right; lengths of 1 and places that are covered already give none, and where as many
    places are drawn as there are, there is none at all.
    """
    key = F.col("table_id")
    count = (draw(seed, key, what, "count") % most + 1).cast("int")
    every = F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.struct(draw(seed, key, what, "place", i).alias("d"), i.alias("i"))))
    places = F.array_sort(F.transform(F.slice(every, 1, count), lambda x: x["i"]))
    length = lambda i: (draw(seed, key, what, "length", i) % F.least(size - i, F.lit(longest)) + 1).cast("int")
    drawn = F.transform(F.filter(places, lambda i: size - i >= 2), lambda i: F.struct(i.cast("int").alias("start"), length(i).alias("length")))

    def step(held, x):
        last = F.try_element_at(held, F.lit(-1))
        free = F.coalesce(last["start"] + last["length"] <= x["start"], F.lit(True)) & (x["length"] > 1)
        return F.when(free, F.concat(held, F.array(x))).otherwise(held)

    none = F.array().cast(f"array<{SPAN}>")
    return F.when((size < 1) | (count >= size), none).otherwise(F.aggregate(drawn, none, step))


def span_layout(tables: DataFrame, seed: str) -> DataFrame:
    """Adds heads (column spans of the first row, never none from two columns on), sides (row spans of the first column below
    the two header rows) and types to tables (table_id, rows, cols).
    """
    tries = [spans(seed, f"head{k}", F.col("cols")) for k in range(TRIES)]
    heads = F.lit(None)
    for x in reversed(tries):
        heads = F.when(F.size(x) > 0, x).otherwise(heads)
    fixed = F.when(F.col("cols") >= 2, F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("length")))).otherwise(F.array().cast(f"array<{SPAN}>"))
    sides = F.transform(spans(seed, "side", F.col("rows") - HEADER_ROWS), lambda x: F.struct((x["start"] + HEADER_ROWS).cast("int").alias("start"), x["length"].alias("length")))
    return tables.withColumns({"types": column_types(seed), "heads": F.coalesce(heads, fixed), "sides": sides})


def missing_cells(tables: DataFrame, seed: str) -> DataFrame:
    """table_id, row, col of cells without a text: as many draws as the whole logarithm of rows * cols to base 2.

    Both places are bound by the number of rows, as in the older generator, so a column may lie outside of the table.
    """
    return tables.select("table_id", F.inline(missing_of(seed))).distinct()


def missing_of(seed: str) -> Column:
    """The places (row, col) that ``missing_cells`` draws for a table, some of them twice; empty where it draws none."""
    n = F.floor(F.log2((F.col("rows") * F.col("cols")).cast("double")) + 1e-12).cast("int")
    unit = lambda what, i: draw(seed, F.col("table_id"), what, i) / F.lit(float(1 << 32))
    row = lambda i: ((F.col("rows") - 1 - HEADER_ROWS) * unit("missing row", i) + HEADER_ROWS).cast("int")
    col = lambda i: ((F.col("rows") - 1) * unit("missing col", i)).cast("int")
    drawn = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(row(i).alias("row"), col(i).alias("col")))
    return F.when(n >= 1, drawn).otherwise(F.array().cast("array<struct<row:int,col:int>>"))


def number_text(seed: str, *keys) -> Column:
    """A number below 10, 100, 1000 or 10000: half with two decimals, a third whole, the rest cut after some digits."""
    top = F.element_at(F.array(F.lit(10), F.lit(100), F.lit(1000), F.lit(10000)), (draw(seed, *keys, "top") % 4 + 1).cast("int"))
    x = draw(seed, *keys, "number") / F.lit(float(1 << 32)) * top
    way = draw(seed, *keys, "way") % 100
    digits = F.length(top.cast("string")) + (draw(seed, *keys, "digits") % 4).cast("int")
    return F.when(way < 50, F.format_string("%.2f", x)).when(way < 85, F.format_string("%.0f", x)).otherwise(F.substring(F.format_string("%.9f", x), F.lit(1), digits))


def piece(text: str, seed: str, *keys) -> Column:
    """A piece of a corpus text of 2 to 7 characters."""
    length = (draw(seed, *keys, "text length") % (LONGEST_TEXT - SHORTEST_TEXT + 1) + SHORTEST_TEXT).cast("int")
    start = (draw(seed, *keys, "text start") % (len(text) - length + 1)).cast("int")
    return F.substring(F.lit(text), start + 1, length)


def cells(tables: DataFrame, seed: str, chinese: str, english: str) -> DataFrame:
    """table_id, rows, cols, ordinal, row, col, rowspan, colspan, tag, role, text of tables (table_id, rows, cols).

    ``chinese`` and ``english``: the corpora that texts are cut from, each of LONGEST_TEXT characters or more.
    """
    t = span_layout(tables, seed).withColumn("missing", missing_of(seed))
    spot = t.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    row, col = F.col("row"), F.col("col")
    over = lambda a, at: F.exists(a, lambda x: (x["start"] <= at) & (at < x["start"] + x["length"]))
    of = lambda a, at: F.get(F.filter(a, lambda x: x["start"] == at), F.lit(0))["length"]
    tall = F.least(F.lit(HEADER_ROWS), F.col("rows"))
    rowspan = F.when(row == 0, F.when(over("heads", col), 1).otherwise(tall)).when((row == 1), F.when(over("heads", col), 1).otherwise(0)).when(col == 0, F.when(over("sides", row), F.coalesce(of("sides", row), F.lit(0))).otherwise(1)).otherwise(1)
    colspan = F.when(row == 0, F.when(over("heads", col), F.coalesce(of("heads", col), F.lit(0))).otherwise(1)).otherwise(1)
    spot = spot.withColumns({"rowspan": rowspan.cast("int"), "colspan": colspan.cast("int")}).where("rowspan > 0 AND colspan > 0")
    head = (row < HEADER_ROWS) | (col == 0)
    gone = F.coalesce(F.exists("missing", lambda x: (x["row"] == row) & (x["col"] == col)), F.lit(False)) & (F.col("rowspan") == 1) & (F.col("colspan") == 1)
    kind = F.when(gone, "t").when(row < HEADER_ROWS, "c").otherwise(F.get("types", col))
    keys = (F.col("table_id"), row, col)
    kind = F.when(col == 0, F.when(draw(seed, *keys, "first") % 2 == 0, "c").otherwise("e")).otherwise(kind)
    own = piece(english, seed, *keys)
    upper = F.when(draw(seed, *keys, "upper") % 2 == 0, F.concat(F.upper(F.substring(own, 1, 1)), F.substring(own, 2, LONGEST_TEXT))).otherwise(own)
    number = number_text(seed, *keys)
    text = F.when(kind == "t", "").when(kind == "n", number).when(kind == "m", F.concat(F.lit("$"), number)).when(kind == "e", upper).otherwise(piece(chinese, seed, *keys))
    ordinal = (row * F.col("cols") + col).cast("int")
    return spot.select("table_id", "rows", "cols", ordinal.alias("ordinal"), "row", "col", "rowspan", "colspan", F.when(head, "th").otherwise("td").alias("tag"), F.when(head, "header").otherwise("body").alias("role"), text.alias("text"))


def page_styles(tables: DataFrame, seed: str) -> DataFrame:
    """table_id, name, table_css, cell_css, header_css: one of seven borders; texts to the left or right (0.25 each) or centred;
    half of the tables with their cells in the middle.
    """
    pick = (draw(seed, F.col("table_id"), "border") % len(BORDERS) + 1).cast("int")
    of = lambda k: F.element_at(F.array(*[F.lit(b[k]) for b in BORDERS]), pick)
    align = one_of(("left", "right", "center", "center"), draw(seed, F.col("table_id"), "align"))
    middle = F.when(draw(seed, F.col("table_id"), "middle") % 2 == 0, "align: center;valign: middle;").otherwise("")
    return tables.select(
        "table_id",
        of(0).alias("name"),
        F.concat(F.lit("text-align:"), align, F.lit(";border-collapse:collapse;"), of(1)).alias("table_css"),
        F.concat(middle, F.lit("word-break:break-all;"), of(2)).alias("cell_css"),
        F.concat(F.lit("padding:6px;padding-left: 15px;padding-right: 15px;"), of(3)).alias("header_css"),
    )
