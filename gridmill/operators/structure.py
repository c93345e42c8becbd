"""Grid structure: occupancy, validation, signatures, regions, layout rewrites, markup.

Cells: table_id, rows, cols, ordinal, row, col, rowspan, colspan, tag, role, text and, where cells are styled, visual
(a map).  ``folded`` gathers a table into one row, its cells an array in their order; what concerns one table is then
an expression over that row, so a chain of such steps costs the one exchange by table_id.  Names that begin with two
underscores are the engine's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.text import escaped, normalized

TABLE = "table_id"
#: Position, span and extent of a cell along each axis.
AXES = {"row": ("row", "rowspan", "rows"), "column": ("col", "colspan", "cols")}
FIELDS = ("ordinal", "row", "col", "rowspan", "colspan", "tag", "role", "text", "visual")


def axis_names(axis: str) -> tuple[str, str, str]:
    if axis not in AXES:
        raise ValueError("axis must be 'row' or 'column'")
    return AXES[axis]


def folded(cells: DataFrame, *keep: str, by: tuple[str, ...] = (TABLE,)) -> DataFrame:
    """One row a table: rows, cols, the first value of each column to keep, and ``cells``, sorted by ordinal."""
    one = [F.map_entries(c).alias(c) if c == "visual" else F.col(c) for c in FIELDS if c in cells.columns]
    return cells.groupBy(*by).agg(F.max("rows").alias("rows"), F.max("cols").alias("cols"), *[F.first(k).alias(k) for k in keep], F.array_sort(F.collect_list(F.struct(*one))).alias("cells"))


def folded_whole(cells: DataFrame) -> DataFrame:
    """One row a table: ``cells``, sorted by ordinal, with all columns but table_id as they are (maps never order cells)."""
    rest = [c for c in cells.columns if c != TABLE]
    held = F.collect_list(F.struct(*rest))
    first = [c for c in FIELDS if c in rest and c != "visual"]
    key = lambda c: F.struct(*[c[k].alias(k) for k in first])
    placed = F.array_sort(F.transform("cells", lambda c, i: F.struct(key(c).alias("k"), i.alias("i"))))
    out = cells.groupBy(TABLE).agg(held.alias("cells"))
    return out.select(TABLE, F.transform(placed, lambda x: F.get(F.col("cells"), x["i"])).alias("cells"))


def unfolded(tables: DataFrame, *keep: str) -> DataFrame:
    """A row a cell again: the columns to keep, rows, cols, and the fields of the cells."""
    out = tables.select(*keep, "rows", "cols", F.inline("cells"))
    return out.withColumn("visual", F.map_from_entries("visual")) if "visual" in out.columns else out


# --- occupancy and validation ------------------------------------------------------------------------------


def fault_of(c, rows, cols) -> Column:
    """The first of the checks on a cell alone that fails, else null; ``c`` gives its fields by name."""
    return (
        F.when((c["row"] < 0) | (c["col"] < 0), "negative_position")
        .when((c["rowspan"] < 1) | (c["colspan"] < 1), "invalid_span")
        .when((c["row"] + c["rowspan"] > rows) | (c["col"] + c["colspan"] > cols), "out_of_range")
    )


def slots(cells: DataFrame) -> DataFrame:
    """One row for each grid slot that a cell covers: slot_row, slot_col."""
    placed = cells.where((F.col("rowspan") >= 1) & (F.col("colspan") >= 1))
    down = placed.withColumn("slot_row", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1)))
    return down.withColumn("slot_col", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)))


def with_slots(tables: DataFrame) -> DataFrame:
    """Adds to folded tables ``__slots`` (slot, ordinal, row, col of all slots that sound cells cover) and ``__sound``: whether
    nothing is wrong, which sound cells that cover each slot exactly once show.
    """
    rows, cols = F.col("rows"), F.col("cols")
    across = lambda c, r: F.transform(F.sequence(c["col"], c["col"] + c["colspan"] - 1), lambda k: F.struct((r.cast("long") * cols + k).alias("slot"), c["ordinal"].alias("ordinal"), r.alias("row"), k.alias("col")))
    covered = lambda c: F.flatten(F.transform(F.sequence(c["row"], c["row"] + c["rowspan"] - 1), lambda r: across(c, r)))
    fine = F.filter("cells", lambda c: fault_of(c, rows, cols).isNull())
    found = tables.withColumn("__slots", F.flatten(F.transform(fine, covered)))
    n = F.size("__slots")
    whole = (n == rows * cols) & (F.size(F.array_distinct(F.col("__slots.slot"))) == n)
    return found.withColumn("__sound", whole & ~F.exists("cells", lambda c: fault_of(c, rows, cols).isNotNull()))


def sound_of(cells, rows, cols) -> Column:
    """Whether nothing is wrong with a table: ``__sound`` of ``with_slots`` without the slots, each part worked out once and only
    where those before it hold.
    """
    area = F.aggregate(cells, F.lit(0).cast("long"), lambda n, c: n + c["rowspan"].cast("long") * c["colspan"])
    across = lambda c, r: F.transform(F.sequence(c["col"], c["col"] + c["colspan"] - 1), lambda k: r.cast("long") * cols + k)
    covered = F.flatten(F.transform(cells, lambda c: F.flatten(F.transform(F.sequence(c["row"], c["row"] + c["rowspan"] - 1), lambda r: across(c, r)))))
    size = rows.cast("long") * cols
    return F.when(F.exists(cells, lambda c: fault_of(c, rows, cols).isNotNull()), False).when(area != size, False).otherwise(F.size(F.array_distinct(covered)) == size)


def issues_of(tables: DataFrame) -> DataFrame:
    """Adds ``issues`` (code, ordinal, row, col) to tables of ``with_slots``; of an overlap the first cell keeps the slot.

    Rows not covered are told only of tables without placement issues.  All steps are linear in a table's slots, but for
    the sorting, and only tables that are not sound take them.
    """
    rows, cols = F.col("rows"), F.col("cols")
    issue = lambda code, ordinal, row, col: F.struct((code if isinstance(code, Column) else F.lit(code)).alias("code"), ordinal.cast("int").alias("ordinal"), row.cast("int").alias("row"), col.cast("int").alias("col"))
    none = F.lit(None)
    bad = tables.withColumn("__sorted", F.when(~F.col("__sound"), F.array_sort("__slots")))
    alone = F.transform(F.filter("cells", lambda c: fault_of(c, rows, cols).isNotNull()), lambda c: issue(fault_of(c, rows, cols), c["ordinal"], c["row"], c["col"]))
    again = F.filter("__sorted", lambda x, i: (i > 0) & (F.get(F.col("__sorted"), i - 1)["slot"] == x["slot"]))
    bad = bad.withColumn("__placed", F.when(~F.col("__sound"), F.concat(alone, F.transform(again, lambda x: issue("overlap", x["ordinal"], x["row"], x["col"])))))
    # Slots are distinct where there is no placement issue: the first slot of each row tells how many the row before has.
    firsts = F.filter(F.transform("__sorted", lambda x, i: F.struct(x["row"].alias("row"), i.alias("at"), ((i == 0) | (F.coalesce(F.get(F.col("__sorted"), i - 1)["row"], F.lit(-1)) != x["row"])).alias("new"))), lambda y: y["new"])
    open_ = ~F.col("__sound") & (F.size("__placed") == 0)
    bad = bad.withColumn("__firsts", F.when(open_, firsts))
    ends = F.transform("__firsts", lambda y, i: F.struct(y["row"].alias("row"), (F.coalesce(F.get(F.col("__firsts"), i + 1)["at"], F.size("__sorted")) - y["at"]).alias("n")))
    short = F.transform(F.filter(ends, lambda y: y["n"] < cols), lambda y: y["row"].cast("int"))
    bare = F.array_except(F.sequence(F.lit(0), rows - 1), F.transform("__firsts", lambda y: y["row"].cast("int")))
    gaps = F.transform(F.concat(short, bare), lambda r: issue("uncovered_row", none, r, none))
    out = bad.withColumn("issues", F.when(F.col("__sound"), F.array().cast("array<struct<code:string,ordinal:int,row:int,col:int>>")).when(open_, gaps).otherwise(F.col("__placed")))
    return out.drop("__slots", "__sorted", "__placed", "__firsts")


def checked(cells: DataFrame, *keep: str) -> DataFrame:
    return issues_of(with_slots(folded(cells, *keep)))


def row_coverage(cells: DataFrame) -> DataFrame:
    """table_id, row, covered, cols of every row of every table."""
    t = with_slots(folded(cells))
    each = F.transform(F.array_distinct(F.transform("__slots", lambda x: F.struct(x["row"].cast("int").alias("row"), x["col"].alias("col")))), lambda x: F.struct(x["row"].alias("row"), F.lit(1).alias("one")))
    bare = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.struct(r.alias("row"), F.lit(0).alias("one")))
    return t.select(TABLE, "cols", F.inline(F.concat(bare, each))).groupBy(TABLE, "row").agg(F.sum("one").alias("covered"), F.first("cols").alias("cols"))


def validate(cells: DataFrame) -> DataFrame:
    """table_id, code, ordinal, row, col of all issues."""
    # An outer generator: of an inner one Spark would infer a filter and work the issues out once more for it.
    return checked(cells).select(TABLE, F.inline_outer("issues")).where("code IS NOT NULL")


def validity(cells: DataFrame) -> DataFrame:
    """table_id, ok, issues."""
    return checked(cells).select(TABLE, F.col("__sound").alias("ok"), F.size("issues").cast("long").alias("issues"))


def valid_cells(cells: DataFrame) -> DataFrame:
    """Cells of the tables that ``validate`` finds nothing against."""
    rest = [c for c in cells.columns if c != TABLE]
    held = cells.where(F.col(TABLE).isNotNull()).groupBy(TABLE).agg(F.max("rows").alias("rows"), F.max("cols").alias("cols"), F.collect_list(F.struct(*rest)).alias("cells"))
    return held.where(sound_of(F.col("cells"), F.col("rows"), F.col("cols"))).select(TABLE, F.inline("cells")).select(cells.columns)


def valid_tables(cells: DataFrame) -> DataFrame:
    """table_id, rows, cols, cells (in no order) of the tables that ``validate`` finds nothing against."""
    one = [c for c in FIELDS if c in cells.columns]
    held = cells.where(F.col(TABLE).isNotNull()).groupBy(TABLE).agg(F.max("rows").alias("rows"), F.max("cols").alias("cols"), F.collect_list(F.struct(*one)).alias("cells"))
    return held.where(sound_of(F.col("cells"), F.col("rows"), F.col("cols")))


def table_facts(cells: DataFrame) -> DataFrame:
    """table_id, cells, has_rowspan, has_colspan, next_ordinal."""
    return cells.groupBy(TABLE).agg(F.count(F.lit(1)).alias("cells"), F.bool_or(F.col("rowspan") > 1).alias("has_rowspan"), F.bool_or(F.col("colspan") > 1).alias("has_colspan"), (F.max("ordinal") + 1).alias("next_ordinal"))


def signature(cells: DataFrame) -> DataFrame:
    """table_id, signature: tag[row,col](rowspan,colspan) in the order of the grid."""
    one = F.format_string("%s[%d,%d](%d,%d)", "tag", "row", "col", "rowspan", "colspan")
    listed = F.array_sort(F.collect_list(F.struct("row", "col", "ordinal", one.alias("s"))))
    return cells.groupBy(TABLE).agg(F.array_join(F.transform(listed, lambda x: x["s"]), "|").alias("signature"))


def json_text(text: Column) -> Column:
    """A JSON string of a text, everything above ASCII as it is."""
    array = F.to_json(F.array(text))
    return array.substr(F.lit(2), F.length(array) - 2)


def canonical_json(cells, rows, cols, header_type) -> Column:
    """One canonical text of structure and content of a table: keys in order of the alphabet, cells by row, column, role and
    tag, texts normalised, ordinals left out.
    """
    ordered = F.array_sort(F.transform(cells, lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), c["role"].alias("role"), c["tag"].alias("tag"), c["ordinal"].alias("ordinal"), c["rowspan"].alias("rowspan"), c["colspan"].alias("colspan"), c["text"].alias("text"), c["visual"].alias("visual"))))
    visual = lambda v: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.coalesce(v, F.array().cast("array<struct<key:string,value:string>>"))), lambda e: F.concat(json_text(e["key"]), F.lit(":"), json_text(e["value"]))), ","), F.lit("}"))
    number = lambda name, x: F.concat(F.lit(f'"{name}":'), x.cast("string"))
    string = lambda name, x: F.concat(F.lit(f'"{name}":'), json_text(x))
    cell = lambda c: F.concat(F.lit("{"), F.concat_ws(",", number("col", c["col"]), number("colspan", c["colspan"]), string("role", c["role"]), number("row", c["row"]), number("rowspan", c["rowspan"]), string("tag", c["tag"]), string("text", normalized(F.coalesce(c["text"], F.lit("")))), F.concat(F.lit('"visual":'), visual(c["visual"]))), F.lit("}"))
    return F.concat(F.lit('{"cells":['), F.array_join(F.transform(ordered, cell), ","), F.lit('],'), number("cols", cols), F.lit(","), string("header_type", header_type), F.lit(","), number("rows", rows), F.lit("}"))


def with_visual(cells: DataFrame) -> DataFrame:
    """Cells with a visual map, an empty one where they have none."""
    empty = F.create_map().cast("map<string,string>")
    return cells.withColumn("visual", F.coalesce("visual", empty) if "visual" in cells.columns else empty)


def content_signature(cells: DataFrame, header_type: str = "header_type") -> DataFrame:
    """table_id, signature: SHA-256 of the canonical text of a table; ``header_type``: a column of the cells."""
    t = folded(with_visual(cells), header_type)
    return t.select(TABLE, F.sha2(canonical_json(F.col("cells"), F.col("rows"), F.col("cols"), F.col(header_type)), 256).alias("signature"))


# --- regions -----------------------------------------------------------------------------------------------


def boundaries(axis: str) -> Column:
    """Of a folded table: the boundaries along an axis that no cell spans, ascending."""
    at, span, limit = axis_names(axis)
    inner = F.flatten(F.transform(F.filter("cells", lambda c: c[span] > 1), lambda c: F.sequence(c[at] + 1, c[at] + c[span] - 1)))
    return F.array_except(F.sequence(F.lit(0), F.col(limit)), inner)


def with_blocks(tables: DataFrame, axis: str) -> DataFrame:
    """Adds to folded tables __safe_AXIS and __held_AXIS: blocks (start, size) between neighbouring safe boundaries with a body
    cell and no title, and those with any cell.
    """
    at, _, limit = axis_names(axis)
    edge, of = f"__edge_{axis}", f"__of_{axis}"
    t = tables.withColumn(edge, boundaries(axis))
    begins = F.transform(F.sequence(F.lit(0), F.col(limit) - 1), lambda p: F.array_max(F.filter(F.col(edge), lambda x: x <= p)))
    t = t.withColumn(of, begins)
    starts = lambda cond: F.array_distinct(F.transform(F.filter("cells", cond), lambda c: F.get(F.col(of), c[at])))
    blocks = F.transform(F.sequence(F.lit(1), F.size(edge) - 1), lambda i: F.struct(F.get(F.col(edge), i - 1).alias("start"), (F.get(F.col(edge), i) - F.get(F.col(edge), i - 1)).alias("size")))
    t = t.withColumns({"__blocks": blocks, "__body": starts(lambda c: c["role"] == "body"), "__title": starts(lambda c: c["role"] == "title"), "__any": starts(lambda c: F.lit(True))})
    safe = F.filter("__blocks", lambda b: F.array_contains("__body", b["start"]) & ~F.array_contains("__title", b["start"]))
    held = F.filter("__blocks", lambda b: F.array_contains("__any", b["start"]))
    return t.withColumns({f"__safe_{axis}": safe, f"__held_{axis}": held}).drop(edge, of, "__blocks", "__body", "__title", "__any")


def safe_regions(cells: DataFrame, axis: str = "row") -> DataFrame:
    """table_id, start, size of blocks between neighbouring safe boundaries that hold a body cell and no title."""
    return with_blocks(folded(cells), axis).select(TABLE, F.inline_outer(f"__safe_{axis}")).where("start IS NOT NULL")


def region_errors(cells: DataFrame, regions: DataFrame, axis: str, action: str = "copy") -> DataFrame:
    """table_id, start, size, error: what forbids to copy, delete or alter a region, null if nothing does.

    ``regions``: table_id, start, size; ``start`` and ``size`` are positions along the axis.
    """
    _, _, limit = axis_names(axis)
    t = folded(cells).withColumn("__edge", boundaries(axis)).join(regions.select(TABLE, F.col("start").alias("__start"), F.col("size").alias("__size")), TABLE)
    start, end = F.col("__start"), F.col("__start") + F.col("__size")
    named = F.concat(F.lit(f"{axis} region ["), start.cast("string"), F.lit(", "), end.cast("string"), F.lit(")"))
    at, span, _ = axis_names(axis)
    held = F.exists("cells", lambda c: (c[at] >= start) & (c[at] + c[span] <= end))
    error = (
        F.when(F.col("__size") < 1, "region count must be positive")
        .when((start < 0) | (end > F.col(limit)), F.concat(named, F.lit(" is out of range")))
        .when(~F.array_contains("__edge", start) | ~F.array_contains("__edge", end), F.concat(named, F.lit(" splits a spanning cell")))
        .when(F.lit(action == "delete") & (F.col("__size") >= F.col(limit)), "cannot delete the entire table")
        .when(F.lit(action == "alter") & ~held, F.concat(F.lit("row block ["), start.cast("string"), F.lit(", "), end.cast("string"), F.lit(") has no independently alterable cells")))
    )
    return t.select(TABLE, start.alias("start"), F.col("__size").alias("size"), error.alias("error"))


def with_region(cells: DataFrame, regions: DataFrame, axis: str) -> DataFrame:
    """Cells of the tables that have a region (start, size): adds __start, __size and __inside."""
    at, span, _ = axis_names(axis)
    own = cells.join(regions.select(TABLE, F.col("start").alias("__start"), F.col("size").alias("__size")), TABLE)
    return own.withColumn("__inside", (F.col(at) >= F.col("__start")) & (F.col(at) + F.col(span) <= F.col("__start") + F.col("__size")))


def copy_region(cells: DataFrame, regions: DataFrame, axis: str = "row") -> DataFrame:
    """Repeat a block behind itself; clones get new ordinals after all others.  Regions must be sound (``region_errors``)."""
    at, _, limit = axis_names(axis)
    own = with_region(cells, regions, axis)
    size, end = F.col("__size"), F.col("__start") + F.col("__size")
    moved = own.withColumn(at, F.when(F.col(at) >= end, F.col(at) + size).otherwise(F.col(at)))
    whole = Window.partitionBy(TABLE)
    numbered = own.withColumn("__next", F.max("ordinal").over(whole) + 1).where("__inside")
    clones = numbered.withColumn(at, F.col(at) + size).withColumn("ordinal", (F.col("__next") + F.row_number().over(whole.orderBy("ordinal")) - 1).cast("int")).drop("__next")
    return moved.unionByName(clones).withColumn(limit, F.col(limit) + size).select(cells.columns)


def delete_region(cells: DataFrame, regions: DataFrame, axis: str = "row") -> DataFrame:
    """Take out a block, unless it is the whole table."""
    at, _, limit = axis_names(axis)
    own = with_region(cells, regions, axis).where(F.col("__size") < F.col(limit))
    end = F.col("__start") + F.col("__size")
    kept = own.where("NOT __inside").withColumn(at, F.when(F.col(at) >= end, F.col(at) - F.col("__size")).otherwise(F.col(at)))
    return kept.withColumn(limit, F.col(limit) - F.col("__size")).select(cells.columns)


def swapped_position(p: Column, start, size, start2, size2) -> Column:
    """Where a position goes when two blocks, the first before the second, change places."""
    return (
        F.when((p >= start) & (p < start + size), p + start2 - start + size2 - size)
        .when((p >= start2) & (p < start2 + size2), p - start2 + start)
        .when((p >= start + size) & (p < start2), p + size2 - size)
        .otherwise(p)
    )


def swap_regions(cells: DataFrame, pairs: DataFrame, axis: str = "row") -> DataFrame:
    """Exchange two blocks that do not overlap: ``pairs`` has start, size, start2, size2, in any order of the two."""
    at, _, _ = axis_names(axis)
    turned = F.col("start") > F.col("start2")
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    pairs = pairs.select(TABLE, pick("start", "start2").alias("__start"), pick("size", "size2").alias("__size"), pick("start2", "start").alias("__start2"), pick("size2", "size").alias("__size2"))
    own = cells.join(pairs.where("__start + __size <= __start2"), TABLE)
    return own.withColumn(at, swapped_position(F.col(at), *map(F.col, ("__start", "__size", "__start2", "__size2"))).cast("int")).select(cells.columns)


def swap_cells(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exchange texts and visuals of two 1x1 cells: ``pairs`` has a, b (ordinals); other tables are left out."""
    own = cells.join(pairs.select(TABLE, F.col("a").alias("__one"), F.col("b").alias("__two")), TABLE)
    plain = (F.col("rowspan") == 1) & (F.col("colspan") == 1)
    whole = Window.partitionBy(TABLE)
    what = [c for c in ("text", "visual") if c in cells.columns]
    held = F.struct(*what)
    of = lambda c: F.first(F.when((F.col("ordinal") == F.col(c)) & plain, held), ignorenulls=True).over(whole)
    own = own.withColumn("__a", of("__one")).withColumn("__b", of("__two")).where("__a IS NOT NULL AND __b IS NOT NULL")
    swap = lambda c: F.when(F.col("ordinal") == F.col("__one"), F.col(f"__b.{c}")).when(F.col("ordinal") == F.col("__two"), F.col(f"__a.{c}")).otherwise(F.col(c))
    return own.withColumns({c: swap(c) for c in what}).select(cells.columns)


def alter_background(cells: DataFrame, regions: DataFrame, color: str, axis: str = "row") -> DataFrame:
    """Cells with visual: inside the region the background colour is set, all else stays."""
    own = with_region(with_visual(cells), regions, axis)
    rest = F.map_filter("visual", lambda k, v: k != "background-color")
    visual = F.when(F.col("__inside"), F.map_concat(rest, F.create_map(F.lit("background-color"), F.lit(color)))).otherwise(F.col("visual"))
    return own.withColumn("visual", visual).select(*[c for c in cells.columns if c != "visual"], "visual")


COLOR = "#f2f6fa"


def augmented(cells: DataFrame, limit: int = 4, *keep: str, by: tuple[str, ...] = (TABLE,), parent: bool = False, slots: bool = True) -> DataFrame:
    """Folded descendants of each table: the columns of ``by`` and to keep, transformation, axis, start, size, start2, size2 (the
    parameters), rows, cols, cells, and __sound, __slots of the new table.

    In this order, up to ``limit``: the last safe body block of rows (else of columns) copied; the same deleted; the first
    and the last such block exchanged (rows, else columns, else the first and last 1x1 body cell); the last such block of
    rows, else the last of any rows, recoloured.  A step that finds nothing to work on gives no row.  One expression over
    each table's row: no join, no exchange beyond that of folding.  ``parent``: the table itself comes first, its
    transformation an empty text.  ``slots``: whether __sound and __slots are wanted.
    """
    t = with_blocks(with_blocks(folded(with_visual(cells), *keep, by=by), "row"), "column")
    rows, cols = F.col("rows"), F.col("cols")
    on = lambda axis: (F.col(f"__safe_{axis}"), *AXES[axis])
    last = lambda a: F.get(a, F.size(a) - 1)
    null = F.lit(None).cast("int")

    def variant(name, axis, first, second, rows_, cols_, cells_):
        at = lambda b, f: b[f].cast("int") if b is not None else null
        return F.struct(F.lit(name).alias("transformation"), F.lit(axis).alias("axis"), at(first, "start").alias("start"), at(first, "size").alias("size"), at(second, "start").alias("start2"), at(second, "size").alias("size2"), rows_.cast("int").alias("rows"), cols_.cast("int").alias("cols"), cells_.alias("cells"))

    def extent(axis, change):
        return (rows + change, cols) if axis == "row" else (rows, cols + change)

    def copied(axis):
        safe, at, span, _ = on(axis)
        b = last(safe)
        end = b["start"] + b["size"]
        base = F.transform("cells", lambda c: c.withField(at, F.when(c[at] >= end, c[at] + b["size"]).otherwise(c[at])))
        top = F.array_max(F.transform("cells", lambda c: c["ordinal"])) + 1
        clones = F.transform(F.filter("cells", lambda c: (c[at] >= b["start"]) & (c[at] + c[span] <= end)), lambda c, i: c.withField(at, c[at] + b["size"]).withField("ordinal", (top + i).cast("int")))
        return F.size(safe) > 0, variant("copy", axis, b, None, *extent(axis, b["size"]), F.concat(base, clones))

    def deleted(axis):
        safe, at, span, extent_ = on(axis)
        b = last(safe)
        end = b["start"] + b["size"]
        kept = F.filter("cells", lambda c: ~((c[at] >= b["start"]) & (c[at] + c[span] <= end)))
        return F.size(safe) > 0, F.when(b["size"] < F.col(extent_), variant("delete", axis, b, None, *extent(axis, -b["size"]), F.transform(kept, lambda c: c.withField(at, F.when(c[at] >= end, c[at] - b["size"]).otherwise(c[at])))))

    def swapped(axis):
        safe, at, _, _ = on(axis)
        a, b = F.get(safe, F.lit(0)), last(safe)
        return F.size(safe) >= 2, variant("swap", axis, a, b, rows, cols, F.transform("cells", lambda c: c.withField(at, swapped_position(c[at], a["start"], a["size"], b["start"], b["size"]).cast("int"))))

    def swapped_cells():
        plain = F.filter("cells", lambda c: (c["role"] == "body") & (c["rowspan"] == 1) & (c["colspan"] == 1))
        a, b = F.get(plain, F.lit(0)), last(plain)
        put = lambda c, x: c.withField("text", x["text"]).withField("visual", x["visual"])
        return F.size(plain) >= 2, variant("swap", "cell_block", None, None, rows, cols, F.transform("cells", lambda c: F.when(c["ordinal"] == a["ordinal"], put(c, b)).when(c["ordinal"] == b["ordinal"], put(c, a)).otherwise(c)))

    def altered():
        safe, held = F.col("__safe_row"), F.col("__held_row")
        b = F.when(F.size(safe) > 0, last(safe)).otherwise(last(held))
        inside = lambda c: (c["row"] >= b["start"]) & (c["row"] + c["rowspan"] <= b["start"] + b["size"])
        paint = lambda c: c.withField("visual", F.concat(F.filter(c["visual"], lambda e: e["key"] != "background-color"), F.array(F.struct(F.lit("background-color").alias("key"), F.lit(COLOR).alias("value")))))
        return b.isNotNull(), variant("alter", "row", b, None, rows, cols, F.transform("cells", lambda c: F.when(inside(c), paint(c)).otherwise(c)))

    def first_of(*choices):
        out = None
        for fits, made in choices:
            out = F.when(fits, made) if out is None else out.when(fits, made)
        return out

    named = [first_of(copied("row"), copied("column")), first_of(deleted("row"), deleted("column")), first_of(swapped("row"), swapped("column"), swapped_cells()), first_of(altered())][: max(0, min(limit, 4))]
    if parent:
        named.insert(0, variant("", "", None, None, rows, cols, F.col("cells")))
    none = F.lit(None).cast("struct<transformation:string>")
    made = F.explode_outer(F.array_compact(F.array(*named))) if named else F.explode(F.array(none))
    out = t.select(*by, *keep, made.alias("__v")).where("__v IS NOT NULL")
    if not named:
        return out.where(F.lit(False))
    out = out.select(*by, *keep, "__v.*")
    return with_slots(out) if slots else out


def augment(cells: DataFrame) -> DataFrame:
    """transformation and the cells of those descendants of ``augmented`` that have no issues."""
    return unfolded(augmented(cells).where("__sound"), TABLE, "transformation")


# --- rebuilding and markup ---------------------------------------------------------------------------------


def fallback(cells: DataFrame) -> DataFrame:
    """Rebuild as a plain grid: the title over row 0, else one cell a slot from the first cell that covers it.

    table_id, rows, cols, ordinal, row, col, rowspan, colspan, tag, role, text, visual, source (the old ordinal),
    header_type, has_colspan.  A slot without a source is a header in rows of headers (row 0 if there are none), else body.
    """
    cells = with_visual(cells)
    grid = cells.groupBy(TABLE).agg(
        F.max("rows").alias("rows"),
        F.max("cols").alias("cols"),
        F.min(F.when(F.col("role") == "title", F.struct("ordinal", "text", F.map_entries("visual").alias("visual")))).alias("__title"),
        F.collect_set(F.when(F.col("role") == "header", F.col("row"))).alias("__heads"),
    )
    head = F.array_contains("__heads", F.col("row")) | ((F.size("__heads") == 0) & (F.col("row") == 0))
    every = grid.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).where("NOT (__title IS NOT NULL AND row = 0)").withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    every = every.select(TABLE, "rows", "cols", "row", "col", head.alias("__head"), F.col("__title").isNotNull().alias("__titled"))
    right = cells.where("row >= 0 AND col >= 0").withColumn("rowspan", F.greatest("rowspan", F.lit(1))).withColumn("colspan", F.greatest("colspan", F.lit(1)))
    inside = slots(right).where("slot_row < rows AND slot_col < cols")
    source = inside.groupBy(TABLE, F.col("slot_row").alias("row"), F.col("slot_col").alias("col")).agg(F.min(F.struct("ordinal", "role", "text", F.map_entries("visual").alias("visual"))).alias("__s"))
    role = F.when(F.col("__s.role").isin("header", "body"), F.col("__s.role")).when(F.col("__head"), "header").otherwise("body")
    number = (F.col("row") - F.col("__titled").cast("int")) * F.col("cols") + F.col("col") + F.col("__titled").cast("int")
    empty = F.array().cast("array<struct<key:string,value:string>>")
    plain = every.join(source, [TABLE, "row", "col"], "left").select(TABLE, "rows", "cols", number.cast("int").alias("ordinal"), "row", "col", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.when(role == "header", "th").otherwise("td").alias("tag"), role.alias("role"), F.coalesce("__s.text", F.lit("")).alias("text"), F.map_from_entries(F.coalesce("__s.visual", empty)).alias("visual"), F.col("__s.ordinal").alias("source"), (F.col("__titled") & (F.col("cols") > 1)).alias("has_colspan"))
    top = grid.where("__title IS NOT NULL").select(TABLE, "rows", "cols", F.lit(0).alias("ordinal"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(1).alias("rowspan"), F.col("cols").alias("colspan"), F.lit("th").alias("tag"), F.lit("title").alias("role"), F.col("__title.text").alias("text"), F.map_from_entries("__title.visual").alias("visual"), F.col("__title.ordinal").alias("source"), (F.col("cols") > 1).alias("has_colspan"))
    return plain.unionByName(top).withColumn("header_type", F.lit("fallback_unit_grid"))


def attributes(c=None):
    """The row and column span attributes of a cell as markup; ``c`` gives its fields by name."""
    of = F.col if c is None else lambda name: c[name]
    span = lambda name: F.when(of(name) > 1, F.concat(F.lit(f' {name}="'), of(name).cast("string"), F.lit('"'))).otherwise("")
    return span("rowspan"), span("colspan")


def by_table(cells: DataFrame, of_cell, column: str, *keep: str, count: str | None = None) -> DataFrame:
    """Texts of all cells in the order of the grid, each row in <tr>; ``of_cell`` maps a cell and its number in that order.

    Rows without a cell of their own are empty; cells outside of the rows are left out.  Linear in a table's cells.
    ``count``: a column for the number of cells that are told.
    """
    t, whole, n = with_rows_told(folded(cells, *keep), "cells", of_cell)
    told = [] if count is None else [n.alias(count)]
    return t.select(TABLE, *keep, whole.alias(column), *told)


def with_rows_told(t: DataFrame, array: str, of_cell) -> tuple[DataFrame, Column, Column]:
    """Of folded tables with an array of cells: what ``by_table`` tells of them, and of how many cells; the tables get a column more."""
    own = f"__c_{array}"
    inside = F.filter(array, lambda c: (c["row"] >= 0) & (c["row"] < F.col("rows")))
    t = t.withColumn(own, F.array_sort(F.transform(inside, lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), c["ordinal"].alias("ordinal"), c.alias("c")))))
    between = F.lit("</tr><tr>")
    one = F.transform(own, lambda x, i: F.concat(F.repeat(between, (x["row"] - F.coalesce(F.get(F.col(own), i - 1)["row"], F.lit(0))).cast("int")), of_cell(x["c"], i)))
    rest = F.repeat(between, (F.col("rows") - 1 - F.coalesce(F.get(F.col(own), F.size(own) - 1)["row"], F.lit(0))).cast("int"))
    whole = F.concat(F.lit("<tr>"), F.array_join(one, ""), rest, F.lit("</tr>"))
    return t, F.when(F.col("rows") > 0, whole).otherwise(""), F.size(own).cast("long")


def structure_tokens(cells: DataFrame) -> DataFrame:
    """table_id, tokens: the structure alone, joined; every cell is a <td>."""
    return by_table(cells, lambda c, i: F.concat(F.lit("<td"), *attributes(c), F.lit("></td>")), "tokens")


def plain_cell(c: Column, i: Column) -> Column:
    return F.concat(F.lit("<"), c["tag"], *attributes(c), F.lit(">"), escaped(c["text"]), F.lit("</"), c["tag"], F.lit(">"))


def build_html(cells: DataFrame) -> DataFrame:
    """table_id, html with escaped texts."""
    body = by_table(cells, plain_cell, "__html")
    return body.select(TABLE, F.concat(F.lit("<table>"), F.col("__html"), F.lit("</table>")).alias("html"))


def html_of_arrays(tables: DataFrame, **arrays: str) -> DataFrame:
    """table_id and, by the names given, what ``build_html`` makes of several arrays of cells of a folded table."""
    told = []
    for name, array in arrays.items():
        tables, whole, _ = with_rows_told(tables, array, plain_cell)
        told.append(F.concat(F.lit("<table>"), whole, F.lit("</table>")).alias(name))
    return tables.select(TABLE, *told)


def build_page(cells: DataFrame, styles: DataFrame) -> DataFrame:
    """table_id, html, id_count: whole pages; cells are numbered in the order of the page and styled by their visual.

    ``styles``: table_id, table_css, cell_css, header_css.
    """
    visual = lambda c: F.array_join(F.transform(F.array_sort(c["visual"]), lambda e: F.concat(escaped(e["key"]), F.lit(":"), escaped(e["value"]))), ";")
    style = lambda c: F.when(F.size(c["visual"]) > 0, F.concat(F.lit(' style="'), visual(c), F.lit('"'))).otherwise("")
    cell = lambda c, i: F.concat(F.lit("<"), c["tag"], F.lit(" id="), i.cast("string"), *attributes(c), style(c), F.lit(">"), escaped(c["text"]), F.lit("</"), c["tag"], F.lit(">"))
    own = with_visual(cells)
    # Styles are whole texts, many times what their source is estimated at: never to be collected for a broadcast.
    body = by_table(own, cell, "__html", count="id_count").join(styles.hint("merge"), TABLE)
    rule = lambda name, css: F.concat(F.lit(name + "{"), F.col(css), F.lit("}"))
    head = F.concat(F.lit('<html><head><meta charset="UTF-8"><style>html{background-color:white;}'), rule("table", "table_css"), rule("td", "cell_css"), rule("th", "header_css"), F.lit("</style></head><body><table>"))
    return body.select(TABLE, F.concat(head, F.col("__html"), F.lit("</table></body></html>")).alias("html"), "id_count")
