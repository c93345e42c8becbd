"""Writers: JSON lines of tables, exported splits with their manifest, reports, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_records(cells: DataFrame) -> DataFrame:
    """One record a table: table_id, rows, cols, cells in the order of the markup."""
    cell = F.struct("row", "col", "ordinal", "rowspan", "colspan", "tag", "role", "text")
    return cells.groupBy("table_id").agg(F.max("rows").alias("rows"), F.max("cols").alias("cols"), F.array_sort(F.collect_list(cell)).alias("cells"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of JSON-line parts, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_split(samples: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Samples with a column ``split`` as JSON lines in one folder a split, their counts beside them; returns the counts."""
    samples.write.mode(mode).partitionBy("split").option("ignoreNullFields", False).json(f"{path}/samples")
    counts = samples.sparkSession.read.json(f"{path}/samples", schema="split string").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode(mode).json(f"{path}/manifest")
    return counts


def write_report(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A summary (a row a group) as JSON, CSV with header and a Markdown table, each whole.

    The Markdown's lines are sorted by ranges, so its parts, in the order of their names, are one table.
    """
    summary.write.mode(mode).option("ignoreNullFields", False).json(f"{path}/json")
    summary.write.mode(mode).option("header", True).csv(f"{path}/csv")
    markdown(summary).write.mode(mode).text(f"{path}/markdown")


def markdown(summary: DataFrame) -> DataFrame:
    """``value``: the lines of the summary as a Markdown table, the head first, then the rows in order of its columns."""
    names = summary.columns
    shown = [F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in names]
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)]
    lines = summary.select(F.lit(1).alias("part"), *keys, F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("value"))
    none = [F.lit(None).cast(f.dataType).alias(f"k{i}") for i, f in enumerate(summary.schema.fields)]
    head = "| " + " | ".join(names) + " |\n|" + "---|" * len(names)
    first = summary.sparkSession.range(1).select(F.lit(0).alias("part"), *none, F.lit(head).alias("value"))
    return first.unionByName(lines).orderBy("part", *[f"k{i}" for i in range(len(names))]).select("value")


def append_trace(records: DataFrame, path: str) -> None:
    """Adds records to a trace; each call adds whole files, so a reader never meets half a record."""
    write_jsonl(records, path, "append")
