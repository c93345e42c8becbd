"""Readers of corpus folders: tolerant and strict JSON lines, reports, ratings, listings, image sizes, text corpora."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of JSON lines; blank lines count as lines and are skipped.

    rows: file, the fields of ``schema``.  errors: file, line_no (from 1), line.  Lines that hold no JSON object are
    errors.  Line numbers come from the place of a line within its block of the file and the number of lines in the
    blocks before it: one small aggregate over blocks, no sort of lines.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.trim("value").alias("line"),
    )
    parsed = lines.withColumn("_json", F.try_parse_json("line"))
    holds = F.coalesce(F.schema_of_variant("_json").startswith("OBJECT"), F.lit(False))
    rows = parsed.where((F.col("line") != "") & holds).select("file", F.from_json("line", schema).alias("_row")).select("file", "_row.*")
    from pyspark.sql import Window

    blocks = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
    wrong = parsed.where((F.col("line") != "") & ~holds).select("file", "_block", "_id", "line")
    errors = wrong.join(blocks, ["file", "_block"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")
    return rows, errors


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a line that is no JSON object fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The one row of a JSON file of several lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_ratings(spark: SparkSession, path: str, required: tuple[str, ...] = ("sample_id", "checker_score", "human_score")) -> DataFrame:
    """Ratings of a CSV file with a header; ValueError where a required column or every row is missing."""
    found = spark.read.option("header", True).csv(path)
    lacking = [c for c in required if c not in found.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    if found.isEmpty():
        raise ValueError("no ratings")
    return found


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length of the files below a folder that are not empty (Spark plans no reading of empty ones); no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")


def size_of(data: bytes) -> tuple[int, int] | None:
    """(width, height) told by the head of a PNG, GIF or JPEG image; None for other or broken ones."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def image_sizes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, ok, width, height of the images below a folder; broken images have ok false and size 0.

    Empty files have no row, so a join finds them missing (``export.image_issues``).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)

    @F.pandas_udf("ok boolean, width int, height int")
    def measured(content: pd.Series) -> pd.DataFrame:
        found = [size_of(c) for c in content]
        return pd.DataFrame({"ok": [s is not None for s in found], "width": [s[0] if s else 0 for s in found], "height": [s[1] if s else 0 for s in found]})

    return files.select("path", measured("content").alias("s")).select("path", "s.*")


def corpus_snippets(spark: SparkSession, path: str, low: int = 3, high: int = 10) -> DataFrame:
    """line, snippet: of every line of a text corpus with ``low`` characters or more, a piece of ``low`` to ``high``."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where(F.length("line") >= low)
    number = F.pmod(F.xxhash64("line"), F.lit(2**31))
    start = (number % (F.length("line") - low + 1) + 1).cast("int")
    length = (F.lit(low) + F.floor(number / 65536) % (high - low + 1)).cast("int")
    return lines.select("line", F.substring("line", start, length).alias("snippet"))
