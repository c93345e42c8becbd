"""Shared pieces of the training-data operators: tables, shared scratch space, hashing, word splitting.

Words are maximal runs of bytes outside ``0x20`` and ``0x09-0x0D``.  In Python that is exactly
``bytes.split()``; in Spark it is the pattern ``WORD``.  Lower-casing touches A-Z only, which in
Python is ``bytes.lower()``.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Multipliers of a 64-bit mixer (fixed values of the splitmix64 generator).
MIX_A, MIX_B, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


#: Bytes of a batch between Spark and a Python worker: some copies of it are in memory at a time.
ARROW_BYTES = "8m"


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the batches between Spark and Python in a session; the registered queries and stages ask for it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, or below the warehouse, which is shared too, where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/gridmill-scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def discard(*frames: DataFrame | None) -> None:
    """Delete what ``stored`` wrote for these; nothing may read them later."""
    for df in frames:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are written out: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(docs: DataFrame, base: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while base.lower() in taken:
        base += "_"
    return base


def beside(docs: DataFrame, judge: Callable[[list[str | None]], list[pa.Array]], max_bytes: int, **kinds: str) -> DataFrame:
    """All columns of ``docs`` and new ones, ``judge`` of its texts; new ones take the place of columns of the same name.

    The caller's columns travel as numbered fields of one struct, so no name of theirs can clash.
    """
    new = {k.lower() for k in kinds}
    kept = [c for c in docs.columns if c.lower() not in new]
    rest = [c for c in kept if c != "text"]
    row = F.struct(F.lit(0).alias("f"), *[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(rest)])
    own = docs.select(row.alias("row"), "text")
    schema = T.StructType([*own.schema.fields, *(T.StructField(f"n{i}", T._parse_datatype_string(v)) for i, v in enumerate(kinds.values()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, max_bytes):
            yield pa.RecordBatch.from_arrays([*b.columns, *judge(b.column("text").to_pylist())], ["row", "text", *(f"n{i}" for i in range(len(kinds)))])

    place = {c: f"row.f{i}" for i, c in enumerate(rest)} | {"text": "text"}
    out = own.mapInArrow(run, schema)
    return out.select(*[F.col(place[c]).alias(c) for c in kept], *[F.col(f"n{i}").alias(k) for i, k in enumerate(kinds)])


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def is_remainder(doc_id: Column | str, n: int, k: int) -> Column:
    return remainder(doc_id, n) == k


def unit_hash(*cols: Column | str) -> Column:
    """Deterministic number in [0, 1) from the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sampled_at_most(df: DataFrame, key: str, bound: int, total: int) -> DataFrame:
    """A seeded sample of about ``bound`` rows out of ``total``, decided row by row."""
    share = min(1.0, bound / max(1, total))
    return df if share >= 1 else df.where(unit_hash(F.lit("sample"), F.col(key)) < share)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixer, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit number a word: two seeded 32-bit checksums, mixed."""
    n = len(words)
    low = np.fromiter(map(crc32, words), np.uint64, n)
    high = np.fromiter(map(hash64_tail, words), np.uint64, n)
    return mixed(low | (high << np.uint64(32)))


def hash64_tail(word: bytes) -> int:
    return crc32(word, 0x5BD1E995) ^ (len(word) * 0x9E3779B1 & 0xFFFFFFFF)


def raw(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(name).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], max_bytes: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that one holds at most about ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0)).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def ragged_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` along axis 0; an empty run sums to 0."""
    out = np.zeros((len(lengths), *values.shape[1:]), np.float64)
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        out[full] = np.add.reduceat(values, starts, axis=0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
