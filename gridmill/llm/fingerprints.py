"""Document fingerprints by consistent weighted sampling (operator 10).

A document is a weighted set: its pairs of neighbouring words (a single word where there is only one), each
weighted by how often it occurs.  For every term and each of K samples a hash gives the three draws of
improved consistent weighted sampling, r ~ Gamma(2, 1), c ~ Gamma(2, 1), b ~ U(0, 1):

    t = floor(ln w / r + b),   ln a = ln c - r (t - b + 1)

The sample is (term, t) of the smallest a; two documents share it with probability equal to their
generalised Jaccard similarity.  A fingerprint keeps 16 bits of each sample; likeness is the share of equal
samples, corrected for chance.

Neighbours in descending order of doc_id come from one exchange: ids are cut into ranges at ids that occur
(an aggregate of ids alone gives the cuts), every row goes to its range, and the first row of each range goes
to the range before it as well, so that a range never needs to look at another.  Texts travel compressed.

Defined results: a null text counts as empty; the empty text has the fingerprint of no terms, which is like
itself only (1) and unlike all others (0); a null doc_id stands after all others; among rows that share an id
the text decides the order; one row alone is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, mixed, pieces, raw, word_hashes

SAMPLES = 64
#: Levels of the quantile tables from which the draws are taken.
LEVELS = 1 << 16
BLOCK = 512
NOTHING = "-"


@lru_cache(maxsize=1)
def gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the mid-points of LEVELS equal steps, by Newton's method on 1 - (1 + x) e^-x."""
    q = (np.arange(LEVELS) + 0.5) / LEVELS
    x = np.sqrt(2 * q) + q
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - q) / np.maximum(x * np.exp(-x), 1e-12), 1e-9)
    return x.astype(np.float32)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    r = gamma_quantiles()
    return r, np.log(r)


@lru_cache(maxsize=2)
def salts(samples: int) -> np.ndarray:
    return mixed((np.arange(1, samples + 1, dtype=np.uint64)) * np.uint64(GOLDEN))


def terms(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms and their weights."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    h = word_hashes(words)
    pairs = mixed(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h
    found, counts = np.unique(pairs, return_counts=True)
    return found, counts.astype(np.float32)


def signature(found: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """16 bits of each sample; ``found`` holds at least one term."""
    r_of, ln_c_of = tables()
    salt = salts(samples)
    best = np.full(samples, np.inf, np.float32)
    chosen = np.zeros(samples, np.uint16)
    ln_w = np.log(weights)
    for a in range(0, len(found), BLOCK):
        part = found[a : a + BLOCK]
        h = part[:, None] ^ salt[None, :]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        fields = h.view(np.uint16).reshape(len(part), samples, 4)
        r, ln_a = r_of.take(fields[..., 3]), ln_c_of.take(fields[..., 2])
        gap = fields[..., 1].astype(np.float32)  # t - b + 1; t = 0 for weight 1, where ln w = 0
        gap *= np.float32(-1 / LEVELS)
        gap += np.float32(1 - 0.5 / LEVELS)
        heavy = np.flatnonzero(ln_w[a : a + BLOCK])
        if len(heavy):
            steps = np.floor(ln_w[a : a + BLOCK][heavy, None] / r[heavy] + (1 - gap[heavy]))
            gap[heavy] += steps
        gap *= r
        ln_a -= gap
        at = ln_a.argmin(0)
        low = ln_a[at, np.arange(samples)]
        better = low < best
        kept_t = np.zeros(samples, np.uint64)
        if len(heavy):
            which = np.minimum(np.searchsorted(heavy, at), len(heavy) - 1)
            kept_t = np.where(heavy[which] == at, steps[which, np.arange(samples)], 0).astype(np.int64).astype(np.uint64)
        code = (mixed(part[at] + kept_t * np.uint64(GOLDEN)) >> np.uint64(48)).astype(np.uint16)
        best = np.where(better, low, best)
        chosen = np.where(better, code, chosen)
    return chosen


def fingerprint(text: str | None, samples: int = SAMPLES) -> np.ndarray | None:
    found, weights = terms(raw(text).split())
    return signature(found, weights, samples) if len(found) else None


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated generalised Jaccard similarity, 0 to 1."""
    if a is None or b is None:
        return 1.0 if a is None and b is None else 0.0
    chance = 2.0**-16
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def shown(sig: np.ndarray | None) -> str:
    return NOTHING if sig is None else sig.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, fingerprint of each row; no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4_000_000):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shown(fingerprint(t, samples)) for t in b.column("text").to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


LOWEST = -(1 << 63)
#: Bytes of text of a range, about.
RANGE_BYTES = 64_000_000
PACKED = "range_no int, place long, guest int, doc_id long, body binary"


def with_neighbours(docs: DataFrame, samples: int = SAMPLES, ranges: int | None = None) -> DataFrame:
    """The fingerprints of each text, of its edited text, and their likenesses (see the module's text)."""
    spark = docs.sparkSession
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("place"), "text")
    steps = [k / ranges for k in range(1, ranges)] or [1.0]
    known = rows.agg(F.percentile_approx("place", F.array(*map(F.lit, steps)), F.lit(max(10_000, 20 * ranges))).alias("cuts"), F.max("place").alias("most")).first()
    # A range holds (cut before, cut]; a cut is an id that occurs, so the first row of the range in descending order has it.
    most = known["most"]
    cuts = np.array(sorted({*(known["cuts"] or []), most} - {None}), np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            at = np.asarray(b.column("place")).astype(np.int64)
            home = np.searchsorted(cuts, at, "left")
            first = np.flatnonzero(cuts[home] == at)  # goes to the range before as well; the first range of all is after the last
            before = (home[first] + 1) % len(cuts)
            take = np.concatenate((np.arange(len(at)), first))
            body = [squeeze(raw(t)) for t in b.column("text").to_pylist()]
            guest = np.concatenate((np.zeros(len(at), np.int32), np.ones(len(first), np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((home, before)).astype(np.int32)),
                    pa.array(at[take]),
                    pa.array(guest),
                    b.column("doc_id").take(pa.array(take)),
                    pa.array([body[k] for k in take.tolist()], pa.binary()),
                ],
                ["range_no", "place", "guest", "doc_id", "body"],
            )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range in descending order, then its guests; only the first guest counts."""
        unsqueeze = zstandard.ZstdDecompressor().decompress
        held: tuple | None = None  # range, doc_id, text, signature, of a row that waits for the next one
        for b in batches:
            out: list[tuple] = []
            for no, guest, doc_id, body in zip(*(b.column(c).to_pylist() for c in ("range_no", "guest", "doc_id", "body")), strict=True):
                if guest and (held is None or held[0] != no):
                    continue
                text = unsqueeze(body).decode("utf-8", "surrogatepass")
                sig = fingerprint(text, samples)
                if held is not None and held[0] == no:
                    own, other = held[2], edited(held[2], text)
                    changed = fingerprint(other, samples) if other != own else held[3]
                    out.append((held[1], len(own), hashlib.sha256(raw(other)).hexdigest(), shown(held[3]), shown(changed), likeness(held[3], changed), likeness(held[3], sig)))
                held = None if guest else (no, doc_id, text, sig)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 7, KINDS, strict=True)], NAMES)

    packed = rows.select("doc_id", "place", "text").mapInArrow(pack, PACKED)
    dealt = packed.repartitionById(len(cuts), "range_no") if len(cuts) else packed
    order = dealt.sortWithinPartitions("range_no", "guest", F.col("place").desc(), "body")
    return order.mapInArrow(judge, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
