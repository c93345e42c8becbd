"""Toxicity by a factorization machine over hashed terms (operator 2).

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 for each hashed term of the text.
The pairwise part learns what additive weights miss, such as an insult together with a mention of a group.
Terms are words (A-Z lower-cased, without punctuation at their ends) and their first 4 and 5 bytes, so that
an inflected form shares a term with its stem; all are hashed to 2^bits places.

Training takes a seeded sample of at most about ``sample`` labelled rows to the driver as term sets, not as
texts, and runs AdaGrad in numpy; weights are then a constant of fixed size (2^bits * (factors + 1) floats)
that every worker gets.  Only terms that at least ``min_docs`` training rows hold are learned, so a term seen
once can't be learned by heart.

Defined results: a null or empty text has no terms and scores sigmoid(w0); rows without a label are scored
but never learned from; with no labelled rows (or one class only) the score is the base rate, 0.5 without
any label; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, pieces, ragged_sums, raw, sampled_at_most, sigmoid, word_hashes

BITS, FACTORS = 18, 6
#: Labelled rows that training takes at most (about: rows are drawn one by one).
SAMPLE = 12_000
STEMS = (4, 5)
EDGES = b".,;:!?\"'()[]{}|#$%&*"


def term_ids(text: str | None, bits: int) -> np.ndarray:
    """Distinct hashed terms of a text."""
    words = {w.strip(EDGES) for w in raw(text).lower().split()}
    words.discard(b"")
    stems = {b" " + w[:n] for n in STEMS for w in words if len(w) > n}
    return np.unique(word_hashes([*words, *stems]) >> np.uint64(64 - bits)).astype(np.int32)


class FactorizationMachine:
    def __init__(self, bits: int = BITS, factors: int = FACTORS, seed: int = 7):
        self.bits, self.factors = bits, factors
        self.bias = 0.0
        self.linear = np.zeros(1 << bits, np.float32)
        self.factor = np.zeros((1 << bits, factors), np.float32)
        self.seed = seed

    def logits(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of many texts at once: ``ids`` holds their terms one after the other."""
        v = self.factor[ids]
        sums = ragged_sums(v, lengths)
        squares = ragged_sums((v * v).sum(1), lengths)
        return self.bias + ragged_sums(self.linear[ids], lengths) + 0.5 * ((sums**2).sum(1) - squares)

    def fit(self, ids: np.ndarray, lengths: np.ndarray, labels: np.ndarray, epochs: int = 10, rate: float = 0.08, decay: float = 5e-3, min_docs: int = 20, batch: int = 64) -> FactorizationMachine:
        """AdaGrad on the logistic loss, in seeded order; both classes weigh the same in sum, up to a factor of 5."""
        share = float(labels.mean()) if len(labels) else 0.5
        self.bias = float(np.log((share + 1e-4) / (1 - share + 1e-4))) if len(labels) else 0.0
        if not 0 < share < 1:
            return self
        used = np.bincount(ids, minlength=1 << self.bits) >= min_docs
        rng = np.random.default_rng(self.seed)
        self.factor[used] = rng.normal(0, 0.01, (int(used.sum()), self.factors)).astype(np.float32)
        row = np.repeat(np.arange(len(lengths)), lengths)
        ids, row = ids[used[ids]], row[used[ids]]
        lengths = np.bincount(row, minlength=len(lengths))
        ends = np.cumsum(lengths)
        weight = np.where(labels == 1, min(5.0, (1 - share) / share), 1.0)
        g_linear, g_factor, g_bias = np.full(1 << self.bits, 1e-6, np.float32), np.full((1 << self.bits, self.factors), 1e-6, np.float32), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(lengths))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                n = lengths[rows]
                flat = np.concatenate([ids[ends[r] - lengths[r] : ends[r]] for r in rows])
                v = self.factor[flat]
                sums = ragged_sums(v, n).astype(np.float32)
                z = self.bias + ragged_sums(self.linear[flat], n) + 0.5 * ((sums**2).sum(1) - ragged_sums((v * v).sum(1), n))
                err = ((sigmoid(z) - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
                each = np.repeat(err, n)
                terms, back = np.unique(flat, return_inverse=True)
                d_linear = np.bincount(back, each, len(terms)).astype(np.float32) + decay * self.linear[terms]
                pull = each[:, None] * (np.repeat(sums, n, axis=0) - v)
                d_factor = np.stack([np.bincount(back, pull[:, f], len(terms)) for f in range(self.factors)], 1).astype(np.float32) + decay * self.factor[terms]
                g_linear[terms] += d_linear**2
                g_factor[terms] += d_factor**2
                self.linear[terms] -= rate * d_linear / np.sqrt(g_linear[terms])
                self.factor[terms] -= 0.25 * rate * d_factor / np.sqrt(g_factor[terms])
                d_bias = float(err.sum())
                g_bias += d_bias**2
                self.bias -= rate * d_bias / np.sqrt(g_bias)
        return self


def collected_terms(docs: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term sets and labels of a bounded sample, as flat arrays, in the order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1_000_000):
            ids = [term_ids(t, bits).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(ids, pa.binary())], ["doc_id", "label", "ids"])

    got = docs.mapInArrow(run, "doc_id long, label int, ids binary").toPandas().sort_values(["doc_id", "label"], kind="stable")
    each = [np.frombuffer(x, np.int32) for x in got["ids"]]
    return np.concatenate([np.zeros(0, np.int32), *each]), np.array([len(x) for x in each], np.int64), got["label"].to_numpy(np.float64)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn, sample: int) -> DataFrame:
    """(doc_id, text, label) of a seeded sample of the labelled rows for which ``learn`` holds."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn).distinct()
    few = sampled_at_most(own, "doc_id", sample, own.count())
    # The ids of the sample are bounded by ``sample``, so they may be broadcast.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")


def train_toxicity(docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE, bits: int = BITS, factors: int = FACTORS) -> FactorizationMachine:
    """``learn``: a condition on doc_id that holds for the rows whose labels may be learned."""
    return FactorizationMachine(bits, factors).fit(*collected_terms(labelled(docs, labels, "toxic", learn, sample), bits))


def score_toxicity(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """All columns of ``docs`` plus score (double, 0 to 1); ``docs`` has doc_id and text."""
    return scored(docs, model, lambda m, texts: flat_scores(m, texts))


def flat_scores(m: FactorizationMachine, texts: list[str | None]) -> np.ndarray:
    each = [term_ids(t, m.bits) for t in texts]
    return sigmoid(m.logits(np.concatenate([np.zeros(0, np.int32), *each]), np.array([len(x) for x in each], np.int64)))


def scored(docs: DataFrame, model, scores, name: str = "score") -> DataFrame:
    """``docs`` plus a column of scores that ``scores(model, texts)`` gives for its texts; the model is broadcast.

    A column of that name in ``docs`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return beside(docs, lambda texts: [pa.array(scores(shared.value, texts), pa.float64())], 500_000, **{name: "double"})
