"""Quality by supervised subword embeddings (operator 7).

A document is the mean of learned vectors of its words and of its character n-grams, both hashed to 2^bits
rows; a softmax over two classes reads the mean.  Vectors and output weights are trained together by numpy
stochastic gradient descent on a seeded sample of at most about ``sample`` labelled rows (a documented bound);
the sample reaches the driver as hashed counts.  For scoring, output weights are folded into the vectors: the
difference of the two logits is then the mean of one number a feature, a table of fixed size for all workers.

Case and signs are kept, for they tell prose from shouting, markup and noise.

Defined results: a null or empty text has no features and gets the score of the class bias alone; with no
labelled rows (or one class only) the score is the base rate, 0.5 without any label; rows without a label are
scored but never learned from; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mixed, pieces, ragged_sums, raw, sigmoid, word_hashes
from .toxicity import labelled, scored

BITS, DIM = 17, 8
GRAMS = (2, 4)
SAMPLE = 6_000


def gram_ids(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashed n-grams of bytes at each place where one begins."""
    if len(data) < n:
        return np.zeros(0, np.uint32)
    code = data[: len(data) - n + 1].astype(np.uint32)
    for k in range(1, n):
        code = code * np.uint32(257) + data[k : len(data) - n + 1 + k]
    code = (code + np.uint32(n)) * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    return code >> np.uint32(32 - bits)


def word_ids(words: list[bytes], bits: int) -> np.ndarray:
    return (mixed(word_hashes(words) + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.uint32)


def features(text: str | None, bits: int) -> np.ndarray:
    """Rows of all words and n-grams of a text, repeats included."""
    own = raw(text)
    data = np.frombuffer(own, np.uint8)
    return np.concatenate([word_ids(own.split(), bits), *(gram_ids(data, n, bits) for n in GRAMS)])


class SubwordClassifier:
    def __init__(self, bits: int = BITS, dim: int = DIM, seed: int = 11):
        self.bits, self.dim, self.seed = bits, dim, seed
        self.bias = 0.0
        self.folded = np.zeros(1 << bits, np.float32)

    def fit(self, ids: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, epochs: int = 8, rate: float = 0.5) -> SubwordClassifier:
        """``ids``, ``shares``: the distinct features of each row and their share of all its features."""
        base = float(labels.mean()) if len(labels) else 0.5
        if not len(labels) or not 0 < base < 1:
            self.bias = float(np.log((base + 1e-4) / (1 - base + 1e-4))) if len(labels) else 0.0
            return self
        rng = np.random.default_rng(self.seed)
        vectors = rng.uniform(-1 / self.dim, 1 / self.dim, (1 << self.bits, self.dim)).astype(np.float32)
        out, bias = rng.normal(0, 0.1, (2, self.dim)).astype(np.float32), np.log(np.array([1 - base, base]))
        steps, done = epochs * len(ids), 0
        for _ in range(epochs):
            for k in rng.permutation(len(ids)):
                lr = rate * (1 - done / steps)
                done += 1
                at, w = ids[k], shares[k]
                if not len(at):
                    continue
                mean = w @ vectors[at]
                z = out @ mean + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[int(labels[k])] -= 1
                pull = p @ out
                out -= lr * np.outer(p, mean).astype(np.float32)
                bias -= 0.1 * lr * p
                # Shares are small; the root keeps frequent and rare features learning at like speed.
                vectors[at] -= (lr * np.sqrt(w))[:, None].astype(np.float32) * pull.astype(np.float32)
        self.folded = (vectors @ (out[1] - out[0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])
        return self

    def scores(self, texts: list[str | None]) -> np.ndarray:
        each = [features(t, self.bits) for t in texts]
        lengths = np.array([len(x) for x in each], np.int64)
        sums = ragged_sums(self.folded[np.concatenate([np.zeros(0, np.uint32), *each])].astype(np.float64), lengths)
        return sigmoid(sums / np.maximum(lengths, 1) + self.bias)


def train_quality(docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE, bits: int = BITS, dim: int = DIM) -> SubwordClassifier:
    """``learn``: a condition on doc_id that holds for the rows whose labels may be learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 500_000):
            found = [np.unique(features(t, bits), return_counts=True) for t in b.column("text").to_pylist()]
            cols = [pa.array([x.astype(kind).tobytes() for x in xs], pa.binary()) for xs, kind in (([f[0] for f in found], np.uint32), ([f[1] for f in found], np.float32))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *cols], ["doc_id", "label", "ids", "counts"])

    rows = labelled(docs, labels, "quality", learn, sample).mapInArrow(run, "doc_id long, label int, ids binary, counts binary").toPandas().sort_values(["doc_id", "label"], kind="stable")
    counts = [np.frombuffer(x, np.float32) for x in rows["counts"]]
    return SubwordClassifier(bits, dim).fit([np.frombuffer(x, np.uint32) for x in rows["ids"]], [c / max(1.0, float(c.sum())) for c in counts], rows["label"].to_numpy(np.int64))


def score_quality(docs: DataFrame, model: SubwordClassifier) -> DataFrame:
    """All columns of ``docs`` plus score (double, 0 to 1)."""
    return scored(docs, model, lambda m, texts: m.scores(texts))
