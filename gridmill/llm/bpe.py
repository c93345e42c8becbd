"""Byte-pair encoding and decoding by forced-boundary splitting (operator 4).

A pair of neighbouring bytes that occurs inside no vocabulary token can never be joined by a merge,
so it marks a certain cut.  Every pre-token is cut at such pairs, the fragments are encoded
independently, and their ids are concatenated.  All fragments of an Arrow batch that are not yet in
the worker's bounded cache are merged together by numpy: each round joins, in every fragment, the
leftmost occurrence of its lowest-ranked pair.

Defined results: a null or empty text has no tokens, decodes to the empty text and has the digests of
the empty string.  Any other column is carried only by the caller; repeated rows are encoded as often
as they occur; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Fixed values of the vocabulary file's pre-tokenizer and end-of-word mark.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
END = "</w>"
#: Fragments a worker remembers before it starts afresh.
CACHE = 250_000
BATCH_BYTES = 1_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: itself where it is visible Latin-1, else the next letter from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Encoder:
    """Tables of one vocabulary file. ``vocabulary`` is the parsed JSON of a word-end BPE."""

    def __init__(self, vocabulary: dict):
        model = vocabulary["model"]
        self.letters = byte_letters()
        back = {c: b for b, c in enumerate(self.letters)}
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PRETOKEN)
        self.plain = np.array([vocab[c] for c in self.letters], np.int64)
        self.final = np.array([vocab[c + END] for c in self.letters], np.int64)
        self.names = {i: t for t, i in (vocab | self.special).items()}
        self.joined = self.allowed(vocab, back)
        self.ranks(model["merges"], vocab)
        self.cache: dict[bytes, bytes] = {}

    @staticmethod
    def allowed(vocab: dict[str, int], back: dict[str, int]) -> np.ndarray:
        """joined[a, b]: some token holds byte a followed by byte b. Where it is false a cut is certain."""
        out = np.zeros((256, 256), bool)
        for token in vocab:
            inner = [back[c] for c in token.removesuffix(END)]
            out[inner[:-1], inner[1:]] = True
        return out

    def ranks(self, merges: list, vocab: dict[str, int]) -> None:
        """An open-addressed table from a pair of ids to its rank and its merged id."""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bits = 18
        mask = (1 << self.bits) - 1
        self.keys = np.full(mask + 1, -1, np.int64)
        self.rank = np.zeros(mask + 1, np.int32)
        self.probes = 1
        for r, key in enumerate((left << 20 | right).tolist()):
            at, n = self.slot(key), 1
            while self.keys[at] >= 0:
                at, n = (at + 1) & mask, n + 1
            self.keys[at], self.rank[at] = key, r
            self.probes = max(self.probes, n)

    def slot(self, key):
        return key * 0x9E3779B1 >> 7 & (1 << self.bits) - 1

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a pair without a merge has the largest int32."""
        key = left << 20 | right
        out = np.full(len(key), np.iinfo(np.int32).max, np.int32)
        todo, at = np.arange(len(key)), self.slot(key)
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == key[todo]
            out[todo[hit]] = self.rank[at[hit]]
            more = ~hit & (found >= 0)
            if not more.any():
                break
            todo, at = todo[more], (at[more] + 1) & (1 << self.bits) - 1
        return out

    def fragments(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all words, the start of each fragment, the number of fragments of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.plain[data]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[data[last]]
        starts = np.zeros(len(data), bool)
        starts[1:] = ~self.joined[data[:-1], data[1:]]
        starts[last[:-1] + 1] = True
        starts[0] = True
        return symbols, np.flatnonzero(starts), np.add.reduceat(starts, last - lengths + 1).astype(np.int64)

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every fragment to its end; the ids and the number of ids of each fragment."""
        none = np.iinfo(np.int32).max
        sizes = np.diff(np.append(starts, len(symbols)))
        done_ids: list[np.ndarray] = []
        done_of: list[np.ndarray] = []
        which = np.arange(len(starts))
        pair = np.full(len(symbols), none, np.int32)
        inside = np.ones(len(symbols), bool)
        inside[starts + sizes - 1] = False
        at = np.flatnonzero(inside)
        pair[at] = self.rank_of(symbols[at], symbols[at + 1])
        while len(which):
            best = np.minimum.reduceat(pair, starts)
            stop = best == none
            if stop.any():
                gone = np.repeat(stop, sizes)
                done_ids.append(symbols[gone])
                done_of.append(np.repeat(which[stop], sizes[stop]))
                symbols, pair = symbols[~gone], pair[~gone]
                which, sizes, best = which[~stop], sizes[~stop], best[~stop]
                starts = np.cumsum(sizes) - sizes
                if not len(which):
                    break
            hits = np.flatnonzero(pair == np.repeat(best, sizes))
            group = np.searchsorted(starts, hits, "right") - 1
            first = hits[np.concatenate(([True], group[1:] != group[:-1]))]
            symbols[first] = self.merged[best]
            keep = np.ones(len(symbols), bool)
            keep[first + 1] = False
            end = first + 2 >= starts + sizes  # the merged symbol is now the last of its fragment
            moved = np.cumsum(keep) - 1
            symbols, pair = symbols[keep], pair[keep]
            sizes = sizes - 1
            starts = np.cumsum(sizes) - sizes
            at = moved[first]
            pair[at[end]] = none
            open_ = at[~end]
            pair[open_] = self.rank_of(symbols[open_], symbols[open_ + 1])
            before = at[at > starts]
            pair[before - 1] = self.rank_of(symbols[before - 1], symbols[before])
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        of = np.concatenate(done_of) if done_of else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        return ids[order], of[order]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each pre-token."""
        if not words:
            return []
        symbols, starts, counts = self.fragments(words)
        ids, of = self.merge(symbols, starts)
        word = np.repeat(np.arange(len(words)), counts)
        per_word = np.bincount(word[of], minlength=len(words))
        packed, ends = ids.astype("<u4").tobytes(), np.cumsum(per_word) * 4
        return [packed[a:b] for a, b in zip((ends - per_word * 4).tolist(), ends.tolist(), strict=True)]

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # letters are lowered one by one, so no final sigma

    def pretokens(self, text: str) -> list[bytes]:
        """Pre-tokens in UTF-8; a special token stands as its text with a leading NUL pair, which no pre-token can have."""
        if self.split_special is None or "<|" not in text:
            return [w.encode("utf-8", "surrogatepass") for w in self.pattern.findall(self.normal(text))]
        out: list[bytes] = []
        for k, part in enumerate(self.split_special.split(text)):
            if k % 2:
                out.append(b"\xff\xff" + part.encode())
            else:
                out += [w.encode("utf-8", "surrogatepass") for w in self.pattern.findall(self.normal(part))]
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self.pretokens(t) if t else [] for t in texts]
        known = self.cache
        new = set().union(*split) - known.keys()
        for mark in [w for w in new if w[:2] == b"\xff\xff"]:
            known[mark] = self.special[mark[2:].decode()].to_bytes(4, "little")
            new.discard(mark)
        fresh = list(new)
        for a in range(0, len(fresh), 100_000):
            known.update(zip(fresh[a : a + 100_000], self.encode_words(fresh[a : a + 100_000]), strict=True))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        if len(known) > CACHE:
            known.clear()
        return out

    def decode(self, ids: bytes) -> str:
        """Token names with one blank between; ids that are in no vocabulary are left out."""
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist() if i in names])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    with open(path, encoding="utf-8") as f:
        return Encoder(json.load(f))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is installed; every worker has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_encode(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>, decoded string): the whole text of every row, encoded and decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path(vocabulary))
        for b in pieces(batches, BATCH_BYTES):
            ids = e.encode_batch(b.column("text").to_pylist())
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(offsets, flat), pa.array([e.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def bpe_digests(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path(vocabulary))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in pieces(batches, BATCH_BYTES):
            ids = e.encode_batch(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([sha(x) for x in ids], pa.string()),
                    pa.array([sha(e.decode(x).encode("utf-8", "surrogatepass")) for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
