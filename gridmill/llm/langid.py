"""Language identification by interpolated Kneser-Ney character models (operator 6).

One model a language over lower-cased text in which each run of non-letters is one blank.  Each has orders 1 to
``ORDER``: the highest order counts n-grams, lower orders count distinct left neighbours, all with one absolute
discount an order; the lowest is uniform over the alphabet.  N-grams are exact 64-bit keys (16 bits a character).

For look-up, all models share sorted key arrays: for every n-gram that any language has seen, the row of its
interpolated log probabilities in all languages, and for every context the row of log back-off weights.  A
character costs one binary search, and further ones only where its n-gram is new.

The language of the lowest cross-entropy per character wins.  ``score`` is the softmax of the negative
cross-entropies at a temperature; ``rejected`` says that the winner's cross-entropy is above the quantile REJECT of
its language.  Both are fitted on training rows set aside, which are not counted.

Training takes a seeded sample of about ``per_language`` rows of each language (a documented bound), whole texts, and a
quarter as many to set aside.

Defined results: a text that is null or has no letter is ``und`` with score 0; rows without a language are
judged but not learned from; without any training row all are ``und``; ties go to the smaller language name;
repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, ragged_sums, unit_hash

ORDER = 4
PER_LANGUAGE = 400
REJECT = 0.999
#: Rows set aside to calibrate on, as a share of those counted; texts count there whole and cut to so many characters.
ASIDE, CUT = 0.25, 120
UND = "und"
BLANK = np.uint16(32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each 16-bit code: itself if it is a letter, else a blank."""
    out = np.full(1 << 16, BLANK, np.uint16)
    codes = [c for c in range(1 << 16) if chr(c).isalpha()]
    out[codes] = codes
    return out


def wide_letters(codes: np.ndarray) -> np.ndarray:
    """Whether code points above 16 bits are letters."""
    each, at = np.unique(codes, return_inverse=True)
    return np.fromiter((chr(c).isalpha() for c in each.tolist()), bool, len(each))[at]


def symbols(text: str) -> np.ndarray:
    """Letters and single blanks, one blank before and after; letters above 16 bits are folded into a private range."""
    wide = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(wide < 1 << 16, wide, 0xE000 + wide % 0x1000).astype(np.uint16)
    kept = letters()[np.where(wide < 1 << 16, codes, np.uint16(0))]
    high = np.flatnonzero(wide >= 1 << 16)
    if len(high):
        kept[high] = np.where(wide_letters(wide[high]), codes[high], BLANK)
    kept = np.concatenate(([BLANK], kept, [BLANK]))
    return kept[np.concatenate(([True], (kept[1:] != BLANK) | (kept[:-1] != BLANK)))]


def keys(codes: np.ndarray, n: int, end: int | None = None) -> np.ndarray:
    """Keys of the n-grams that end at each place from n - 1 on."""
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        out = out << np.uint64(16) | codes[k : len(codes) - n + 1 + k].astype(np.uint64)
    return out


@dataclass
class LanguageModels:
    languages: list[str]
    grams: dict[int, tuple[np.ndarray, np.ndarray]]  # order: sorted keys, log probabilities (key, language)
    backoffs: dict[int, tuple[np.ndarray, np.ndarray]]  # order of the n-gram: sorted contexts, log weights
    floor: float  # log probability of a character never seen
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def costs(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Negative log probability of the character at the end of each n-gram of a text, a row a character."""
        return -self.look_up(keys(codes, order), order)

    def look_up(self, key: np.ndarray, n: int) -> np.ndarray:
        known, rows = self.grams[n]
        at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        hit = known[at] == key if len(known) else np.zeros(len(key), bool)
        out = np.empty((len(key), len(self.languages)), np.float32)
        out[hit] = rows[at[hit]]
        miss = ~hit
        if miss.any():
            rest = key[miss]
            if n == 1:
                out[miss] = self.floor
            else:
                out[miss] = self.back(rest >> np.uint64(16), n) + self.look_up(rest & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)
        return out

    def back(self, context: np.ndarray, n: int) -> np.ndarray:
        known, rows = self.backoffs[n]
        at = np.minimum(np.searchsorted(known, context), max(0, len(known) - 1))
        hit = known[at] == context
        return np.where(hit[:, None], rows[at], np.float32(0))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text in each language; whether the text has a letter."""
        codes = [symbols(t) if t else np.zeros(0, np.uint16) for t in texts]
        alive = np.array([bool((c != BLANK).any()) for c in codes])
        flat = [keys(np.concatenate(([BLANK] * (ORDER - 2), c)) if len(c) else c, ORDER) for c in codes]
        lengths = np.array([len(k) for k in flat], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *flat])
        total = np.empty((len(every), len(self.languages)), np.float32)
        for a in range(0, len(every), 1 << 18):
            total[a : a + (1 << 18)] = -self.look_up(every[a : a + (1 << 18)], ORDER)
        return ragged_sums(total, lengths) / np.maximum(lengths, 1)[:, None], alive

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, rejected of each text."""
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, alive = self.entropies(texts)
        best = h.argmin(1)
        p = np.exp(-(h - h.min(1, keepdims=True)) * self.temperature)
        score = np.where(alive, 1 / p.sum(1), 0.0)
        rejected = ~alive | (h.min(1) > (self.limits[best] if self.limits is not None else np.inf))
        return [self.languages[k] if a else UND for k, a in zip(best.tolist(), alive.tolist(), strict=True)], score, rejected


def summed(key: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(key))) if count is None else np.add.reduceat(count[order], first) if len(first) else np.zeros(0)
    return key[first], sizes.astype(np.float64)


def kneser_ney(codes: list[np.ndarray], alphabet: int) -> tuple[dict, dict]:
    """Of one language: order -> (n-gram keys, probabilities), order -> (contexts, back-off weights)."""
    counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    padded = [np.concatenate(([BLANK] * (ORDER - 2), c)).astype(np.uint16) for c in codes]
    counts[ORDER] = summed(np.concatenate([keys(c, ORDER) for c in padded]))
    for n in range(ORDER - 1, 0, -1):  # distinct left neighbours of each shorter n-gram
        counts[n] = summed(counts[n + 1][0] & np.uint64((1 << 16 * n) - 1))
    grams, backs = {}, {}
    lower_keys, lower = np.zeros(1, np.uint64), np.array([1 / alphabet])
    for n in range(1, ORDER + 1):
        key, c = counts[n]
        ones, twos = (c == 1).sum(), (c == 2).sum()
        discount = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
        context, of = np.unique(key >> np.uint64(16), return_inverse=True)
        total = np.bincount(of, c)
        weight = discount * np.bincount(of) / total
        if n == 1:
            p = (c - discount) / total[of] + weight[of] / alphabet
        else:
            at = np.searchsorted(lower_keys, key & np.uint64((1 << 16 * (n - 1)) - 1))
            p = (c - discount) / total[of] + weight[of] * lower[at]
        grams[n], backs[n] = (key, p), (context, weight)
        lower_keys, lower = key, p
    return grams, backs


def train_models(by_language: dict[str, list[str]], aside: dict[str, list[str]] | None = None) -> LanguageModels:
    """Models of the texts of each language; ``aside``: further texts of them that are not counted, to calibrate on."""
    names = sorted(k for k, v in by_language.items() if any((symbols(t) != BLANK).any() for t in v))
    codes = {k: [symbols(t) for t in by_language[k]] for k in names}
    alphabet = 1 + len(np.unique(np.concatenate([np.unique(c) for k in names for c in codes[k]]))) if names else 1
    each = [kneser_ney(codes[k], alphabet) for k in names]
    grams, backs = {}, {}
    unseen = 1 / alphabet
    for n in range(1, ORDER + 1):
        context = np.unique(np.concatenate([np.zeros(0, np.uint64), *(b[n][0] for _, b in each)]))
        weights = np.zeros((len(context), len(names)))
        for j, (_, b) in enumerate(each):
            weights[np.searchsorted(context, b[n][0]), j] = np.log(b[n][1])
        backs[n] = context, weights.astype(np.float32)
        key = np.unique(np.concatenate([np.zeros(0, np.uint64), *(g[n][0] for g, _ in each)]))
        rows = np.empty((len(key), len(names)))
        shorter = key & np.uint64((1 << 16 * (n - 1)) - 1)
        at_context = np.searchsorted(context, key >> np.uint64(16))
        for j, (g, _) in enumerate(each):
            # Every n-gram of order n has its shorter one in the shared array of order n - 1.
            lower = np.log(unseen) if n == 1 else grams[n - 1][1][np.searchsorted(grams[n - 1][0], shorter), j]
            rows[:, j] = weights[at_context, j] + lower
            own = np.searchsorted(key, g[n][0])
            rows[own, j] = np.log(g[n][1])
        grams[n] = key, rows.astype(np.float32)
    m = LanguageModels(names, grams, backs, float(np.log(unseen)))
    calibrate(m, {k: (aside or {}).get(k) or by_language[k] for k in names})
    return m


def calibrate(m: LanguageModels, texts: dict[str, list[str]]) -> None:
    """Temperature of the least log loss, and each language's limit of cross-entropy, on texts and on their first CUT characters."""
    if not m.languages:
        return
    limits, h_all, truth = [], [], []
    for j, name in enumerate(m.languages):
        h, alive = m.entropies([p for t in texts[name] for p in (t, t[:CUT])])
        h = h[alive]
        limits.append(float(np.quantile(h[:, j], REJECT)) if len(h) else np.inf)
        h_all.append(h)
        truth += [j] * len(h)
    h, truth = np.concatenate(h_all), np.array(truth, np.int64)
    if not len(h):
        return
    loss = lambda t: -(-(h * t) - np.log(np.exp(-(h - h.min(1, keepdims=True)) * t).sum(1, keepdims=True)) + h.min(1, keepdims=True) * t)[np.arange(len(h)), truth].mean()
    m.temperature = min((2.0**k for k in range(0, 7)), key=loss)
    m.limits = np.array(limits)


def train_language_id(docs: DataFrame, learn, per_language: int = PER_LANGUAGE) -> LanguageModels:
    """``learn``: a condition on doc_id that holds for the rows that may be learned from."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not sizes:
        return train_models({})
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, per_language * (1 + ASIDE) / n)]), F.col("lang"))
    drawn = own.withColumn("place", unit_hash(F.lit("lang"), "doc_id") / share).where("place < 1")
    rows = drawn.select("lang", "text", "doc_id", (F.col("place") < ASIDE / (1 + ASIDE)).alias("aside")).toPandas().sort_values(["lang", "doc_id", "text"], kind="stable")
    parts = [{k: list(g["text"]) for k, g in rows[rows["aside"] == flag].groupby("lang")} for flag in (False, True)]
    counted, aside = parts
    for k in [k for k in aside if k not in counted]:
        counted[k] = aside.pop(k)  # a language of a few rows is counted whole
    return train_models(counted, aside)


def identify(docs: DataFrame, model: LanguageModels) -> DataFrame:
    """All columns of ``docs`` plus lang_pred, score, rejected, which replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: list[str | None]) -> list[pa.Array]:
        lang, score, rejected = shared.value.judge(texts)
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

    return beside(docs, judge, 1_000_000, lang_pred="string", score="double", rejected="boolean")
