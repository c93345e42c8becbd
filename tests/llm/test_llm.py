"""Operators of training data against brute force, and on nulls, empty tables, ties and repeated rows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.llm import ann, bpe, context_mixing, fingerprints, langid, mixing, neardup, quality, toxicity, urls
from gridmill.llm.common import is_remainder

KIND = "doc_id long, text string, lang string, source string, n_chars long, score string"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo twentythree twentyfour"
TEXTS = [None, "", " \t\n", "word", "Word", BASE, BASE.upper(), BASE + " more", "une phrase tout à fait différente des autres", "x " * 9000, "éß <|endoftext|> it's 12 Σ!"]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "fr" if t and "phrase" in t else "en", None if i % 3 == 0 else f"s{i % 3}", len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]] if rows else [], KIND)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")


def test_neardup_components(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(documents(spark)).collect()}
    split = {i: (t or "").encode().lower().split() for i, t in enumerate(TEXTS)}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in split.items()}
    want = {i: i for i in sets}
    for b in sets:
        for a in range(b):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                want[b] = min(want[b], want[a])
    assert got == {(i, len(sets[i]), want[i], want[i] == i) for i in sets}
    left = neardup.without_duplicates(documents(spark))
    assert left.columns == documents(spark).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i in sets if want[i] == i)


def test_neardup_empty(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_neardup_star_of_many_copies(spark):
    """Copies that are like their original only, which has the largest id: all are one group."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(254)]
    texts = []
    for i in range(400):
        own = list(words)
        for k in rng.choice(50, 6, replace=False).tolist():
            own[5 * k + 2] = f"c{i}x{k}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame([*enumerate(texts), (len(texts), " ".join(words))], "doc_id long, text string")
    sets = [set(neardup.shingles(t).tolist()) for t in [*texts, " ".join(words)]]
    assert min(len(s & sets[-1]) / len(s | sets[-1]) for s in sets[:-1]) >= 0.75
    assert {r.component_id for r in neardup.near_duplicates(docs).collect()} == {0}


def template_corpus(n, seed=4):
    """Texts of one template, each twice: any two of different pairs share over half of their shingles, two of a pair more than 3/4."""
    rng = np.random.default_rng(seed)
    words = [f"t{k}" for k in range(300)]
    out = []
    for i in range(n // 2):
        own = list(words)
        for k in rng.choice(60, 8, replace=False).tolist():
            own[5 * k + 2] = f"p{i}x{k}"
        for half in "ab":
            each = list(own)
            for k in rng.choice(60, 3, replace=False).tolist():
                each[5 * k + 2] = f"{half}{i}x{k}"
            out.append(" ".join(each))
    return out


def brute_components(texts):
    codes = [neardup.shingles(t) for t in texts]
    every, at = np.unique(np.concatenate(codes), return_inverse=True)
    has = np.zeros((len(texts), len(every)), np.float32)
    has[np.repeat(np.arange(len(texts)), [len(c) for c in codes]), at] = 1
    both = np.rint(has @ has.T).astype(int)
    size = has.sum(1).astype(int)
    link = 100 * both >= 75 * (size[:, None] + size[None] - both)
    label = np.arange(len(texts))
    while True:
        low = np.array([label[link[i]].min() for i in range(len(texts))])
        if (low == label).all():
            return label.tolist(), int((link.sum() - len(texts)) // 2), both, size
        label = low


@pytest.mark.parametrize("n,options", [(240, {"pairs_a_node": 2000, "depth": 3}), (900, {"pairs_a_node": 20000, "depth": 4}), (900, {})])
def test_neardup_large_nodes_lose_no_link(spark, n, options):
    texts = template_corpus(n)
    want, links, both, size = brute_components(texts)
    assert 0.3 * n < links < 5 * n and np.median(both / (size[:, None] + size[None] - both)) > 0.5
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, **options).collect()}
    right = sum(got[i] == want[i] for i in range(n))
    assert right >= 0.995 * n


def test_neardup_repeated_and_null_ids(spark):
    rows = [(5, BASE), (5, "an entirely different text of seven words"), (9, "an entirely different text of seven words"), (12, "an entirely different text of seven words"), (None, BASE), (None, "only null ids have this text here"), (None, "only null ids have this text here"), (5, BASE), (None, None), (7, "")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, _rows long, _kept string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()), key=str)
    split = len(BASE.split()) - 4
    want = [(5, split, 5, True), (5, 3, 5, True), (9, 3, 5, False), (12, 3, 5, False), (None, split, 5, False), (None, 3, None, True), (None, 3, None, True), (5, split, 5, True), (None, 0, None, True), (7, 0, 7, True)]
    assert got == sorted(want, key=str)
    left = neardup.without_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(5, BASE), (5, rows[1][1]), (None, "only null ids have this text here"), (None, None), (7, "")], key=str)


@pytest.mark.parametrize("train,score", [(toxicity.train_toxicity, toxicity.score_toxicity), (quality.train_quality, quality.score_quality)])
def test_classifiers(spark, train, score):
    docs = documents(spark)
    model = train(docs, labels(spark), F.lit(True))
    got = score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    bare = train(docs, labels(spark).limit(0), F.lit(True))
    assert {r.score for r in score(docs, bare).collect()} == {0.5}


def test_toxicity_learns_insults():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50, 30)) + (" moron" if i % 4 == 0 else "") for i in range(600)]
    ids = [toxicity.term_ids(t, 18) for t in texts]
    m = toxicity.FactorizationMachine().fit(np.concatenate(ids), np.array([len(x) for x in ids]), np.array([float(i % 4 == 0) for i in range(600)]))
    s = toxicity.flat_scores(m, texts)
    assert s[::4].min() > np.delete(s, np.arange(0, 600, 4)).max()


def test_urls(spark):
    given = ["http://A.example.ORG/es/x?y", "https://example.org/en/12", "http://x.com/fr/casino", "http://m.casino-win.example.net/en/1", "http://free-bets.example.net/1", "http://free.example.net/?ref=x", "no scheme casino", None]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block") and got[2][2:] == ("com/fr/", "allow")
    assert [got[i][3] for i in range(3, 8)] == ["block", "block", "allow", "block", "allow"] and got[7][:3] == ("", "", None)


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.tokenizer_path("word_bpe_49k.json"))
    for r in bpe.bpe_encode(documents(spark)).collect():
        want = lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == lib.decode(want, skip_special_tokens=False)


def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[100:300] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(600)] + [(600, None), (650, [0.0] * 16), (700, [float("nan")] * 16)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, shard_rows=200).collect()
    s = v.astype(float) @ v.astype(float).T / np.outer(*[np.linalg.norm(v.astype(float), axis=1)] * 2)
    hit = 0
    for q in range(0, 600, 50):
        order = [i for i in np.lexsort((np.arange(600), -np.round(s[q], 12))) if i != q][:5]
        hit += len(set(order) & {r.vec_id for r in got if r.query_id == q})
    assert hit >= 0.9 * 60 and {r.query_id for r in got} == set(range(0, 600, 50))


def test_language(spark):
    docs = documents(spark)
    model = langid.train_language_id(docs, F.lit(True))
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs.select("doc_id", "text"), model).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[8] == "fr" and got[5] == "en"
    none = langid.identify(docs.select("doc_id", "text"), langid.train_models({})).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_lm_base(spark):
    docs = documents(spark)
    got = context_mixing.score_texts(docs, ~is_remainder("doc_id", 7, 2)).collect()
    assert len(got) == len(TEXTS) + 1
    held = {r.doc_id: r.held_out for r in got}
    split = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for i, t in [*enumerate(TEXTS), (len(TEXTS) - 1, TEXTS[-1])] if not held[i] for w in split(t))
    n, v = sum(c.values()), len(c)
    for r in got:
        words = split(TEXTS[r.doc_id])
        assert r.n_tokens == len(words) and r.n_known == sum(w in c for w in words) and r.train_tokens == n
        assert abs(r.base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words)) < 1e-6 and r.score < 0


def test_mix(spark):
    docs = documents(spark)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    total = sum(r.size for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * total) <= 64
    assert sorted(got) == sorted(mixing.mix_sources(docs).collect())
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    assert sum(len(r.text.encode().split()) for r in whole.collect()) == sum(r.taken for r in got)


def test_fingerprints(spark):
    got = {r.doc_id: r for r in fingerprints.with_neighbours(documents(spark, TEXTS[:-1])).collect()}
    order = sorted(range(len(TEXTS) - 1), reverse=True)
    for k, i in enumerate(order):
        own, other = TEXTS[i] or "", TEXTS[order[(k + 1) % len(order)]] or ""
        if i == order[0]:
            continue  # stands twice in the table
        want = fingerprints.edited(own, other)
        assert got[i].n_chars == len(own) and got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[0].fingerprint == got[1].fingerprint == got[2].fingerprint != got[3].fingerprint


def test_fingerprint_estimates_jaccard():
    rng = np.random.default_rng(5)
    a = {int(t): float(w) for t, w in zip(rng.integers(1, 1 << 60, 200), rng.integers(1, 6, 200), strict=True)}
    b = {t: (w + 1 if k % 3 == 0 else w) for k, (t, w) in enumerate(a.items()) if k % 5}
    sig = lambda x: fingerprints.signature(np.array(list(x), np.uint64), np.array(list(x.values()), np.float32), 2048)
    keys = a.keys() | b.keys()
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    assert abs(fingerprints.likeness(sig(a), sig(b)) - want) < 0.05
