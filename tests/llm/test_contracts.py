"""Nulls, empty and repeated rows, clashing names and empty tables for every operator and pipeline stage; learned models
against brute force or held-out rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridmill.llm import ann, bpe, context_mixing, fingerprints, langid, mixing, neardup, quality, toxicity, urls
from gridmill.llm.common import free_name, is_remainder

#: Names that operators use themselves.
CLASH = "score double, Score2 string, _score string, row string, f0 string, n0 string, lang_pred string, rejected boolean, _kept string, _rows long, _n long, size long, component_id long, taken long, label string, rep long"
KIND = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def rows(n=24):
    out = []
    for i in range(n):
        text = [None, "", " \t ", " ".join(WORDS), "😀 12 !", "x " * 30_000][i] if i < 6 else " ".join(WORDS[(i * k) % 20] for k in range(1, 30 + i))
        out.append((i, text, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", len(text or "")))
    out += [out[7], out[7], (None, out[8][1], "en", "s1", 3), (None, None, None, None, None)]
    return [(*r, 0.5, "a", "b", "c", "d", "e", "f", True, "g", 1, 2, 3, 4, 5, "h", 6) for r in out]


def documents(spark, n=24):
    return spark.createDataFrame(rows(n), KIND)


def nothing(spark):
    return spark.createDataFrame([], KIND)


def labels(spark, n=24):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")


def vectors(spark, n):
    return spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0], "z") for i in range(n)], "vec_id long, embedding array<float>, score string")


def operators(spark, docs):
    """Each operator over the same rows: name, result, columns of the caller's that it keeps."""
    tox = toxicity.train_toxicity(docs, labels(spark), F.lit(True))
    good = quality.train_quality(docs, labels(spark), F.lit(True))
    lang = langid.train_language_id(docs, F.lit(True))
    yield "neardup", neardup.near_duplicates(docs), None
    yield "without_duplicates", neardup.without_duplicates(docs), docs.columns
    yield "toxicity", toxicity.score_toxicity(docs, tox), docs.columns
    yield "quality", quality.score_quality(docs, good), docs.columns
    yield "language", langid.identify(docs, lang), docs.columns
    yield "bpe", bpe.bpe_digests(docs), None
    yield "lm", context_mixing.score_texts(docs, ~is_remainder("doc_id", 7, 2)), None
    yield "mix", mixing.mix_sources(docs), None
    yield "mixed", mixing.mixed_documents(docs), docs.columns
    yield "fingerprints", fingerprints.with_neighbours(docs), None


def test_every_operator_takes_odd_rows_and_clashing_names(spark):
    docs = documents(spark)
    n = docs.count()
    for name, found, kept in operators(spark, docs):
        got = found.collect()
        assert len(got) == n or name in ("without_duplicates", "mixed"), name
        if kept:
            assert set(kept) <= set(found.columns), name
            assert all(r["Score2"] == "a" and r["_score"] == "b" and r["label"] == "h" for r in got), name


def test_every_operator_takes_an_empty_table(spark):
    for name, found, _ in operators(spark, nothing(spark)):
        assert found.count() == 0, name
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string, rule string")).count() == 0
    assert ann.search(vectors(spark, 0), F.col("vec_id") % 50 == 0).count() == 0


def test_stages_take_odd_rows_clashing_names_and_empty_tables(spark, tmp_path):
    docs = documents(spark)
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        some, none = stage(spark, docs, str(tmp_path)), stage(spark, nothing(spark), str(tmp_path))
        assert none.count() == 0, name
        if name != "encode":
            assert some.columns == docs.columns, name
            assert all(r["score"] == 0.5 and r["_score"] == "b" for r in some.collect()), name
        else:
            assert some.count() == docs.count()


def test_pipeline_chains_its_stages(spark, tmp_path):
    rng = np.random.default_rng(6)
    plain = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(plain, 60)) + (" vile moron" if i % 4 == 0 else "") for i in range(600)]
    texts += [t + " more" for t in texts[1:9]]  # near copies, some of toxic rows
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("moron" in t)) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    toxic, clean = {i for i in range(600) if i % 4 == 0}, {i for i in range(600) if i % 4}
    assert len(ids & toxic) <= 0.4 * len(toxic) and len(ids & clean) >= 0.9 * len(clean) and not ids & {i for i in range(600, 608) if (i - 599) % 4}
    assert all(len(r.ids) == r.n_tokens for r in got)


def test_free_names(spark):
    assert free_name(nothing(spark), "score") == "score_" and free_name(nothing(spark), "other") == "other"


def test_lm_scores_do_not_depend_on_partitions(spark):
    docs = documents(spark)
    learn = ~is_remainder("doc_id", 7, 2)
    score = lambda df: sorted(((r.doc_id, r.n_tokens, r.score, r.base_score) for r in context_mixing.score_texts(df, learn).collect()), key=str)
    first = score(docs.repartition(4))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert score(docs.repartition(9, "n_chars")) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_lm_paths_are_a_distribution():
    rng = np.random.default_rng(4)
    words = [f"w{k}".encode() for k in range(40)]
    hashes = np.sort(context_mixing.word_hashes(words))
    counts = np.arange(60, 20, -1)
    model = context_mixing.Model(hashes[:38], counts[:38], int(counts.sum()) + 9, int(counts[:39].sum()), np.ones(256, np.int64), 14)
    model.path = [rng.integers(0, 256, len(t)).astype(np.uint8) for t in model.path]
    pack = context_mixing.shrunk
    row = {"ids": np.zeros((2, 40), np.int64).tobytes(), "held": np.ones(40, bool).tobytes(), "lengths": np.ones(40, np.int64).tobytes(), "sizes": np.ones(40, np.int64).tobytes(), "words": pack(b"\n".join(words)), "hashes": hashes.tobytes(), "tally": pack(np.zeros(40, np.uint32).tobytes()), "tokens": pack(np.arange(40, dtype=np.uint32).tobytes()), "place": pack(np.arange(40, dtype=np.uint32).tobytes()), "counts": pack(np.concatenate((counts[:39], [1])).astype(np.int64).tobytes())}
    cost = model.path_costs(context_mixing.Texts(row, model), np.arange(40))
    assert abs((2.0**-cost).sum() - 1) < 1e-3


def test_lm_learns_and_knows_twins(spark):
    rng = np.random.default_rng(8)
    words = [f"v{k}" for k in range(2000)]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(800)]
    texts[200:400] = texts[:200]  # twins, learned from
    texts[790:795] = texts[:5]  # held out, their twins are learned from
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in context_mixing.score_texts(docs, F.col("doc_id") < 700).collect()}
    once, fresh = np.mean([got[i].score for i in range(400, 700)]), np.mean([got[i].score for i in range(700, 790)])
    assert np.mean([got[i].score for i in range(400)]) > 0.8 * once and np.mean([got[i].score for i in range(790, 795)]) > 0.8 * once
    assert abs(fresh / once - 1) < 0.05
    assert all(abs(r.bits_per_byte + r.score / np.log10(2) / (len(texts[i].encode()) + 1)) < 1e-9 for i, r in got.items())


def test_toxicity_learns_what_additive_weights_cannot():
    """One of two words alone is toxic, neither and both are not."""
    rng = np.random.default_rng(2)
    texts, truth = [], []
    for i in range(1200):
        a, b = i % 2, i // 2 % 2
        texts.append(" ".join([*(f"w{k}" for k in rng.integers(0, 40, 6)), *["insult"] * a, *["praise"] * b]))
        truth.append(float(a != b))
    ids = [toxicity.term_ids(t, 18) for t in texts]
    part = slice(0, 900)
    model = toxicity.FactorizationMachine().fit(np.concatenate(ids[part]), np.array([len(x) for x in ids[part]]), np.array(truth[part]), epochs=40, rate=0.2, decay=0.0)
    right = (toxicity.flat_scores(model, texts[900:]) > 0.5) == (np.array(truth[900:]) == 1)
    assert right.mean() > 0.9


def test_quality_learns_from_parts_of_words():
    rng = np.random.default_rng(3)
    make = lambda good: " ".join(f"{rng.choice(['lor', 'ips', 'dol'])}{rng.integers(0, 999)}{'ness' if good else 'zzq'}" for _ in range(12))
    truth = np.arange(400) % 2
    texts = [make(t) for t in truth]
    found = [np.unique(quality.features(t, quality.BITS), return_counts=True) for t in texts[:300]]
    model = quality.SubwordClassifier().fit([f[0].astype(np.uint32) for f in found], [(f[1] / f[1].sum()).astype(np.float32) for f in found], truth[:300])
    assert ((model.scores(texts[300:]) > 0.5) == (truth[300:] == 1)).mean() > 0.95


def test_language_models_are_kneser_ney():
    texts = ["abab abc abd", "bcab bba", "aab"]
    model = langid.train_models({"l": texts})
    blank = int(langid.BLANK)
    seqs = [[blank] * (langid.ORDER - 2) + langid.symbols(t).tolist() for t in texts]
    grams = {langid.ORDER: Counter(tuple(s[i : i + langid.ORDER]) for s in seqs for i in range(len(s) - langid.ORDER + 1))}
    for n in range(langid.ORDER - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    alphabet = 1 + len({c for t in texts for c in langid.symbols(t).tolist()})

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / alphabet
        c = grams[n]
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
        total = sum(v for g, v in c.items() if g[:-1] == gram[:-1])
        kinds = sum(g[:-1] == gram[:-1] for g in c)
        lower = p(gram[1:])
        return lower if not total else max(c[gram] - d, 0) / total + d * kinds / total * lower

    for text in ("abab", "abcd", "ccca bd"):
        codes = np.concatenate(([langid.BLANK] * (langid.ORDER - 2), langid.symbols(text))).astype(np.uint16)
        got = -model.costs(codes)[:, 0]
        want = [np.log(p(tuple(codes[i : i + langid.ORDER].tolist()))) for i in range(len(codes) - langid.ORDER + 1)]
        assert np.allclose(got, want, atol=1e-4)


def test_language_asks_for_letters(spark):
    docs = spark.createDataFrame([(0, "😀😀😀"), (1, "𐐨𐐩 12"), (2, "12 !")], "doc_id long, text string")
    model = langid.train_models({"en": ["some words here"], "fr": ["une phrase"]})
    assert [r.lang_pred == "und" for r in langid.identify(docs, model).orderBy("doc_id").collect()] == [True, False, True]


def test_bpe_digests(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.tokenizer_path("word_bpe_49k.json"))
    docs = documents(spark)
    for r, d in zip(bpe.bpe_digests(docs.where("doc_id < 7")).orderBy("doc_id").collect(), docs.where("doc_id < 7").orderBy("doc_id").collect(), strict=True):
        ids = lib.encode(d.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_ann_ranks_scores_and_ties(spark):
    n = 151
    got = defaultdict(list)
    for r in ann.search(vectors(spark, n), F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    v = np.array([(i % 7 + 1, i % 5, 1) for i in range(n)], float)
    s = (v @ v.T) / np.outer(*[np.linalg.norm(v, axis=1)] * 2)
    for q in range(0, n, 50):
        order = [i for i in np.lexsort((np.arange(n), -np.round(s[q], 12))) if i != q][:5]
        own = sorted(got[q])
        assert [k for k, _, _ in own] == [1, 2, 3, 4, 5] and [i for _, i, _ in own] == order
        assert np.allclose([x for _, _, x in own], s[q][order])


def test_fingerprint_likeness_of_neighbours(spark):
    docs = documents(spark).where("doc_id BETWEEN 6 AND 20").distinct()
    got = sorted(fingerprints.with_neighbours(docs).collect(), key=lambda r: -r.doc_id)
    for k, r in enumerate(got):
        after = got[(k + 1) % len(got)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1) == (r.fingerprint == after.fingerprint) and (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)


@pytest.mark.parametrize("links", [[(1, 2), (2, 3), (5, 4), (9, 5), (3, 7), (20, 21)], [(i, i + 1) for i in range(30)]])
def test_components_of_many_tasks(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    whole = {r.rep: r.label for r in neardup.components(df).collect()}
    assert whole == {r.rep: r.label for r in neardup.components(df, links_a_task=3).collect()}
    assert whole[max(whole)] == (20 if len(links) == 6 else 0)
