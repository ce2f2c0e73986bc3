"""Classifiers and the language model: held-out accuracy, exact base figures, defined edge cases."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hmm, langid, quality, toxicity

from . import brute


def labelled(spark, n=900):
    """Texts with labels: toxic ones hold a few words that no other text has, junk is full of signs."""
    rng = random.Random(1)
    common = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(common) + rng.choice(["", "", f"{rng.randint(0, 5000)}"]) for _ in range(rng.randint(40, 150))]
        bad, junk = rng.random() < 0.3, rng.random() < 0.2
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["nasty", "vile", "scum"]))
        if junk:
            words = [w + "&&&" for w in words]
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 0 if junk else 1, int(bad)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(docs, schema).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def corpus(spark):
    return labelled(spark)


def test_toxicity_on_held_out_rows(corpus):
    docs, labels = corpus
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (brute.crc(r.doc_id, 5) == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_toxicity_never_reads_held_out_labels(corpus):
    docs, labels = corpus
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.toxicity(docs, turned).collect()}
    assert a == pytest.approx(b)


def _hashes(words):
    """Buckets of words, and of the beginning of a text for None."""
    found = toxicity.words_of(pa.array([w or "" for w in words]), toxicity.ALNUM, lower=True)
    own = iter((found.hash & np.uint64(toxicity.BUCKETS - 1)).astype(np.int64))
    return np.array([toxicity.START if w is None else next(own) for w in words])


def test_toxicity_models_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    texts = [(int(i % 5 == 0), " ".join(rng.choice(words[i % 5 :]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    model = toxicity.count(spark.createDataFrame([*texts, (0, None), (1, "")], "class long, text string").repartition(3))
    plain = brute.kneser_ney(texts, toxicity.BUCKETS)
    pairs = [(v, w) for v in [None, *words, "unseen"] for w in [*words, "new"]]
    before, own = _hashes([v for v, _ in pairs]), _hashes([w for _, w in pairs])
    for c in (0, 1):
        assert model.probabilities(c, before, own) == pytest.approx([plain(c, v, w) for v, w in pairs], rel=1e-4)
    alone, added = model.ratios(before, own)
    assert alone + added == pytest.approx([np.log(plain(1, v, w) / plain(0, v, w)) for v, w in pairs], abs=1e-3)


def test_toxicity_finds_pairs_of_ordinary_words_with_few_labels(spark):
    """All words are as common in ordinary texts; only that two of them stand side by side is toxic."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(400):
        own = [rng.choice(words) for _ in range(50)]
        for at in sorted(rng.sample(range(49), 2), reverse=True):
            own[at : at + 1] = ["hot", "stone"] if i % 10 == 0 else [rng.choice(["hot", "stone"]), rng.choice(words), rng.choice(["hot", "stone"])]
        docs.append((i, " ".join(own)))
        labels.append((i, int(i % 10 == 0)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    toxic = [r.predicted for r in found if r.doc_id % 10 == 0]
    assert len(toxic) >= 5 and all(toxic)
    assert not any(r.predicted for r in found if r.doc_id % 10)


def test_toxicity_edges(spark, docs, repeated, nothing, texts):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] + [(None, 1), (5, None), (6, 0), (6, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == len(texts)
    assert toxicity.toxicity(repeated, labels).count() == 2 * len(texts)
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert all(r.score < 1e-9 for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect())
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_quality_keeps_the_target(corpus):
    docs, labels = corpus
    found = quality.resample(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in found]) > 0.97
    kept = quality.keep_sampled(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.kept}


def test_quality_draws_k_by_gumbel_keys(corpus):
    docs, labels = corpus
    found = quality.resample(docs, labels, k=100, temperature=1.0).collect()
    order = sorted(found, key=lambda r: -r.key)
    assert {r.doc_id for r in found if r.kept} == {r.doc_id for r in order[:100]}


def test_cut_is_exact(spark):
    rng = random.Random(3)
    values = [rng.choice([0.0, 1e-9, -5.0, rng.gauss(0, 1e6), rng.random()]) for _ in range(5000)]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    ranked = sorted(values, reverse=True)
    for k in (1, 7, 1999, 4999):
        assert quality.cut(keys, k, bins=16, few=50) == ranked[k - 1]
    assert quality.cut(keys, 0) == float("inf") and quality.cut(keys, 5000) == float("-inf")


def test_gumbel_noise_has_its_mean_and_spread():
    noise = quality._gumbel(np.random.default_rng(0).integers(0, 2**63, 200_000, dtype=np.uint64) * np.uint64(2))
    assert noise.mean() == pytest.approx(0.5772, abs=0.02) and noise.std() == pytest.approx(np.pi / 6**0.5, abs=0.02)


def test_quality_edges(spark, docs, repeated, nothing, texts):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, quality int")
    assert quality.resample(docs, labels).count() == len(texts)
    assert quality.resample(repeated, labels).count() == 2 * len(texts)
    assert quality.resample(nothing, labels).count() == 0
    assert quality.resample(docs, labels.limit(0)).where("kept").count() == len(texts)
    assert quality.keep_sampled(docs, labels).columns == docs.columns


def languages(spark, n=240):
    rng = random.Random(2)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "ß"], "cc": ["éau", "ou", "ç", "tre"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randint(2, 40))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_language_on_held_out_rows(spark):
    df = languages(spark)
    found = langid.language(df, per_language=50, landmarks=10).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (brute.crc(r.doc_id, 4) == 2) for r in found)
    assert np.mean([r.lang == r.lang_pred for r in found if r.held_out]) > 0.97


def test_language_edges(docs, repeated, nothing, texts):
    found = {r.doc_id: r for r in langid.language(docs).collect()}
    for i, text in enumerate(texts):
        assert (found[i].lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= found[i].score <= 1 and found[i].lang_pred in ("en", "de", "und")
    assert langid.language(repeated).count() == 2 * len(texts)
    assert langid.language(nothing).count() == 0


def test_presence_is_that_of_the_ngrams():
    """Texts with the same n-grams have the same presence, whatever their neighbours in the batch."""
    import pyarrow as pa

    from corpusloom.llm.tokens import buffer_of

    a = langid._presence(*buffer_of(pa.array(["abab", "", "xyz", "ABAB"])))
    assert (a[0] == a[3]).all() and a[1].sum() == 0 and a[0].sum() == 2 + 2 + 2 + 1
    assert a[2].sum() == 3 + 2 + 1


def test_language_model_base_is_exact(docs, repeated, texts, nothing):
    found = {r.doc_id: r for r in hmm.score(docs).collect()}
    want = brute.unigram(list(enumerate(texts)), lambda k: brute.crc(k, 5) == 1)
    for i in range(len(texts)):
        row, (n, known, total, base) = found[i], want[i]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (n, known, total)
        assert row.base_score == pytest.approx(base) and row.score < 0
    twice = hmm.score(repeated).collect()
    again = brute.unigram([((i, j), t) for j in range(2) for i, t in enumerate(texts)], lambda k: brute.crc(k[0], 5) == 1)
    assert len(twice) == 2 * len(texts)
    for row in twice:
        n, known, total, base = again[row.doc_id, 0]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (n, known, total) and row.base_score == pytest.approx(base)
    assert hmm.score(nothing).count() == 0


def test_language_model_symbols_have_no_block_floor(spark):
    """Words of two topics, each often in the corpus but fewer than 20 times in any block, tell the topic."""
    rng = random.Random(4)
    topics = [["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)] for _ in range(2)]
    rows = [(i, " ".join(rng.choices(topics[i % 2], k=120))) for i in range(500)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 25), "doc_id long, text string")
    held = [r for r in hmm.score(docs, iterations=8).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert len(held) > 50 and gain > 0.15


def test_language_model_symbols_have_no_limit(spark):
    """More than 10,000 words above the count are all symbols: the sums of a round have a row for each."""
    docs = spark.range(8).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 200000), i -> concat('w', i % 12500))) AS text")
    sizes = []
    improved = hmm._improved
    try:
        hmm._improved = lambda train, model: sizes.append(len(model.emit)) or improved(train, model)
        hmm.score(docs, F.lit(False), iterations=1)
    finally:
        hmm._improved = improved
    assert sizes == [12500 + 1 + hmm.RARE]


def test_forward_and_expected_counts_by_enumeration():
    rng = np.random.default_rng(0)
    states, size = 3, 5
    model = hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(size), states).T)
    lengths = np.array([4, 1, 3, 4])
    classes = rng.integers(0, size, lengths.sum())
    likelihood, starts, moves, emits = [], np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
    from itertools import product

    for low, n in zip(np.cumsum(lengths) - lengths, lengths):
        own = classes[low : low + n]
        paths = {}
        for path in product(range(states), repeat=int(n)):
            p = model.start[path[0]] * model.emit[own[0], path[0]]
            for t in range(1, n):
                p *= model.move[path[t - 1], path[t]] * model.emit[own[t], path[t]]
            paths[path] = p
        total = sum(paths.values())
        likelihood.append(np.log10(total))
        for path, p in paths.items():
            starts[path[0]] += p / total
            for t in range(n):
                emits[own[t], path[t]] += p / total
                if t:
                    moves[path[t - 1], path[t]] += p / total
    assert hmm.forward(model, classes, lengths) == pytest.approx(likelihood)
    for got, want in zip(hmm.expected_counts(model, classes, lengths), (starts, moves, emits)):
        assert got == pytest.approx(want)
