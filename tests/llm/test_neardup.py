"""Near duplicates and components against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from corpusloom.llm import graph, neardup
from corpusloom.llm.tokens import ALNUM, SPACED, by_bytes, windows, words_of

from . import brute


def family(n, seed):
    """Near copies of one text, each with its own few changes, so that many are not linked directly."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 999)}" for _ in range(150)]
    out = []
    for _ in range(n):
        own = base[:]
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = f"v{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


def test_components_of_near_copies(spark, texts, nothing):
    rows = list(enumerate(texts + family(60, 1) + family(25, 2) + ["a b c d e"] * 3))
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.links(df).collect()}
    want = brute.near_duplicates(rows)
    assert found == want and len({c for _, c in want.values()}) < len(rows) - 60
    kept = neardup.keep_first(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert neardup.links(nothing).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (7, "A b c d e f"), (None, "a b c d e f"), (9, None), (9, "")]
    found = neardup.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in found) == [
        (-1, 2, -1), (3, 2, 3), (3, 2, 3), (7, 2, 3), (9, 0, 9), (9, 0, 9),
    ]


def test_estimate_is_close_to_the_similarity(spark):
    texts = family(12, 5)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    signed = neardup._signatures(rows)
    pairs = neardup._side(signed.select("id", "n", "bits"), "a").crossJoin(neardup._side(signed.select("id", "n", "bits"), "b"))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(146)} for i, t in enumerate(texts)}
    for r in pairs.select("a", "b", neardup.estimate("bits_a", "bits_b").alias("e")).collect():
        true = len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b])
        assert abs(r.e - true) < 0.16


def test_components_of_paths_and_stars(spark):
    rng = random.Random(8)
    nodes = list(range(400))
    rng.shuffle(nodes)
    edges = list(zip(nodes[:150], nodes[1:150])) + [(nodes[200], n) for n in nodes[201:300]] + [(5, 5)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[n] for n in nodes[:150]} == {min(nodes[:150])} and {found[n] for n in nodes[200:300]} == {min(nodes[200:300])}
    assert len(found) == 250
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_and_windows():
    texts = ["", None, "a", " a  b\tc\n", "é 日 x", "a" * 100 + " b", "x y"]
    words = words_of(pa.array(texts), SPACED)
    data = words.data.tobytes()
    got = [data[a:b].decode() for a, b in zip(words.start, words.end)]
    assert got == [w for t in texts for w in brute.spaced(t)] and words.counts.tolist() == [len(brute.spaced(t)) for t in texts]
    by_word = {}
    for word, value in zip(got, words.hash.tolist()):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)
    values, begin = windows(words, 2)
    pairs = [(got[b], got[b + 1]) for b in begin]
    assert pairs == [(w[i], w[i + 1]) for w in map(brute.spaced, texts) for i in range(len(w) - 1)]
    low = words_of(pa.array(["A-b C9", "É x"]), ALNUM, lower=True)
    assert [low.data[a:b].tobytes().decode() for a, b in zip(low.start, low.end)] == ["a", "b", "c9", "É", "x"]


def test_slices_of_batches_and_long_texts():
    texts = ["word " * 50, None, "x", "y z " * 4000, ""] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(by_bytes(iter([batch.slice(1, 13)]), most=300))
    assert sum(p.num_rows for p in parts) == 13
    whole = words_of(batch.column(0).slice(1, 13))
    assert np.array_equal(np.concatenate([words_of(p.column(0)).hash for p in parts]), whole.hash)
