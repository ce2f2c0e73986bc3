"""Fingerprints and their links against plain versions."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import graph, simhash

from . import brute

LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text):
    words = brute.spaced((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values):
    """Each value's least connected one, over all pairs."""
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= simhash.BITS:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_documents(spark, docs, texts, repeated, nothing):
    prints = {i: fingerprint(t) for i, t in enumerate(texts)}
    joined = classes(sorted(set(prints.values())))
    least = {}
    for i, fp in sorted(prints.items()):
        least.setdefault(joined[fp], i)
    want = {i: (f"{fp:016x}", least[joined[fp]]) for i, fp in prints.items()}
    found = simhash.links(docs).select("doc_id", simhash.hexadecimal("fp").alias("f"), "component_id")
    assert {r.doc_id: (r.f, r.component_id) for r in found.collect()} == want
    twice = simhash.links(repeated).collect()
    assert len(twice) == 2 * len(texts) and {r.doc_id: r.component_id for r in twice} == {i: c for i, (_, c) in want.items()}
    assert simhash.links(nothing).count() == 0


@pytest.mark.parametrize("flips", [64, 14])
def test_links_connect_what_all_pairs_connect(spark, flips):
    """With few bits to flip the buckets are large, and go through the values in between."""
    rng = random.Random(flips)
    values = {0, -1}
    for n in (1, 2, 40, 250):
        base = rng.getrandbits(64)
        for _ in range(n):
            value = base
            for _ in range(rng.randint(0, 5)):
                value ^= 1 << rng.randrange(flips)
            values.add(value - (1 << 64) if value >> 63 else value)
    values = sorted(values)
    edges = simhash.near(spark.createDataFrame([(v,) for v in values], "fp long"))
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= simhash.BITS for r in edges.collect())
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert {v: found.get(v, v) for v in values} == classes(values)


def test_every_close_pair_has_a_chain(spark):
    """All pairs at two bits' distance share a key whose chain holds, wherever the bits are."""
    rng = random.Random(2)
    rows = [(rng.getrandbits(63), 1 << i | 1 << j) for i in range(63) for j in range(63)]
    df = spark.createDataFrame(rows, "fp long, flip long").withColumn("other", F.col("fp").bitwiseXOR(F.col("flip")))
    key = F.explode(F.array_intersect(simhash._keys(F.col("fp")), simhash._keys(F.col("other"))))
    shared = df.withColumn("key", key).where(simhash._chained(F.col("flip"), F.col("key")))
    assert shared.select("fp", "flip").distinct().count() == len(rows)


def test_ids_of_any_kind_and_null_ids(spark):
    rows = [("b", "x y z w"), (None, "x y z w"), ("c", "X Y  z w"), (None, "quite another text than that one")]
    found = simhash.links(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [r.component_id for r in sorted(found, key=lambda r: (r.doc_id or "", r.component_id or ""))] == [None, "b", "b", "b"]
