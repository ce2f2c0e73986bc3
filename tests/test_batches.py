"""One greedy run over many slices, and levels of requirements, against plain loops."""

from __future__ import annotations

import random

import pytest

from corpusloom.operators.embeddings import _batches, batch_numbers
from corpusloom.operators.pages import requirement_faults, requirement_levels


@pytest.mark.parametrize("limits", [(5, 60), (1, 10), (50, 25), (7, 10_000)])
def test_numbers_of_one_run(spark, limits):
    rng = random.Random(sum(limits))
    rows = [(f"id{rng.random():.6f}é{i}", rng.choice([0, 1, 5, 9, 30, 61, 200])) for i in range(700)]
    want = {}
    for number, batch in enumerate(_batches(iter((i, "x" * n) for i, n in sorted(rows)), *limits)):
        want |= {i: number for i, _ in batch}
    frame = spark.createDataFrame(rows, "id string, chars int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.batch for r in batch_numbers(frame, *limits).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == want
    assert batch_numbers(frame.limit(0), *limits).count() == 0


def test_requirement_levels(spark):
    rows = [
        ("a", [], "draft", "p0"), ("b", ["a"], "active", "p3"), ("c", ["a", "b", "gone", "b"], "x", None), ("d", None, None, "p9"),
        ("e", ["f"], "draft", "p0"), ("f", ["g", "a"], "draft", "p0"), ("g", ["e"], "draft", "p0"), ("h", ["g", "b"], "draft", "p0"), ("i", ["i"], "draft", "p0"),
    ]
    df = spark.createDataFrame(rows, "id string, depends_on array<string>, status string, priority string")
    got = {r.id: (r.level, r.missing, r.cyclic) for r in requirement_levels(df).collect()}
    assert got == {
        "a": (0, 0, False), "b": (1, 0, False), "c": (2, 1, False), "d": (0, 0, False),
        **{i: (None, 0, True) for i in "efghi"},
    }
    faults = {(r.id, r.field, r.value) for r in requirement_faults(df).collect()}
    assert faults == {("c", "status", "x"), ("c", "priority", None), ("d", "status", None), ("d", "priority", "p9")}
    assert requirement_levels(df.limit(0)).count() == 0
