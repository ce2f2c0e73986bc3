"""Maintained projections against full rebuilds after every batch."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import links
from corpusloom.plans.rebuild import rebuild
from corpusloom.streaming.maintained import Maintained, maintain_stream, refresh_delta

CHANGES = "path string, content string, deleted boolean, mtime long"
PAGE = "---\ntype: {0}\ntitle: {1}\ndescription: about {1}\n---\n\n{2}\n"


def rows_of(df):
    return sorted(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.collect())


def check(spark, state, pages):
    """All views equal those of a rebuild over pages {path: content}."""
    files = spark.createDataFrame(list(pages.items()), "path string, content string")
    frames = rebuild(files).frames
    unresolved = links.unresolved_links(frames["links"])
    assert rows_of(state.inbound()) == rows_of(frames["inbound"])
    assert rows_of(state.backlinks()) == rows_of(frames["backlinks"])
    assert rows_of(state.gaps()) == rows_of(frames["gaps"])
    assert rows_of(state.gap_counts()) == rows_of(links.gap_counts(unresolved))
    assert rows_of(state.directory_index()) == rows_of(frames["directory_index"])
    assert rows_of(state.status()) == rows_of(frames["status"])
    assert rows_of(state.documents()) == rows_of(frames["documents"])


def invented(rng, path):
    targets = [f"/a/{rng.randint(0, 7)}.md" for _ in range(rng.randint(0, 4))] + rng.choice([[], ["/b/c/1.md"], ["../../x.md", "http://e.org/y.md"]])
    text = " ".join(f"[t]({t})" for t in targets) + rng.choice(["", " [[a/3]] [[a/3|x]] [[lost]]", f" [[{path[:-3]}]]"])
    return PAGE.format(rng.choice(["note", "concept"]), path, text)


def test_random_batches_equal_rebuilds(spark, tmp_path):
    rng = random.Random(11)
    root = str(tmp_path / "kept")
    paths = [f"a/{i}.md" for i in range(7)] + ["b/c/1.md", "b/c/2.md", "b/d/deep/3.md", "top.md"]
    pages, stamp = {}, 0
    for epoch in range(5):
        batch = []
        for path in rng.sample(paths, 11 if epoch == 0 else 4):
            stamp += 1
            kind = rng.random()
            if epoch and kind < 0.25:
                batch.append((path, None, True, stamp))
                pages.pop(path, None)
            elif epoch and kind < 0.4:
                batch.append((path, "no frontmatter", False, stamp))
            else:
                batch.append((path, "outdated", False, 0))
                batch.append((path, invented(rng, path), False, stamp))
                pages[path] = batch[-1][1]
        state = refresh_delta(spark.createDataFrame(batch, CHANGES).repartition(3), epoch, root, buckets=5)
        assert state.version == epoch + 1
        check(spark, Maintained.open(spark, root), pages)
    assert refresh_delta(spark.createDataFrame(batch, CHANGES), epoch, root) is None
    assert state.superseded().count() > 0


def test_clashes_wait_until_the_other_page_goes(spark, tmp_path):
    root = str(tmp_path / "kept")
    step = lambda epoch, *rows: refresh_delta(spark.createDataFrame(rows, CHANGES), epoch, root, buckets=3)
    text = PAGE.format("note", "A", "[b](/b.md)")
    step(0, ("x and y/A.md", text, False, 1), ("b.md", text, False, 1))
    state = step(1, ("X and Y/a.md", text, False, 2), ("b.md", PAGE.format("note", "B", ""), False, 2))
    found = state.quarantine().collect()
    assert [(r.code, r.path) for r in found] == [("concept_identity_collision", "X and Y/a.md")]
    assert found[0].message == "Identity collision between x and y/A.md and X and Y/a.md"
    # An edit of the published page is not a clash with the page that waits.
    state = step(2, ("x and y/A.md", PAGE.format("note", "A2", ""), False, 3))
    check(spark, state, {"x and y/A.md": PAGE.format("note", "A2", ""), "b.md": PAGE.format("note", "B", "")})
    state = step(3, ("x and y/A.md", None, True, 4))
    assert state.quarantine().count() == 0
    check(spark, state, {"X and Y/a.md": text, "b.md": PAGE.format("note", "B", "")})
    state = step(4, ("X and Y/a.md", None, True, 5), ("b.md", None, True, 5), ("index.md", text, False, 5))
    assert state.status().first().health == "Empty" and state.inbound().count() == 0 and not state.at


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    root = str(tmp_path / "kept")
    many = spark.range(3000).select(
        F.concat(F.lit("p/"), F.col("id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("---\ntype: t\n---\n\n[hub](/p/0.md) [n](/p/"), ((F.col("id") * 7) % 3000).cast("string"), F.lit(".md)")).alias("content"),
        F.lit(False).alias("deleted"), F.lit(1).cast("long").alias("mtime"),
    )
    first = refresh_delta(many, 0, root, buckets=64)
    assert first.written > 4 * 60
    one = spark.createDataFrame([("p/5.md", "---\ntype: t\n---\n\n[hub](/p/0.md) [n](/p/9.md)", False, 2)], CHANGES)
    second = refresh_delta(one, 1, root)
    assert second.buckets == 64 and second.written <= 12
    inbound = {r.id: r.n for r in second.inbound().where("id in ('p/0', 'p/9', 'p/35')").collect()}
    assert inbound == {"p/0": 3000, "p/9": 2, "p/35": 0}


def test_stream_and_taken_versions(spark, tmp_path):
    root, folder = str(tmp_path / "kept"), str(tmp_path / "in")
    text = PAGE.format("note", "A", "[[b]]")
    for number, rows in enumerate([[("a.md", text, False, 1)], [("b.md", text, False, 2)]]):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"{folder}/n{number}")
        stream = spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true").parquet(folder)
        maintain_stream(stream, root, str(tmp_path / "ckpt"), buckets=2).awaitTermination(240)
    late = Maintained.open(spark, root)
    check(spark, late, {"a.md": text, "b.md": text})
    refresh_delta(spark.createDataFrame([("c.md", text, False, 3)], CHANGES), 9, root)
    with pytest.raises(Exception, match="exist"):
        late.commit("other", 1)
    assert Maintained.open(spark, root).inbound().count() == 3


def test_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], CHANGES)
    state = refresh_delta(empty, 0, str(tmp_path / "kept"))
    assert state.version == 1 and state.documents() is None
    assert state.status().first().total_pages == 0 and state.directory_index().count() == 1 and state.gaps().count() == 0
