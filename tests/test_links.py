from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.commonmark import markdown_links
from corpusloom.operators import lint, links
from corpusloom.operators.skew import with_positions

# One of each shape that decides whether brackets are a link.
SHAPES = [
    ("see [the harbour](harbour.md?x=1#quay) at dusk", ["harbour.md?x=1#quay"]),
    ("[ferries][lines] and [Timetable][] and [fares]\n\n[lines]: lines.md\n[timetable]: timetable.md\n[FARES]: fares.md", ["lines.md", "timetable.md", "fares.md"]),
    ("![a map](map.md) ![legend][key]\n\n[key]: key.md", []),
    ("<https://ferry.example/> <piers/north.md> <a href='pier.md'>pier</a>", []),
    ("``[tick](tick.md)`` \\[kept](out.md) \\\\[in](in.md)", ["in.md"]),
    ("para\n\n    [block](block.md)\n\n~~~\n[tilde](tilde.md)\n~~~\n[after](after.md)", ["after.md"]),
    ("[nobody uses]: this.md", []),
]


def targets(spark, body):
    df = spark.createDataFrame([(body,)], "b string")
    return [t["target"] for t in df.select(links.markdown_link_targets(F.col("b"))).first()[0]]


def test_reference_and_inline_links(spark):
    for body, want in SHAPES:
        assert targets(spark, body) == want, body


def test_scan_and_pattern_agree(spark):
    bodies = [
        "a [x](a.md) b [y](/b/c.md?q#f) [[w|z]] [no link] (p) [z](c(d).md)",
        "one\n\n- [x](a.md)\n- [y](b.md)\n\n> [q](c.md)\n\n# [h](d.md)",
        "[a [b](c.md)](d.md) [e]() [f](g h.md) [t](u.md \"title\") [i](<a b.md>)",
        "[multi\nline](a.md) [x]\n(b.md)\n\ttabbed [x](c.md)",
    ]
    for body in bodies:
        assert targets(spark, body) == [t for t, _ in markdown_links(body)]
    assert targets(spark, bodies[2]) == ["c.md", "u.md", "a b.md"]


def page(spark, rows):
    return spark.createDataFrame(rows, "id string, body string")


def test_edges_and_unresolved(spark):
    docs = page(spark, [
        ("concepts/source", "[one](inline.md) [[concepts/inline]] [two](./inline.md) [bad](bad%ZZ.md) [m](missing.md) [e](../../o.md)"),
        ("concepts/inline", "[[ gone |x]] [[concepts/source]]"), ("concepts/lone", ""),
    ])
    resolved = links.resolve_links(links.extract_links(docs), docs)
    edges = {tuple(r) for r in links.edges(resolved).collect()}
    assert edges == {("concepts/source", "concepts/inline"), ("concepts/inline", "concepts/source")}
    codes = sorted(r["code"] for r in links.link_diagnostics(resolved).collect())
    assert codes == ["link_path_escape", "link_unresolved", "link_unresolved", "link_unresolved"]
    back = {tuple(r) for r in links.backlinks(docs, links.edges(resolved)).collect()}
    assert ("concepts/lone", None) in back and len(back) == 3


def test_lint_pair(spark):
    docs = page(spark, [
        ("concepts/a", "[m](/concepts/missing-topic.md)"), ("concepts/b", "[[concepts/missing-topic]]"),
        ("concepts/c", "⚠️ **Contradiction**: x"),
    ])
    resolved = links.resolve_links(links.extract_links(docs), docs)
    inbound = links.inbound_counts(docs, links.edges(resolved))
    summary = lint.lint_summary(docs, resolved, inbound).first()
    assert tuple(summary) == (3, 3, 2, 1)
    unresolved = links.unresolved_links(resolved)
    stubs = lint.stub_candidates(unresolved, docs).collect()
    assert [(s["id"], s["title"], s["mentions"]) for s in stubs] == [("concepts/missing-topic", "missing topic", 2)]


def test_links_without_target_and_hot_targets(spark):
    """External links have no target; one page that most links point to joins like any other."""
    docs = page(spark, [("a/hub", ""), *[(f"a/p{i}", "[h](hub.md) [e](https://x.example/) [[a/hub]] [n](none.md)") for i in range(300)]])
    resolved = links.resolve_links(links.extract_links(docs), docs)
    assert resolved.count() == 1200 and resolved.where("dst is null and not known").count() == 300
    inbound = {r["id"]: r["n"] for r in links.inbound_counts(docs, links.edges(resolved)).collect()}
    assert inbound["a/hub"] == 300 and sum(inbound.values()) == 300


def test_positions_span_slices(spark):
    df = spark.range(10_000).select(
        F.when(F.col("id") % 3 > 0, "big").otherwise(F.concat(F.lit("g"), (F.col("id") % 300).cast("string"))).alias("g"),
        F.xxhash64("id").alias("o"),
    )
    got = with_positions(df, ["g"], ["o"], slices=7)
    from pyspark.sql import Window

    wide = with_positions(df.withColumn("text", F.repeat(F.lit("x"), 5)), ["g"], ["o"], slices=7)
    carried = with_positions(df.withColumn("text", F.repeat(F.lit("x"), 5)), ["g"], ["o"], slices=3, narrow=True)
    assert wide.drop("text").exceptAll(got).isEmpty() and carried.drop("text").exceptAll(got).isEmpty()
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("bigint"))
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == 10_000
