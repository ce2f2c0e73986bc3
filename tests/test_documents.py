from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.frontmatter import core_scalar, read_mapping, write_yaml
from corpusloom.operators import audit, pages as pageops
from corpusloom.operators.repair import repair_documents
from corpusloom.sources import documents as src

NESTED = """---
type: concept
title: Nested
description: One  line
generated:
  by: tool
  at: 2026-08-01
verified:
  - by: me
    at: 2026-08-02
sources:
  - id: SRC-1
    resource: /sources/SRC-1.md
producer_data:
  nested:
    enabled: true
    weights: [1, 2.5, yes]
---

Body line

[[wiki]] end
"""

BROKEN = [
    ("type: a\ntype: b\n", "frontmatter_duplicate_key"), ("type: &a b\nx: *a\n", "frontmatter_alias_forbidden"),
    ("type: !x a\n", "frontmatter_custom_tag_forbidden"), ("type: a\n...\n---\ntype: b\n", "frontmatter_multiple_documents"),
    ("type: [a\n", "frontmatter_parse_error"), ("type: 1\n", "concept_missing_type"), ("title: x\n", "concept_missing_type"),
    ("- a\n", "frontmatter_parse_error"), ("true: 1\n\"true\": 2\ntype: a\n", "frontmatter_duplicate_key"),
    ("type: a\nx: " + "z" * (128 * 1024) + "\n", "frontmatter_limit_bytes"),
    ("type: a\nx: " + "[" * 33 + "]" * 33 + "\n", "frontmatter_limit_depth"),
    ("type: a\nx: {y: 1, y: 2}\n", "frontmatter_duplicate_key"),
]


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_nested_document(spark):
    documents, diagnostics = src.discover_documents(files(spark, [("concepts/nested.md", NESTED)]))
    row = documents.first()
    assert diagnostics.isEmpty()
    assert (row["id"], row["type"], row["title"]) == ("concepts/nested", "concept", "Nested")
    assert row["body"] == "Body line\n\n[[wiki]] end\n"
    assert row["sources_kind"] == "canonical" and json.loads(row["sources"])[0]["id"] == "SRC-1"
    assert json.loads(row["extensions"]) == {"producer_data": {"nested": {"enabled": True, "weights": [1, 2.5, "yes"]}}}
    assert row["has_legacy_wikilinks"] and row["legacy_fields"] == ["wikilinks"]
    assert json.loads(row["frontmatter"])["generated"]["at"] == "2026-08-01"


def test_broken_documents(spark):
    rows = [(f"b/{i:02}.md", f"---\n{block}---\n\nx\n") for i, (block, _) in enumerate(BROKEN)]
    rows += [("b/90.md", "no fence"), ("b/91.md", "---\ntype: a\nnever closed")]
    _, diagnostics = src.discover_documents(files(spark, rows))
    codes = {r["path"]: r["code"] for r in diagnostics.collect()}
    assert [codes[f"b/{i:02}.md"] for i in range(len(BROKEN))] == [c for _, c in BROKEN]
    assert codes["b/90.md"] == "frontmatter_missing" and codes["b/91.md"] == "frontmatter_parse_error"


def test_closing_fences(spark):
    rows = [
        ("a.md", "---\ntype: a\n---\n\n\nx\n---\ny"), ("b.md", "---\r\ntype: a\r\n---\r\nx"),
        ("c.md", "---\ntype: a\n---"), ("d.md", "---\ntype: a\n...\n---\nbody"),
    ]
    documents, _ = src.discover_documents(files(spark, rows))
    bodies = {r["id"]: r["body"] for r in documents.collect()}
    assert bodies == {"a": "\nx\n---\ny", "b": "x", "c": "", "d": "body"}


def test_collisions_and_reserved_names(spark):
    good = "---\ntype: a\n---\n"
    rows = [("A/x.md", good), ("a/X.md", good), ("a/index.md", "junk"), ("LOG.md", "junk"), ("café.md", good), ("café.md", good)]
    documents, diagnostics = src.discover_documents(files(spark, rows))
    assert sorted(r["path"] for r in documents.collect()) == ["A/x.md", "café.md"]
    assert {(r["path"], r["code"]) for r in diagnostics.collect()} == {
        ("a/X.md", "concept_identity_collision"), ("café.md", "concept_identity_collision"),
    }


def test_serialise_round_trip(spark):
    documents, _ = src.discover_documents(files(spark, [("n.md", NESTED)]))
    again, _ = src.discover_documents(src.serialise_documents(documents))
    first, second = documents.first().asDict(), again.first().asDict()
    assert first["body"].rstrip("\n") == second["body"].rstrip("\n")
    for key in ("frontmatter", "extensions", "sources", "type"):
        load = json.loads if key != "type" else str
        assert load(first[key]) == load(second[key])


@pytest.mark.parametrize("value", ["yes", "1", "true", "a: b", "- x", "", " x", "null", "x #y", "2024-01-01", "a\nb", "a\nb\n", "é", "\"q\"", "0x1F", "*a", "@x", "tab\tx"])
def test_yaml_strings_survive(value):
    assert read_mapping(write_yaml({"type": value, "list": [value, {"k": value}]})) == {"type": value, "list": [value, {"k": value}]}


def test_core_schema():
    assert [core_scalar(t) for t in ("1", "-2", "0o17", "0x1F", "1e3", ".5", "true", "NULL", "~", "yes", "1_000", "2024-01-01")] == [
        1, -2, 15, 31, 1000.0, 0.5, True, None, None, "yes", "1_000", "2024-01-01",
    ]


def test_read_files(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.MD").write_text("---\ntype: a\n---\n", encoding="utf-8")
    (tmp_path / "y.md").write_text("é", encoding="utf-8")
    (tmp_path / "z.txt").write_text("no", encoding="utf-8")
    rows = {r["path"]: r["content"] for r in src.read_files(spark, str(tmp_path)).collect()}
    assert rows == {"a b/x.MD": "---\ntype: a\n---\n", "y.md": "é"}


def test_corpus_format(spark):
    index = lambda v: f"---\nokf_version: {v}\n---\n\n# T\n"
    rows = [
        ("legacy", "{}", None), ("named", '{"knowledge_format":"legacy"}', "# no frontmatter"),
        ("new", '{"knowledge_format":"okf-0.2"}', index('"0.2"')), ("fresh", '{"knowledge_format":"okf-0.2"}', None),
        ("number", '{"knowledge_format":"okf-0.2"}', index("0.2")), ("bad", '{"knowledge_format":"x"}', None),
        ("list", "[1]", None), ("old", "{}", index('"0.1"')), ("null", '{"knowledge_format":null}', None),
    ]
    state = src.corpus_format(spark.createDataFrame(rows, "vault string, config string, root_index string"))
    got = {r["vault"]: (r["knowledge_format"], r["blocking"], r["code"]) for r in state.collect()}
    assert got == {
        "legacy": ("legacy", False, None), "named": ("legacy", False, None), "new": ("okf-0.2", False, None),
        "fresh": ("okf-0.2", False, None), "number": ("okf-0.2", True, "okf_version_mismatch"),
        "bad": ("legacy", True, "config_invalid_knowledge_format"), "list": ("legacy", True, "config_invalid_knowledge_format"),
        "old": ("legacy", True, "okf_version_mismatch"), "null": ("legacy", True, "config_invalid_knowledge_format"),
    }


def test_repair(spark):
    rows = [
        ("entities/no-type.md", "---\ntitle: x\n---\n\nbody"), ("concepts/plain.md", "# Heading\n\ntext"),
        ("skills/bad.md", "---\na: [1\n---\n\nbody\n"), ("cases/open.md", "---\ntype: a\nnever"), ("concepts/some_name-x.md", "text"),
        ("concepts/dup.md", "---\ntype: a\ntype: b\n---\n"),
    ]
    known = spark.createDataFrame([("skills/bad", "case", "Known")], "id string, type string, title string")
    got = {r["path"]: r for r in repair_documents(files(spark, rows), known).collect()}
    assert got["entities/no-type.md"]["content"] == '---\ntype: "entity"\ntitle: x\n---\n\nbody'
    assert got["concepts/plain.md"]["content"] == "---\ntype: concept\ntitle: Heading\nlegacy_repair: true\n---\n\n# Heading\n\ntext\n"
    assert got["skills/bad.md"]["content"] == (
        "---\ntype: case\ntitle: Known\nlegacy_repair: true\nlegacy_frontmatter: |\n  a: [1\n---\n\nbody\n"
    )
    assert got["cases/open.md"]["status"] == "refused" and got["cases/open.md"]["content"] == rows[3][1]
    assert "title: some name x" in got["concepts/some_name-x.md"]["content"]
    assert "concepts/dup.md" not in got
    repaired = spark.createDataFrame([(r["path"], r["content"]) for r in got.values() if r["status"] != "refused"], "path string, content string")
    assert src.discover_documents(repaired)[1].isEmpty()


def test_ownership(spark):
    paths = ["raw/x", "rawish/x", "meta/events.jsonl", "meta/registry.json", "wiki/a/INDEX.md", "wiki/log.md", "wiki/a/log.md"]
    got = {r["path"]: r["protected"] for r in audit.ownership_audit(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert [got[p] for p in paths] == [True, False, True, True, True, True, False]


def test_obsolete_outputs(spark):
    old = spark.createDataFrame([("index.md",), ("a/index.md",), ("b/index.md",)], "path string")
    new = spark.createDataFrame([("b/index.md",)], "path string")
    assert [r["path"] for r in audit.obsolete_outputs(old, new).collect()] == ["a/index.md"]


def test_observation_pages(spark):
    rows = [("2024-01-02", "t1", "标题", "c1", "high", "", ""), ("2024-01-02", "t2", "题", "c2", "other", "a b", "ctx")]
    df = spark.createDataFrame(rows, "day string, observed_at string, title string, content string, relevance string, tags string, source_context string")
    row = pageops.observations_to_documents(df).first()
    assert row["id"] == "sources/obs-2024-01-02-" and row["replaced"] == 1 and row["tags"] == ["a", "b"]
    assert row["body"] == "# 📝 Observation: 题\n\nc2\n\n*Relevance: other*\n*Context: ctx*\n*Tags: a b*\n\n---\n*Observed: t2*"


def index_text(spark, rows, title):
    from corpusloom.operators.registry import directory_index, render_directory_index

    docs = spark.createDataFrame(rows, "id string, title string, description string")
    out = {}
    for row in render_directory_index(directory_index(docs, title)).collect():
        out.setdefault(row["dir"], []).append(row["line"])
    return {folder: "\n".join(lines) + "\n" for folder, lines in out.items()}


def test_directory_index_lists_folders_and_pages(spark):
    got = index_text(spark, [
        ("tools/hand/saws", "Saws", "For wood."), ("start here", "Start", "Where to\n  begin."), ("tools/100% steel", "Steel [raw]", ""),
    ], "Workshop")
    assert sorted(got) == ["", "tools", "tools/hand"]
    assert got[""] == (
        '---\nokf_version: "0.2"\n---\n\n# Workshop\n\n## Directories\n\n- [tools/](tools/)\n\n'
        "## Concepts\n\n- [Start](start%20here.md) — Where to begin.\n"
    )
    assert got["tools"] == "# tools\n\n## Directories\n\n- [hand/](hand/)\n\n## Concepts\n\n- [Steel \\[raw\\]](100%25%20steel.md)\n"
    assert got["tools/hand"] == "# hand\n\n## Concepts\n\n- [Saws](saws.md) — For wood.\n"


def test_empty_directory_index(spark):
    assert index_text(spark, [], "Wiki") == {"": '---\nokf_version: "0.2"\n---\n\n# Wiki\n'}


def test_page_index(spark):
    from corpusloom.operators.registry import build_registry, render_index_by_type

    docs = spark.createDataFrame([("b/y", "skill", None, None), ("a/x", "concept", "X", "2024-01-01")], "id string, type string, title string, created string")
    text = "\n".join(r["value"] for r in render_index_by_type(build_registry(docs), "now").collect())
    assert text == (
        "# Wiki Index\n\n> Auto-generated from meta/registry.json. Do not edit manually.\n\n"
        "## Concepts\n\n- [[a/x]] — X *(created: 2024-01-01)*\n\n## Skills\n\n- [[b/y]] — y *(created: unknown)*\n\n"
        "---\n*Last updated: now* | *Total pages: 2*"
    )


def test_created_documents(spark):
    rows = spark.createDataFrame([("a.md", '{"type":"x","k":1,"tags":["a"]}', "b\r\n\n", '[{"id":"S"}]'), ("b.md", '{"type":"x","sources":[]}', "", None)], "path string, fields string, body string, sources string")
    good, bad = src.create_documents(rows)
    row = good.first()
    assert (row["frontmatter"], row["extensions"], row["body"]) == ('{"tags":["a"],"type":"x"}', '{"k":1}', "b")
    assert bad.count() == 1
    assert src.serialise_documents(good).first()["content"] == "---\ntype: x\ntags:\n  - a\nsources:\n  - id: S\nk: 1\n---\n\nb\n"


def test_index_in_locale_order(spark):
    from corpusloom.operators.registry import index_in_locale_order

    titles = ["zebra", "\u00c4pfel", "apfel", "Apfel", "\u00e9clair", "eclair", "Z1", "a b", "ab", "ab", "e\u0301clair", "", None]
    pages = spark.createDataFrame([(f"p{i:02}", "en" if i != 8 else None, t) for i, t in enumerate(titles)], "id string, type string, title string")

    def order(**how):
        return [r["id"] for r in index_in_locale_order(pages, **how).where("type = 'en'").orderBy("position").collect()]

    # Letters first, then accents, then small before capital; equal titles by id.
    assert order() == ["p07", "p09", "p02", "p03", "p01", "p05", "p04", "p10", "p11", "p12", "p06", "p00"]
    swedish = order(locale="sv")
    assert swedish[-1] == "p01" and swedish.index("p02") < swedish.index("p00")
    assert order(by="id") == sorted(set(order()))
    unknown = index_in_locale_order(pages).where("type = 'unknown'").collect()
    assert [(r["position"], r["id"]) for r in unknown] == [(1, "p08")]
    assert index_in_locale_order(pages.limit(0)).count() == 0


def test_fences_are_found_without_reading_the_rest(spark):
    """A text of a megabyte without a closing fence, with line ends of all kinds; parts of texts with several fences."""
    texts = {
        "---\na: 1\n...\n---\nb\n---\n\n\nc": (True, True, "a: 1\n...\n---\nb\n", "\nc"), "---\na: 1\r\n---": (True, True, "a: 1\n", ""),
        "---\n---\nx": (True, True, "", "x"), "a\n---\nb": (False, False, None, None), "---\n" + "x\n--" * 250_000: (True, False, "", None),
    }
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    plan = df.select(src._split(F.col("v")).alias("s"))
    # Only a second fence is looked for with a regular expression.
    assert "^(.*?)" not in plan._jdf.queryExecution().optimizedPlan().toString()
    for row, want in zip(plan.collect(), texts.values()):
        assert all(w is None or g == w for g, w in zip(row.s, want))
