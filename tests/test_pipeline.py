from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import htmlmd, jsonmd
from corpusloom.functions.vectors import cosine_similarity, normalize_vector
from corpusloom.operators import embeddings as emb
from corpusloom.operators import ingest, repair, trajectories as traj
from corpusloom.plans.queries import QUERIES, letter_counts as letters
from corpusloom.session import SETTINGS
from corpusloom.plans.rebuild import latest_version, obsolete_versions, publish, read_current, rebuild
from corpusloom.sources import convert, packets
from corpusloom.streaming.refresh import refresh_batch, refresh_stream


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


def wrap(inner, title="T"):
    return f"<html><head><title>{title}</title><style>x</style></head><body><nav>menu</nav>{inner}<footer>f</footer></body></html>"


@pytest.mark.parametrize(
    "inner, parts",
    [
        ("<p>Tides are <strong>predictable</strong> and <b> strong </b>.</p>", ["# T", "**predictable**", "**strong**"]),
        ("<p>Not <em>every</em> pier, <del>none</del>.</p>", ["_every_", "~~none~~"]),
        ("<ol start=3><li>Moor</li><li>Unload</li></ol>", ["3. Moor", "4. Unload"]),
        ("<ul><li>north<li>south<ul><li>old pier</li></ul></ul>", ["* north", "* south", "  * old pier"]),
        ("<p>Set <kbd>tide --now</kbd></p>", ["`tide --now`"]),
        ("<pre><code class='language-sql'>select 1;\n  -- two</code></pre>", ["```sql\nselect 1;\n  -- two\n```"]),
        ("<table><tr><td>Pier<td>Depth</tr><tr><td>a|b</td></tr></table>", ["| Pier | Depth |\n| --- | --- |\n| a\\|b |  |"]),
        ("<img src=pier.png><img alt=none>", ["![](pier.png)"]),
        ("<h3>Piers_now</h3><a href='/n'>North</a> <a href='https://t.example'>https://t.example</a>", ["### Piers\\_now", "[North](/n)"]),
        ("<h1>Own</h1><p>up<br>down</p><hr><blockquote>said</blockquote>", ["# Own", "up  \ndown", "---", "> said"]),
    ],
)
def test_html(inner, parts):
    out = htmlmd.convert(wrap(inner))
    assert all(p in out for p in parts), out
    assert "menu" not in out and "<" not in out.replace("<https://t.example>", "")
    assert out.startswith("# T") == ("<h1>" not in inner)


def test_html_of_nothing_is_kept():
    source = "<html><head></head><body></body></html>"
    assert htmlmd.convert(source) == source


def test_nested_noise(spark):
    source = "a<nav><nav>x</nav></nav><scr<script>y</script>ipt>z</script>b<STYLE>q</style>"
    assert one(spark, source, convert.strip_noise) == htmlmd.strip_noise(source)


def test_xml(spark):
    xml = '<?xml version="1.0"?>\n<document>\n<title>Report &amp;</title><p>One &lt;b&gt; &#65;</p><item>Two</item></document>'
    out = one(spark, xml, convert.xml_to_markdown)
    assert out == "# Report &amp;\n\n\nReport &One <b> A\nTwo"
    empty = "<a><b></b></a>"
    assert one(spark, empty, convert.xml_to_markdown) == empty


def test_json():
    text = json.dumps({
        "name": " Harbour works ", "openingYear": 1931, "piers": ["north", "south"],
        "crews": [{"id": "c7", "boat_names": ["Kestrel"], "on": True}, {"shifts": []}, ["x"], None], "depth": 4.0,
    })
    assert jsonmd.convert(text).split("\n") == [
        "# Harbour works", "", "- **Name:**  Harbour works ", "- **Opening Year:** 1931", "## Piers", "", "- north", "- south", "",
        "## Crews", "", "### c7", "", "  - **Id:** c7", "### Boat names", "", "  - Kestrel", "", "  - **On:** true", "",
        "### Item 2", "", "### Shifts", "", "  - _(empty)_", "", "- Item 3:", "  - x", "", "- null", "", "- **Depth:** 4",
    ]
    assert jsonmd.convert('{"a": 1, ') == '{"a": 1, '
    assert jsonmd.convert("[]") == "# JSON Extract\n\n- _(empty)_"


def test_one_row_never_fails_or_stalls(spark):
    import time

    deep = "<b>" * 5000 + "x" + "</b>" * 5000
    pages = [deep, "<div>" * 5000 + "kept", "<script" * 150_000, "<nav>x" * 100_000, "a &#55296; &#" + "9" * 5000 + "; b", "<a " * 300_000]
    texts = ["[" * 900 + "1" + "]" * 900, "[" * 200_000, '{"a": "\\ud800"}', '{"n": ' + "9" * 6000 + "}"]
    began = time.time()
    for name, values in ((convert.html_to_markdown, pages), (convert.xml_to_markdown, pages), (convert.strip_noise, pages), (convert.json_to_markdown, texts)):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        assert all(r[0] is not None for r in df.select(name(F.col("v"))).collect())
    assert time.time() - began < 60
    assert "kept" in htmlmd.convert(pages[1]) and "x" in htmlmd.convert(deep)
    began = time.time()
    htmlmd.convert("<nav>" * 200_000)
    htmlmd.strip_noise("<style>" * 150_000)
    assert time.time() - began < 10


@pytest.mark.parametrize(
    "inner, text",
    [
        ("<h1>of&amp</h1>", "# of&amp"), ("<p>a &am b &a</p>", "a &am b &a"), ("<p>x &lty &#65 &#x41 &notit; z</p>", "x &lty &#65 &#x41 &notit; z"),
        ("<p>&amp;&#65;&#x42;&eacute;&amp</p>", "&AB\u00e9&amp"), ("<p>\ufdd0 &copy</p> tail &lt", "\ufdd0 &copy\n\ntail &lt"),
        ('<p><a href="/q?a=1&copy=2">go</a></p>', "[go](/q?a=1&copy=2)"), ("<pre>a &lt b &lt; c</pre>", "```\na &lt b < c\n```"),
    ],
)
def test_a_reference_without_its_semicolon_stays(inner, text):
    assert htmlmd.to_markdown(inner) == text


def test_entities(spark):
    assert one(spark, "&amp;lt; &LT; &#38;lt; &quot;&apos; &copy;", convert.decode_entities) == "&lt; < &lt; \"' &copy;"


def test_ids_continue_and_widen(spark):
    rows = spark.range(1005).select(F.lit("2024-01-01").alias("day"), F.lpad(F.col("id").cast("string"), 6, "0").alias("capture_order"))
    used = spark.createDataFrame([("SRC-2024-01-01-007",), ("SRC-2023-01-01-900",)], "id string")
    ids = [r["id"] for r in packets.daily_ids(rows, "SRC", used).orderBy("capture_order").collect()]
    assert ids[0] == "SRC-2024-01-01-008" and ids[-1] == "SRC-2024-01-01-1012" and len(set(ids)) == 1005


def test_used_ids_of_five_digits_stay_whole(spark, tmp_path):
    corpora = {
        "labels": "select cast(51281 as bigint) as doc_id", "events": "select cast(0 as bigint) as event_id, '{}' as props where false",
        "pages": "select cast(0 as bigint) as page_id, '' as url, '' as html where false",
        "documents": "select cast(7 as bigint) as doc_id, 'x' as text, 'en' as lang",
    }
    for name, sql in corpora.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [r.id for r in QUERIES["capture_packets"](spark, str(tmp_path)).collect()] == ["SRC-2024-06-01-51282"]


def raw(spark, rows):
    return spark.createDataFrame(rows, "day string, capture_order string, kind string, name string, title string, payload string")


def test_capture(spark):
    got = {r["capture_order"]: r for r in packets.capture_sources(raw(spark, [
        ("2024-01-01", "a", "url", "https://e.com/x.pdf?y", None, "%PDF-1.4"), ("2024-01-01", "b", "url", "https://e.com/", None, ""),
        ("2024-01-01", "c", "url", "https://e.com/p", None, wrap("<p>hi</p>", "Title")), ("2024-01-01", "d", "file", "/tmp/secret/x.bin", None, "MZ12"),
        ("2024-01-01", "e", "file", "/tmp/n.md", None, "# N"), ("2024-01-01", "f", "text", None, None, "#*_`x  y"), ("2024-01-01", "g", "file", "/t/a.pdf", None, ""),
    ])).collect()}
    status = {k: (r["extractor"], r["extraction_status"], r["format"], r["title"]) for k, r in got.items()}
    assert status == {
        "a": ("markitdown", "failed", "web", "https://e.com/x.pdf?y"), "b": ("none", "failed", "web", "https://e.com/"),
        "c": ("htmlToMarkdown", "success", "web", "Title"), "d": ("magicBytes", "unsupported", "file", "x.bin"),
        "e": ("passthrough", "success", "markdown", "n.md"), "f": ("passthrough", "success", "text", "Pasted text — 2024-01-01"),
        "g": ("markitdown", "failed", "pdf", "a.pdf"),
    }
    assert got["b"]["extracted"] == "_Content could not be extracted from https://e.com/_\n"
    assert "secret" not in got["d"]["event"] and json.loads(got["d"]["manifest"])["file_path"] == "/tmp/secret/x.bin"
    assert "_Auto-preview: x y_" in got["f"]["page_body"]


def test_capture_with_own_extractor(spark):
    rows = raw(spark, [("2024-01-01", "a", "file", "/t/a.pdf", None, "bytes")])
    got = packets.extract_sources(rows, {"pdf": lambda c: F.concat(F.lit("text of "), c)}).first()
    assert (got["extracted"], got["extraction_status"]) == ("text of bytes", "success")


def test_manifests_and_fallbacks(spark, tmp_path):
    for name, manifest in (("SRC-1", {"id": "SRC-1", "title": "One", "captured": "2024-01-01"}), ("SRC-2", {"type": "note"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps(manifest, indent=2), encoding="utf-8")
    found = packets.read_manifests(spark, str(tmp_path))
    from corpusloom.operators.registry import packet_fallbacks

    docs = spark.createDataFrame([("sources/none",)], "id string")
    got = {r["id"]: (r["type"], r["title"], r["created"]) for r in packet_fallbacks(found, docs, "sources", "source").collect()}
    assert got == {"sources/SRC-1": ("source", "One", "2024-01-01"), "sources/SRC-2": ("note", "SRC-2", None)}


def test_embedding_refresh_is_incremental(spark):
    pages = spark.createDataFrame([(f"p{i}", "concept", "Title", f"body {i} " * 5) for i in range(30)], "id string, type string, title string, body string")
    store = spark.createDataFrame([], "id string, hash string, model string, dim int, vector array<double>, updated string")
    first = emb.refresh_embeddings(pages, store, letters, "m", "1").persist()
    assert first.count() == 30 and tuple(emb.refresh_stats(pages, first, "m").first()) == (0, 30, 30, 0)
    edited = pages.where("id <> 'p3'").withColumn("body", F.when(F.col("id") == "p4", "new").otherwise(F.col("body")))
    assert tuple(emb.refresh_stats(edited, first, "m").first()) == (1, 28, 29, 1)
    second = emb.refresh_embeddings(edited, first, letters, "m", "2")
    assert {r["id"]: r["updated"] for r in second.collect() if r["updated"] == "2"} == {"p4": "2"} and second.count() == 29
    assert tuple(emb.refresh_stats(pages, first, "m", force=True).first()) == (30, 0, 30, 0)


def test_batches_respect_limits():
    texts = [(str(i), "x" * n) for i, n in enumerate([10, 10, 10, 99, 5, 5, 5])]
    sizes = [[len(t) for _, t in b] for b in emb._batches(iter(texts), 2, 25)]
    assert sizes == [[10, 10], [10], [99], [5, 5], [5]]


def test_short_embedding_answer_fails(spark):
    texts = spark.createDataFrame([("a", "x", "h"), ("b", "y", "h")], "id string, text string, hash string").coalesce(1)
    with pytest.raises(Exception, match="expected 2 vectors, got 1"):
        emb.embed_texts(texts, lambda batch: [[1.0]]).collect()


def test_embedding_text(spark):
    df = spark.createDataFrame([("a/b", " ", "concept", ["x", "y"], " tag ", " body \n" + "z" * 9000)], "id string, title string, type string, aliases array<string>, tags string, body string")
    text = emb.page_texts(df).first()["text"]
    assert text.startswith("title: a/b\ntype: concept\naliases: x, y\ntags: tag\n\nbody \nzzz") and len(text.split("\n\n", 1)[1]) > 8000


def test_responses(spark):
    rows = [
        (1, 200, '{"data":[{"index":1,"embedding":[2]},{"index":0,"embedding":[1]}]}', 2), (2, 200, '{"error":{"message":"no"}}', 1),
        (3, 200, '{"detail":"bad"}', 1), (4, 500, '{"data":[]}', 0), (5, 200, '{"data":[{"embedding":[1]}]}', 2), (6, 200, '{"data":[{"embedding":[2]},{"embedding":[1]}]}', 2),
    ]
    df = spark.createDataFrame(rows, "request_id long, status int, body string, n int")
    got = {r["request_id"]: (r["error"], r["vectors"]) for r in emb.response_vectors(df).collect()}
    assert got[1] == (None, [[1.0], [2.0]]) and got[6] == (None, [[2.0], [1.0]])
    assert [got[i][0] for i in (2, 3, 4, 5)] == ["no", "bad", "status 500", "vector count mismatch"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, float("nan"), 4.0, float("inf")], [1.0, 0.0]), ([1e-12], [1.0])], "a array<double>, b array<double>")
    rows = df.select(normalize_vector(F.col("a")).alias("n"), cosine_similarity(F.col("a"), F.col("b")).alias("c")).collect()
    assert rows[0]["n"] == [0.6, 0.0, 0.8, 0.0] and rows[0]["c"] == 0.0 and rows[1]["n"] == [0.0] and rows[1]["c"] == pytest.approx(1.0)


def synthesis(spark, rows):
    return spark.createDataFrame(rows, ingest.SYNTHESIS_SCHEMA)


def test_commit_creates_once_and_links(spark):
    entity = lambda t, d="": (t, d)
    data = synthesis(spark, [
        ("SRC-1", "T", "web", "d", None, "en", "s", [], [entity("New Tool", "x"), entity("new tool"), entity("Old")], [entity("Idea")], [], []),
        ("SRC-2", None, None, None, None, "xx", "s", ["k "], [entity("New tool!")], [], [("q ", "me")], ["c"]),
    ])
    old = spark.createDataFrame([("entities/old",)], "id string")
    pages, outcomes = ingest.commit_mentions(data, old, "2024-01-01")
    assert {r["id"]: (r["title"], r["description"]) for r in pages.collect()} == {
        "entities/new-tool": ("New Tool", "x"), "concepts/idea": ("Idea", "One-line definition."),
    }
    stats = {r["source_id"]: tuple(r)[1:] for r in ingest.commit_stats(data, outcomes).collect()}
    assert stats == {"SRC-1": (1, 2, 1, 0, 0), "SRC-2": (0, 1, 0, 0, 1)}
    existing = spark.createDataFrame([("sources/SRC-2", "Mine")], "id string, title string")
    done = {r["id"]: r for r in ingest.commit_sources(data, existing, "2024-02-02").collect()}
    assert (done["sources/SRC-1"]["action"], done["sources/SRC-2"]["action"], done["sources/SRC-2"]["title"]) == ("created", "patched", "Mine")
    assert "> q — me\n\n## Contradictions\n\n⚠️ **Contradiction**: c\n## Source Packet" in done["sources/SRC-2"]["body"]
    assert "- [New Tool](/entities/new-tool.md)\n- [new tool](/entities/new-tool.md)" in done["sources/SRC-1"]["body"]
    assert "## Concepts Mentioned\n\n- [None]" in done["sources/SRC-2"]["body"]


def test_pending_rules(spark):
    have = spark.createDataFrame([(f"SRC-{i}",) for i in range(7)], "id string")
    table = spark.createDataFrame(
        [("sources/SRC-0", "source", "skeleton"), ("sources/SRC-1", "source", "ingested"), ("sources/SRC-2", "source", None), ("x/SRC-3", "note", None)],
        "id string, type string, status string",
    )
    pending = ingest.pending_sources(have, table)
    assert sorted(r["id"] for r in pending.collect()) == ["SRC-0", "SRC-3", "SRC-4", "SRC-5", "SRC-6"]
    assert [tuple(r) for r in ingest.next_batch(pending).collect()] == [("SRC-0", 2), ("SRC-3", 2), ("SRC-4", 2)]
    assert [tuple(r) for r in ingest.next_batch(pending.limit(0)).collect()] == []
    asked = spark.createDataFrame([("SRC-1",), ("SRC-3",), ("SRC-3",), ("SRC-9",), (None,)], "id string")
    found = {r["id"]: r["status"] for r in ingest.requested(have, asked).collect()}
    assert found == {"SRC-1": "selected", "SRC-3": "selected", "SRC-9": "not_found", None: "not_found"}


def test_codes_by_path(spark):
    rows = [("a.md", "frontmatter_parse_error"), ("a.md", "frontmatter_missing"), ("a.md", "frontmatter_missing"), ("b.md", "other")]
    found = spark.createDataFrame(rows, "path string, code string")
    assert [tuple(r) for r in repair.codes_by_path(found).collect()] == [("a.md", ["frontmatter_missing", "frontmatter_parse_error"])]
    assert {r["path"]: r["codes"] for r in repair.codes_by_path(found, None).collect()}["b.md"] == ["other"]
    assert repair.codes_by_path(found.limit(0)).count() == 0


def test_message_steps(spark):
    entries = [
        {"type": "note"}, {"type": "message", "message": {"role": "user", "content": "x" * 1300}},
        {"type": "message", "message": {"role": "assistant", "model": "m", "content": [{"type": "text", "text": " a"}, {"type": "text", "text": "b "}, {"type": "toolCall", "id": 1, "name": "read", "arguments": {"p": 1}}]}},
        {"type": "message", "message": {"role": "toolResult", "toolName": "read", "toolCallId": "1", "content": [{"type": "text", "text": "y" * 700}], "isError": True}},
        {"type": "message", "message": {"role": "assistant", "content": []}}, {"type": "message", "message": {"role": "system", "content": "z"}},
        {"type": "message", "message": {"role": "assistant", "content": [{"type": "toolCall"}, {"type": "toolCall", "name": "read"}]}},
    ]
    df = spark.createDataFrame([("s", i, json.dumps(e)) for i, e in enumerate(entries)], "session_id string, turn long, entry string")
    steps = traj.message_steps(df)
    rows = steps.orderBy("turn").collect()
    assert [(r["turn"], r["role"], len(r["text"])) for r in rows] == [(1, "user", 1300), (2, "assistant", 3), (3, "tool", 700), (6, "assistant", 0)]
    assert [len(r["preview"]) for r in rows] == [1200, 3, 600, 0]
    assert rows[1]["text"] == "a\nb" and rows[1]["tool_calls"][0]["arguments"] == '{"p":1}' and rows[2]["is_error"]
    calls = traj.tool_calls(steps)
    assert {(r["name"], r["calls"]) for r in traj.tool_usage(calls).collect()} == {("read", 2), ("unknown", 1)}
    packet = traj.trajectories(steps, "2024-01-01")
    row = packet.first()
    assert (row["id"], row["title"], row["step_count"], row["tool_call_count"], row["model"]) == ("TRJ-2024-01-01-001", "x" * 60, 4, 3, "m")
    lines = [r["line"] for r in traj.summary_lines(packet, traj.tool_usage(calls), traj.tool_sequence(calls)).orderBy("id", "section", "position").collect()]
    assert lines[1:3] == ["read×2", "unknown×1"] and lines[-3:] == ["1. `read`", "2. `unknown`", "3. `read`"]


def test_undistilled_rules(spark):
    have = spark.createDataFrame([("TRJ-1",), ("TRJ-2",)], "id string")
    cited = spark.createDataFrame([("skills/a", "trajectories/TRJ-1"), ("concepts/a", "trajectories/TRJ-2")], "src string, dst string")
    assert [r["id"] for r in traj.undistilled(have, cited).collect()] == ["TRJ-2"]
    none = spark.createDataFrame([], "id string")
    assert traj.undistilled(have, cited, none).count() == 2


GOOD = "---\ntype: concept\ntitle: {0}\n---\n\n{1}\n"


def vault(spark, **extra):
    rows = {"concepts/a.md": GOOD.format("A", "[b](b.md) [[concepts/c]]"), "concepts/b.md": GOOD.format("B", "[a](a.md)"), **extra}
    return spark.createDataFrame(list(rows.items()), "path string, content string")


def rows_of(df):
    return sorted(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.collect())


def test_rebuild_publish_and_fail_closed(spark, tmp_path):
    root = str(tmp_path)
    lines = spark.createDataFrame([(0, '{"timestamp":"2026-08-01T00:00:00Z","kind":"a"}')], "seq long, raw string")
    first = rebuild(vault(spark), raw_events=lines)
    assert publish(first, root, 1) == 1
    before = {n: rows_of(read_current(spark, root, n)) for n in first.frames}
    assert [json.loads(r)["mentioned_by"] for r in before["gaps"]] == ["concepts/a"]
    broken = rebuild(vault(spark, **{"concepts/bad.md": "no frontmatter"}))
    assert not broken.ok and not publish(broken, root, 2)
    assert {n: rows_of(read_current(spark, root, n)) for n in first.frames} == before
    again = rebuild(vault(spark).repartition(3))
    assert publish(again, root, 3)
    for name in again.frames:
        if name != "diagnostics":
            assert rows_of(read_current(spark, root, name)) == before[name]
    assert rows_of(read_current(spark, root, "day_log")) == before["day_log"]
    partial = rebuild(vault(spark, **{"concepts/bad.md": "no frontmatter"}), on_error="quarantine")
    assert partial.ok and rows_of(partial.frames["registry"]) == before["registry"]
    assert obsolete_versions(spark, root, keep=1).count() == len(again.frames)


CHANGES = "path string, content string, deleted boolean, mtime long"


def test_refresh_equals_rebuild_in_every_table(spark, tmp_path):
    root = str(tmp_path / "out")
    batches = [
        [("concepts/a.md", GOOD.format("A", "[b](b.md) [[concepts/c]]"), False, 1), ("concepts/b.md", GOOD.format("B", "[a](a.md)"), False, 1)],
        [("concepts/c.md", GOOD.format("C", "[a](a.md) [x](x.md)"), False, 2), ("concepts/b.md", "broken", False, 1), ("concepts/b.md", GOOD.format("B2", "[c](c.md)"), False, 3)],
        [("concepts/a.md", None, True, 4)],
        [("concepts/c.md", "no frontmatter", False, 5), ("concepts/y.md", GOOD.format("Y", "[b](b.md)"), False, 5), ("concepts/bad.md", "x", False, 5)],
        [("concepts/bad.md", None, True, 6), ("Concepts/Y.md", GOOD.format("twin", ""), False, 6), ("concepts/z.md", GOOD.format("Z", ""), False, 6)],
    ]
    # A version that someone published before the stream began is followed, not hidden behind.
    publish(rebuild(vault(spark)), root, 42)
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{number}"))
        stream = spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        refresh_stream(stream, root, str(tmp_path / "ckpt"), letters, "m").awaitTermination(240)
    final = {
        "concepts/b.md": GOOD.format("B2", "[c](c.md)"), "concepts/c.md": GOOD.format("C", "[a](a.md) [x](x.md)"),
        "concepts/y.md": GOOD.format("Y", "[b](b.md)"), "concepts/z.md": GOOD.format("Z", ""),
    }
    full = rebuild(spark.createDataFrame(list(final.items()), "path string, content string"))

    def check():
        assert latest_version(spark, root) == 47
        for name in set(full.frames) - {"diagnostics", "quarantine"}:
            assert rows_of(read_current(spark, root, name)) == rows_of(full.frames[name]), name
        left_out = {(r["code"], r["path"]) for r in read_current(spark, root, "quarantine").collect()}
        assert left_out == {("frontmatter_missing", "concepts/c.md"), ("concept_identity_collision", "Concepts/Y.md")}
        assert left_out <= {(r["code"], r["path"]) for r in read_current(spark, root, "diagnostics").collect()}
        store = {r["id"]: r["updated"] for r in read_current(spark, root, "embeddings").collect()}
        assert store == {"concepts/b": "44", "concepts/c": "44", "concepts/y": "46", "concepts/z": "47"}

    check()
    # A batch that runs again after it was published changes nothing.
    assert refresh_batch(spark.createDataFrame(batches[1], CHANGES), 1, root, letters, "m") is None
    check()


def test_versions_only_grow(spark, tmp_path):
    root = str(tmp_path)
    assert publish(rebuild(vault(spark)), root, 7) == 7
    with pytest.raises(ValueError):
        publish(rebuild(vault(spark)), root, 7)
    assert publish(rebuild(vault(spark)), root) == 8


def test_texts_go_to_python_in_small_batches(spark, sf_dir):
    keys = [f"spark.sql.execution.arrow.{k}PerBatch" for k in ("maxRecords", "maxBytes")]
    spark.conf.set(keys[0], "10000")
    spark.conf.set(keys[1], "1g")
    try:
        QUERIES["recall_lexical"](spark, sf_dir)
        assert [spark.conf.get(k) for k in keys] == ["2000", "8m"]
    finally:
        for k in keys:
            spark.conf.set(k, SETTINGS[k])


def test_ordinary_xml_stays_on_the_jvm(spark, monkeypatch):
    """What goes to Python comes back as a mark here."""
    monkeypatch.setattr(convert, "_plain_text", convert._udf(lambda text: "python"))
    ordinary = "<p>a < b &amp;lt; &copy; &AMP; 'x'</p>tail <b"
    assert one(spark, ordinary, convert.xml_to_markdown) == "a  b &lt; &copy; & 'x'\ntail b"
    for text in ("<<i>b>c", "x &<#65;", "<i>&#65;</i>"):
        assert one(spark, text, convert.xml_to_markdown) == "python"


@pytest.mark.parametrize("text", [
    "<p>x</p>tail <b", "<a<b>c>d", "<<i>b>c", "x &<#65; &amp;#66;", "&amp;lt;&LT;i&gt;&apo\u017f;", "a > b < c", "<" * 3, "<i> &amp;amp; &<lt;", "x",
])
def test_xml_texts_match_one_pass_in_python(spark, text):
    plain = convert._ENTITY.sub(convert._character, convert._without_tags(text.replace("</p>", "\n")).replace("<", "")).strip()
    assert one(spark, text, convert.xml_to_markdown) == (plain or text)


def test_batches_are_planned_from_lengths(spark):
    rows = [(f"{i}", "é" * n) for i, n in enumerate([5, 9, 0, 30, 4, 4])]
    frame = spark.createDataFrame(rows, "id string, text string").coalesce(1)
    planned = emb.embed_batches(frame, 2, 12)
    assert [(r.texts, r.chars) for r in planned.orderBy("batch_no").collect()] == [(1, 5), (2, 9), (1, 30), (2, 8)]
    assert "text#" not in planned._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[1].split("\n")[0]
