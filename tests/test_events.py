from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.operators.sessions import reminder_state
from corpusloom.sources import events as ev
from corpusloom.streaming import events as stream_events
from corpusloom.streaming.reminders import reminder_batches, reminder_stream

LINES = [
    '{"kind":"import","timestamp":"2025-03-09T23:30:00Z","rows":12,"by":{"tool":"csv","id":7}}', "{broken",
    '{"timestamp":"2025-03-10T00:15:00+01:00","kind":"check"}', '{"timestamp":"2025-03-11T08:00:00Z","kind":"merge","of":["b","a"]}',
    '{"timestamp":"someday","kind":"plan"}', '{"timestamp":"2025-03-11T08:00:00Z","kind":"split"}',
]


def expected_log():
    """By the rules: newest day, instant and line first; keys of details in order; bad lines left out."""
    days = {
        "2025-03-11": ["- **split**", '- **merge**: {"of":["b","a"]}'],
        "2025-03-09": ['- **import**: {"by":{"id":7,"tool":"csv"},"rows":12}', "- **check**"],
    }
    return "# Wiki Update Log\n" + "\n".join(f"\n## {day}\n\n" + "\n".join(lines) for day, lines in days.items())


def raw(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "seq long, raw string")


def test_day_log_golden(spark):
    parsed = ev.parse_events(raw(spark, LINES))
    text = "\n".join(r["value"] for r in ev.render_day_log(ev.valid_events(parsed)).collect())
    assert text == expected_log()
    codes = {r["message"]: r["code"] for r in ev.event_diagnostics(parsed).collect()}
    assert codes == {"Invalid JSON at line 2": "event_invalid_json", "Invalid timestamp at line 5": "event_invalid_timestamp"}


def test_odd_lines(spark):
    lines = [
        "[1]", "3", "null", "", "  ", '{"timestamp":5,"kind":"x"}', '{"timestamp":"2026-08-02T01:00:00+02:00","kind":" a_b*[c]  d\\\\ "}',
        '{"timestamp":"2026-08-02","kind":3}', '{"timestamp":"12:30","kind":"x"}',
    ]
    rows = {r["seq"]: r for r in ev.parse_events(raw(spark, lines)).collect()}
    assert [rows[i]["code"] for i in (0, 1, 2, 5, 7, 8)] == ["event_invalid_json"] * 3 + ["event_invalid_timestamp", "event_missing_kind", "event_invalid_timestamp"]
    assert 3 not in rows and 4 not in rows
    assert str(rows[6]["event_date"]) == "2026-08-01"
    line = ev.day_log(ev.valid_events(ev.parse_events(raw(spark, lines)))).first()["line"]
    assert line == "- **a\\_b\\*\\[c\\] d\\\\**"


def test_spellings_of_instants_and_repeated_keys(spark):
    spellings = {
        "Tue, 02 Jan 2024 10:00:00 GMT": "2024-01-02 10:00", "2 Jan 2024 10:00 +0130": "2024-01-02 08:30", "Jan 2, 2024": "2024-01-02 00:00",
        "March 5, 2024": "2024-03-05 00:00", "2024": "2024-01-01 00:00", "2024-03": "2024-03-01 00:00", "2024/3/5 07:08": "2024-03-05 07:08",
        "3/5/2024": "2024-03-05 00:00", "Tue Jan 02 2024 10:00:00 GMT-0200": "2024-01-02 12:00", "2024-01-02T10:00:00.5Z": "2024-01-02 10:00",
    }
    wrong = ["12:30", "soon", "Jan", "2024-13-01", "40 Jan 2024", "1/2"]
    lines = [f'{{"timestamp":"no","kind":"a","kind":"b","timestamp":"{t}"}}' for t in [*spellings, *wrong]]
    rows = ev.parse_events(raw(spark, lines)).withColumn("at", F.date_format(F.timestamp_millis("epoch_ms"), "yyyy-MM-dd HH:mm")).orderBy("seq").collect()
    assert [r["at"] for r in rows] == [*spellings.values(), *[None] * len(wrong)]
    assert {r["kind"] for r in rows} == {"b"}


def test_activity_log_keeps_member_order(spark):
    rows = ev.activity_log(raw(spark, LINES)).orderBy("seq").collect()
    assert rows[0]["heading"] == "## [2025-03-09T23:30:00Z] import"
    assert rows[0]["details"] == '- rows: 12, by: {"id":7,"tool":"csv"}' and rows[1]["details"] == ""
    assert [r["seq"] for r in rows] == [0, 2, 3, 4, 5]


def test_activity_log_text(spark):
    text = "\n".join(r["value"] for r in ev.render_activity_log(raw(spark, LINES[2:3])).collect())
    head = "# Activity Log\n\n> Auto-generated from meta/events.jsonl. Do not edit manually.\n"
    assert text == head + "\n## [2025-03-10T00:15:00+01:00] check\n"
    assert ev.render_activity_log(raw(spark, ["no"])).first()["value"] == head + "\n_No events recorded yet._\n"


def test_append_and_read(spark, tmp_path):
    path = str(tmp_path / "events")
    none, diagnostics = ev.read_event_lines(spark, path)
    assert none is None and diagnostics.first()["code"] == "event_source_missing"
    asked = spark.createDataFrame([(" a ", '{"x":1,"timestamp":"no"}'), ("b", None), (" ", "{}")], "kind string, details string")
    accepted, rejected = ev.accept_events(asked)
    assert sorted(r["error"] for r in rejected.collect()) == ["event_missing_kind", "event_reserved_field"]
    ev.append_events(accepted, path)
    ev.append_events(spark.createDataFrame([(" a ", '{"x":1}')], "kind string, details string"), path)
    lines, diagnostics = ev.read_event_lines(spark, path)
    valid = ev.valid_events(ev.parse_events(lines)).orderBy("kind").collect()
    assert [(r["kind"], r["details"]) for r in valid] == [("a", '{"x":1}'), ("b", "")] and diagnostics.isEmpty()


def test_line_numbers_across_splits(spark, tmp_path):
    """Files that are read in many splits keep the numbers of their lines."""
    for name, n in (("a", 3000), ("b", 700)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(f'{{"n":{i}}}' + "x" * (i % 37) if i % 11 else "" for i in range(n)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines, _ = ev.read_event_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        rows = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, n in (("a", 3000), ("b", 700)):
        own = {r["seq"]: r["raw"] for r in rows if r["file"].endswith(f"{name}.jsonl")}
        assert sorted(own) == list(range(n))
        assert all(own[i].startswith(f'{{"n":{i}}}') if i % 11 else own[i] == "" for i in own)


def simulate(rows, turns=5):
    state, out = {}, {}
    for session, seq, _, action in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        counter, seen = state.get(session, (0, False))
        if action == "session_start":
            counter, seen = 0, False
        elif action == "compact":
            counter = 0
        elif action == "observe":
            seen = True
        elif action == "turn":
            counter += 1
        state[session] = (counter, seen)
        out[(session, seq)] = (counter, seen, action == "turn" and counter >= turns and not seen)
    return out


def session_rows(seed, count):
    rng = random.Random(seed)
    actions = ["turn"] * 12 + ["observe", "compact", "session_start", "retry", "closed"]
    return [
        (rng.choice(["hot", "hot", "b", f"s{i % 9}"]), i, rng.randint(0, count // 2), rng.choice(actions)) for i in range(count)
    ]


def test_reminders_batch(spark):
    rows = session_rows(1, 3000)
    df = spark.createDataFrame(rows, "session_id string, seq long, ts long, action string")
    got = {(r["session_id"], r["seq"]): (r["counter"], r["observed"], r["emit"]) for r in reminder_state(df, slices=6).collect()}
    assert got == simulate(rows)


def test_reminders_stream_equals_batch(spark, tmp_path):
    rows = sorted(session_rows(2, 600), key=lambda r: r[2])
    schema = "session_id string, seq long, ts long, action string"
    folder = tmp_path / "in"
    for part in range(3):
        spark.createDataFrame(rows[part * 200 : part * 200 + 200], schema).coalesce(1).write.parquet(str(folder / f"p{part}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 3).parquet(str(folder))
    query = (
        reminder_stream(stream).writeStream.format("memory").queryName("reminders").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {(r["session_id"], r["seq"]): (r["counter"], r["observed"], r["emit"]) for r in spark.table("reminders").collect()}
    assert got == simulate(rows)
    root = str(tmp_path / "out")
    reminder_batches(stream, root, str(tmp_path / "ckpt2")).awaitTermination(240)
    parts = spark.read.parquet(*[f"{root}/reminders/v{v}" for v in range(len(list((tmp_path / "out" / "reminders").iterdir())))])
    got = {(r["session_id"], r["seq"]): (r["counter"], r["observed"], r["emit"]) for r in parts.collect()}
    assert got == simulate(rows)


def test_event_stream_and_digest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(LINES), encoding="utf-8")
    late = '{"timestamp":"2025-03-19T10:00:00Z","kind":"tick"}'
    (folder / "b.jsonl").write_text(late, encoding="utf-8")
    parsed = stream_events.event_stream(stream_events.read_event_stream(spark, str(folder)))
    query = stream_events.append_event_table(parsed, str(tmp_path / "table"), str(tmp_path / "c1"))
    query.awaitTermination(120)
    table = spark.read.parquet(str(tmp_path / "table"))
    assert table.where("code is null").count() == 5 and table.count() == 7
    digest = stream_events.digest_stream(stream_events.event_stream(stream_events.read_event_stream(spark, str(folder))))
    query = (
        digest.writeStream.format("memory").queryName("digest").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {(str(r["period_start"])[:10], r["kind"]): r["events"] for r in spark.table("digest").collect()}
    batch = ev.event_digest(ev.valid_events(ev.parse_events(raw(spark, LINES))))
    want = {(str(r["period_start"]), r["kind"]): r["events"] for r in batch.collect()}
    assert got == want


def test_digest_of_touched_days_counts_late_events(spark, tmp_path):
    folder, table, path = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "digest")
    folder.mkdir()
    late = ['{"timestamp":"2025-03-09T01:00:00Z","kind":"import"}', "{broken", '{"timestamp":"2025-04-01T01:00:00Z","kind":"plan"}']
    for number, lines in enumerate([LINES, late, late[:1]]):
        (folder / f"{number}.jsonl").write_text("\n".join(lines), encoding="utf-8")
        stream = stream_events.event_stream(stream_events.read_event_stream(spark, str(folder)))
        stream_events.digest_batches(stream, table, path, str(tmp_path / "ckpt")).awaitTermination(120)
    got = {(str(r["period_start"]), r["kind"]): r["events"] for r in spark.read.parquet(path).collect()}
    batch = ev.event_digest(ev.valid_events(ev.parse_events(raw(spark, LINES + late + late[:1]))))
    assert got == {(str(r["period_start"]), r["kind"]): r["events"] for r in batch.collect()}
    assert got["2025-03-09", "import"] == 3


def test_first_queries_stream(spark, tmp_path):
    schema = "ts timestamp, model string, query string"
    rows = [("m", "Login form"), ("m", "login-FORM!"), ("n", "login form"), ("m", "other")]
    df = spark.createDataFrame(rows, "model string, query string").select(F.timestamp_seconds(F.lit(1000)).alias("ts"), "model", "query")
    df.write.parquet(str(tmp_path / "q"))
    stream = stream_events.first_queries(spark.readStream.schema(schema).parquet(str(tmp_path / "q")))
    query = (
        stream.writeStream.format("memory").queryName("firsts").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = sorted((r["model"], r["normalized"]) for r in spark.table("firsts").collect())
    assert got == [("m", "login form"), ("m", "other"), ("n", "login form")]
