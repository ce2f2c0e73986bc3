"""Append-only event history: JSON lines to events, diagnostics and log lines.

All of it is row-local, so the same functions serve batch tables and streams. Logs are rows
with sort keys; a day that holds a third of the history is never gathered into one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import blank_to_null, collapse_space, trim_space
from ..operators.skew import with_positions
from ..session import broadcast_if_small, computed_once, materialise

_RESERVED = ("timestamp", "kind")


def read_event_lines(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame]:
    """(raw_events or None, diagnostics). A missing source keeps earlier log tables as they are.

    raw_events(file, seq, raw): seq is the 0-based line number. Files are read in splits: a
    line's number is its place in its split plus the lines of the splits before it.
    """
    schema = "severity string, code string, path string, message string"
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
    except AnalysisException:
        note = "Authoritative event source is missing; existing log projections were preserved"
        return None, spark.createDataFrame([("warning", "event_source_missing", path, note)], schema)
    placed = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"),
    )
    # One row per split: a split is read by one task, in order.
    splits = placed.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "block", (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = placed.join(broadcast_if_small(materialise(offsets)), ["file", "block"])
    return numbered.select("file", (F.col("at") + F.col("shift")).alias("seq"), "raw"), spark.createDataFrame([], schema)


# Date spellings besides ISO 8601, once the name of the day and the zone are taken off.
_SPELLINGS = [
    "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy", "MMM d yyyy HH:mm:ss", "MMM d yyyy HH:mm", "MMM d yyyy",
    "d MMMM yyyy", "MMMM d yyyy", "MMMM d yyyy HH:mm:ss", "yyyy/M/d HH:mm:ss", "yyyy/M/d HH:mm", "yyyy/M/d",
    "M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "M/d/yyyy",
]


def _instant(stamp: Column) -> Column:
    """Instant of a timestamp's text, NULL for none."""
    iso = F.when(stamp.rlike(r"^\d{4}(?:-\d{2}(?:-\d{2}(?:[T ]\d{2}:\d{2}.*)?)?)?$"), F.try_to_timestamp(stamp))
    plain = F.regexp_replace(stamp, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    zone = F.regexp_extract(plain, r"(?:GMT|UTC|Z|\s)([+-]\d{2}:?\d{2})$", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"\s*(?:GMT|UTC|Z)?(?:\s*[+-]\d{2}:?\d{2})?$", ""), r",\s*|\s+", " "))
    named = F.when(plain.rlike(r"^(?:\d{1,2} [A-Za-z]|[A-Za-z]{3,9} \d|\d{1,4}/)"), F.coalesce(*[F.try_to_timestamp(plain, F.lit(p)) for p in _SPELLINGS]))
    minutes = F.regexp_replace(zone, ":", "")
    sign = F.when(minutes.startswith("-"), -1).otherwise(1)
    offset = F.when(minutes == "", 0).otherwise(
        sign * (F.substring(minutes, 2, 2).try_cast("int") * 60 + F.substring(minutes, 4, 2).try_cast("int"))
    )
    return F.coalesce(iso, named - F.make_dt_interval(mins=offset))


def parse_events(raw_events: DataFrame) -> DataFrame:
    """Parse raw_events(seq, raw): adds code (NULL when valid), epoch_ms, event_date, kind, details.

    Blank lines are dropped. Timestamps are ISO 8601 (from a year alone to fractions of a
    second), or dates with named months or slashes as in mail headers; without an offset they
    are UTC, and the day is the UTC day. Of a key that is repeated the last value counts.
    """
    raw_events.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = raw_events.where(trim_space(F.col("raw")) != "")
    rows = computed_once(rows, {"_v": F.try_parse_json("raw")})
    rows = computed_once(rows, {
        "_members": F.when(
            F.schema_of_variant("_v").startswith("OBJECT"), F.col("_v").cast("map<string,variant>")
        )
    })
    text = lambda key: F.when(
        F.schema_of_variant(F.col("_members")[key]) == "STRING",
        F.try_variant_get(F.col("_members")[key], "$", "string"),
    )
    rows = computed_once(rows, {
        "_stamp": text("timestamp"), "_kind": text("kind"),
        "_rest": F.map_filter("_members", lambda k, v: ~k.isin(*_RESERVED)),
    })
    rows = computed_once(rows, {
        "epoch_ms": F.unix_millis(_instant(F.col("_stamp"))),
        "kind": trim_space(blank_to_null(F.col("_kind"))),
        "details": F.when(F.size("_rest") > 0, F.to_json("_rest")).otherwise(""),
        "_object": F.col("_members").isNotNull(),
    })
    code = (
        F.when(~F.col("_object"), "event_invalid_json")
        .when(F.col("epoch_ms").isNull(), "event_invalid_timestamp")
        .when(F.col("kind").isNull(), "event_missing_kind")
    )
    others = [c for c in raw_events.columns if c != "raw"]
    return rows.select(
        *others, "raw", code.alias("code"), "epoch_ms",
        F.date_add(
            F.lit("1970-01-01").cast("date"), F.floor(F.col("epoch_ms") / 86_400_000).cast("int")
        ).alias("event_date"),
        "kind", "details",
    )


def valid_events(parsed: DataFrame) -> DataFrame:
    return parsed.where("code is null").drop("code", "raw")


def event_diagnostics(parsed: DataFrame, path: str = "meta/events.jsonl") -> DataFrame:
    what = (
        F.when(F.col("code") == "event_invalid_json", "Invalid JSON at line ")
        .when(F.col("code") == "event_invalid_timestamp", "Invalid timestamp at line ")
        .otherwise("Missing kind at line ")
    )
    return parsed.where("code is not null").select(
        F.lit("warning").alias("severity"), "code", F.lit(path).alias("path"),
        F.concat(what, (F.col("seq") + 1).cast("string")).alias("message"),
    )


def escape_kind(kind: Column) -> Column:
    return collapse_space(F.regexp_replace(kind, r"([\\*_\[\]])", r"\\$1"))


def day_log(events: DataFrame) -> DataFrame:
    """Log lines (event_date, epoch_ms, seq, line): newest day, instant and line first."""
    line = F.concat(
        F.lit("- **"), escape_kind(F.col("kind")), F.lit("**"),
        F.when(F.col("details") != "", F.concat(F.lit(": "), "details")).otherwise(""),
    )
    return events.select("event_date", "epoch_ms", "seq", line.alias("line"))


def day_log_positions(events: DataFrame) -> DataFrame:
    """Log lines numbered within their day, however many a day has."""
    lines = day_log(events).withColumns({"_ms": -F.col("epoch_ms"), "_seq": -F.col("seq")})
    return with_positions(lines, ["event_date"], ["_ms", "_seq"], narrow=True).drop("_ms", "_seq")


def render_day_log(events: DataFrame) -> DataFrame:
    """The whole log as ordered rows of one text column; write it with df.write.text."""
    lines = day_log(events)
    heads = lines.select("event_date").distinct().select(
        "event_date", F.lit(None).cast("bigint").alias("epoch_ms"), F.lit(None).cast("bigint").alias("seq"),
        F.concat(F.lit("\n## "), F.date_format("event_date", "yyyy-MM-dd"), F.lit("\n")).alias("line"),
    )
    title = events.sparkSession.range(1).select(
        F.lit(None).cast("date").alias("event_date"), F.lit(None).cast("bigint").alias("epoch_ms"),
        F.lit(None).cast("bigint").alias("seq"), F.lit("# Wiki Update Log").alias("line"),
    )
    return (
        lines.unionByName(heads).unionByName(title)
        .orderBy(F.desc_nulls_first("event_date"), F.desc_nulls_first("epoch_ms"), F.desc_nulls_first("seq"))
        .select(F.col("line").alias("value"))
    )


def activity_log(raw_events: DataFrame) -> DataFrame:
    """Activity lines (seq, heading, details) in file order; lines that are no object are left out.

    Members keep the order they were written in; nested maps print with sorted keys.
    """
    rows = computed_once(raw_events, {"_v": F.try_parse_json("raw")})
    rows = rows.where(F.schema_of_variant("_v").startswith("OBJECT"))
    rows = computed_once(rows, {"_members": F.col("_v").cast("map<string,variant>")})
    shown = lambda key, default: F.coalesce(
        F.nullif(F.try_variant_get(F.col("_members")[key], "$", "string"), F.lit("")), F.lit(default)
    )
    keys = F.filter(F.json_object_keys("raw"), lambda k: ~k.isin(*_RESERVED))
    details = F.array_join(
        F.transform(keys, lambda k: F.concat(k, F.lit(": "), F.to_json(F.col("_members")[k]))), ", "
    )
    return rows.select(
        "seq",
        F.concat(F.lit("## ["), shown("timestamp", "unknown"), F.lit("] "), shown("kind", "event")).alias("heading"),
        F.when(details != "", F.concat(F.lit("- "), details)).otherwise("").alias("details"),
    )


def render_activity_log(raw_events: DataFrame) -> DataFrame:
    """The activity log as ordered rows of one text column."""
    entries = activity_log(raw_events)
    lines = entries.select(
        "seq", F.concat("heading", F.lit("\n"), F.when(F.col("details") != "", F.concat("details", F.lit("\n"))).otherwise("")).alias("value")
    )
    head = entries.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(-1).cast("bigint").alias("seq"),
        F.concat(
            F.lit("# Activity Log\n\n> Auto-generated from meta/events.jsonl. Do not edit manually.\n"),
            F.when(F.col("n") == 0, "\n_No events recorded yet._\n").otherwise(""),
        ).alias("value"),
    )
    return lines.unionByName(head).orderBy("seq").select("value")


def accept_events(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split event requests(kind, details JSON) into accepted and rejected(…, error).

    A blank kind and details naming kind or timestamp are rejected.
    """
    keys = F.coalesce(F.json_object_keys("details"), F.array().cast("array<string>"))
    error = (
        F.when(F.coalesce(trim_space(F.col("kind")), F.lit("")) == "", "event_missing_kind")
        .when(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in _RESERVED])), "event_reserved_field")
    )
    checked = requests.withColumn("error", error)
    return checked.where("error is null").drop("error"), checked.where("error is not null")


def append_events(accepted: DataFrame, path: str) -> None:
    """Append accepted(kind, details JSON) as JSON lines stamped now; given timestamps are ignored."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    members = F.map_filter(
        F.coalesce(
            F.try_parse_json("details").cast("map<string,variant>"),
            F.expr("cast(map() as map<string,variant>)"),
        ),
        lambda k, v: ~k.isin(*_RESERVED),
    )
    own = F.map_from_arrays(
        F.array(F.lit("timestamp"), F.lit("kind")),
        F.array(
            F.to_variant_object(F.struct(stamp.alias("v"))),
            F.to_variant_object(F.struct(trim_space(F.col("kind")).alias("v"))),
        ),
    )
    own = F.transform_values(own, lambda k, v: F.variant_get(v, "$.v", "variant"))
    accepted.select(F.to_json(F.map_concat(members, own)).alias("value")).write.mode("append").text(path)


def event_digest(events: DataFrame, period: str = "day") -> DataFrame:
    """Events per kind and UTC day or week; counts are combined before the shuffle."""
    day = F.col("event_date")
    start = F.trunc(day, "week") if period == "week" else day
    return events.groupBy(start.alias("period_start"), "kind").agg(
        F.count(F.lit(1)).cast("bigint").alias("events")
    )
