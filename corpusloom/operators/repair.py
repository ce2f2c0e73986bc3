"""Repair of pages whose frontmatter does not parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import SPACE, blank_to_null, trim_space
from ..sources.documents import document_text, parse_frontmatter
from .pages import folder_type

# What can be repaired.
RECOVERABLE = ("frontmatter_missing", "frontmatter_parse_error", "concept_missing_type")


def codes_by_path(diagnostics: DataFrame, codes: tuple[str, ...] | None = RECOVERABLE) -> DataFrame:
    """(path, codes): the distinct diagnostic codes of every path, sorted.

    Only `codes` count (None: all), and a path without one has no row. The kinds of codes are
    few, so a path's list is short however often each was reported.
    """
    rows = diagnostics if codes is None else diagnostics.where(F.col("code").isin(*codes))
    # Equal codes combine before the shuffle.
    return rows.groupBy("path").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def inferred_type(path: Column, registry_type: Column) -> Column:
    return F.coalesce(blank_to_null(registry_type), folder_type(F.substring_index(path, "/", 1)))


def inferred_title(path: Column, content: Column, registry_title: Column) -> Column:
    heading = F.nullif(trim_space(F.regexp_extract(content, rf"(?m)^#[{SPACE}]+(.+)$", 1)), F.lit(""))
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    name = F.nullif(trim_space(F.regexp_replace(name, "[-_]+", " ")), F.lit(""))
    return F.coalesce(blank_to_null(registry_title), heading, name, F.lit("Recovered page"))


def repair_documents(files: DataFrame, registry: DataFrame) -> DataFrame:
    """repairs(path, code, status, before_sha256, after_sha256, content) of broken files(path, content).

    A missing type is added if that makes the page parse; otherwise the page gets new
    frontmatter and keeps the old block as legacy_frontmatter. A page whose fence never
    closes is refused, its content unchanged. registry(id, type, title).
    """
    broken = parse_frontmatter(files).where(F.col("code").isin(*RECOVERABLE)).select("path", "content", "code")
    known = registry.select("id", F.col("type").alias("_type"), F.col("title").alias("_title"))
    rows = broken.withColumn("id", F.regexp_replace("path", r"(?i)\.md$", "")).join(known, "id", "left")
    rows = rows.select(
        "path", "code", F.col("content").alias("original"),
        inferred_type(F.col("path"), F.col("_type")).alias("new_type"),
        inferred_title(F.col("path"), F.col("content"), F.col("_title")).alias("new_title"),
    )
    quoted = F.regexp_extract(F.to_json(F.array("new_type")), r"(?s)^\[(.*)\]$", 1)
    typed = F.concat(F.lit("---\ntype: "), quoted, F.lit("\n"), F.regexp_replace("original", r"^---\r?\n", ""))
    missing_type = F.col("code") == "concept_missing_type"
    candidate = rows.withColumn("content", F.when(missing_type, typed).otherwise(""))
    checked = parse_frontmatter(candidate.withColumnRenamed("code", "old_code")).select(
        "path", "old_code", "original", "new_type", "new_title", F.col("content").alias("typed"),
        ((F.col("old_code") == "concept_missing_type") & F.col("code").isNull()).alias("simple"),
    )
    text = F.regexp_replace("original", "\r\n?", "\n")
    opened = text.startswith("---\n")
    rest = F.substr(text, F.lit(4))
    block = F.regexp_extract(rest, r"(?s)^(.*?)\n---\n", 1)
    raw = F.when(opened & (block != ""), F.concat(F.substr(block, F.lit(2)), F.lit("\n")))
    after = F.regexp_replace(F.substr(rest, F.length(block) + 6), r"^\n", "")
    rebuilt = document_text(
        F.to_json(F.struct(F.col("new_type").alias("type"), F.col("new_title").alias("title"))),
        F.lit(None).cast("string"),
        F.to_json(F.struct(F.lit(True).alias("legacy_repair"), raw.alias("legacy_frontmatter"))),
        F.when(opened, after).otherwise(text),
    )
    splits = ~opened | rest.contains("\n---\n")
    done = checked.withColumn("splits", splits).withColumn("rebuilt", rebuilt).withColumn(
        "fixed", F.when(F.col("simple"), F.col("typed")).when(F.col("splits"), F.col("rebuilt"))
    )
    return done.select(
        "path", F.col("old_code").alias("code"),
        F.when(F.col("fixed").isNull(), "refused").when(F.col("simple"), "typed").otherwise("rebuilt").alias("status"),
        F.sha2("original", 256).alias("before_sha256"),
        F.sha2(F.coalesce("fixed", "original"), 256).alias("after_sha256"),
        F.coalesce("fixed", "original").alias("content"),
    )
