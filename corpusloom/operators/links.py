"""Links between documents: extraction, resolution, edges, backlinks, gaps.

Every table is in long form, one row per edge. A page that a third of the corpus points
to is then a third of the rows, never one array in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.commonmark import markdown_links
from ..functions.paths import resolve_markdown_target, resolve_wikilink_target
from ..functions.text import nfc, trim_space
from ..session import computed_once, materialise

WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
_INLINE = r"\[[^\[\]]*\]\(([^()\s]+)\)"
# Anything that makes plain pattern matching differ from a CommonMark reading: code, HTML,
# escapes, images, definitions, indented lines, unusual targets, link texts over two lines.
_SCAN_MARKS = ("`", "<", "\\", "![", "]:", "\n    ", "\t", "~~~")
_SCAN_TARGET = r"\]\((?![^()\s\"'&]+\))|\[[^\[\]]*\n[^\[\]]*\]\("
_LINKS = T.ArrayType(
    T.StructType([T.StructField("target", T.StringType()), T.StructField("offset", T.IntegerType())])
)


@F.pandas_udf(_LINKS)
def _scan(bodies: pd.Series) -> pd.Series:
    return bodies.map(
        lambda b: [{"target": t, "offset": o} for t, o in markdown_links(b)], na_action="ignore"
    )


def _targets(matches: Column) -> Column:
    return F.transform(
        matches, lambda t: F.struct(t.alias("target"), F.lit(None).cast("int").alias("offset"))
    )


def _needs_scan(body: Column) -> Column:
    found = body.startswith("    ")
    for mark in _SCAN_MARKS:
        found = found | body.contains(mark)
    return found | body.rlike(_SCAN_TARGET)


def markdown_link_targets(body: Column) -> Column:
    """Array of struct(target, offset); offset is NULL where the pattern pass found the link."""
    fast = _targets(F.regexp_extract_all(body, F.lit(_INLINE), F.lit(1)))
    return F.coalesce(_scan(F.when(_needs_scan(body), body)), fast)


def wikilink_targets(body: Column) -> Column:
    found = F.regexp_extract_all(body, F.lit(WIKILINK), F.lit(1))
    return F.transform(found, trim_space)


def extract_links(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """links(src, seq, syntax, target, kind, dst), one row per link occurrence; carry: more columns of docs."""
    both = F.concat(
        F.transform(
            markdown_link_targets(F.col("body")),
            lambda t: F.struct(F.lit("markdown").alias("syntax"), t["target"].alias("target")),
        ),
        F.transform(
            wikilink_targets(F.col("body")),
            lambda t: F.struct(F.lit("wikilink").alias("syntax"), t.alias("target")),
        ),
    )
    # Bodies without a bracket have no links; skip them before any work is done.
    raw = (
        docs.where(F.col("body").contains("["))
        .select(F.col("id").alias("src"), *carry, F.posexplode(both).alias("seq", "link"))
        .select("src", *carry, "seq", "link.syntax", "link.target")
    )
    resolved = F.when(
        F.col("syntax") == "markdown", resolve_markdown_target(F.col("target"), F.col("src"))
    ).otherwise(resolve_wikilink_target(F.col("target")))
    return computed_once(raw, {"_to": resolved}).select(
        "src", "seq", "syntax", "target", F.col("_to.kind").alias("kind"),
        nfc(F.col("_to.dst")).alias("dst"), *carry,
    )


def resolve_links(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Links with a `known` flag: does dst name a document?

    One checkpoint after the join: bodies are scanned once, and all consumers read link rows.
    """
    known = docs.select(F.col("id").alias("_key"), F.lit(True).alias("known"))
    # Links without a target get keys of their own, which match nothing and spread over tasks.
    nowhere = F.concat(F.lit("\0"), F.xxhash64("src", "seq").cast("string"))
    joined = links.withColumn("_key", F.coalesce("dst", nowhere)).join(known, "_key", "left")
    return materialise(joined.withColumn("known", F.coalesce("known", F.lit(False))).select(*links.columns, "known"))


def edges(resolved: DataFrame) -> DataFrame:
    return resolved.where("known").select("src", "dst").distinct()


def unresolved_links(resolved: DataFrame) -> DataFrame:
    """One row per occurrence of a link to a document that does not exist."""
    return resolved.where((F.col("kind") == "concept") & ~F.col("known")).select(
        "src", "seq", "syntax", "dst"
    )


def link_diagnostics(resolved: DataFrame) -> DataFrame:
    kind = F.col("kind")
    broken = (kind == "concept") & ~F.col("known")
    wiki = F.col("syntax") == "wikilink"
    message = (
        F.when(kind == "escape", F.concat(F.lit("Link escapes bundle root: "), "target"))
        .when(kind == "invalid", F.concat(F.lit("Malformed percent-encoded link: "), "target"))
        .when(broken & wiki, F.concat(F.lit("Unresolved wikilink: "), "dst"))
        .otherwise(F.concat(F.lit("Unresolved link: "), "dst"))
    )
    return resolved.where(kind.isin("escape", "invalid") | broken).select(
        F.lit("warning").alias("severity"),
        F.when(kind == "escape", "link_path_escape").otherwise("link_unresolved").alias("code"),
        F.concat(F.col("src"), F.lit(".md")).alias("path"),
        message.alias("message"),
    )


def inbound_counts(docs: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """inbound(id, n) for every document, 0 for orphans. Counts are combined before the shuffle."""
    counted = edge_rows.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return docs.select("id").join(counted, "id", "left").select(
        "id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def backlinks(docs: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """backlinks(id, src): one row per edge, and one with NULL src for a page nobody links to."""
    targets = edge_rows.select(F.col("dst").alias("id")).distinct()
    alone = docs.select("id").join(targets, "id", "left_anti")
    return edge_rows.select(F.col("dst").alias("id"), "src").unionByName(
        alone.withColumn("src", F.lit(None).cast("string"))
    )


def gaps(unresolved: DataFrame) -> DataFrame:
    """gaps(topic, mentioned_by): distinct pages that mention a missing topic."""
    return unresolved.select(
        F.col("dst").alias("topic"), F.col("src").alias("mentioned_by")
    ).distinct()


def gap_counts(unresolved: DataFrame) -> DataFrame:
    """gap sizes: distinct mentioners (exact, two combined aggregations) and occurrences."""
    per_source = unresolved.groupBy(F.col("dst").alias("topic"), "src").agg(
        F.count(F.lit(1)).alias("links")
    )
    return per_source.groupBy("topic").agg(
        F.count(F.lit(1)).cast("bigint").alias("mentions"),
        F.sum("links").cast("bigint").alias("links"),
    )
