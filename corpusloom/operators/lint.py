"""Corpus health: orphans, missing pages, contradictions, stub candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import slugify
from .links import gap_counts, unresolved_links

# Fixed value: the marker that generated pages carry.
CONTRADICTION_MARKERS = ("⚠️ **Contradiction",)


def has_contradiction(body: Column, markers: tuple[str, ...] = CONTRADICTION_MARKERS) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | body.contains(marker)
    return found


def orphans(inbound: DataFrame) -> DataFrame:
    return inbound.where("n = 0").select("id")


def findings(docs: DataFrame, resolved: DataFrame, inbound: DataFrame) -> DataFrame:
    """findings(kind, id, seq, finding): missing pages by link, then orphans and contradictions."""
    missing = unresolved_links(resolved).select(
        F.lit("missing").alias("kind"), F.col("src").alias("id"),
        F.col("seq").cast("bigint").alias("seq"),
        F.concat(F.lit("Missing page: "), "dst", F.lit(" (in "), "src", F.lit(")")).alias("finding"),
    )
    alone = orphans(inbound).select(
        F.lit("orphan").alias("kind"), "id", F.lit(0).cast("bigint").alias("seq"),
        F.concat(F.lit("Orphan: "), "id", F.lit(" has no inbound links")).alias("finding"),
    )
    marked = docs.where(has_contradiction(F.col("body"))).select(
        F.lit("contradiction").alias("kind"), "id", F.lit(1).cast("bigint").alias("seq"),
        F.concat(F.lit("Contradiction flagged in "), "id").alias("finding"),
    )
    return missing.unionByName(alone).unionByName(marked)


def lint_summary(docs: DataFrame, resolved: DataFrame, inbound: DataFrame) -> DataFrame:
    """One row of counts. Every input is reduced to a count per partition before the shuffle."""
    pages = docs.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(has_contradiction(F.col("body"))).alias("contradictions"),
    )
    alone = inbound.agg(F.count_if(F.col("n") == 0).alias("orphans"))
    broken = resolved.agg(
        F.count_if((F.col("kind") == "concept") & ~F.col("known")).alias("missing_links")
    )
    # Three one-row results side by side.
    rows = (
        pages.select(F.struct("pages", "contradictions").alias("p"), F.lit(None).alias("o"), F.lit(None).alias("m"))
        .unionAll(alone.select(F.lit(None), F.col("orphans"), F.lit(None)))
        .unionAll(broken.select(F.lit(None), F.lit(None), F.col("missing_links")))
    )
    return rows.agg(
        F.max("p.pages").cast("bigint").alias("pages"),
        F.max("o").cast("bigint").alias("orphans"),
        F.max("m").cast("bigint").alias("missing_links"),
        F.max("p.contradictions").cast("bigint").alias("contradictions"),
    )


def lint_report(summary: DataFrame, finding_rows: DataFrame, day: str) -> DataFrame:
    """The health report as ordered rows (part, id, seq, line)."""
    text = lambda name: F.col(name).cast("string")
    head = F.concat(
        F.lit(f"# Wiki Lint Report\nGenerated: {day}\n## Summary\n- Total pages: "), text("pages"),
        F.lit("\n- Orphans: "), text("orphans"), F.lit("\n- Missing pages: "), text("missing_links"),
        F.lit("\n- Contradictions: "), text("contradictions"), F.lit("\n## Findings"),
    )
    edge = lambda frame, line: frame.select(
        F.lit(0).alias("part"), F.lit("").alias("id"), F.lit(0).cast("bigint").alias("seq"), line.alias("line")
    )
    clean = (F.col("orphans") == 0) & (F.col("missing_links") == 0) & (F.col("contradictions") == 0)
    rows = finding_rows.select(
        F.when(F.col("kind") == "missing", 1).otherwise(2).alias("part"), "id", "seq",
        F.concat(F.lit("- "), "finding").alias("line"),
    )
    none = edge(summary.where(clean), F.lit("✅ No issues found!")).withColumn("part", F.lit(3))
    return edge(summary, head).unionByName(rows).unionByName(none).orderBy("part", "id", "seq")


def stub_candidates(unresolved: DataFrame, docs: DataFrame) -> DataFrame:
    """stubs(topic, id, title, mentions): missing concepts that at least two pages mention.

    A topic qualifies with one segment or as concepts/<name>, and only if the name is
    already a slug. Existing pages are never replaced.
    """
    name = F.when(
        F.col("topic").rlike(r"^(?:concepts/)?[^/]+\z"),
        F.regexp_replace("topic", "^concepts/", ""),
    )
    sized = gap_counts(unresolved).where("mentions >= 2").withColumn("name", name)
    named = sized.where(F.col("name").isNotNull() & (F.col("name") != "concepts/"))
    slugs = named.where(slugify(F.col("name")) == F.col("name")).select(
        "topic", F.concat(F.lit("concepts/"), "name").alias("id"),
        F.replace("name", F.lit("-"), F.lit(" ")).alias("title"), "mentions",
    )
    return slugs.join(docs.select("id"), "id", "left_anti")


def stub_documents(stubs: DataFrame, day: str) -> DataFrame:
    """One page per stub; two topics (foo, concepts/foo) may lead to the same page."""
    return stubs.groupBy("id").agg(F.min_by("title", "topic").alias("title")).select(
        "id", F.lit("concept").alias("type"), "title", F.lit(day).alias("created"),
        F.lit(day).alias("updated"), F.lit("stub").alias("status"),
    )


def stub_mentions(stubs: DataFrame, gap_rows: DataFrame) -> DataFrame:
    """Body of a stub as rows (id, mentioned_by, link): popular topics stay spread out.

    Of two topics leading to one page, the one created first (lower in order) fills it.
    """
    chosen = stubs.groupBy("id").agg(F.min("topic").alias("topic"))
    return gap_rows.join(chosen, "topic").select(
        "id", "mentioned_by",
        F.concat(F.lit("["), "mentioned_by", F.lit("](/"), "mentioned_by", F.lit(".md)")).alias("link"),
    )
