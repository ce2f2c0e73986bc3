"""Pages made on request: ensured pages, observations, insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import observation_slug, slugify, valid_insight_slug
from ..session import stored

# Page type, its folder, and the body a new page starts with.
FOLDERS = {
    "entity": "entities", "concept": "concepts", "synthesis": "syntheses", "analysis": "analyses",
    "requirement": "requirements", "skill": "skills", "case": "cases",
}
_LINKS = "## Links\n\n- [related-page](/concepts/related-page.md)"
TEMPLATES = {
    "entity": f"One-line description.\n\n## Overview\n\n[Key facts]\n\n{_LINKS}",
    "concept": f"One-line definition.\n\n## Definition\n\n[Clear explanation]\n\n{_LINKS}",
    "synthesis": f"Cross-cutting analysis.\n\n## Question\n\n[What drove this?]\n\n{_LINKS}",
    "analysis": f"Durable answer from a query.\n\n## Question\n\n[Original question]\n\n{_LINKS}",
    "skill": (
        "_One-line summary of the reusable pattern this skill captures._\n\n"
        "## When to Use\n\n[Trigger conditions — when this pattern applies]\n\n"
        "## Procedure\n\n1. [Step 1]\n2. [Step 2]\n\n"
        "## Pitfalls\n\n- [Known failure mode or caveat]\n\n"
        "## Distilled From\n\n_Trajectories this skill was generalized from._\n\n"
        "- [trajectories/TRJ-...](/trajectories/TRJ-....md)"
    ),
    "case": (
        "_One-line summary of the specific task this case records._\n\n"
        "## Task\n\n[What was requested]\n\n"
        "## Approach\n\n[How the agent solved it — key steps and decisions]\n\n"
        "## Outcome\n\n[Result, and anything worth reusing or avoiding next time]\n\n"
        "## Trajectory\n\n- [trajectories/TRJ-...](/trajectories/TRJ-....md) — captured tool-call run"
    ),
    "requirement": (
        "## Description\n\n[Clear description of what this requirement entails]\n\n"
        "## Acceptance Criteria\n\n- [ ] [Criterion 1]\n- [ ] [Criterion 2]\n\n"
        "## Dependencies\n\n_Pages this requirement depends on._\n\n"
        "## Implementation Notes\n\n[Optional notes]\n\n"
        "## Sources\n\n- [sources/SRC-...](/sources/SRC-....md) — original concept capture"
    ),
    "": f"[Description to be filled]\n\n{_LINKS}",
}
RELEVANCE_ICONS = {"low": "📝", "medium": "🔍", "high": "⭐", "critical": "🔴"}


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def type_folder(type_: Column) -> Column:
    return _lookup(FOLDERS, type_, "concepts")


def folder_type(folder: Column) -> Column:
    """Page type of a folder: also knows sources; concept when unknown."""
    table = {folder_: type_ for type_, folder_ in FOLDERS.items()}
    return _lookup({**table, "sources": "source"}, folder, "concept")


def template(type_: Column, title: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), _lookup(TEMPLATES, type_, TEMPLATES[""]))


def ensure_pages(requests: DataFrame, pages: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """(new_pages, outcomes) of requests(request_id, type, title, content).

    A page is inserted if its folder and slug are free; the first request in order creates
    it, later ones and requests for existing pages report created = false.
    """
    rows = requests.withColumn("id", F.concat(type_folder(F.col("type")), F.lit("/"), slugify(F.col("title"))))
    first = rows.groupBy("id").agg(
        F.min_by(F.struct("request_id", "type", "title", "content"), "request_id").alias("f")
    )
    missing = first.join(pages.select("id"), "id", "left_anti").select("id", "f.*")
    new_pages = missing.select(
        "id", "type", "title", F.lit(day).alias("created"), F.lit(day).alias("updated"),
        F.coalesce("content", template(F.col("type"), F.col("title"))).alias("body"),
    )
    creators = missing.select("id", F.col("request_id").alias("_creator"))
    outcomes = rows.select("request_id", "id").join(creators, "id", "left").select(
        "request_id", "id", F.col("_creator").eqNullSafe(F.col("request_id")).alias("created")
    )
    return new_pages, outcomes


def observations_to_documents(observations: DataFrame) -> DataFrame:
    """Pages of observations(day, observed_at, title, content, relevance, tags, source_context).

    Titles in scripts without ASCII letters share a slug per day; the last one observed is
    kept (a combined max aggregate) and `replaced` counts the others.
    """
    filled = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    part = lambda label, name: F.when(
        filled(name), F.concat(F.lit(f"\n*{label}: "), name, F.lit("*"))
    ).otherwise("")
    icon = _lookup(RELEVANCE_ICONS, F.col("relevance"), "📝")
    body = F.concat(
        F.lit("# "), icon, F.lit(" Observation: "), "title", F.lit("\n\n"), "content",
        F.lit("\n\n*Relevance: "), "relevance", F.lit("*"),
        part("Context", "source_context"), part("Tags", "tags"),
        F.lit("\n\n---\n*Observed: "), "observed_at", F.lit("*"),
    )
    rows = observations.select(
        observation_slug(F.col("title"), F.col("day")).alias("slug"), "day", "observed_at", "relevance",
        F.concat(F.lit("Observation: "), "title").alias("title"),
        F.when(filled("tags"), F.filter(F.split(F.col("tags"), r"\s+"), lambda t: t != "")).alias("tags"),
        F.when(filled("source_context"), F.col("source_context")).alias("source_context"), body.alias("body"),
    )
    last = rows.groupBy("slug").agg(
        F.max_by(F.struct(*[c for c in rows.columns if c != "slug"]), F.struct("observed_at", "body")).alias("r"),
        (F.count(F.lit(1)) - 1).cast("bigint").alias("replaced"),
    )
    return last.select(
        F.concat(F.lit("sources/"), "slug").alias("id"), F.lit("source").alias("type"), "r.title", "slug",
        F.lit("observation").alias("status"), F.col("r.day").alias("created"), F.col("r.day").alias("updated"),
        "r.relevance", "r.observed_at", "r.tags", "r.source_context", "r.body", "replaced",
    )


def insights_to_documents(insights: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) of insights(slug, title, body, category); bad slugs are rejected."""
    valid = F.coalesce(valid_insight_slug(F.col("slug")), F.lit(False))
    category = F.coalesce(F.col("category"), F.lit(""))
    body = F.concat(
        F.lit("# "), "title", F.lit("\n\n"), "body", F.lit("\n\n"),
        F.when(category != "", F.concat(F.lit("*Category: "), category, F.lit("*"))).otherwise(""),
        F.lit(f"\n\n---\n*Captured: {day}*\n\n## Related\n\n_Add links to related pages._"),
    )
    documents = insights.where(valid).select(
        F.concat(F.lit("sources/"), "slug").alias("id"), F.lit("source").alias("type"), "title", "slug",
        F.lit("insight").alias("status"), F.lit(day).alias("created"), F.lit(day).alias("updated"),
        F.nullif(category, F.lit("")).alias("category"), body.alias("body"),
    )
    return documents, insights.where(~valid).withColumn(
        "error", F.concat(F.lit("Invalid insight slug: "), "slug")
    )


def requirement_counts(documents: DataFrame) -> DataFrame:
    """Requirements by status and priority; extensions hold the priority as JSON."""
    rows = documents.where("type = 'requirement'").select(
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce(F.get_json_object("extensions", "$.priority"), F.lit("unknown")).alias("priority"),
    )
    return rows.groupBy("status", "priority").agg(F.count(F.lit(1)).cast("bigint").alias("requirements"))


# What a requirement's status and priority may be.
REQUIREMENT_STATUS = ("draft", "clarified", "active", "implemented", "deferred", "rejected")
REQUIREMENT_PRIORITY = ("p0", "p1", "p2", "p3")


def requirement_faults(requirements: DataFrame) -> DataFrame:
    """(id, field, value): statuses and priorities that no requirement may have; a missing value is a fault."""
    fields = F.array(*[
        F.struct(F.lit(name).alias("field"), F.col(name).alias("value"), F.coalesce(F.col(name).isin(*allowed), F.lit(False)).alias("ok"))
        for name, allowed in (("status", REQUIREMENT_STATUS), ("priority", REQUIREMENT_PRIORITY))
    ])
    return requirements.select("id", F.inline(fields)).where(~F.col("ok")).drop("ok")


def requirement_levels(requirements: DataFrame) -> DataFrame:
    """(id, level, missing, cyclic) of requirements(id, depends_on ARRAY<STRING>).

    Level 0 depends on nothing; others are one above the highest they depend on. What depends on
    a cycle, or is part of one, is cyclic and has no level. Dependencies that are no requirement
    are counted as missing and do not count for the level. One round per level: each settles the
    requirements whose dependencies are all settled, and only open ones go on.
    """
    ids = stored(requirements.select("id", F.array_distinct(F.coalesce("depends_on", F.array().cast("array<string>"))).alias("needs")))
    arrows = ids.select("id", F.explode("needs").alias("need"))
    known = ids.select(F.col("id").alias("need"), F.lit(True).alias("known")).distinct()
    arrows = stored(arrows.join(known, "need", "left").withColumn("known", F.coalesce("known", F.lit(False))))
    missing = arrows.where("not known").groupBy("id").agg(F.count("*").alias("missing"))
    open_ = arrows.where("known").select("id", "need", F.lit(0).cast("bigint").alias("settled"), F.lit(False).alias("done"))
    settled = ids.select("id").distinct().join(open_.select("id"), "id", "left_anti").withColumn("level", F.lit(0).cast("bigint"))
    rounds, last = [stored(settled)], None
    while not rounds[-1].isEmpty():
        last = rounds[-1].select(F.col("id").alias("need"), F.col("level").alias("_level"))
        open_ = open_.join(last, "need", "left").select(
            "id", "need", F.coalesce("_level", "settled").alias("settled"), (F.col("done") | F.col("_level").isNotNull()).alias("done")
        )
        open_ = stored(open_)
        state = open_.groupBy("id").agg(F.bool_and("done").alias("ready"), (F.max("settled") + 1).alias("level"))
        rounds.append(stored(state.where("ready").select("id", "level")))
        open_ = open_.join(rounds[-1].select("id"), "id", "left_anti")
    levels = rounds[0]
    for more in rounds[1:]:
        levels = levels.unionByName(more)
    joined = ids.select("id").distinct().join(levels, "id", "left").join(missing, "id", "left")
    return joined.select("id", "level", F.coalesce("missing", F.lit(0)).cast("bigint").alias("missing"), F.col("level").isNull().alias("cyclic"))
