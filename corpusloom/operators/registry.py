"""Registry of pages and the tables derived from it: search, status, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import encode_path, escape_label, is_reserved, scan_order
from ..functions.text import blank_to_null, collapse_space, nfc, path_title, trim_space
from .skew import with_positions

# Columns a page table may have besides id, type, title and body; missing ones read as NULL.
FIELDS = [
    "description", "tags", "category", "domain", "aliases", "recall_triggers", "status",
    "stale_after", "resource", "generated", "verified", "summary", "raw_path", "source_id",
    # JSON of all values under keys of the producer's own.
    "extensions",
]
SEARCHED = ["title", "type", "category", "domain", "tags", "aliases", "recall_triggers"]


def with_fields(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    return df.withColumns({n: F.lit(None).cast("string") for n in missing}) if missing else df


def semantic_title(title: Column, doc_id: Column) -> Column:
    return F.coalesce(trim_space(blank_to_null(title)), path_title(doc_id))


def build_registry(docs: DataFrame) -> DataFrame:
    """One row per document: type, title, named fields, created/updated if not blank."""
    docs = with_fields(docs, FIELDS + ["title", "created", "updated"])
    return docs.select(
        "id",
        "type",
        semantic_title(F.col("title"), F.col("id")).alias("title"),
        *FIELDS,
        blank_to_null(F.col("created")).alias("created"),
        blank_to_null(F.col("updated")).alias("updated"),
        F.lit("page").alias("origin"),
    )


def packet_fallbacks(packets: DataFrame, documents: DataFrame, folder: str, type_: str) -> DataFrame:
    """Registry rows for packets without a page; manifest keys override the defaults.

    packets(dir, id?, title?, captured?, type?, ...): dir is the packet folder's name.
    """
    packets = with_fields(packets, FIELDS + ["id", "title", "captured", "type", "created", "updated"])
    own = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col("dir"))
    captured = F.nullif(F.col("captured"), F.lit(""))
    rows = packets.select(
        F.concat(F.lit(f"{folder}/"), own).alias("id"),
        F.coalesce("type", F.lit(type_)).alias("type"),
        F.coalesce("title", own).alias("title"),
        *FIELDS,
        F.coalesce("created", captured).alias("created"),
        F.coalesce("updated", captured).alias("updated"),
        F.lit("packet").alias("origin"),
    )
    return rows.join(documents.select("id"), "id", "left_anti")


def full_registry(docs: DataFrame, *fallbacks: DataFrame) -> DataFrame:
    out = build_registry(docs)
    for rows in fallbacks:
        out = out.unionByName(rows)
    return out


def search_registry(registry: DataFrame, query: str, type_: str | None = None) -> DataFrame:
    """Pages whose id, title, type, category, domain, tags, aliases or triggers contain query."""
    registry = with_fields(registry, SEARCHED)
    needle = F.lit(query.lower())
    found = F.lower(F.col("id")).contains(needle)
    for name in SEARCHED:
        column = F.col(name)
        if dict(registry.dtypes)[name].startswith("array"):
            hit = F.exists(column, lambda v: F.lower(v).contains(needle))
        else:
            hit = F.lower(column.cast("string")).contains(needle)
        found = found | F.coalesce(hit, F.lit(False))
    rows = registry.where(found)
    if type_:
        rows = rows.where(F.lower(F.col("type")) == type_.lower())
    return rows.select(
        "id",
        F.coalesce(F.nullif("title", F.lit("")), F.col("id")).alias("title"),
        F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown")).alias("type"),
    )


def pages_by_type(registry: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown"))
    return registry.groupBy(kind.alias("type")).agg(
        F.count(F.lit(1)).cast("bigint").alias("pages")
    )


def health(total: Column, orphans: Column) -> Column:
    return F.when(total == 0, "Empty").when(orphans > 5, "Warning").otherwise("Good")


def status(registry: DataFrame, inbound: DataFrame, gap_sizes: DataFrame) -> DataFrame:
    """One row: pages, types, orphans, gaps, health. All counts are combined before the shuffle."""
    facts = (
        registry.select(F.lit("page").alias("fact"), F.col("type"))
        .unionByName(inbound.where("n = 0").select(F.lit("orphan").alias("fact"), F.lit(None).cast("string").alias("type")))
        .unionByName(gap_sizes.select(F.lit("gap").alias("fact"), F.lit(None).cast("string").alias("type")))
    )
    counted = facts.groupBy("fact", "type").agg(F.count(F.lit(1)).alias("n"))
    of = lambda fact: F.coalesce(F.sum(F.when(F.col("fact") == fact, F.col("n"))), F.lit(0))
    return counted.agg(
        of("page").cast("bigint").alias("total_pages"),
        F.count_if(F.col("fact") == "page").cast("bigint").alias("types"),
        of("orphan").cast("bigint").alias("orphans"),
        of("gap").cast("bigint").alias("gaps"),
    ).withColumn("health", health(F.col("total_pages"), F.col("orphans")))


def type_label(type_: Column) -> Column:
    return F.concat(F.upper(F.left(type_, F.lit(1))), F.substr(type_, F.lit(2)), F.lit("s"))


def index_by_type(registry: DataFrame) -> DataFrame:
    """Lines of the page index: (type, section, id, line); order by the first three columns.

    One row per line instead of one text per type: a type may hold a third of all pages.
    """
    entry = F.concat(
        F.lit("- [["), "id", F.lit("]] — "), "title", F.lit(" *(created: "),
        F.coalesce("created", F.lit("unknown")), F.lit(")*"),
    )
    lines = registry.select("type", F.lit(1).alias("section"), "id", entry.alias("line"))
    heads = registry.select("type").distinct().select(
        "type", F.lit(0).alias("section"), F.lit("").alias("id"),
        F.concat(F.lit("## "), type_label(F.col("type"))).alias("line"),
    )
    return lines.unionByName(heads).withColumn("section", F.col("section").cast("bigint"))


def index_in_locale_order(registry: DataFrame, by: str = "title", locale: str = "UNICODE") -> DataFrame:
    """(type, position, id, title): pages of each type numbered by the order of a locale.

    Accents and case decide only between equal letters; texts that the locale holds equal, and
    copies, follow their ids in binary order. locale is a collation of Spark (UNICODE, de, sv ...).
    Missing types count as unknown, missing titles as the id. Only keys and titles are moved,
    and a type of any size is numbered in range slices.
    """
    rows = registry.select(
        F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown")).alias("type"), "id",
        F.coalesce(F.nullif("title", F.lit("")), F.col("id")).alias("title"),
    )
    keyed = rows.withColumn("_key", F.collate(F.col(by), locale))
    return with_positions(keyed, ["type"], ["_key", "id"], narrow=True).select("type", "position", "id", "title")


def folder_steps(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(dir, name) for every ancestor folder of every page, once per page; carry: more columns of docs."""
    parts = F.split("id", "/")
    depth = F.size("parts")
    steps = F.transform(
        F.sequence(F.lit(1), depth - 1),
        lambda i: F.struct(
            F.array_join(F.slice("parts", F.lit(1), i - 1), "/").alias("dir"),
            F.get("parts", i - 1).alias("name"),
        ),
    )
    nested = docs.select(parts.alias("parts"), *carry).where(F.size("parts") > 1)
    return nested.select(F.explode(steps).alias("s"), *carry).select("s.dir", "s.name", *carry)


def directory_index(docs: DataFrame, root_title: str = "Wiki", folders: DataFrame | None = None) -> DataFrame:
    """Lines of every folder's index: (dir, section, name, line).

    Sections: 0 title, 1 sub-folders, 2 pages. Order by the first three columns and render
    each section under its heading; the root always has a title line. folders(dir, name) are
    taken from the pages, unless the caller keeps them.
    """
    docs = with_fields(docs, ["title", "description"])
    folders = folder_steps(docs).distinct() if folders is None else folders
    sub = folders.select(
        "dir", F.lit(1).alias("section"), "name",
        F.concat(
            F.lit("- ["), escape_label(F.col("name")), F.lit("/]("),
            encode_path(F.col("name")), F.lit("/)"),
        ).alias("line"),
    )
    folder_of = F.regexp_replace("id", "/?[^/]*$", "")
    name = F.element_at(F.split("id", "/"), -1)
    description = F.nullif(collapse_space(F.col("description")), F.lit(""))
    pages = docs.select(
        folder_of.alias("dir"), F.lit(2).alias("section"), name.alias("name"),
        F.concat(
            F.lit("- ["),
            escape_label(F.coalesce(trim_space(blank_to_null(F.col("title"))), name)),
            F.lit("]("), encode_path(F.concat(name, F.lit(".md"))), F.lit(")"),
            F.coalesce(F.concat(F.lit(" — "), description), F.lit("")),
        ).alias("line"),
    )
    all_dirs = (
        pages.select("dir").distinct().unionByName(folders.select("dir").distinct())
        .unionByName(docs.sparkSession.range(1).select(F.lit("").alias("dir")))
        .distinct()
    )
    last = F.element_at(F.split("dir", "/"), -1)
    heading = F.when(F.col("dir") == "", F.lit(root_title)).otherwise(last)
    titles = all_dirs.select(
        "dir", F.lit(0).alias("section"), F.lit("").alias("name"),
        F.concat(F.lit("# "), escape_label(heading)).alias("line"),
    )
    return titles.unionByName(sub).unionByName(pages).withColumn(
        "section", F.col("section").cast("bigint")
    )


def render_index_by_type(registry: DataFrame, last_updated: str) -> DataFrame:
    """The page index as ordered rows of one text column; write it with df.write.text."""
    lines = index_by_type(registry).withColumn(
        "line", F.when(F.col("section") == 0, F.concat("line", F.lit("\n"))).otherwise(F.col("line"))
    ).withColumn("part", F.lit(1))
    # An empty line ends every type.
    ends = registry.select("type").distinct().select(
        "type", F.lit(2).cast("bigint").alias("section"), F.lit("").alias("id"), F.lit("").alias("line"), F.lit(1).alias("part")
    )
    one = registry.sparkSession.range(1)
    edge = lambda line, part: one.select(
        F.lit("").alias("type"), F.lit(0).cast("bigint").alias("section"), F.lit("").alias("id"),
        line.alias("line"), F.lit(part).alias("part"),
    )
    head = edge(F.lit("# Wiki Index\n\n> Auto-generated from meta/registry.json. Do not edit manually.\n"), 0)
    total = registry.agg(F.count(F.lit(1)).cast("string")).scalar()
    foot = edge(F.concat(F.lit(f"---\n*Last updated: {last_updated}* | *Total pages: "), total, F.lit("*")), 2)
    rows = lines.unionByName(ends).unionByName(head).unionByName(foot)
    return rows.orderBy("part", "type", "section", "id").select(F.col("line").alias("value"))


def render_directory_index(index: DataFrame) -> DataFrame:
    """Index files as ordered rows (dir, section, name, line): the lines of dir/index.md.

    Sections with entries get their heading; the root's title carries the format version.
    """
    # Frontmatter of the root index and the section headings.
    root = F.lit('---\nokf_version: "0.2"\n---\n\n')
    titled = index.withColumn(
        "line", F.when((F.col("section") == 0) & (F.col("dir") == ""), F.concat(root, "line")).otherwise(F.col("line"))
    )
    heads = index.where("section > 0").select("dir", "section").distinct().select(
        "dir", "section", F.lit("").alias("name"),
        F.when(F.col("section") == 1, "\n## Directories\n").otherwise("\n## Concepts\n").alias("line"),
    )
    return titled.unionByName(heads).orderBy("dir", "section", "name")


def identity_collisions(files: DataFrame) -> DataFrame:
    """Pages whose id equals an earlier page's id but for case or Unicode form.

    The first path per identity comes from a combined min aggregate, not a window.
    files(path): paths relative to the corpus root.
    """
    pages = files.where(~is_reserved(F.col("path"))).select(
        "path",
        F.lower(nfc(F.regexp_replace("path", r"\.md\z", ""))).alias("identity"),
    )
    first = pages.groupBy("identity").agg(
        F.min(F.struct(scan_order(F.col("path")).alias("o"), F.col("path").alias("first_path"))).alias("f"),
        F.count(F.lit(1)).alias("n"),
    ).where("n > 1").select("identity", "f.first_path")
    return (
        pages.join(first, "identity")
        .where(F.col("path") != F.col("first_path"))
        .select(
            F.lit("error").alias("severity"),
            F.lit("concept_identity_collision").alias("code"),
            "path",
            F.concat(
                F.lit("Identity collision between "), "first_path", F.lit(" and "), "path"
            ).alias("message"),
        )
    )
