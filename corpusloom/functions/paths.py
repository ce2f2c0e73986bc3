"""Link targets, relative path encoding and label escaping, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import nfc, trim_space

_NO_SEGMENTS = "array<string>"


def _fold_segments(start: Column, segments: Column) -> Column:
    """Apply '.' and '..' to a path: struct(stack, escaped)."""
    state = F.struct(start.alias("stack"), F.lit(False).alias("escaped"))

    def step(acc: Column, part: Column) -> Column:
        depth = F.size(acc["stack"])
        return (
            F.when(part.isin("", "."), acc)
            .when(
                part == "..",
                F.struct(
                    F.when(depth > 0, F.slice(acc["stack"], F.lit(1), F.greatest(depth - 1, F.lit(0))))
                    .otherwise(acc["stack"])
                    .alias("stack"),
                    (acc["escaped"] | (depth == 0)).alias("escaped"),
                ),
            )
            .otherwise(
                F.struct(
                    F.concat(acc["stack"], F.array(part)).alias("stack"),
                    acc["escaped"].alias("escaped"),
                )
            )
        )

    return F.aggregate(segments, state, step)


def resolve_markdown_target(target: Column, source_id: Column) -> Column:
    """struct(kind, dst): concept, escape, external, empty or invalid."""
    clean = F.regexp_extract(target, r"^[^?#]*", 0)
    # URL decoding here is form decoding, which would turn '+' into a space.
    decoded = F.try_url_decode(F.replace(clean, F.lit("+"), F.lit("%2B")))
    bad_escape = clean.rlike("%(?![0-9A-Fa-f]{2})") | decoded.isNull()
    bad_utf8 = decoded.contains("�") & ~F.lower(clean).rlike("�|%ef%bf%bd")
    path = F.replace(F.coalesce(decoded, F.lit("")), F.lit("\\"), F.lit("/"))
    folder = F.regexp_extract(source_id, r"^(.*/)?", 0)
    base = F.filter(F.split(folder, "/"), lambda p: p != "")
    start = F.when(path.startswith("/"), F.array().cast(_NO_SEGMENTS)).otherwise(base)
    folded = _fold_segments(start, F.split(path, "/"))
    resolved = F.array_join(folded["stack"], "/")
    is_page = resolved.endswith(".md")
    kind = (
        F.when(clean == "", "empty")
        .when(clean.rlike("(?i)^[a-z][a-z0-9+.-]*:"), "external")
        .when(bad_escape | bad_utf8, "invalid")
        .when(folded["escaped"], "escape")
        .when(is_page, "concept")
        .otherwise("empty")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "concept", F.left(resolved, F.length(resolved) - 3)).alias("dst"),
    )


def resolve_wikilink_target(target: Column) -> Column:
    """struct(kind, dst): wikilinks already name a document id."""
    clean = trim_space(target)
    return F.struct(
        F.when(clean == "", "empty").otherwise("concept").alias("kind"),
        F.when(clean != "", clean).alias("dst"),
    )


def document_id(path: Column) -> Column:
    """Document id of a path: NFC, '/' separators, '.md' removed."""
    return F.regexp_replace(nfc(F.replace(path, F.lit("\\"), F.lit("/"))), r"\.md\z", "")


def is_reserved(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return name.isin("index.md", "log.md")


def scan_order(path: Column) -> Column:
    """Key that sorts paths the way a sorted recursive directory walk visits them."""
    return F.replace(path, F.lit("/"), F.lit("\x01"))


def escape_label(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\\[\]])", r"\\$1")


def encode_path(c: Column) -> Column:
    """URI-component encoding per segment; form encoding differs in five characters and spaces."""
    out = F.url_encode(c)
    for encoded, plain in (
        ("%2F", "/"), ("+", "%20"), ("%21", "!"), ("%27", "'"),
        ("%28", "("), ("%29", ")"), ("%7E", "~"),
    ):
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out
