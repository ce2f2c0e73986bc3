"""Markdown files to documents and diagnostics, and back."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.frontmatter import (
    LEGACY_KEYS, MAX_BYTES, MAX_DEPTH, STANDARD_KEYS, FrontmatterError, dump_json, flatten, read_mapping,
    sources_kind, write_yaml,
)
from ..functions.paths import document_id, is_reserved
from ..functions.text import bound
from ..operators.registry import identity_collisions
from ..session import broadcast_if_small, computed_once, materialise

DIAGNOSTIC = ["severity", "code", "path", "message"]

_PARSED = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("mapping", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("frontmatter", T.StringType()),
    T.StructField("extensions", T.StringType()),
    T.StructField("sources_kind", T.StringType()),
    T.StructField("sources", T.StringType()),
    T.StructField("legacy", T.ArrayType(T.StringType())),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
])


def _parse_one(text: str | None, max_depth: int = MAX_DEPTH) -> dict:
    empty = {f.name: None for f in _PARSED.fields}
    if text is None:
        return empty
    try:
        mapping = read_mapping(text, max_depth)
    except FrontmatterError as error:
        return {**empty, "code": error.code, "message": str(error)}
    standard = {k: v for k, v in mapping.items() if k in STANDARD_KEYS and k != "sources"}
    kind = sources_kind(mapping)
    legacy = [k for k in mapping if k in LEGACY_KEYS]
    if kind.startswith("legacy"):
        legacy.append("sources")
    type_ = mapping.get("type")
    return {
        **empty,
        "mapping": dump_json(mapping),
        "type": type_ if isinstance(type_, str) else None,
        "frontmatter": dump_json(standard),
        "extensions": dump_json({k: v for k, v in mapping.items() if k not in STANDARD_KEYS}),
        "sources_kind": kind,
        "sources": dump_json(mapping["sources"]) if "sources" in mapping else None,
        "legacy": legacy,
        "fields": {k: flatten(v) for k, v in standard.items()},
    }


def _clean(value):
    """value without lone surrogates, which no table can hold."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(value, dict):
        return {_clean(k): _clean(v) for k, v in value.items()}
    return [_clean(v) for v in value] if isinstance(value, list) else value


def _parse_yaml(max_depth: int):
    @F.pandas_udf(_PARSED)
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_clean(_parse_one(t, max_depth)) for t in texts], columns=_PARSED.fieldNames())

    return parse


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """files(path, content) of all markdown files below root; path is relative to root."""
    strip = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:/*|^/+", "/")
    base = strip(F.lit(root.rstrip("/") + "/"))
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[mM][dD]").load(root)
    )
    return found.select(
        F.substr(strip(F.col("path")), F.length(base) + 1).alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def _split(content: Column) -> Column:
    """struct(opened, closed, yaml, body): the fences, without reading the YAML."""
    text = F.when(content.contains("\r"), F.regexp_replace(content, "\r\n?", "\n")).otherwise(content)
    return bound(text, lambda text: bound(F.substr(text, F.lit(4)), lambda rest: _parts(text, rest)))


def _parts(text: Column, rest: Column) -> Column:
    fence = F.instr(rest, F.lit("\n---\n"))
    at = F.when(fence > 0, fence).when(rest.endswith("\n---"), F.length(rest) - 3).when(rest.isNotNull(), 0)
    # A fence right after an explicit document end only closes if no other fence follows.
    second = F.regexp_extract(rest, r"(?s)^(.*?\n---(?:\n.*?)?)\n---(?=\n|\z)", 1)

    def inner_of(first: Column) -> Column:
        return F.when(first.endswith("\n...") & (second != ""), second).otherwise(first)

    def parts(at: Column, inner: Column) -> Column:
        body = F.substr(rest, F.length(inner) + 5)
        return F.struct(
            text.startswith("---\n").alias("opened"),
            (at > 0).alias("closed"),
            F.when(inner == "", "").otherwise(F.concat(F.substr(inner, F.lit(2)), F.lit("\n"))).alias("yaml"),
            F.when(body.startswith("\n\n"), F.substr(body, F.lit(3)))
            .when(body.startswith("\n"), F.substr(body, F.lit(2))).otherwise(body).alias("body"),
        )

    first = lambda at: F.when(at > 0, F.left(rest, at - 1)).when(rest.isNotNull(), "")
    return bound(at, lambda at: bound(bound(first(at), inner_of), lambda inner: parts(at, inner)))


def parse_frontmatter(
    files: DataFrame, require_type: bool = True, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """Add code/message (NULL when fine), the parsed values and the body to files(path, content).

    Only the YAML block, at most max_bytes, goes to Python; the body stays on the JVM.
    """
    split = computed_once(files, {"_s": _split(F.col("content"))})
    usable = (
        F.col("_s.opened") & F.col("_s.closed") & (F.octet_length("_s.yaml") <= max_bytes)
    )
    parsed = split.withColumn("_p", _parse_yaml(max_depth)(F.when(usable, F.col("_s.yaml"))))
    error = (
        F.when(~F.col("_s.opened"), F.struct(F.lit("frontmatter_missing").alias("code"), F.lit("Missing frontmatter opening delimiter").alias("message")))
        .when(~F.col("_s.closed"), F.struct(F.lit("frontmatter_parse_error").alias("code"), F.lit("Missing frontmatter closing delimiter").alias("message")))
        .when(~usable, F.struct(F.lit("frontmatter_limit_bytes").alias("code"), F.lit(f"Frontmatter exceeds {max_bytes} bytes").alias("message")))
        .when(F.col("_p.code").isNotNull(), F.struct(F.col("_p.code").alias("code"), F.col("_p.message").alias("message")))
    )
    if require_type:
        untyped = F.col("_p.type").isNull() | (F.trim("_p.type") == "")
        error = error.when(untyped, F.struct(F.lit("concept_missing_type").alias("code"), F.lit("Missing or empty type field").alias("message")))
    wikilinks = F.col("_s.body").rlike(r"\[\[[^\]]+\]\]")
    return computed_once(parsed, {"_e": error}).select(
        *files.columns,
        F.col("_e.code").alias("code"), F.col("_e.message").alias("message"),
        "_p.mapping", "_p.type", "_p.frontmatter", "_p.extensions", "_p.sources_kind", "_p.sources",
        F.when(wikilinks, F.concat("_p.legacy", F.array(F.lit("wikilinks")))).otherwise(F.col("_p.legacy")).alias("legacy_fields"),
        wikilinks.alias("has_legacy_wikilinks"), "_p.fields", F.col("_s.body").alias("body"),
    )


def discover_documents(
    files: DataFrame, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH
) -> tuple[DataFrame, DataFrame]:
    """(documents, diagnostics) of files(path, content); any error diagnostic blocks publishing.

    documents(id, path, type, title, ..., frontmatter, extensions, sources_kind, sources, body).
    The text columns named after standard keys hold flattened values; `frontmatter`,
    `extensions` and `sources` keep them as JSON (try_parse_json makes them VARIANT).
    """
    pages = files.where(~is_reserved(F.col("path")))
    # Paths alone decide collisions; the few that collide are kept away from the contents.
    collisions = materialise(identity_collisions(pages.select("path")))
    kept = pages.join(broadcast_if_small(collisions.select("path")), "path", "left_anti")
    parsed = parse_frontmatter(kept, max_bytes=max_bytes, max_depth=max_depth)
    return parsed_documents(parsed), collisions.unionByName(parse_errors(parsed))


def parsed_documents(parsed: DataFrame) -> DataFrame:
    """The documents among the rows of parse_frontmatter."""
    names = [k for k in STANDARD_KEYS if k not in ("type", "sources")]
    return parsed.where("code is null").select(
        document_id(F.col("path")).alias("id"), "path", "type",
        *[F.col("fields")[n].alias(n) for n in names],
        "frontmatter", "extensions", "sources_kind", "sources", "legacy_fields",
        "has_legacy_wikilinks", "body",
    )


def parse_errors(parsed: DataFrame) -> DataFrame:
    """The diagnostics among the rows of parse_frontmatter."""
    return parsed.where("code is not null").select(F.lit("error").alias("severity"), "code", "path", "message")


def _serialise_one(frontmatter, sources, extensions) -> str:
    head = json.loads(frontmatter or "{}")
    mapping = {k: head[k] for k in STANDARD_KEYS if k in head and k != "sources"}
    if sources is not None:
        mapping["sources"] = json.loads(sources)
    mapping.update(json.loads(extensions or "{}"))
    return write_yaml(mapping)


@F.pandas_udf(T.StringType())
def _write_yaml(frontmatter: pd.Series, sources: pd.Series, extensions: pd.Series) -> pd.Series:
    return pd.Series(
        [_serialise_one(f, s, e) for f, s, e in zip(frontmatter, sources, extensions)],
        dtype="object",
    )


def document_text(frontmatter: Column, sources: Column, extensions: Column, body: Column) -> Column:
    """File text of a page. Standard keys come first in their fixed order; one final newline."""
    text = F.regexp_replace(F.regexp_replace(body, "\r\n?", "\n"), r"\n*\z", "")
    return F.concat(
        F.lit("---\n"), _write_yaml(frontmatter, sources, extensions), F.lit("---\n"),
        F.when(text != "", F.concat(F.lit("\n"), text, F.lit("\n"))).otherwise(""),
    )


def serialise_documents(documents: DataFrame) -> DataFrame:
    """files(path, content) of documents(path, frontmatter, sources, extensions, body)."""
    text = document_text(F.col("frontmatter"), F.col("sources"), F.col("extensions"), F.col("body"))
    return documents.select("path", text.alias("content"))


def create_documents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) of rows(path, fields, body, sources): fields and sources as JSON.

    Standard fields and extensions are told apart; `sources` among the fields is rejected.
    """
    members = F.try_parse_json("fields").cast("map<string,variant>")
    checked = computed_once(rows, {"_f": members})
    bad = F.coalesce(F.map_contains_key("_f", F.lit("sources")), F.lit(False))
    part = lambda standard: F.to_json(
        F.map_filter("_f", lambda k, v: k.isin(STANDARD_KEYS) if standard else ~k.isin(STANDARD_KEYS))
    )
    documents = checked.where(~bad).select(
        document_id(F.col("path")).alias("id"), "path",
        F.try_variant_get(F.try_parse_json("fields"), "$.type", "string").alias("type"),
        part(True).alias("frontmatter"), part(False).alias("extensions"),
        F.when(F.col("sources").isNull(), "absent").otherwise("canonical").alias("sources_kind"), "sources",
        F.regexp_replace(F.regexp_replace("body", "\r\n?", "\n"), r"\n*\z", "").alias("body"),
    )
    rejected = checked.where(bad).drop("_f").withColumn(
        "error", F.lit("Pass canonical sources in their own column")
    )
    return documents, rejected


def patch_documents(documents: DataFrame, patches: DataFrame) -> DataFrame:
    """Overwrite the fields a patch names and, if given, the body; all other values survive.

    documents(id, frontmatter, body, ...), patches(id, fields MAP<STRING, STRING>, body).
    """
    wanted = patches.select("id", F.col("fields").alias("_f"), F.col("body").alias("_b"))
    patched = documents.join(wanted, "id", "left")
    as_variants = lambda c: F.coalesce(c.cast("map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    old = as_variants(F.try_parse_json("frontmatter"))
    new = F.transform_values("_f", lambda k, v: F.to_variant_object(F.struct(v.alias("v"))))
    new = F.transform_values(new, lambda k, v: F.variant_get(v, "$.v", "variant"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key("_f", k)), new)
    return patched.select(
        *[c for c in documents.columns if c not in ("frontmatter", "body")],
        F.when(F.col("_f").isNotNull(), F.to_json(F.parse_json(F.to_json(merged)))).otherwise(F.col("frontmatter")).alias("frontmatter"),
        F.coalesce("_b", "body").alias("body"),
    )


def corpus_format(corpora: DataFrame) -> DataFrame:
    """state(vault, knowledge_format, blocking, code, message) of corpora(vault, config, root_index).

    config is the config file's text, root_index the root index page's text or NULL.
    """
    config = F.try_parse_json("config")
    is_object = F.coalesce(F.schema_of_variant(config).startswith("OBJECT"), F.lit(False))
    raw = F.try_variant_get(config, "$.knowledge_format", "variant")
    named = F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(config, "$.knowledge_format", "string"))
    state = corpora.withColumns({
        "content": F.coalesce("root_index", F.lit("")),
        "path": F.lit("index.md"),
        "_object": is_object,
        "_missing": raw.isNull(),
        "_format": named,
    })
    parsed = parse_frontmatter(state, require_type=False)
    declared = F.try_variant_get(F.try_parse_json("mapping"), "$.okf_version", "variant")
    version_ok = F.coalesce(F.to_json(declared) == '"0.2"', F.lit(False))
    has_index = F.col("root_index").isNotNull()
    new_format = F.coalesce(F.col("_format") == "okf-0.2", F.lit(False))
    legacy = F.col("_missing") | F.coalesce(F.col("_format") == "legacy", F.lit(False))
    code = (
        F.when(~F.col("_object") | ~(legacy | new_format), "config_invalid_knowledge_format")
        .when(new_format & has_index & ~version_ok, "okf_version_mismatch")
        .when(legacy & has_index & F.col("code").isNull() & declared.isNotNull() & ~version_ok, "okf_version_mismatch")
    )
    return parsed.select(
        "vault",
        F.when(F.col("_object") & new_format, "okf-0.2").otherwise("legacy").alias("knowledge_format"),
        code.isNotNull().alias("blocking"), code.alias("code"),
    )
