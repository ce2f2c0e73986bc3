"""Every registered query: (spark, sf_dir) -> DataFrame over the whole supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import normalize_text, query_terms, slugify
from ..operators import lint, links, registry
from ..operators import recall as rc
from ..operators import embeddings as emb
from ..operators.sessions import reminder_state as run_reminders
from ..operators import audit, ingest, pages as pageops, repair, trajectories as traj
from ..sources import convert, packets
from ..sources import documents as srcdocs
from ..sources import events as srcevents
from ..operators.chunks import chunk_pages
from ..session import ensure_checkpoint_dir, stored
from ..streaming.maintained import refresh_delta
from . import corpora

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _docs(spark, sf_dir):
    return corpora.docs_linked(spark, sf_dir)


def _resolved(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return links.resolve_links(links.extract_links(docs), docs)


@query
def registry_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpora.docs_corpus(spark, sf_dir)
    docs = docs.withColumn("extensions", F.concat(F.lit('{"owner":"'), "category", F.lit('","size":'), F.length("body").cast("string"), F.lit("}")))
    packets = corpora.table(spark, sf_dir, "pages").select(
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("P"), F.col("page_id").cast("string"))).alias("id"),
        F.concat(F.lit("DIR-"), F.col("page_id").cast("string")).alias("dir"),
        F.when(F.col("page_id") % 3 == 0, F.col("url")).alias("title"),
        F.when(F.col("page_id") % 2 == 0, "2024-05-01").otherwise("").alias("captured"),
    )
    fallback = registry.packet_fallbacks(packets, docs, "sources", "source")
    return registry.full_registry(docs, fallback).select(
        "id", "type", "title", "category", "tags", "created", "updated", "extensions", "origin"
    )


@query
def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = registry.build_registry(corpora.docs_corpus(spark, sf_dir))
    wide = registry.search_registry(built, "SRC1").withColumn("search", F.lit("SRC1"))
    typed = registry.search_registry(built, "er", "EN").withColumn("search", F.lit("er:EN"))
    return wide.unionByName(typed)


@query
def pages_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.pages_by_type(registry.build_registry(corpora.docs_corpus(spark, sf_dir)))


@query
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    resolved = _resolved(spark, sf_dir)
    inbound = links.inbound_counts(docs, links.edges(resolved))
    sizes = links.gap_counts(links.unresolved_links(resolved))
    built = registry.build_registry(corpora.docs_corpus(spark, sf_dir))
    return registry.status(built, inbound, sizes)


@query
def index_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.index_by_type(registry.build_registry(corpora.docs_corpus(spark, sf_dir)))


@query
def index_locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.index_in_locale_order(registry.build_registry(corpora.docs_corpus(spark, sf_dir)))


@query
def directory_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpora.docs_corpus(spark, sf_dir)
    nested = docs.select(
        F.concat("category", F.lit("/lang "), "type", F.lit("/"), F.substring_index("id", "/", -1)).alias("id"),
        F.when(F.length("title") > 20, F.col("title")).alias("title"),
        F.when(F.col("type") == "en", F.concat(F.lit(" a  b\n"), "category")).alias("description"),
    )
    return registry.directory_index(nested, "My [Wiki]")


@query
def identity_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpora.docs_corpus(spark, sf_dir)
    variant = lambda folder, name, key: corpora.table(spark, sf_dir, name).select(
        F.concat(F.lit(folder), F.col(key).cast("string"), F.lit(".md")).alias("path")
    )
    paths = docs.select("path").unionByName(variant("Docs/", "labels", "doc_id")).unionByName(
        variant("DOCS/", "embeddings", "vec_id")
    )
    return registry.identity_collisions(paths)


@query
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.extract_links(_docs(spark, sf_dir)).select("src", "syntax", "target", "kind", "dst")


@query
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.backlinks(_docs(spark, sf_dir), links.edges(_resolved(spark, sf_dir)))


@query
def inbound_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.inbound_counts(_docs(spark, sf_dir), links.edges(_resolved(spark, sf_dir)))


@query
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.unresolved_links(_resolved(spark, sf_dir)).select("src", "syntax", "dst")


@query
def link_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.link_diagnostics(_resolved(spark, sf_dir))


@query
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.gaps(links.unresolved_links(_resolved(spark, sf_dir)))


@query
def gap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.gap_counts(links.unresolved_links(_resolved(spark, sf_dir)))


def _concept_links(spark, sf_dir):
    """Pages that also mention missing concepts by name."""
    number = F.substring_index("id", "/", -1).cast("bigint")
    topic = F.concat(
        F.when(number % 3 == 0, "[[concepts/topic-").when(number % 3 == 1, "[[topic-").otherwise("[[Topic "),
        (number % 40).cast("string"), F.lit("]]"),
    )
    return _docs(spark, sf_dir).withColumn("body", F.concat("body", F.lit(" "), topic))


@query
def stub_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _concept_links(spark, sf_dir)
    resolved = links.resolve_links(links.extract_links(docs), docs)
    return lint.stub_candidates(links.unresolved_links(resolved), docs)


@query
def stub_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _concept_links(spark, sf_dir)
    missing = links.unresolved_links(links.resolve_links(links.extract_links(docs), docs))
    return lint.stub_mentions(lint.stub_candidates(missing, docs), links.gaps(missing))


@query
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.orphans(links.inbound_counts(_docs(spark, sf_dir), links.edges(_resolved(spark, sf_dir))))


def _marked(spark, sf_dir):
    number = F.substring_index("id", "/", -1).cast("bigint")
    mark = F.when(number % 13 == 0, "\n⚠️ **Contradiction**: x").otherwise("")
    return _docs(spark, sf_dir).withColumn("body", F.concat("body", mark))


@query
def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _marked(spark, sf_dir)
    resolved = links.resolve_links(links.extract_links(docs), docs)
    inbound = links.inbound_counts(docs, links.edges(resolved))
    return lint.findings(docs, resolved, inbound).select("kind", "id", "finding")


@query
def lint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _marked(spark, sf_dir)
    resolved = links.resolve_links(links.extract_links(docs), docs)
    inbound = links.inbound_counts(docs, links.edges(resolved))
    return lint.lint_summary(docs, resolved, inbound)


@query
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_pages(corpora.docs_headed(spark, sf_dir))


@query
def normalize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.docs_corpus(spark, sf_dir).select("id", normalize_text(F.col("body")).alias("normalized"))


@query
def query_term_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every page title, in generation order."""
    return corpora.docs_corpus(spark, sf_dir).select(
        "id", F.posexplode(query_terms(F.col("title"))).alias("pos", "term")
    ).select("id", F.col("pos").cast("bigint").alias("pos"), "term")


@query
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of whole page texts, page titles and part names."""
    docs = corpora.docs_corpus(spark, sf_dir)
    names = corpora.table(spark, sf_dir, "part").select(
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("text")
    )
    return (
        docs.select("id", F.col("body").alias("text"))
        .unionByName(docs.select(F.concat(F.lit("title/"), "id").alias("id"), F.col("title").alias("text")))
        .unionByName(names)
        .select("id", slugify(F.col("text")).alias("slug"))
    )


@query
def recall_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best pages per benchmark query by terms alone, before feedback."""
    index = rc.search_index(corpora.docs_headed(spark, sf_dir))
    queries = rc.prepare_queries(corpora.bench_queries(spark, sf_dir))
    ranked = rc.rank_lexical(rc.score_pages(index, queries), 25)
    return ranked.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "id",
        F.round("lexical", 6).alias("score"), F.col("chunk_no").cast("bigint").alias("chunk_no"),
    )


@query
def recall_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query, scored on the JVM: the most frequent language's name and source as query text."""
    asked = corpora.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("source"))
    asked = asked.agg(F.max_by(F.struct("lang", "source"), F.struct("n", "lang")).alias("q")).select("q.*").select(
        F.lit(1).cast("bigint").alias("query_id"), F.concat("lang", F.lit(" "), "source", F.lit(" the tion")).alias("query")
    )
    return _rounded(rc.recall(corpora.docs_headed(spark, sf_dir), asked, 10))


def _rounded(results):
    return results.withColumn("score", F.round("score", 6)).drop("vault")


@query
def recall_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full ranking with relevance feedback and previews."""
    results = rc.recall(corpora.docs_headed(spark, sf_dir), corpora.bench_queries(spark, sf_dir))
    return _rounded(results)


def _query_vectors(spark, sf_dir):
    return corpora.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")
    )


@query
def recall_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = rc.recall(
        corpora.docs_headed(spark, sf_dir), corpora.bench_queries(spark, sf_dir), max_results=8,
        min_score=5.0, vectors=corpora.doc_vectors(spark, sf_dir),
        query_vectors=_query_vectors(spark, sf_dir),
    )
    return _rounded(results).drop("preview", "title")


@query
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of all pages for every vector whose id is divisible by 50."""
    queries = _query_vectors(spark, sf_dir).where(F.col("query_id") % 50 == 0)
    found = rc.semantic_topk(corpora.doc_vectors(spark, sf_dir), queries, 5)
    return found.withColumn("cosine", F.round("cosine", 6)).drop("rank")


@query
def recall_layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = rc.recall(corpora.two_vaults(spark, sf_dir), corpora.bench_queries(spark, sf_dir))
    merged = rc.recall_layered(results)
    return merged.withColumn("score", F.round("score", 6)).drop("preview")


@query
def recall_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill and case pages: over-fetch by four, merge the vaults, then filter by type."""
    results = rc.recall(corpora.two_vaults(spark, sf_dir), corpora.bench_queries(spark, sf_dir), 20)
    kept = rc.only_kinds(rc.recall_layered(results, 20), ["skill", "case"])
    return kept.select("query_id", "rank", "id", "type", "vault", F.round("score", 6).alias("score"))


@query
def recall_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpora.docs_headed(spark, sf_dir)
    results = rc.recall(docs, corpora.bench_queries(spark, sf_dir))
    return rc.render_context(results.withColumn("path", F.concat(F.lit("wiki/"), "id", F.lit(".md"))))


@query
def recall_render_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links-first rendering of merged vaults, with skill and case bodies inlined."""
    pages = corpora.two_vaults(spark, sf_dir)
    results = rc.recall_layered(rc.recall(pages, corpora.bench_queries(spark, sf_dir), 3), 3)
    results = results.withColumn("path", F.concat("vault", F.lit("/"), "id", F.lit(".md")))
    return rc.render_context(results, pages, links_first=True, skill_inline_max=200)


@query
def frontmatter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = srcdocs.discover_documents(corpora.markdown_files(spark, sf_dir))
    return documents.select(
        "id", "type", "title", "tags", "created", "extensions", "sources_kind", "sources",
        F.array_join("legacy_fields", ",").alias("legacy_fields"), "body",
    )


@query
def frontmatter_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, diagnostics = srcdocs.discover_documents(corpora.markdown_files(spark, sf_dir))
    return diagnostics.select("severity", "code", "path")


@query
def diagnostics_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct codes with the number of pages that have each."""
    _, diagnostics = srcdocs.discover_documents(corpora.markdown_files(spark, sf_dir))
    return diagnostics.select("path", "code").distinct().groupBy("code").agg(
        F.count(F.lit(1)).cast("bigint").alias("pages")
    )


@query
def recoverable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes per page over the diagnostics of two scans: with the frontmatter, and of the text alone."""
    _, first = srcdocs.discover_documents(corpora.markdown_files(spark, sf_dir))
    bare = corpora.docs_corpus(spark, sf_dir).select(
        F.concat(F.lit("notes/"), F.substring_index("id", "/", -1), F.lit(".md")).alias("path"), F.col("body").alias("content")
    )
    _, second = srcdocs.discover_documents(bare)
    found = repair.codes_by_path(first.select("path", "code").unionByName(second.select("path", "code")))
    return found.select("path", F.array_join("codes", ",").alias("codes"))


@query
def serialise_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = srcdocs.discover_documents(corpora.markdown_files(spark, sf_dir))
    return srcdocs.serialise_documents(documents)


@query
def patch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set status and updated on every parsed page; other values survive."""
    documents, _ = srcdocs.discover_documents(corpora.markdown_files(spark, sf_dir))
    # Read twice below, parsed once.
    documents = stored(documents.select("id", "type", "frontmatter", "extensions", "body"))
    patches = documents.select(
        "id",
        F.create_map(F.lit("status"), F.lit("ingested"), F.lit("title"), F.upper("type")).alias("fields"),
        F.lit(None).cast("string").alias("body"),
    )
    return srcdocs.patch_documents(documents, patches).select("id", "frontmatter", "extensions")


def _events(spark, sf_dir):
    return srcevents.parse_events(corpora.event_log(spark, sf_dir))


@query
def event_day_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = srcevents.day_log_positions(srcevents.valid_events(_events(spark, sf_dir)))
    return lines.select(F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "position", "line")


@query
def event_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srcevents.event_diagnostics(_events(spark, sf_dir))


@query
def event_activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srcevents.activity_log(corpora.event_log(spark, sf_dir))


@query
def event_digest_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = srcevents.event_digest(srcevents.valid_events(_events(spark, sf_dir)))
    return digest.withColumn("period_start", F.date_format("period_start", "yyyy-MM-dd"))


@query
def event_digest_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = srcevents.event_digest(srcevents.valid_events(_events(spark, sf_dir)), "week")
    return digest.withColumn("period_start", F.date_format("period_start", "yyyy-MM-dd"))


@query
def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event requests at the boundary: accepted or rejected with a reason."""
    requests = corpora.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 9 == 0, "  ").otherwise(F.col("event_type")).alias("kind"),
        F.when(F.col("event_id") % 8 == 0, F.replace("props", F.lit('"k"'), F.lit('"timestamp"')))
        .otherwise(F.col("props")).alias("details"),
    )
    accepted, rejected = srcevents.accept_events(requests)
    return accepted.withColumn("error", F.lit(None).cast("string")).unionByName(rejected)


@query
def reminder_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_reminders(corpora.session_events(spark, sf_dir)).drop("ts")


@query
def embedding_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb.page_texts(corpora.docs_corpus(spark, sf_dir)).select("id", "hash")


def _store(spark, sf_dir, pages):
    return corpora.embedding_store(spark, sf_dir, emb.page_texts(pages).select("id", "hash"))


@query
def embedding_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpora.docs_corpus(spark, sf_dir)
    return emb.stale_texts(emb.page_texts(pages), _store(spark, sf_dir, pages), "mock").select("id", "hash")


@query
def embedding_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpora.docs_corpus(spark, sf_dir)
    return emb.pruned_ids(_store(spark, sf_dir, pages), pages)


@query
def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpora.docs_corpus(spark, sf_dir)
    return emb.refresh_stats(pages, _store(spark, sf_dir, pages), "mock")


@query
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all batches add up to, and how many break a limit (a lone long text may)."""
    batches = emb.embed_batches(emb.page_texts(corpora.docs_corpus(spark, sf_dir)))
    return batches.agg(
        F.sum("texts").cast("bigint").alias("texts"),
        F.sum("chars").cast("bigint").alias("chars"),
        F.count_if(F.col("texts") > emb.BATCH_TEXTS).cast("bigint").alias("over_count"),
        F.count_if((F.col("chars") > emb.BATCH_CHARS) & (F.col("texts") > 1)).cast("bigint").alias("over_chars"),
    )


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in for an embedding model."""
    return [[float(t.count(c)) for c in "aent"] for t in texts]


@query
def embedding_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refreshed store; vectors as rounded text."""
    pages = corpora.docs_corpus(spark, sf_dir)
    store = _store(spark, sf_dir, pages).withColumn(
        "vector", F.coalesce("vector", F.array().cast("array<double>"))
    )
    new = emb.refresh_embeddings(pages, store, letter_counts, "mock", "2024-02-01")
    first = F.coalesce(F.round(F.get("vector", F.lit(0)), 6), F.lit(-9.0))
    return new.select("id", "hash", "model", F.col("dim").cast("bigint").alias("dim"), "updated", first.alias("first"))


@query
def html_noise_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return corpora.html_pages(spark, sf_dir).select(
        "id", convert.html_title(html).alias("title"), convert.strip_noise(html).alias("stripped")
    )


@query
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.html_pages(spark, sf_dir).select("id", convert.html_to_markdown(F.col("html")).alias("markdown"))


@query
def xml_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.html_pages(spark, sf_dir).select("id", convert.xml_to_markdown(F.col("html")).alias("markdown"))


@query
def json_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties, wrapped so that titles, lists and nested maps occur."""
    wrapped = F.concat(
        F.lit('{"name": "'), "event_type", F.lit('", "user_id": '), F.col("user_id").cast("string"),
        F.lit(', "props": '), "props", F.lit(', "tagList": ["a", 2, null], "items": [{"id": "i"}]}'),
    )
    return corpora.table(spark, sf_dir, "events").select("event_id", convert.json_to_markdown(wrapped).alias("markdown"))


@query
def binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of page payloads that got a signature in front, one in 22 none."""
    heads = F.array(*[F.lit(s) for s, _ in convert.SIGNATURES], F.lit(""))
    head = F.unhex(F.get(heads, (F.col("page_id") % (len(convert.SIGNATURES) + 1)).cast("int")))
    return corpora.html_pages(spark, sf_dir).select(
        "id", convert.sniff_binary(F.concat(head, F.col("html").cast("binary"))).alias("format")
    )


@query
def extractor_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.array(*[F.lit(e) for e in (".pdf", ".MD", ".txt", ".htm", ".Xml", ".json", ".docx", ".csv", "")])
    name = F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.get(endings, (F.col("page_id") % 9).cast("int")))
    rows = corpora.html_pages(spark, sf_dir).select("id", "url", name.alias("name"))
    return rows.select(
        "id", "name", convert.file_route(F.col("name"))["format"].alias("format"),
        convert.file_route(F.col("name"))["extractor"].alias("extractor"),
        convert.file_route(F.col("name"))["content_type"].alias("content_type"),
        convert.original_name(F.concat("name", F.lit("?x=1#y.pdf"))).alias("original"),
    )


def _packets(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    # Spark's lpad cuts what is longer.
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    used = corpora.table(spark, sf_dir, "labels").select(F.concat(F.lit("SRC-2024-06-01-"), padded).alias("id"))
    return packets.capture_sources(corpora.raw_sources(spark, sf_dir), used)


@query
def capture_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of captured texts, files and pages (titles of pages come from their HTML)."""
    return _packets(spark, sf_dir).select(
        "capture_order", "id", "title", "format", "extractor", "extraction_status", "content_type", "event"
    )


@query
def packet_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeleton pages and manifests of pasted texts, files and fetched pages."""
    return _packets(spark, sf_dir).select("page_id", "page_body", "manifest")


def _packet_registry(spark, sf_dir):
    """Documents as packets, their pages ingested or not by label."""
    docs = corpora.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("SRC-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("id")
    )
    labels = corpora.table(spark, sf_dir, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality") == 1, "ingested").otherwise("skeleton")
    registry_rows = docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("sources/"), "id").alias("id"), F.lit("source").alias("type"), status.alias("status")
    )
    return docs.select("id"), registry_rows


@query
def pending_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.pending_sources(*_packet_registry(spark, sf_dir))


@query
def pending_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.next_batch(ingest.pending_sources(*_packet_registry(spark, sf_dir)), 9)


@query
def requested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three times the number of every labelled document is asked for; about a third exists."""
    number = (F.col("doc_id") * 3).cast("string")
    asked = corpora.table(spark, sf_dir, "labels").select(F.concat(F.lit("SRC-"), F.lpad(number, 9, "0")).alias("id"))
    have, _ = _packet_registry(spark, sf_dir)
    return ingest.requested(have, asked.unionAll(asked))


def _known_pages(spark, sf_dir):
    """Some entity pages exist already: one per nation number, as brands."""
    return corpora.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("entities/brand"), F.col("n_nationkey").cast("string")).alias("id")
    )


def _commit(spark, sf_dir):
    return ingest.commit_mentions(corpora.synthesis(spark, sf_dir), _known_pages(spark, sf_dir), "2024-07-01")


@query
def commit_new_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commit(spark, sf_dir)[0]


@query
def commit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commit(spark, sf_dir)[1]


@query
def commit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.commit_stats(corpora.synthesis(spark, sf_dir), _commit(spark, sf_dir)[1])


@query
def touched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.touched_pages(_commit(spark, sf_dir)[1])


@query
def commit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source pages after the ingest; pages of suppliers' numbers exist with a title of their own."""
    own = corpora.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("sources/SRC-"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("id"),
        F.col("s_name").alias("title"),
    )
    return ingest.commit_sources(corpora.synthesis(spark, sf_dir), own, "2024-07-01")


def _ensured(spark, sf_dir):
    types = F.array(*[F.lit(t) for t in [*pageops.FOLDERS, "other"]])
    requests = corpora.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("request_id"),
        F.get(types, (F.col("p_partkey") % 8).cast("int")).alias("type"), F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % 16 == 3, F.col("p_brand")).alias("content"),
    )
    return pageops.ensure_pages(requests, _known_pages(spark, sf_dir), "2024-07-01")


@query
def ensure_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ensured(spark, sf_dir)[0]


@query
def ensure_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ensured(spark, sf_dir)[1]


@query
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.array(*[F.lit(r) for r in pageops.RELEVANCE_ICONS])
    rows = corpora.table(spark, sf_dir, "conversations").select(
        F.lit("2024-06-01").alias("day"),
        F.concat(F.lit("2024-06-01T00:00:"), F.lpad(F.col("turn").cast("string"), 6, "0"), F.lit("."), F.lpad(F.col("conv_id").cast("string"), 9, "0")).alias("observed_at"),
        F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(" of "), "role").alias("title"),
        F.col("text").alias("content"), F.get(levels, (F.col("conv_id") % 4).cast("int")).alias("relevance"),
        F.when(F.col("role") == "user", F.concat(F.lit(" a  "), "role")).alias("tags"),
        F.when(F.col("turn") == 0, F.lit("start")).alias("source_context"),
    )
    return pageops.observations_to_documents(rows).withColumn("tags", F.array_join("tags", ","))


@query
def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpora.table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("Bad Slug "), F.col("doc_id").cast("string")))
        .otherwise(F.concat(F.lit("note-"), F.col("doc_id").cast("string"))).alias("slug"),
        F.col("source").alias("title"), F.col("text").alias("body"),
        F.when(F.col("lang") == "en", F.col("lang")).alias("category"),
    )
    good, bad = pageops.insights_to_documents(rows, "2024-07-01")
    return good.select("id", "title", "category", "body", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select(F.col("slug").alias("id"), "title", "category", "body", "error")
    )


def _steps(spark, sf_dir):
    return traj.message_steps(corpora.session_entries(spark, sf_dir))


@query
def trajectory_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select(
        "session_id", "turn", "role", "text", "model",
        F.array_join(F.transform("tool_calls", lambda c: F.concat(c["id"], F.lit(":"), c["name"], F.lit(":"), c["arguments"])), ",").alias("calls"),
    )


@query
def trajectory_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traj.trajectories(_steps(spark, sf_dir), "2024-06-01")


@query
def tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traj.tool_usage(traj.tool_calls(_steps(spark, sf_dir)))


@query
def tool_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traj.tool_sequence(traj.tool_calls(_steps(spark, sf_dir)))


def _undistilled(spark, sf_dir):
    """Trajectories that no skill page cites; every labelled document is a skill page."""
    manifests = traj.trajectories(_steps(spark, sf_dir), "2024-06-01").select("id", "title")
    skills = corpora.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("skills/"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(
            F.lit("Distilled from [[trajectories/TRJ-2024-06-01-"),
            F.lpad(((F.col("doc_id") * 3) % 999).cast("string"), 3, "0"), F.lit("]]"),
        ).alias("body"),
    )
    return traj.undistilled(manifests, links.extract_links(skills))


@query
def undistilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _undistilled(spark, sf_dir)


@query
def undistilled_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.next_batch(_undistilled(spark, sf_dir), 5)


@query
def repair_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpora.markdown_files(spark, sf_dir)
    known = corpora.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("notes/"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("quality") == 1, "entity").otherwise(" ").alias("type"),
        F.when(F.col("toxic") == 1, "Known").alias("title"),
    )
    return repair.repair_documents(files, known).select("path", "code", "status", "before_sha256", "content")


@query
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot of all documents against one where labels changed some and dropped others."""
    docs = corpora.docs_corpus(spark, sf_dir)
    labels = corpora.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "quality", "toxic"
    )
    after = docs.select("path", "body").join(labels, "path", "left").where("coalesce(toxic, 0) = 0").select(
        F.when(F.col("quality") == 0, F.concat(F.lit("new/"), "path")).otherwise(F.col("path")).alias("path"),
        F.sha2(F.when(F.col("quality") == 1, F.concat("body", F.lit("!"))).otherwise(F.col("body")), 256).alias("sha256"),
    )
    return audit.snapshot_diff(docs.select("path", F.sha2("body", 256).alias("sha256")), after)


@query
def ownership_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = F.array(*[F.lit(f) for f in ("raw/", "meta/", "wiki/", "outputs/", "wiki/a/Index.md", "meta/events.jsonl")])
    number = (F.col("doc_id") % 6).cast("int")
    name = F.when(number < 4, F.concat(F.get(folders, number), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(F.get(folders, number))
    rows = corpora.table(spark, sf_dir, "documents").select(name.alias("path"))
    return audit.ownership_audit(rows)


@query
def requirement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requirements: size class as priority, type as status."""
    rows = corpora.table(spark, sf_dir, "part").select(
        F.lit("requirement").alias("type"), F.lower("p_type").alias("status"),
        F.concat(F.lit('{"priority":"p'), (F.col("p_size") % 4).cast("string"), F.lit('"}')).alias("extensions"),
    )
    return pageops.requirement_counts(rows)


@query
def directory_index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index file lines of all folders with their headings."""
    docs = corpora.docs_corpus(spark, sf_dir).select("id", "title")
    return registry.render_directory_index(registry.directory_index(docs, "Corpus"))


@query
def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = registry.build_registry(corpora.docs_corpus(spark, sf_dir))
    return registry.render_index_by_type(built, "2024-07-01")


@query
def lint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _marked(spark, sf_dir)
    resolved = links.resolve_links(links.extract_links(docs), docs)
    inbound = links.inbound_counts(docs, links.edges(resolved))
    report = lint.lint_report(lint.lint_summary(docs, resolved, inbound), lint.findings(docs, resolved, inbound), "2024-07-01")
    return report.select(F.col("part").cast("bigint").alias("part"), "line")


@query
def create_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpora.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(
            F.lit('{"type":"note","own":{"n":'), F.col("doc_id").cast("string"), F.lit('},"title":"'), "source",
            F.when(F.col("lang") == "fr", '","sources":"x"}').otherwise('"}'),
        ).alias("fields"),
        F.concat("text", F.lit("\r\n\n")).alias("body"), F.lit(None).cast("string").alias("sources"),
    )
    good, bad = srcdocs.create_documents(rows)
    return good.select("path", "frontmatter", "extensions", "body", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("path", F.lit(None).cast("string").alias("frontmatter"), F.lit(None).cast("string").alias("extensions"), "body", "error")
    )


@query
def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of page titles as queries; titles that normalise alike are embedded once."""
    asked = corpora.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("source").alias("query")
    )
    found = emb.embed_queries(asked, lambda texts: [[float(len(t)), float(t.count("1")), 1.0] for t in texts])
    return found.select("query_id", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(F.get("vector", F.lit(1)), 6).alias("second"))


def _changes(spark, sf_dir):
    """Two batches of page changes that end with the pages of docs_linked, each as it is there.

    First half of the pages, some with links that go later, and pages that go later; then the
    other half, the final texts of those with such links, the deletions, and broken edits.
    """
    pages = corpora.docs_linked(spark, sf_dir).select(
        F.concat("id", F.lit(".md")).alias("path"), F.concat(F.lit("---\ntype: note\n---\n\n"), "body").alias("content"),
        F.lit(False).alias("deleted"), (F.substring_index("id", "/", -1).cast("bigint") % 20).alias("_draw"),
    )
    early, edited = F.col("_draw") % 2 == 0, F.col("_draw") == 2
    draft = F.when(edited, F.concat("content", F.lit(" [later](/docs/later.md) [[extra/page]]"))).otherwise(F.col("content"))
    extra = pages.where("_draw = 5").withColumn("path", F.concat(F.lit("extra/"), "path"))
    first = pages.where(early).withColumn("content", draft).unionByName(extra)
    broken = pages.where("_draw = 0").withColumn("content", F.lit("no frontmatter"))
    gone = extra.withColumn("content", F.lit(None).cast("string")).withColumn("deleted", F.lit(True))
    second = pages.where(~early | edited).unionByName(broken).unionByName(gone)
    return [rows.drop("_draw").withColumn("mtime", F.lit(epoch)) for epoch, rows in enumerate((first, second))]


def _maintained(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/maintained-{uuid.uuid4().hex}"
    for epoch, rows in enumerate(_changes(spark, sf_dir)):
        state = refresh_delta(rows, epoch, root, buckets=16)
    return state


@query
def embed_batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request every page is embedded with, in one run over all pages by id."""
    texts = emb.page_texts(corpora.docs_corpus(spark, sf_dir))
    return emb.batch_numbers(texts.select("id", F.length("text").alias("chars")))


def _requirements(spark, sf_dir):
    """Parts as requirements in chains of up to seven; every fifth chain closes a cycle, some needs do not exist."""
    k = F.col("p_partkey")
    name = lambda key: F.concat(F.lit("req/"), key.cast("string"))
    needs = F.array(
        F.when(k % 7 != 0, name(k + 1)), F.when(k % 7 == 1, name(k + 5)), F.when(k % 35 == 7, name(k - 6)),
        F.when(k % 11 == 0, F.concat(F.lit("req/none-"), (k % 3).cast("string"))),
    )
    status = F.element_at(F.array(*map(F.lit, [*pageops.REQUIREMENT_STATUS, "done"])), (k % 7 + 1).cast("int"))
    return corpora.table(spark, sf_dir, "part").select(
        name(k).alias("id"), F.array_compact(needs).alias("depends_on"), status.alias("status"),
        F.when(k % 13 != 0, F.concat(F.lit("p"), (k % 5).cast("string"))).alias("priority"),
    )


@query
def requirement_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pageops.requirement_levels(_requirements(spark, sf_dir))


@query
def requirement_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pageops.requirement_faults(_requirements(spark, sf_dir))


@query
def refresh_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to every page after two refreshes with edits, deletions and broken pages."""
    return _maintained(spark, sf_dir).inbound()


@query
def maintained_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbound counts, backlinks, gaps, directory index and status as two refreshes leave them."""
    state = _maintained(spark, sf_dir)
    one, none = F.lit(1).cast("bigint"), F.lit("")
    name = lambda text: F.lit(text).alias("projection")
    parts = [
        state.inbound().select(name("inbound"), F.col("id").alias("key"), none.alias("detail"), "n"),
        state.backlinks().select(name("backlink"), "id", F.coalesce("src", none), one),
        state.gaps().select(name("gap"), "topic", "mentioned_by", one),
        state.gap_counts().select(name("gap size"), "topic", none, "links"),
        state.directory_index().select(name("directory"), F.concat("dir", F.lit(":"), "name"), "line", "section"),
        state.status().select(name("status"), "health", none, "total_pages"),
        state.status().select(name("status"), F.lit("orphans"), none, "orphans"),
        state.status().select(name("status"), F.lit("gaps"), none, "gaps"),
        state.quarantine().select(name("quarantine"), "path", "code", one),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
