"""Page, link, event and session tables derived from the supplied parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import computed_once, small_batches, spread


TEXT_TABLES = {"documents", "pages", "events", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def _text(column: str):
    return F.col(column).cast("string")


def docs_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain pages, one per row of documents."""
    first = F.substring(F.substring_index("text", "\n", 1), 1, 80)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), _text("doc_id")).alias("id"),
        F.concat(F.lit("docs/"), _text("doc_id"), F.lit(".md")).alias("path"),
        F.col("lang").alias("type"),
        first.alias("title"),
        F.col("source").alias("category"),
        F.concat_ws(" ", "source", "lang").alias("tags"),
        F.col("text").alias("body"),
    )


def docs_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with known, unresolved, escaping and external links."""
    docs = table(spark, sf_dir, "documents")
    span = docs.agg(F.floor(F.count(F.lit(1)) * 1.1).cast("bigint")).scalar()
    number = lambda a, b: ((F.col("doc_id") * a + b) % span).cast("string")
    extra = F.when(
        F.col("doc_id") % 10 == 0, " [x](../../out.md) [e](https://example.com/y.md)"
    ).otherwise("")
    body = F.concat(
        "text", F.lit("\n\n[a](/docs/"), number(7, 3), F.lit(".md) [b]("), number(11, 1),
        F.lit(".md#s) [[docs/"), number(13, 5), F.lit("|w]]"), extra,
    )
    rows = docs.select(F.concat(F.lit("docs/"), _text("doc_id")).alias("id"), body.alias("_body"))
    return computed_once(rows, {"body": F.col("_body")}).drop("_body")


def docs_headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose lines starting with T are headings."""
    text = F.concat(F.lit("\n"), F.col("text"))
    body = F.substring(F.replace(text, F.lit("\nT"), F.lit("\n## T")), 2, 2_000_000_000)
    return docs_corpus(spark, sf_dir).withColumn("text", F.col("body")).withColumn("body", body).drop("text")


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages/"), _text("page_id")).alias("id"), "page_id", "url", "html"
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with invalid JSON, timestamps and kinds mixed in."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    event = F.col("event_id")
    line = F.concat(
        F.lit('{"timestamp":"'), F.when(event % 101 == 0, "bad").otherwise(stamp),
        F.lit('","kind":"'), F.when(event % 103 == 0, " ").otherwise(F.col("event_type")),
        F.lit('","user_id":'), _text("user_id"), F.lit(',"props":'), F.col("props"), F.lit("}"),
    )
    return table(spark, sf_dir, "events").select(
        event.alias("seq"), F.when(event % 97 == 0, "not json").otherwise(line).alias("raw")
    )


def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as agent messages; assistant turns carry one tool call."""
    pick = (F.col("conv_id") + F.col("turn")) % 3
    tool = F.when(pick == 0, "read").when(pick == 1, "bash").otherwise("edit")
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("chat/"), _text("conv_id")).alias("session_id"),
        "turn",
        F.when(F.col("role") == "system", "user").otherwise(F.col("role")).alias("role"),
        "text",
        F.when(F.col("role") == "assistant", tool).alias("tool_name"),
    )


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors for the first pages; the other pages have none."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("docs/"), _text("vec_id")).alias("id"),
        F.lit("table").alias("model"),
        F.col("embedding").cast("array<double>").alias("vector"),
        "label",
    )


def bench_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall queries: the text of every benchmark item."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def two_vaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as the project vault, benchmark items as personal pages sharing their ids."""
    number = F.substring_index("id", "/", -1).cast("bigint")
    project = docs_headed(spark, sf_dir).withColumn("vault", F.lit("project"))
    items = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("docs/"), _text("item_id")).alias("id"),
        F.concat(F.lit("docs/"), _text("item_id"), F.lit(".md")).alias("path"),
        F.lit("note").alias("type"), F.lit("Item").alias("title"), F.lit("bench").alias("category"),
        F.lit("bench note").alias("tags"), F.col("text").alias("body"),
        F.lit("personal").alias("vault"),
    )
    return project.unionByName(items).withColumn(
        "type", F.when(number % 4 == 0, "skill").when(number % 4 == 1, "case").otherwise(F.col("type"))
    )


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as markdown files; of every ten, six have a defect of their own kind."""
    number = F.col("doc_id") % 10
    name = F.concat(F.lit("Doc "), _text("doc_id"))
    good = F.concat(
        F.lit("---\ntype: "), F.col("lang"), F.lit("\ntitle: "), name,
        F.lit("\ntags:\n  - "), F.col("source"), F.lit("\n  - yes\nsources:\n  - id: S"), _text("doc_id"),
        F.lit("\nproducer:\n  weights: [1, 2.5, true]\n  when: 2026-08-02\n---\n\n"),
    )
    head = (
        F.when(number == 0, "")
        .when(number == 1, F.lit("---\ntype: note\n"))
        .when(number == 2, F.concat(F.lit("---\ntitle: "), name, F.lit("\n---\n")))
        .when(number == 3, F.lit("---\ntype: a\nx: {y: 1, y: 2}\n---\n"))
        .when(number == 4, F.lit("---\ntype: &t a\nx: *t\n---\n"))
        .when(number == 5, F.lit("---\r\ntype: note\r\ncreated: 2024-05-01\r\nsources:\r\n  - raw one\r\n---\r\n"))
        .when(number == 6, F.lit("---\ntype: !custom a\n---\n"))
        .when(number == 7, F.lit("---\ntype: a\n...\n---\ntype: b\n---\n"))
        .otherwise(good)
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("notes/"), _text("doc_id"), F.lit(".md")).alias("path"),
        F.concat(head, "text").alias("content"),
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as session actions, one session per user."""
    kind = F.col("event_type")
    action = (
        F.when((kind == "error") & (F.col("event_id") % 40 == 0), "session_start")
        .when((kind == "error") & (F.col("event_id") % 7 == 0), "compact")
        .when(kind == "error", "retry")
        .when((kind == "purchase") & (F.col("event_id") % 5 == 0), "observe")
        .otherwise("turn")
    )
    return table(spark, sf_dir, "events").select(
        _text("user_id").alias("session_id"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"), action.alias("action"),
    )


def embedding_store(spark: SparkSession, sf_dir: str, texts: DataFrame) -> DataFrame:
    """A store for every document: some fresh, some with another hash or model, some pages gone."""
    vectors = doc_vectors(spark, sf_dir)
    number = F.substring_index("id", "/", -1).cast("bigint")
    known = texts.join(vectors, "id", "left").select(
        F.when(number % 10 == 9, F.concat(F.lit("old/"), "id")).otherwise(F.col("id")).alias("id"),
        F.when(number % 10 == 1, "0").otherwise(F.col("hash")).alias("hash"),
        F.when(number % 10 == 2, "other").otherwise("mock").alias("model"),
        F.coalesce(F.size("vector"), F.lit(0)).alias("dim"), "vector", F.lit("2024-01-01").alias("updated"),
    )
    return known


def raw_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture requests: fetched pages, pasted texts and event property files."""
    none = F.lit(None).cast("string")
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("url-"), F.lpad(_text("page_id"), 12, "0")).alias("capture_order"),
        F.lit("url").alias("kind"), F.col("url").alias("name"), none.alias("title"), F.col("html").alias("payload"),
    )
    texts = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("text-"), F.lpad(_text("doc_id"), 12, "0")).alias("capture_order"),
        F.lit("text").alias("kind"), none.alias("name"),
        F.when(F.col("lang") == "en", F.concat(F.lit("Doc "), _text("doc_id"))).alias("title"),
        F.col("text").alias("payload"),
    )
    number = F.col("event_id") % 4
    extension = F.when(number == 0, ".json").when(number == 1, ".bin").when(number == 2, ".docx").otherwise(".TXT")
    files = table(spark, sf_dir, "events").select(
        F.concat(F.lit("file-"), F.lpad(_text("event_id"), 12, "0")).alias("capture_order"),
        F.lit("file").alias("kind"), F.concat(F.lit("/data/e"), _text("event_id"), extension).alias("name"),
        none.alias("title"),
        F.when(number == 1, F.concat(F.lit("PK\x03\x04"), F.col("props"))).otherwise(F.col("props")).alias("payload"),
    )
    return pages.unionByName(texts).unionByName(files).withColumn("day", F.lit("2024-06-01"))


def synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthesis rows, one per part: brand and kind as entities, type as concept."""
    part = table(spark, sf_dir, "part")
    number = F.col("p_partkey")
    entity = lambda title, text: F.struct(title.alias("title"), text.alias("description"))
    none = F.array().cast("array<struct<text:string,attribution:string>>")
    return part.select(
        F.concat(F.lit("SRC-"), F.lpad(_text("p_partkey"), 9, "0")).alias("source_id"),
        F.col("p_name").alias("title"), F.lit("web").alias("format"), F.lit("2024-06-01").alias("captured"),
        F.when(number % 2 == 0, F.concat(F.lit("https://example.com/"), _text("p_partkey"))).alias("url"),
        F.when(number % 3 == 0, "de").otherwise("en").alias("lang"),
        F.concat(F.lit(" About "), F.col("p_name"), F.lit(" ")).alias("summary"),
        F.array(F.col("p_name"), F.col("p_type")).alias("key_takeaways"),
        F.array(entity(F.col("p_brand"), F.lit(" ")), entity(F.col("p_name"), F.col("p_type"))).alias("entities"),
        F.array(entity(F.col("p_type"), F.col("p_name"))).alias("concepts"),
        F.when(number % 4 == 0, F.array(F.struct(F.col("p_name").alias("text"), F.col("p_brand").alias("attribution"))))
        .otherwise(none).alias("quotes"),
        F.when(number % 5 == 0, F.array(F.lit("x "), F.lit("y"))).otherwise(F.array().cast("array<string>")).alias("contradictions"),
    )


def session_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as session entries in JSON: users plain, assistants with blocks and a tool call."""
    turns = chat_sessions(spark, sf_dir)
    block = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    none = F.lit(None).cast("string")
    blocks = F.array(
        block(type=F.lit("text"), text=F.col("text"), id=none, name=none),
        block(type=F.lit("toolCall"), text=none, id=F.concat(F.lit("c"), _text("turn")), name=F.col("tool_name")),
    )
    message = lambda content: F.to_json(F.struct(
        F.lit("message").alias("type"),
        F.struct(
            F.col("role"), content.alias("content"),
            F.when(F.col("role") == "assistant", F.concat(F.lit("m"), _text("turn"))).alias("model"),
        ).alias("message"),
    ))
    return turns.select(
        "session_id", "turn",
        F.when(F.col("role") == "assistant", message(blocks)).otherwise(message(F.col("text"))).alias("entry"),
    )
