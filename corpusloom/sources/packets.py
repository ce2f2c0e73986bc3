"""Source packets: capture of texts, files and fetched pages, ids, manifests, skeleton pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import collapse_space, left_units
from ..operators.skew import with_positions
from . import convert


def daily_ids(
    rows: DataFrame, prefix: str, existing: DataFrame | None = None, name: str = "id", narrow: bool = False
) -> DataFrame:
    """Add ids PREFIX-day-NNN in capture order, going on from the day's highest existing number.

    rows(day, capture_order, ...). All rows may fall on one day: numbering is spread over
    slices, see operators.skew.with_positions.
    """
    numbered = with_positions(rows, ["day"], ["capture_order"], "_n", narrow=narrow)
    if existing is not None:
        used = existing.select(
            F.regexp_extract("id", rf"^{prefix}-(\d{{4}}-\d{{2}}-\d{{2}})-(\d+)$", 1).alias("day"),
            F.regexp_extract("id", rf"^{prefix}-(\d{{4}}-\d{{2}}-\d{{2}})-(\d+)$", 2).cast("bigint").alias("_last"),
        ).where("day <> ''").groupBy("day").agg(F.max("_last").alias("_last"))
        # One row per day of history: a few thousand rows however many packets there are.
        numbered = numbered.join(F.broadcast(used), "day", "left")
    else:
        numbered = numbered.withColumn("_last", F.lit(None).cast("bigint"))
    number = F.col("_n") + F.coalesce("_last", F.lit(0))
    digits = number.cast("string")
    padded = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    return numbered.withColumn(name, F.concat(F.lit(f"{prefix}-"), "day", F.lit("-"), padded)).drop("_n", "_last")


def extract_sources(raw: DataFrame, extractors: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Add format, title, extracted, extractor, extraction_status, content_type.

    raw(kind, name, title, payload): kind is text, file or url; name the path or URL; payload
    the text (or bytes as BINARY in `bytes`). `extractors` maps a file format to a column
    function and replaces or adds to the built-in conversions.
    """
    own = extractors or {}
    payload = F.coalesce("payload", F.lit(""))
    sniffed = F.when(F.col("_r.format") == "file", convert.sniff_binary(F.coalesce(F.col("bytes"), payload.cast("binary"))))
    if "bytes" not in raw.columns:
        raw = raw.withColumn("bytes", F.lit(None).cast("binary"))
    is_file, is_url = F.col("kind") == "file", F.col("kind") == "url"
    rows = raw.withColumn("_r", convert.file_route(F.coalesce("name", F.lit("")))).withColumn("_bin", F.when(is_file, sniffed))
    fetched = is_url & (payload != "") & ~convert.is_pdf_url(F.col("name")) & ~convert.looks_like_pdf(payload)
    rows = rows.withColumn("_html", convert.html_to_markdown(F.when(fetched, payload)))
    rows = rows.withColumn("_json", convert.json_to_markdown(F.when(is_file & (F.col("_r.format") == "json"), payload)))
    by_format = (
        F.when(F.col("_bin").isNotNull(), convert.binary_failure(F.col("_bin")))
    )
    for format_, extract in own.items():
        by_format = by_format.when(F.col("_r.format") == format_, extract(payload))
    by_format = (
        by_format.when(F.col("_r.format") == "pdf", convert.pdf_failure(F.col("name")))
        .when(F.col("_r.format") == "docx", convert.docx_failure(F.col("name")))
        .when(F.col("_r.format") == "json", F.col("_json"))
        .when(F.col("_r.format") == "xml", convert.xml_to_markdown(payload))
        .otherwise(payload)
    )
    pdf_url = is_url & (convert.is_pdf_url(F.col("name")) | convert.looks_like_pdf(payload))
    extracted = (
        F.when(pdf_url, convert.pdf_failure(F.col("name")))
        .when(fetched, F.col("_html"))
        .when(is_url, convert.content_failure(F.col("name")))
        .when(is_file, by_format)
        .otherwise(payload)
    )
    out = rows.withColumn("extracted", extracted)
    status = (
        F.when(F.col("_bin").isNotNull(), "unsupported")
        .when(is_url & ~fetched, "failed")
        .when(is_file, convert.extraction_status(F.col("extracted")))
        .otherwise("success")
    )
    extractor = (
        F.when(F.col("_bin").isNotNull(), "magicBytes")
        .when(is_url & convert.is_pdf_url(F.col("name")), "markitdown")
        .when(pdf_url, "curl")
        .when(fetched, "htmlToMarkdown")
        .when(is_url, "none")
        .when(is_file, F.col("_r.extractor"))
        .otherwise("passthrough")
    )
    content_type = F.when(pdf_url, "application/pdf").when(is_file & F.col("_bin").isNull(), F.col("_r.content_type"))
    found = F.coalesce(convert.markdown_title(F.col("extracted")), F.nullif(convert.html_title(payload), F.lit("")))
    file_name = F.nullif(F.element_at(F.split("name", "/"), -1), F.lit(""))
    title = (
        F.when(is_url, F.coalesce(F.when(fetched, found), F.col("name")))
        .when(is_file, F.coalesce(file_name, F.lit("unknown")))
        .otherwise(F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Pasted text — "), F.col("day"))))
    )
    return out.select(
        *[c for c in raw.columns if c not in ("title", "bytes")],
        title.alias("title"),
        F.when(is_url, "web").when(is_file, F.col("_r.format")).otherwise("text").alias("format"),
        "extracted", extractor.alias("extractor"), status.alias("extraction_status"),
        content_type.alias("content_type"),
    )


def manifest_json(packets: DataFrame) -> Column:
    """Manifest of a packet; absent members are left out."""
    return F.to_json(F.struct(
        "id", F.col("day").alias("captured"), F.lit("1.0").alias("packet_version"), "title",
        F.when(F.col("kind") == "url", F.col("name")).alias("url"),
        F.when(F.col("kind") == "file", F.col("name")).alias("file_path"),
        "format", "extractor", "extraction_status", "content_type",
    ))


def skeleton_body(packets: DataFrame) -> Column:
    """Body of the page a new packet gets until it is ingested."""
    preview = left_units(collapse_space(F.regexp_replace("extracted", "[#*_`]", "")), 500)
    origin = F.when(
        F.col("kind") == "url", F.concat(F.lit("\n> _Original: ["), "name", F.lit("]("), "name", F.lit(")_"))
    ).otherwise("")
    return F.concat(
        F.lit("# "), "title", origin,
        F.lit("\n\n## Summary\n\n[LLM: Replace with 2-3 paragraph summary of key content]\n\n> _Auto-preview: "),
        preview, F.when(F.length("extracted") > 500, "...").otherwise(""),
        F.lit(
            "_\n\n## Key Takeaways\n\n- [LLM: Most important point]\n- [LLM: Second important point]\n"
            "- [LLM: Third important point]\n\n## Entities Mentioned\n\n- [LLM: Add linked entities after review]\n\n"
            "## Concepts Mentioned\n\n- [LLM: Add linked concepts after review]\n\n## Notable Quotes\n\n"
            "> [LLM: Important quote] — attribution\n\n## Source Packet\n\n- **ID:** `sources/"
        ),
        "id", F.lit("`\n- **Extracted:** `raw/sources/"), "id",
        F.lit("/extracted.md`\n- **Manifest:** `raw/sources/"), "id", F.lit("/manifest.json`\n"),
    )


def capture_sources(
    raw: DataFrame, existing: DataFrame | None = None,
    extractors: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """packets of raw(day, capture_order, kind, name, title, payload).

    Adds id, extraction results, manifest (JSON), the skeleton page (page_id, page_body) and
    the capture event (JSON). The event never names a local file path.
    """
    packets = daily_ids(extract_sources(raw, extractors), "SRC", existing)
    event = F.to_json(F.struct(
        F.col("id").alias("source_id"),
        F.when(F.col("kind") == "url", F.col("name")).alias("url"), "format",
    ))
    return packets.withColumns({
        "manifest": manifest_json(packets),
        "page_id": F.concat(F.lit("sources/"), "id"),
        "page_body": skeleton_body(packets),
        "event": event,
    })


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """packets(dir, id, title, captured, type, ...) of <root>/<dir>/manifest.json files."""
    schema = (
        "id string, title string, captured string, type string, format string, status string, url string, "
        "file_path string, extractor string, extraction_status string, content_type string, "
        "model string, outcome string, step_count bigint, tool_call_count bigint"
    )
    return (
        spark.read.schema(schema).option("multiLine", "true").json(f"{root.rstrip('/')}/*/manifest.json")
        .withColumn("dir", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    )
