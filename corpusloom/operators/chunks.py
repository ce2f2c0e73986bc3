"""Pages split into heading sections, row by row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import SPACE, left_units, one_line, trim_space

_BLANK = SPACE.replace(r"\n", "")
# A heading line: up to six '#', white space, text. Fences are not special.
_HEADING = rf"[{_BLANK}]*(#{{1,6}})[{_BLANK}]+([^{SPACE}][^\n]*)"
_BEFORE_HEADING = rf"(?dm)(?=^{_HEADING}$)"
_HEADING_LINE = rf"^{_HEADING}(?:\n|\z)"


def chunk_array(body: Column) -> Column:
    """Array of struct(level, heading, content); empty for a blank body."""
    parts = F.split(body, _BEFORE_HEADING)

    def section(part: Column) -> Column:
        marks = F.regexp_extract(part, _HEADING_LINE, 1)
        heading = trim_space(F.regexp_extract(part, _HEADING_LINE, 2))
        content = trim_space(F.regexp_replace(part, _HEADING_LINE, ""))
        return F.struct(
            F.length(marks).alias("level"), heading.alias("heading"), content.alias("content")
        )

    none = F.array().cast("array<struct<level:int,heading:string,content:string>>")
    return F.when(trim_space(body) != "", F.transform(parts, section)).otherwise(none)


def chunk_pages(docs: DataFrame) -> DataFrame:
    """chunks(id, chunk_no, level, heading, content)."""
    return docs.select(
        "id", F.posexplode(chunk_array(F.col("body"))).alias("chunk_no", "chunk")
    ).select("id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk.*")


def chunk_preview(heading: Column, content: Column) -> Column:
    text = one_line(left_units(content, 180))
    return F.when(heading != "", F.concat(F.lit("#"), heading, F.lit(" — "), text)).otherwise(text)


def page_preview(body: Column) -> Column:
    return one_line(left_units(trim_space(body), 200))
