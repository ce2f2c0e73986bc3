"""Path ownership and snapshot comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Why a path may not be written.
RAW = "Raw sources are immutable. Use wiki_capture_source to add sources."
EVENTS = (
    "Event history is append-only authoritative state. Use wiki_log_event or an owning wiki operation instead."
)
META = "Metadata is auto-generated. Use wiki_rebuild_meta or wiki_log_event instead."
INDEX = "Generated index or log page."


def ownership_audit(changes: DataFrame, generated_indexes: bool = True) -> DataFrame:
    """changes(path) relative to the corpus root -> path, protected, reason."""
    path = F.col("path")
    inside = lambda folder: (path == folder) | path.startswith(folder + "/")
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    reason = (
        F.when(inside("raw"), RAW)
        .when(path == "meta/events.jsonl", EVENTS)
        .when(inside("meta"), META)
    )
    if generated_indexes:
        index = path.startswith("wiki/") & ((name == "index.md") | (F.lower(path) == "wiki/log.md"))
        reason = reason.when(index, INDEX)
    return changes.select("path", reason.isNotNull().alias("protected"), reason.alias("reason"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """before/after(path, sha256) -> path, change: added, missing, changed or same."""
    old = before.select("path", F.col("sha256").alias("_old"))
    new = after.select("path", F.col("sha256").alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "missing")
        .when(F.col("_old") != F.col("_new"), "changed").otherwise("same")
    )
    return old.join(new, "path", "full").select("path", change.alias("change"))


def obsolete_outputs(existing: DataFrame, current: DataFrame) -> DataFrame:
    """Generated index paths that are no longer produced; the root index always stays."""
    return existing.where(F.col("path") != "index.md").join(current.select("path"), "path", "left_anti")
