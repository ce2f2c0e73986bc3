"""The projection rebuild as one plan, and publishing it as a consistent version."""

from __future__ import annotations

from dataclasses import dataclass, field
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import links, lint, registry
from ..session import materialise
from ..sources import documents as docs_source
from ..sources import events as event_source


@dataclass
class Projections:
    """Result of a rebuild; without `ok` there are diagnostics only."""

    ok: bool
    diagnostics: DataFrame
    frames: dict[str, DataFrame] = field(default_factory=dict)


def rebuild(
    files: DataFrame, packets: dict[str, DataFrame] | None = None,
    raw_events: DataFrame | None = None, event_diagnostics: DataFrame | None = None,
    root_title: str = "Wiki", on_error: str = "fail_closed",
) -> Projections:
    """All derived tables of files(path, content).

    packets maps a folder ('sources', 'trajectories') to its manifests. Without raw_events the
    log tables are left out, so published ones stay. on_error = 'quarantine' goes on with the
    pages that parse.
    """
    documents, diagnostics = docs_source.discover_documents(files)
    documents, diagnostics = materialise(documents), materialise(diagnostics)
    blocking = not diagnostics.where("severity = 'error'").isEmpty()
    if blocking and on_error == "fail_closed":
        return Projections(False, diagnostics)
    return project(documents, diagnostics, packets, raw_events, event_diagnostics, root_title)


def project(
    documents: DataFrame, quarantine: DataFrame, packets: dict[str, DataFrame] | None = None,
    raw_events: DataFrame | None = None, event_diagnostics: DataFrame | None = None, root_title: str = "Wiki",
) -> Projections:
    """All tables that follow from parsed documents; quarantine holds the diagnostics of pages left out."""
    fallbacks = [
        registry.packet_fallbacks(rows, documents, folder, "source" if folder == "sources" else "trajectory")
        for folder, rows in (packets or {}).items()
    ]
    table = registry.full_registry(documents, *fallbacks)
    resolved = links.resolve_links(links.extract_links(documents), documents)
    edge_rows = links.edges(resolved)
    unresolved = links.unresolved_links(resolved)
    inbound = links.inbound_counts(documents, edge_rows)
    frames = {
        "documents": documents,
        "registry": table,
        "links": resolved,
        "backlinks": links.backlinks(documents, edge_rows),
        "inbound": inbound,
        "gaps": links.gaps(unresolved),
        "findings": lint.findings(documents, resolved, inbound),
        "index_by_type": registry.index_by_type(table),
        "directory_index": registry.directory_index(documents, root_title),
        "status": registry.status(table, inbound, links.gap_counts(unresolved)),
        "quarantine": quarantine,
    }
    diagnostics = quarantine.unionByName(links.link_diagnostics(resolved))
    if raw_events is not None:
        parsed = materialise(event_source.parse_events(raw_events))
        frames["day_log"] = event_source.day_log(event_source.valid_events(parsed))
        frames["activity_log"] = event_source.activity_log(raw_events)
        diagnostics = diagnostics.unionByName(event_source.event_diagnostics(parsed))
    if event_diagnostics is not None:
        diagnostics = diagnostics.unionByName(event_diagnostics)
    frames["diagnostics"] = diagnostics
    return Projections(True, diagnostics, frames)


_MARKS = "name string, version bigint, source string, epoch bigint"


def _marks(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(_MARKS).parquet(f"{root}/_published")
    except AnalysisException:
        return spark.createDataFrame([], _MARKS)


def latest_version(spark: SparkSession, root: str) -> int:
    """The highest published version, 0 before the first."""
    return _marks(spark, root).agg(F.max("version")).first()[0] or 0


def was_published(spark: SparkSession, root: str, source: str, epoch: int) -> bool:
    """Whether a source (a stream's name) has published this epoch."""
    return not _marks(spark, root).where((F.col("source") == source) & (F.col("epoch") == epoch)).isEmpty()


def publish(
    projections: Projections, root: str, version: int | None = None, source: str | None = None, epoch: int | None = None
) -> int | None:
    """Write every frame as root/<name>/v<version>, then make the version current; returns it.

    Versions only grow: without one, the next is taken, and one that is not above the highest
    published is refused. Readers follow the marker rows, which are appended last, so a job
    that dies half way changes nothing for them. Nothing is written for a blocked rebuild.
    """
    if not projections.ok:
        return None
    spark = projections.diagnostics.sparkSession
    last = latest_version(spark, root)
    number = last + 1 if version is None else version
    if number <= last:
        raise ValueError(f"version {number} is not above the published {last}")
    for name, frame in projections.frames.items():
        frame.write.mode("overwrite").parquet(f"{root}/{name}/v{number}")
    rows = spark.createDataFrame([(name, number, source, epoch) for name in projections.frames], _MARKS)
    rows.coalesce(1).write.mode("append").parquet(f"{root}/_published")
    return number


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The table as last published; None before its first version."""
    version = _marks(spark, root).where(F.col("name") == name).agg(F.max("version")).first()[0]
    return None if version is None else spark.read.parquet(f"{root}/{name}/v{version}")


def obsolete_versions(spark: SparkSession, root: str, keep: int = 2) -> DataFrame:
    """Versions (name, version) of tables that newer ones have replaced."""
    newest = Window.partitionBy("name").orderBy(F.desc("version"))
    marks = _marks(spark, root).select("name", "version").distinct()
    return marks.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") > keep).select("name", "version")
