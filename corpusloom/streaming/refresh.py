"""Refresh on a stream: a micro-batch of changed pages leads to a new version of all tables.

Only the pages of the batch are parsed. Registry, links, indexes, findings and status follow
from the merged documents in one pass, as in a full rebuild, so no projection goes stale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import document_id
from ..operators.embeddings import EmbedFn, refresh_embeddings
from ..operators.registry import identity_collisions
from ..plans.rebuild import latest_version, project, publish, read_current, was_published
from ..session import materialise
from ..sources.documents import discover_documents

_STORE = "id string, hash string, model string, dim int, vector array<double>, updated string"


def _without(table: DataFrame | None, keys: DataFrame, rows: DataFrame) -> DataFrame:
    """table with the rows of some keys replaced; keys has one column."""
    if table is None:
        return rows
    return table.join(keys.distinct(), keys.columns[0], "left_anti").select(rows.columns).unionByName(rows)


def refresh_batch(
    batch: DataFrame, epoch: int, root: str, embed: EmbedFn | None = None, model: str = "", source: str = "refresh"
) -> int | None:
    """One coalesced pass over batch(path, content, deleted, mtime); the version it published.

    The newest row per path counts. A page that does not parse, or that is new and has the
    identity of another page, goes to the table `quarantine` and to the diagnostics; its earlier
    text, if any, stays published, and all other pages of the batch go on. The version follows
    the highest published one; source and epoch are recorded with it, so that a batch that is
    repeated is recognised and returns None.
    """
    spark = batch.sparkSession
    if was_published(spark, root, source, epoch):
        return None
    last = batch.groupBy("path").agg(F.max_by(F.struct("content", "deleted"), "mtime").alias("r")).select("path", "r.*")
    last = materialise(last)
    parsed, errors = discover_documents(last.where("not deleted").select("path", "content"))
    parsed, errors = materialise(parsed), materialise(errors)
    deleted = last.where("deleted").select("path")
    before = read_current(spark, root, "documents")
    if before is not None:
        stay = before.select("path").join(last.select("path"), "path", "left_anti")
        # Pages of the corpus come first: of two paths with one identity the new one is left out.
        known = before.select("path").join(parsed.select("path"), "path", "left_semi")
        new = parsed.select("path").join(known, "path", "left_anti")
        found = identity_collisions(stay.unionByName(known).unionByName(new))
        found = materialise(found.withColumn("other", F.regexp_extract("message", r" between (.*) and ", 1)))
        late = found.join(new, "path", "left_semi")
        early = found.drop("path").join(new.withColumnRenamed("path", "other"), "other", "left_semi").withColumn("path", F.col("other"))
        clash = late.unionByName(early).select(errors.columns).dropDuplicates(["path"])
        errors = materialise(errors.unionByName(clash))
        parsed = materialise(parsed.join(errors.select("path"), "path", "left_anti"))
    documents = materialise(_without(before, parsed.select("path").unionByName(deleted), parsed))
    quarantine = materialise(_without(read_current(spark, root, "quarantine"), last.select("path"), errors))
    result = project(documents, quarantine)
    if embed is not None:
        number = latest_version(spark, root) + 1
        store = read_current(spark, root, "embeddings")
        store = spark.createDataFrame([], _STORE) if store is None else store
        touched = parsed.select("id").unionByName(deleted.select(document_id(F.col("path")).alias("id")))
        mine = materialise(store.join(parsed.select("id"), "id", "left_semi"))
        fresh = refresh_embeddings(parsed, mine, embed, model, str(number))
        result.frames["embeddings"] = _without(store, touched, fresh)
    return publish(result, root, source=source, epoch=epoch)


def refresh_stream(
    changes: DataFrame, root: str, checkpoint: str, embed: EmbedFn | None = None, model: str = "", source: str = "refresh"
) -> StreamingQuery:
    """Run refresh_batch per micro-batch of changes(path, content, deleted, mtime), then stop.

    All writes waiting at a trigger are one pass; writes during it make the next batch. Streams
    with checkpoints of their own need a source name of their own.
    """
    return (
        changes.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, epoch: refresh_batch(df, epoch, root, embed, model, source))
        .trigger(availableNow=True).start()
    )
