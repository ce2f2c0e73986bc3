"""Projections kept up to date by signed deltas: a batch writes what it touches, not the corpus.

Every table is cut into buckets by a hash of its key. A batch of changed pages becomes rows
with signs: what the old texts of these pages said counts -1, what the new ones say +1. The
signs are summed and folded into counters (how often a page mentions a target, how many pages
link to one, how many pages lie in a folder), each fold handing the changes of its rows to the
next. Only buckets that hold a changed row are written again; a manifest per version names the
files of every bucket, so readers see a batch whole or not at all.

Keys that a third of the corpus shares do no harm: mentions are cut by target and source
together, and a target is one row of counters. Backlinks and gaps are joins of the two on
reading.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType
from pyspark.sql.utils import AnalysisException

from ..functions.paths import document_id, is_reserved, scan_order
from ..functions.text import nfc
from ..operators import links, registry
from ..session import stored
from ..sources.documents import parse_errors, parse_frontmatter, parsed_documents

# Key columns and counters of the folded tables.
COUNTERS = {
    "mentions": (["dst", "src"], ["n"]),
    "targets": (["id"], ["pages", "sources", "links"]),
    # Pages of a type (a), orphans, gaps, and pages in a folder (a: its parent, b: its name).
    "facts": (["fact", "a", "b"], ["n"]),
}
_IDENTITIES = "identity string, path string"
_WAITING = "path string, identity string, content string, severity string, code string, message string"
_MANIFEST = "name string, bucket bigint, at bigint"
# Manifest rows that are not buckets: the number of buckets, and the last epoch of a source.
_SIZE, _EPOCH = "#buckets", "#epoch "


def _counter_schema(name: str) -> str:
    keys, sums = COUNTERS[name]
    return ", ".join([f"{k} string" for k in keys] + [f"{s} bigint" for s in sums])


def _identity(path):
    return F.lower(nfc(F.regexp_replace(path, r"\.md\z", "")))


@dataclass
class Maintained:
    """The maintained tables under root as of one version.

    buckets is fixed when the first batch is written; a bucket should be a file or two of the
    largest table. `at` says which run wrote the files of a bucket, `epochs` the last batch of
    every source. Runs write to folders of their own, so none overwrites what another reads.
    """

    spark: SparkSession
    root: str
    buckets: int = 64
    version: int = 0
    at: dict[tuple[str, int], int] = field(default_factory=dict)
    epochs: dict[str, int] = field(default_factory=dict)
    written: int = 0
    run: int = field(default_factory=lambda: uuid.uuid4().int >> 66)

    @staticmethod
    def open(spark: SparkSession, root: str, buckets: int = 64) -> Maintained:
        """The newest published version; an empty one before the first."""
        out = Maintained(spark, root, buckets)
        try:
            manifests = spark.read.schema(f"{_MANIFEST}, version bigint").parquet(f"{root}/_manifest")
        except AnalysisException:
            return out
        out.version = manifests.agg(F.max("version")).first()[0] or 0
        # A row per bucket and table, whatever the size of the corpus.
        for row in manifests.where(F.col("version") == out.version).collect():
            if row.name == _SIZE:
                out.buckets = row.bucket
            elif row.name.startswith(_EPOCH):
                out.epochs[row.name[len(_EPOCH) :]] = row.at
            else:
                out.at[row.name, row.bucket] = row["at"]
        return out

    def bucketed(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("bigint"))

    def touched(self, df: DataFrame) -> list[int]:
        """The buckets of some rows, of which there are at most `buckets`."""
        return [r.bucket for r in df.select("bucket").distinct().collect()]

    def read(self, name: str, schema: StructType | str, only: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets, with the column `bucket`."""
        paths = [
            f"{self.root}/{name}/run={at}/bucket={bucket}"
            for (table, bucket), at in sorted(self.at.items()) if table == name and (only is None or bucket in only)
        ]
        empty = self.spark.createDataFrame([], schema)
        schema = StructType(list(empty.schema.fields)).add("bucket", LongType())
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)
        return rows.select(*schema.names)

    def put(self, name: str, rows: DataFrame, only: list[int]) -> None:
        """Write buckets of the next version; buckets without rows are dropped."""
        if not only:
            return
        path = f"{self.root}/{name}/run={self.run}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        left = self.spark.read.schema(rows.schema).parquet(path).select("bucket").distinct()
        present = {r.bucket for r in left.collect()}
        for bucket in only:
            self.at.pop((name, bucket), None)
            if bucket in present:
                self.at[name, bucket] = self.run
        self.written += len(present)

    def fold(self, name: str, deltas: DataFrame) -> DataFrame:
        """Add signed rows to a table of counters; the changed rows with counters `c`, and `old_c` before."""
        keys, sums = COUNTERS[name]
        summed = deltas.groupBy(*keys).agg(*[F.sum(s).cast("bigint").alias(s) for s in sums])
        moved = F.lit(False)
        for s in sums:
            moved = moved | (F.col(s) != 0)
        summed = stored(self.bucketed(summed.where(moved), keys))
        only = self.touched(summed)
        old = self.read(name, _counter_schema(name), only)
        merged = old.unionByName(summed).groupBy("bucket", *keys).agg(*[F.sum(s).cast("bigint").alias(s) for s in sums])
        before = old.drop("bucket").withColumnsRenamed({s: f"old_{s}" for s in sums} | {k: f"_{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        changed = summed.join(before, same, "left")
        was = {s: F.coalesce(f"old_{s}", F.lit(0).cast("bigint")) for s in sums}
        self.put(name, merged.where(moved), only)
        return changed.select(*keys, *[was[s].alias(f"old_{s}") for s in sums], *[(was[s] + F.col(s)).alias(s) for s in sums])

    def replace(self, name: str, old: DataFrame, key: str, gone: DataFrame, new: DataFrame, only: list[int]) -> None:
        """Write the buckets `old` came from without the rows of some keys, and with new rows."""
        stay = old.join(gone.select(key).distinct(), key, "left_anti").select(*new.columns)
        self.put(name, stay.unionByName(new), only)

    def commit(self, source: str, epoch: int) -> int:
        """Make the written buckets the next version; fails if another publisher has taken it meanwhile."""
        self.version += 1
        self.epochs[source] = epoch
        rows = [(name, bucket, at) for (name, bucket), at in self.at.items()]
        rows += [(_SIZE, self.buckets, 0)] + [(_EPOCH + name, 0, at) for name, at in self.epochs.items()]
        target = f"{self.root}/_manifest/version={self.version}"
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("error").parquet(target)
        return self.version

    # What readers ask for.

    def counters(self, name: str) -> DataFrame:
        return self.read(name, _counter_schema(name)).drop("bucket")

    def documents(self) -> DataFrame | None:
        """The pages; None before the first."""
        path = next((f"{self.root}/{n}/run={at}/bucket={b}" for (n, b), at in self.at.items() if n == "documents"), None)
        return None if path is None else self.read("documents", self.spark.read.parquet(path).schema).drop("bucket")

    def inbound(self) -> DataFrame:
        """(id, n) as links.inbound_counts."""
        return self.counters("targets").where("pages > 0").select("id", F.col("sources").alias("n"))

    def backlinks(self) -> DataFrame:
        """(id, src) as links.backlinks."""
        pages = self.counters("targets").where("pages > 0")
        edges = self.counters("mentions").select(F.col("dst").alias("id"), "src")
        return edges.join(pages.where("sources > 0").select("id"), "id").unionByName(
            pages.where("sources = 0").select("id", F.lit(None).cast("string").alias("src"))
        )

    def gaps(self) -> DataFrame:
        """(topic, mentioned_by) as links.gaps."""
        missing = self.counters("targets").where("pages = 0").select(F.col("id").alias("dst"))
        return self.counters("mentions").join(missing, "dst").select(F.col("dst").alias("topic"), F.col("src").alias("mentioned_by"))

    def gap_counts(self) -> DataFrame:
        """(topic, mentions, links) as links.gap_counts."""
        return self.counters("targets").where("pages = 0").select(F.col("id").alias("topic"), F.col("sources").alias("mentions"), "links")

    def directory_index(self, root_title: str = "Wiki") -> DataFrame:
        """Lines of every folder's index, as registry.directory_index."""
        pages = self.documents()
        if pages is None:
            pages = self.spark.createDataFrame([], "id string, title string, description string")
        folders = self.counters("facts").where("fact = 'folder'").select(F.col("a").alias("dir"), F.col("b").alias("name"))
        return registry.directory_index(pages.select("id", "title", "description"), root_title, folders)

    def status(self) -> DataFrame:
        """One row as registry.status, from a few counters."""
        facts = self.counters("facts")
        of = lambda fact: F.coalesce(F.sum(F.when(F.col("fact") == fact, F.col("n"))), F.lit(0)).cast("bigint")
        return facts.agg(
            of("page").alias("total_pages"), F.count_if(F.col("fact") == "page").cast("bigint").alias("types"),
            of("orphan").alias("orphans"), of("gap").alias("gaps"),
        ).withColumn("health", registry.health(F.col("total_pages"), F.col("orphans")))

    def quarantine(self) -> DataFrame:
        """(severity, code, path, message) of the pages that are left out."""
        return self.read("waiting", _WAITING).select("severity", "code", "path", "message")

    def superseded(self) -> DataFrame:
        """(name, bucket, at) of bucket files that no longer belong to the newest version."""
        manifests = self.spark.read.schema(f"{_MANIFEST}, version bigint").parquet(f"{self.root}/_manifest")
        held = manifests.where(~F.col("name").startswith("#"))
        now = held.where(F.col("version") == self.version).select("name", "bucket", "at")
        return held.select("name", "bucket", "at").distinct().join(now, ["name", "bucket", "at"], "left_anti")


def _mentions(signed: DataFrame) -> DataFrame:
    """(dst, src, n): links to pages, existing or not, of documents with a sign."""
    found = links.extract_links(signed, ("sign",)).where((F.col("kind") == "concept") & F.col("dst").isNotNull())
    return found.select("dst", "src", F.col("sign").alias("n"))


def _clashes(mine: DataFrame, alive: DataFrame) -> DataFrame:
    """Pages of a batch whose identity another page has: one that is published, or an earlier one of the batch."""
    ranked = alive.select("identity", "path", F.lit(0).alias("rank")).unionByName(mine.select("identity", "path", F.lit(1).alias("rank")))
    owner = F.min(F.struct("rank", scan_order(F.col("path")).alias("order"), F.col("path").alias("first_path")))
    owners = ranked.groupBy("identity").agg(owner.alias("o")).select("identity", "o.first_path")
    message = F.concat(F.lit("Identity collision between "), "first_path", F.lit(" and "), "path")
    return mine.join(owners, "identity").where(F.col("path") != F.col("first_path")).select(
        "path", "identity", "content", F.lit("error").alias("severity"), F.lit("concept_identity_collision").alias("code"), message.alias("message")
    )


def refresh_delta(
    batch: DataFrame, epoch: int, root: str, source: str = "refresh", buckets: int = 64
) -> Maintained | None:
    """One pass over batch(path, content, deleted, mtime); the new state, or None for a batch that was done before.

    The newest row per path counts. A page that does not parse, or whose identity another page
    has, waits in quarantine, its earlier text stays; one that waited because of a clash is tried
    again when a batch deletes the page it clashed with. Epochs of one source only grow. Reads
    and writes the buckets of the batch's pages, of their old and new link targets, folders and
    types, and nothing else.
    """
    spark = batch.sparkSession
    state = Maintained.open(spark, root, buckets)
    if state.epochs.get(source, -1) >= epoch:
        return None
    last = batch.groupBy("path").agg(F.max_by(F.struct("content", "deleted"), "mtime").alias("r")).select("path", "r.*")
    last = stored(state.bucketed(last.withColumn("identity", _identity(F.col("path"))), ["identity"]))
    mine = state.touched(last)
    known = state.read("identities", _IDENTITIES, mine)
    waiting = state.read("waiting", _WAITING, mine)
    if any(("waiting", bucket) in state.at for bucket in mine):
        # Pages that clashed with one that goes now.
        freed = known.join(last.where("deleted").select("path"), "path", "left_semi").select("identity").distinct()
        again = waiting.where("code = 'concept_identity_collision'").join(freed, "identity", "left_semi")
        again = again.join(last.select("path"), "path", "left_anti")
        last = stored(last.unionByName(again.select("path", "content", F.lit(False).alias("deleted"), "identity", "bucket")))
    alive = known.join(last.where("deleted").select("path"), "path", "left_anti")
    wanted = last.where(~F.col("deleted") & ~is_reserved(F.col("path")))
    clash = stored(_clashes(wanted, alive))
    read = stored(parse_frontmatter(wanted.join(clash.select("path"), "path", "left_anti").select("path", "content")))
    parsed = state.bucketed(parsed_documents(read), ["id"])
    errors = parse_errors(read).join(last.select("path", "identity", "content"), "path")
    left_out = clash.unionByName(errors.select(clash.columns))
    state.replace("waiting", waiting, "path", last, state.bucketed(left_out, ["identity"]), mine)

    gone = stored(last.where("deleted").select("path").unionByName(parsed.select("path")))
    fresh = parsed.select("path", _identity(F.col("path")).alias("identity"))
    state.replace("identities", known, "path", gone, state.bucketed(fresh.select("identity", "path"), ["identity"]), mine)

    only = state.touched(state.bucketed(gone.select(document_id(F.col("path")).alias("id")), ["id"]))
    published = state.read("documents", parsed.drop("bucket").schema, only)
    old = published.join(gone, "path", "left_semi").select(*parsed.columns)
    signed = stored(old.withColumn("sign", F.lit(-1)).unionByName(parsed.withColumn("sign", F.lit(1))))
    state.replace("documents", published, "path", gone, parsed, only)

    mentions = state.fold("mentions", _mentions(signed))
    linked = mentions.select(
        F.col("dst").alias("id"), F.lit(0).alias("pages"),
        ((F.col("n") > 0).cast("int") - (F.col("old_n") > 0).cast("int")).alias("sources"), (F.col("n") - F.col("old_n")).alias("links"),
    )
    pages = signed.select("id", F.col("sign").alias("pages"), F.lit(0).alias("sources"), F.lit(0).alias("links"))
    targets = state.fold("targets", linked.unionByName(pages))
    none = F.lit(None).cast("string")
    facts = signed.select(F.lit("page").alias("fact"), F.col("type").alias("a"), none.alias("b"), F.col("sign").alias("n"))
    steps = registry.folder_steps(signed, ("sign",))
    facts = facts.unionByName(steps.select(F.lit("folder").alias("fact"), F.col("dir").alias("a"), F.col("name").alias("b"), F.col("sign").alias("n")))
    for fact, is_so in (
        ("orphan", lambda p: (F.col(f"{p}pages") > 0) & (F.col(f"{p}sources") == 0)),
        ("gap", lambda p: (F.col(f"{p}pages") == 0) & (F.col(f"{p}links") > 0)),
    ):
        step = is_so("").cast("int") - is_so("old_").cast("int")
        facts = facts.unionByName(targets.select(F.lit(fact).alias("fact"), none.alias("a"), none.alias("b"), step.alias("n")))
    state.fold("facts", facts)
    state.commit(source, epoch)
    return state


def maintain_stream(changes: DataFrame, root: str, checkpoint: str, source: str = "refresh", buckets: int = 64) -> StreamingQuery:
    """Run refresh_delta per micro-batch of changes(path, content, deleted, mtime), then stop."""

    def fold_batch(df: DataFrame, epoch: int) -> None:
        refresh_delta(df, epoch, root, source, buckets)

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold_batch).trigger(availableNow=True).start()
