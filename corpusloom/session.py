"""Session settings and the places where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows here carry whole page bodies: keep Arrow batches small in rows and bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def small_batches(spark: SparkSession) -> None:
    """Apply the settings that bound what a Python worker holds, whatever the size of its task."""
    for key, value in SETTINGS.items():
        if ".arrow.max" in key:
            spark.conf.set(key, value)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings this package is designed for."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back only in local mode."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="corpusloom-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so every reader sees the same rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared checkpoint folder; df is evaluated once.

    A checkpoint evaluates its frame a second time to write it. Rows keep no order.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, most: int = 64) -> DataFrame:
    """Repartition an input that comes in fewer splits than there are cores.

    A file with one row group is one task however many cores wait. Large inputs have more
    splits than cores and pass through without a shuffle.
    """
    target = min(df.sparkSession.sparkContext.defaultParallelism, most)
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    The optimizer otherwise copies an expression into every later use and into filters it
    pushes down, which multiplies costly text work. A generator that yields one row is where
    it stops doing so; nothing is shuffled.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))


# Rows of narrow keys that may be broadcast: a few tens of megabytes at most.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast after counting that df has at most `rows` rows; else leave it to a shuffle.

    For narrow sides joined to page texts: a broadcast keeps the texts from being shuffled.
    Pass a materialised or cheap df, it is read twice.
    """
    most = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
