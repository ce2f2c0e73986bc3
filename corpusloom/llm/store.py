"""Reading the tables and keeping intermediate results where every executor sees them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import ensure_checkpoint_dir

# Texts travel to Python in batches of so many rows; the functions cut them further by bytes.
ROWS_PER_BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings for jobs whose rows carry whole texts.

    Shuffle files of finished executions are dropped, so that the disk holds one step at a time.
    """
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder, read back.

    Cuts the lineage like a checkpoint; unlike one it is compressed, columnar, and has a known
    size, so the planner broadcasts it only if it is small.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
