"""Cutting lineage where a plan would otherwise be computed again or grow without end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure checkpoints have a folder that every executor shares.

    The folder named by ``spark.checkpoint.dir`` is used. Only a local master may fall back to a
    temporary folder, since nothing else would see it on a cluster.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="quillgraph-checkpoint-")
    context.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there.

    The files outlive executors, so a lost executor costs a re-read and not a re-run.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """As ``cut``, but as compressed columns: readers take those they need, and plans know the table's size."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written to a folder of their own under the shared checkpoint folder, gone at the end.

    Written tables are compressed columns, so they take a fraction of what a checkpoint takes, and
    any executor can read them again. Results that outlive the ``with`` block must be ``cut`` in it.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.tables = spark, 0
        self.path = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and continue from the table."""
        self.tables += 1
        path = f"{self.path}/{self.tables}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failed) -> None:
        remove(self.spark, self.path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at ``path``, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is; a missing one is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
