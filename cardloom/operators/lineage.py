"""Reliable lineage cuts, and folders that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent a local folder is made and set, but only if driver and executors are one
    process; on a cluster that is an error, as no other machine would see the files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="cardloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder, below one that is removed when the application ends."""
    base = f"{shared_dir(spark)}/cardloom-{spark.sparkContext.applicationId}"
    path, fs = _path(spark, base)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder that is no longer read."""
    path, fs = _path(spark, folder)
    fs.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and read it from there.

    A reliable checkpoint: it survives lost executors.  Spark removes its files when nothing refers to them
    if the application was started with ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of the rounds of a loop, written to the shared folder.

    A checkpoint keeps what Spark has derived of a plan's columns, which grows from round to round where joins rename
    columns; a table that is read again keeps nothing.  :meth:`drop` removes all tables but the given ones.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}

    def written(self, df: DataFrame) -> DataFrame:
        folder = new_folder(self.spark, "round")
        df.write.parquet(folder)
        out = self.spark.read.schema(df.schema).parquet(folder)
        self.folders[id(out)] = (out, folder)
        return out

    def drop(self, *kept: DataFrame) -> None:
        for name, (df, folder) in list(self.folders.items()):
            if not any(df is k for k in kept):
                remove(self.spark, folder)
                del self.folders[name]
