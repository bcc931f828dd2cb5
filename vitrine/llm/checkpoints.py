"""Cutting lineage with files that every executor can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.session import shared_folder

__all__ = ["removed", "saved", "shared_folder"]


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there.

    Spark deletes the files of what is no longer referred to where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that was written in the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
