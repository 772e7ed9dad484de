"""Tables that a step leaves for later ones, in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path there; only a local session without that setting (tests) gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="plateworks-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def large(df: DataFrame) -> DataFrame:
    """The table, for a join that sorts both sides: it grows with the photos.

    By the size of its compressed files a table of millions of keys can look small
    enough to be gathered by the driver and sent to all executors.
    """
    return df.hint("merge")


#: How rows are dealt over tasks: into how many, and by which columns.
Dealt = tuple[int, str]
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def saved(df: DataFrame, name: str, dealt: Dealt | None = None) -> DataFrame:
    """The same rows, read from files: what is built on them never runs the steps before again.

    With ``dealt`` a file holds the rows of one task, and Spark knows: what is
    grouped by that column, or joined with other tables dealt alike, also by
    further columns, is not shuffled again.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    if not dealt:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n, column = dealt
    spark.conf.set(_ALL_KEYS, "false")  # a photo's rows are in one task, so those of its detections are
    table = f"plateworks_{uuid.uuid4().hex}"
    df.repartition(n, column).write.bucketBy(n, column).option("path", path).saveAsTable(table)
    return spark.table(table)
