"""Folders that driver and executors share, and bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting (tests) gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="plateworks-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of a batch of rows that goes to Python, unless the session sets its own.
BATCH_BYTES, _BATCH_KEY = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(docs: DataFrame) -> DataFrame:
    """The same table; from now on the session sends it to Python in batches of bounded size.

    The usual bound, 64 MB, is held twice for each running task: by the executor
    and by its Python worker. A value that the session has set is left alone.
    """
    if docs.sparkSession.conf.get(_BATCH_KEY, None) is None:
        docs.sparkSession.conf.set(_BATCH_KEY, BATCH_BYTES)
    return docs


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and reread, so that later steps start from files."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`save` wrote."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of a table that may be broadcast; their columns are short.
FEW_ROWS = 500_000


def few(df: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it has at most FEW_ROWS rows."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def with_class(rows: DataFrame, classes: DataFrame, key: str, large: int = 2000) -> DataFrame:
    """Rows with the further columns of their class, null for rows of none; classes has one row a key, and n, a key's rows.

    Few classes are broadcast. Of more, only those of more than ``large`` rows
    are, and no key of the join that deals rows out has more rows than that.
    """
    if classes.count() <= FEW_ROWS:
        return rows.join(F.broadcast(classes), key, "left")
    names = [c for c in classes.columns if c != key]
    big = classes.where(F.col("n") > large).select(key, F.struct(*names).alias("_big"))
    other = classes.where(F.col("n") <= large).select(F.col(key).alias("_key"), F.struct(*names).alias("_other"))
    # A row of a large class asks for no other; rows that ask for none aren't joined.
    found = rows.join(few(big), key, "left")
    settled = F.col("_big").isNotNull() | F.col(key).isNull()
    joined = found.where(~settled).join(other, F.col(key) == F.col("_key"), "left").drop("_key")
    whole = joined.unionByName(found.where(settled), allowMissingColumns=True)
    return whole.select(*rows.columns, F.coalesce("_big", "_other").alias("_class")).select(*rows.columns, "_class.*")


def fold(id_col: str, parts: int):
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
