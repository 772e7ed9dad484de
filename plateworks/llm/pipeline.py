"""Documents to packed training sequences, in five stages.

Each stage works on all rows that the one before kept, and each but the last
returns the columns of documents. Null texts and ids, repeated rows, empty
tables and further columns are treated as the operators' docstrings state; a
stage that filters returns a kept row unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import decontaminate, langid, linear, neardup, packing
from . import quality as q
from .shared import few, fold, save


def _rows(docs: DataFrame) -> DataFrame:
    """Id, text and language beside the whole row, so that no column of docs can clash."""
    return docs.select("doc_id", "text", "lang", F.struct("*").alias("_row"))


def _ordered(kind: T.DataType) -> bool:
    """Whether Spark can compare values of a type."""
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind)
    return _ordered(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def _least(docs: DataFrame) -> Column:
    """The least ``_row`` of a group by all columns that can be compared; docs are the rows' table."""
    return F.min_by("_row", F.struct(*(F.col(f"_row.`{f.name}`") for f in docs.schema if _ordered(f.dataType)))).alias("_row")


def _vertices(docs: DataFrame) -> DataFrame:
    """vertex, text, _row: one vertex for each id and text. The first text of an id has that id; others get numbers above all ids."""
    digest = F.xxhash64("text")
    texts = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("first"), F.max(digest).alias("last"))
    several = save(texts.where("first <> last").select(F.col("doc_id").alias("vertex"), "first"), "several")
    rows = docs.select(F.col("doc_id").cast("long").alias("vertex"), "text", F.struct("*").alias("_row"))
    if not several.head(1):
        return rows
    rows = rows.join(few(several), "vertex", "left")
    other = rows.where(digest != F.col("first")).withColumn("digest", F.coalesce(F.sha2("text", 256), F.lit("")))
    least, most = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    number = F.monotonically_increasing_id()
    # Above all ids, so that they give way to near copies; below, where there is no room above.
    vertex = F.lit(most) + 1 + number if most < 2**62 else F.lit(least) - 1 - number
    numbers = save(other.select(F.col("vertex").alias("_id"), "digest").distinct().select("_id", "digest", vertex.alias("number")), "numbers")
    named = other.withColumnRenamed("vertex", "_id").join(few(numbers), ["_id", "digest"]).withColumnRenamed("number", "vertex")
    own = rows.where("first is null").unionByName(rows.where(digest == F.col("first")))
    return own.select("vertex", "text", "_row").unionByName(named.select("vertex", "text", "_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score reaches the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = linear.train(docs, labels.where(fold("doc_id", q.PARTS) != q.HELD), "quality", q.OPTIONS)
    scored = linear.score(_rows(docs), weights, q.OPTIONS, keep=("_row",))
    return scored.where(F.col("score") >= q.THRESHOLD).select("_row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text fits the model of its language."""
    scored = langid.score(_rows(docs), langid.learn(docs), keep=("_row",))
    return scored.where("accepted").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id; of rows with one id and text, the least by all columns that can be compared."""
    rows = _vertices(docs)
    kept = neardup.near_duplicates(rows, "vertex").where("kept and vertex is not null").select("vertex").distinct()
    # Rows and kept vertices are dealt once, for the join and for the choice among rows with one id and text.
    some = rows.select("vertex", "_row").join(kept, "vertex", "left_semi").groupBy("vertex").agg(_least(docs))
    return some.select("_row.*").unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark passage."""
    rows = _vertices(docs)
    hits = decontaminate.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "vertex")
    ids = save(hits.select("vertex").distinct(), "contaminated")
    return rows.join(few(ids), "vertex", "left_anti").select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens, with their ids."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: A trained classifier and a tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
