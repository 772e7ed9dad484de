"""A user's own tables: boxes of a detector, readings of a recogniser, and photos in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOXES = {"photo_id": "bigint", "det_seq": "int", "x1": "double", "y1": "double", "x2": "double", "y2": "double", "confidence": "double"}
WHOLE_READINGS = {"photo_id": "bigint", "det_seq": "int", "reading_seq": "int", "restricted": "boolean", "raw_text": "string", "confidence": "double"}
FIELD_READINGS = {"photo_id": "bigint", "det_seq": "int", "field": "string", "variant_no": "int", "restricted": "boolean", "raw_text": "string", "confidence": "double"}


def table(spark: SparkSession, path: str, columns: dict[str, str], format: str = "parquet", **options: str) -> DataFrame:
    """These columns of a table, cast to their types; others are not read."""
    df = spark.read.format(format).options(**options).load(path)
    if gone := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(gone)}")
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in columns.items()))


def photo_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of the image files in a folder and those below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,png,bmp,webp,JPG,JPEG,PNG,BMP,WEBP}")
    return files.load(folder).select("path", "length", "content")
