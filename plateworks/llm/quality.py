"""Quality classifier: hashed word n-gram logistic regression, FTRL updates.

Every document gets a score: null and empty texts that of the bias alone,
repeated rows one each; an empty table gives none. Columns other than id and
text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .linear import Options, classify

OPTIONS = Options(shapes=((), (1,), (1, 1)), alpha=2.0, l1=0.1, min_rows=3)
PARTS, HELD, THRESHOLD = 5, 0, 0.3


def quality(docs: DataFrame, labels: DataFrame, options: Options = OPTIONS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1: keep)."""
    return classify(docs, labels, "quality", options, PARTS, HELD, threshold)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return quality(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
