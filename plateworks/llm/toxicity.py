"""Toxicity: FTRL-proximal logistic regression over word n-grams and skip-grams.

Every document gets a score: null and empty texts that of the bias alone,
repeated rows one each; an empty table gives none. Columns other than id and
text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .linear import Options, classify

#: Chosen by cross-validation over the learning folds alone, at THRESHOLD.
OPTIONS = Options(shapes=((), (1,), (2,)), head=6, pair=0.5, alpha=10.0, l1=1.0, epochs=8, min_rows=3)
PARTS, HELD, THRESHOLD = 4, 2, 0.3


def toxicity(docs: DataFrame, labels: DataFrame, options: Options = OPTIONS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1: toxic)."""
    return classify(docs, labels, "toxic", options, PARTS, HELD, threshold)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
