"""Tag scores: confidence of two groups, thresholds, and a hook for a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUSPICIOUS = 0.6


def group_sum(tags: Column, scores: Column, word: str) -> Column:
    """Sum of the scores whose tag contains the word."""
    pairs = F.arrays_zip(tags.alias("t"), scores.alias("s"))
    return F.aggregate(F.filter(pairs, lambda x: F.contains(x["t"], F.lit(word))), F.lit(0.0), lambda a, x: a + x["s"].cast("double"))


def confidence(rows: DataFrame, first: str = "boy", second: str = "girl") -> DataFrame:
    """Add ``first`` and ``second``: their shares of the two sums; both 0 if neither scores."""
    a, b = group_sum(F.col("tags"), F.col("scores"), first), group_sum(F.col("tags"), F.col("scores"), second)
    out = rows.withColumns({"_a": a, "_b": b}).withColumn("_t", F.col("_a") + F.col("_b"))
    shares = {n: F.round(F.when(F.col("_t") > 0, F.col(c) / F.col("_t")).otherwise(F.col(c)), 6) for n, c in ((first, "_a"), (second, "_b"))}
    return out.withColumns(shares).drop("_a", "_b", "_t")


def suspicious(rows: DataFrame, column: str, limit: float = SUSPICIOUS) -> DataFrame:
    return rows.where(F.col(column) > limit)


def with_model(rows: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, failed: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Score batches with a model that each worker builds once.

    ``failed`` gives the result of rows that the scorer raises an error on: a batch that fails is scored row by row, so
    one bad row costs the others nothing.  Without it errors are raised.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make_scorer()
        for batch in batches:
            try:
                yield score(batch)
            except Exception:
                if failed is None:
                    raise
                for i in range(len(batch)):
                    row = batch.iloc[i : i + 1]
                    try:
                        yield score(row)
                    except Exception:
                        yield failed(row)

    return rows.mapInPandas(run, schema)
