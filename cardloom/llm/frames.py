"""Small helpers that the operators share: lineage cuts, gapless ranks, names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.operators.joins import skew_join  # noqa: F401
from cardloom.operators.lineage import Rounds, cut, new_folder, remove, shared_dir  # noqa: F401

#: Values that are sampled for each bucket of :func:`gapless`; buckets for each partition of a shuffle.
SAMPLED, BUCKETS = 20, 8


def parts(spark: SparkSession) -> int:
    """The number of partitions this session deals shuffles out to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _bounds(df: DataFrame, order: str, rows: int) -> np.ndarray:
    """Bounds between buckets of about equally many rows: a sorted sample of ``order``, each value as often as it fell.

    The sample has about ``SAMPLED`` values (8 bytes each) for each of ``BUCKETS`` times the shuffle's partitions.
    """
    n = df.count()
    buckets = min(BUCKETS * parts(df.sparkSession), n // rows)
    if buckets < 2:
        return np.zeros(0, np.int64)
    share = min(1.0, SAMPLED * buckets / n)
    values = df.select(F.coalesce(order, F.lit(-(2**63))).alias("v"))
    found = np.sort(np.array([r["v"] for r in (values.sample(share, 1) if share < 1 else values).collect()], np.int64))
    return found[[len(found) * i // buckets for i in range(1, buckets)]] if len(found) else found


def bucketed(df: DataFrame, order: str, ties: tuple[str, ...], bucket_rows: int) -> tuple[Column, Column]:
    """A bucket of consecutive values of a long column for each row, and the hash that orders rows of one value.

    Buckets ascend with (value, hash) and hold about equally many rows; a value that many rows hold is dealt out by its hash, a
    hash of ``ties``.  Where no value is that frequent the hash is 0 and ``ties`` are not read for it.
    """
    bounds = _bounds(df, order, bucket_rows)
    many = len(bounds) > 1 and bool((bounds[2:] == bounds[:-2]).any())

    @F.pandas_udf("int")
    def bucket(values: pd.Series, hashes: pd.Series) -> pd.Series:
        v = values.to_numpy(np.int64)
        low, high = np.searchsorted(bounds, v, "left"), np.searchsorted(bounds, v, "right")
        share = (hashes.to_numpy(np.int64) >> 32).astype(np.float64) / 2**32 + 0.5
        spread = np.where(high - low > 2, high - low, 1)
        return pd.Series((low + np.minimum((share * spread).astype(np.int64), spread - 1)).astype(np.int32))

    mixed = F.xxhash64(*ties) if ties and many else F.lit(0).cast("long")
    return (bucket(F.coalesce(F.col(order), F.lit(-(2**63))), mixed) if len(bounds) else F.lit(0)), mixed


def gapless(df: DataFrame, by: list[str], order: str, out: str, ties: tuple[str, ...] = (), bucket_rows: int = 4096) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... in each group of ``by`` in ascending ``order``.

    ``order`` is a long column; nulls come first, and rows with equal values
    follow a hash of the columns ``ties``, then those.  No task ever gets a whole group: rows are ranked
    within buckets of consecutive values, and a running sum over the bucket sizes (a small table)
    gives each bucket its first number.  Bounds of buckets are taken from a sample, so neither one far value nor
    dense ones leave a bucket overfull, and a value that many rows hold is dealt out
    to several buckets by the hash.  Rows that agree in ``order`` and all of ``ties`` share a bucket.
    """
    bucket, mixed = bucketed(df, order, ties, bucket_rows)
    keyed = df.withColumns({"_gapless_hash": mixed, "_gapless_bucket": bucket})
    sizes = keyed.groupBy(*by, "_gapless_bucket").agg(F.count(F.lit(1)).alias("_gapless_n"))
    before = Window.partitionBy(*by).orderBy("_gapless_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.withColumn("_gapless_first", F.coalesce(F.sum("_gapless_n").over(before), F.lit(0))).drop("_gapless_n")
    firsts = firsts.select(*[F.col(c).alias(f"_gapless_k{i}") for i, c in enumerate(by)], F.col("_gapless_bucket").alias("_gapless_kb"), "_gapless_first")
    inside = Window.partitionBy(*by, "_gapless_bucket").orderBy(F.col(order).asc_nulls_first(), "_gapless_hash", *ties)
    ranked = keyed.withColumn("_gapless_in", F.row_number().over(inside) - 1)
    on = [F.col(c).eqNullSafe(F.col(f"_gapless_k{i}")) for i, c in enumerate(by)] + [F.col("_gapless_bucket") == F.col("_gapless_kb")]
    return ranked.join(firsts, on, "left").withColumn(out, (F.col("_gapless_first") + F.col("_gapless_in")).cast("long")).select(*df.columns, out)
