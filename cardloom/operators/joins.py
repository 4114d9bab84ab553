"""Joins that spread frequent values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skew_join(rows: DataFrame, table: DataFrame, on: list[str], count: str, hot: int = 10_000) -> DataFrame:
    """Inner join with a computed table that has one row for each value of ``on``; null matches nothing.

    ``count`` is its column that says how many of ``rows`` have the value.  Values that more than one
    in ``hot`` rows has (so there are fewer than ``hot``) are joined by broadcast, the others by a shuffle: no
    task gets all rows of a frequent value.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) > total // hot
    others = [c for c in table.columns if c not in (*on, count)]
    frequent = F.broadcast(table.where(often).select(*on, F.struct(F.lit(1).alias("_skew_one"), *others).alias("_skew")))
    found = rows.join(frequent, on, "left")
    spread = found.where("_skew is not null").select(*rows.columns, *[F.col("_skew")[c].alias(c) for c in others])
    dealt = found.where("_skew is null").drop("_skew").join(table.where(~often).select(*on, *others), on)
    return spread.unionByName(dealt.select(*rows.columns, *others))
