"""Statistics of a catalogue: the flagship aggregate, ranks and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import names

PAGE = 10


def series_stats(catalog: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per pool and series: items, distinct characters, share of all the pool's items, items a character.

    The denominator counts every row of the pool, also those that get no series because their only
    underscore stands in the extension.
    """
    by = by or ["pool"]
    listed = names.is_listed(F.col("file_name")) & (names.underscores(F.col("stem")) >= 1)
    # one pass over the catalogue: a row for each character, from which items, characters and totals follow
    each = catalog.groupBy(*by, "series", "character").agg(F.count_if(listed).alias("_listed"), F.count(F.lit(1)).alias("_all"))
    grouped = each.groupBy(*by, "series").agg(F.sum("_listed").alias("items"), F.count_if((F.col("_listed") > 0) & F.col("character").isNotNull()).alias("characters"), F.sum("_all").alias("_all"))
    out = grouped.withColumn("_total", F.sum("_all").over(Window.partitionBy(*by))).where("items > 0")
    share = F.round(100.0 * F.col("items") / F.col("_total"), 6)
    skins = F.round(F.when(F.col("characters") > 0, F.col("items") / F.col("characters")).otherwise(0.0), 6)
    return out.select(*by, "series", "items", "characters", share.alias("share"), skins.alias("avg_skins"))


def ranked(stats: DataFrame, by: list[str]) -> DataFrame:
    """Rank by items, the name breaks ties; page of ten."""
    w = Window.partitionBy(*by).orderBy(F.desc("items"), "series")
    return stats.withColumn("rank", F.row_number().over(w)).withColumn("page", F.expr(f"(rank - 1) div {PAGE} + 1"))


def top(stats: DataFrame, by: list[str], k: int | None) -> DataFrame:
    """The first k of each group; all without k."""
    out = ranked(stats, by)
    return out if k is None else out.where(F.col("rank") <= k)
