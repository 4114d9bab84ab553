"""Names as users write them: aliases and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions import text

#: Fixed value: the least score of a match.
THRESHOLD = 70.0
#: The distinct names that queries are matched against are broadcast up to so many.
BROADCAST_NAMES = 100_000


def normalised(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """The canonical name of each query, in lower case; unknown ones pass through."""
    known = aliases.select(F.col("alias").alias("_alias"), F.lower("name").alias("_name"))
    return queries.join(known, F.lower("query") == F.col("_alias"), "left").select("query", F.coalesce("_name", F.lower("query")).alias("name"))


def scores(queries: DataFrame, library: DataFrame) -> DataFrame:
    """Score of each query with each library name.

    Every query meets every name, as any name may be near: the names are a small dimension (the series of a
    catalogue).  They are broadcast only if they are few; otherwise Spark deals the product out in blocks.
    """
    found = library.select("name").distinct()
    if found.count() <= BROADCAST_NAMES:
        found = F.broadcast(found)
    return queries.join(found).withColumn("score", F.round(text.similarity(F.col("query"), F.col("name")), 6))


def best_match(queries: DataFrame, library: DataFrame) -> DataFrame:
    """The exact name, else the best one of at least the threshold, else no row."""
    scored = scores(queries, library).withColumn("exact", (F.col("query") == F.col("name")).cast("int"))
    best = scored.groupBy("query").agg(F.min_by(F.struct("name", "score"), F.struct(-F.col("exact"), -F.col("score"), F.col("name"))).alias("b"))
    return best.select("query", "b.name", "b.score").where(F.col("score") >= THRESHOLD)
