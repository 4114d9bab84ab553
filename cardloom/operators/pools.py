"""Changes to the catalogue: files move to another pool or are removed, with lists of what worked and what did not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions import names

REMOVED = "removed"


def requested(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """A row for each request and file of its character in its pool: the request's columns, item_id, file_name, stem, ok.

    ``requests``: user_id, card, pool (null: any), to, ts, seq.  Of several requests for a file the earliest moves it and
    the others fail, as does one to a pool that holds a file of that name already.
    """
    wanted = requests.withColumn("_id", names.two_part(F.col("card"))).where(F.size(F.split("card", "_")) >= 2)
    files = catalog.select("item_id", "file_name", "stem", F.col("pool").alias("_pool"), names.two_part(F.col("stem")).alias("_id"))
    found = wanted.join(files, "_id").where(F.col("pool").isNull() | (F.col("pool") == F.col("_pool"))).where(F.col("_pool") != F.col("to"))
    first = found.groupBy("item_id").agg(F.min(F.struct("ts", "seq")).alias("_first")).withColumnRenamed("item_id", "_item")
    there = catalog.select(F.col("pool").alias("to"), "file_name", F.lit(True).alias("_there")).distinct()
    out = found.join(first, F.col("item_id") == F.col("_item")).join(there, ["to", "file_name"], "left")
    ok = (F.struct("ts", "seq") == F.col("_first")) & F.col("_there").isNull()
    return out.select(*requests.columns, "item_id", "file_name", "stem", ok.alias("ok"))


def moved(catalog: DataFrame, found: DataFrame) -> DataFrame:
    """The catalogue after the moves of :func:`requested`; removed files are in the pool ``REMOVED``."""
    to = found.where("ok").select(F.col("item_id").alias("_item"), F.col("to").alias("_to"))
    return catalog.join(to, F.col("item_id") == F.col("_item"), "left").withColumn("pool", F.coalesce("_to", "pool")).drop("_item", "_to")


def report(found: DataFrame) -> DataFrame:
    """user_id, card, to, moved (stems) and failed (file names) of each request that found files, in the order of items."""

    def listed(name: str, which) -> Column:
        rows = F.sort_array(F.collect_list(F.when(which, F.struct("item_id", F.col(name).alias("_n")))))
        return F.transform(rows, lambda x: x["_n"])

    return found.groupBy("user_id", "card", "to", "seq").agg(listed("stem", F.col("ok")).alias("moved"), listed("file_name", ~F.col("ok")).alias("failed"))


def without_holdings(held: DataFrame, found: DataFrame) -> DataFrame:
    """Holdings of those whose request moved a file are given up."""
    gone = found.where("ok").select("user_id", F.col("card").alias("_card")).distinct().withColumnRenamed("user_id", "_user")
    return held.join(gone, (F.col("user_id") == F.col("_user")) & (F.col("card") == F.col("_card")), "left_anti")
