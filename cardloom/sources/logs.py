"""Stored logs: append-only Parquet with declared schemas, and the state that folds from them.

A folder has a sub-folder for each log.  Parquet has no MERGE, so upserts, inserts and deletes are rows that are
appended, and reading folds them by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators import holdings
from cardloom.sources.schemas import HISTORY_ENTRY, LOGS


def create(spark: SparkSession, folder: str) -> None:
    """Make every log that is not there yet, empty; logs that are there stay as they are."""
    for name, schema in LOGS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")


def append(rows: DataFrame, folder: str, name: str) -> None:
    """Add rows to a log, cast to its schema; columns that are missing are null, others are an error."""
    schema = LOGS[name]
    if unknown := set(rows.columns) - set(schema.names):
        raise ValueError(f"{name} has no {sorted(unknown)}")
    fields = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    rows.select(*fields).write.mode("append").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(LOGS[name]).parquet(f"{folder}/{name}")


def moves(spark: SparkSession, folder: str, user_id: Column | None = None) -> DataFrame:
    """The log of moves, with its images as a list again."""
    rows = read(spark, folder, "moves").withColumn("moved_images", F.split("moved_images", ", "))
    return rows if user_id is None else rows.where(user_id)


def ballots(spark: SparkSession, folder: str) -> DataFrame:
    """The stored ballot of each image: the last one that was saved."""
    return holdings.last_wins(read(spark, folder, "votes"), ["image_name"], ["vote_time", "id"], ["id", "owner_user_id", "vote_result", "vote_time", "voters"])


def histories(spark: SparkSession, folder: str) -> DataFrame:
    """user_id, card_type, history (list of timestamp and card_name, empty where none is stored), total_count: the last state of each."""
    last = holdings.last_wins(read(spark, folder, "history"), ["user_id", "card_type"], ["total_count", "last_draw_time"], ["history", "last_draw_time"])
    rows = read(spark, folder, "history").groupBy("user_id", "card_type").agg(F.max("total_count").alias("total_count"))
    entries = F.coalesce(F.from_json("history", HISTORY_ENTRY), F.array().cast(HISTORY_ENTRY))
    return last.join(rows, ["user_id", "card_type"]).withColumn("history", entries)
