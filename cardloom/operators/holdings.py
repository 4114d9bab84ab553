"""State from event logs: current holdings, histories, renames, terms, moves.

Parquet has no MERGE, so every mutation is an event, and state is a fold over events by key.  All folds
are aggregates with partial results before the shuffle.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(events: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Upsert: of each key the values of its last event."""
    at = F.struct(*order)
    return events.groupBy(*key).agg(*[F.max_by(v, at).alias(v) for v in values])


def first_wins(events: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Insert if absent: of each key the values of its first event."""
    at = F.struct(*order)
    return events.groupBy(*key).agg(*[F.min_by(v, at).alias(v) for v in values])


def without_deleted(state: DataFrame, deletes: DataFrame, key: list[str], ts: str = "ts") -> DataFrame:
    """Rows of ``state`` that no later delete of their key removes."""
    last = deletes.groupBy(*key).agg(F.max(ts).alias("_deleted"))
    return state.join(last, key, "left").where(F.col("_deleted").isNull() | (F.col("_deleted") < F.col(ts))).drop("_deleted")


def history(events: DataFrame, key: list[str], order: list[str], entry: Column) -> DataFrame:
    """Ordered list of entries, their number and the last time of each key."""
    rows = F.sort_array(F.collect_list(F.struct(*order, entry.alias("_entry"))))
    return events.groupBy(*key).agg(F.transform(rows, lambda x: x["_entry"]).alias("history"), F.count(F.lit(1)).alias("total_count"), F.max(order[0]).alias("last_draw_time"))


def running_total(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Add ``running_total``: how many events of its key there are up to each, in the order of ``order`` (a time first).

    Events are numbered within a key's day, and a sum over the days' counts (a small table) gives each day its first
    number, so a key with very many events is spread over tasks by its days.
    """
    dated = events.withColumn("_running_day", F.to_date(order[0]))
    by = [*key, "_running_day"]
    before = Window.partitionBy(*key).orderBy("_running_day").rowsBetween(Window.unboundedPreceding, -1)
    days = dated.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_running_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    days = days.select(*[F.col(c).alias(f"_running_{i}") for i, c in enumerate(by)], "_running_before")
    numbered = dated.withColumn("_running_in", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    on = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_running_{i}")) for i, c in enumerate(by)))
    return numbered.join(days, on).withColumn("running_total", F.col("_running_before") + F.col("_running_in")).select(*events.columns, "running_total")


def get_or_create(users: DataFrame, accepted: DataFrame) -> DataFrame:
    """Every user with ``read_help``, 0 unless accepted."""
    return users.join(accepted.select("user_id").distinct().withColumn("_yes", F.lit(1)), "user_id", "left").select("user_id", F.coalesce("_yes", F.lit(0)).alias("read_help"))


def mark_read(users: DataFrame, readers: DataFrame) -> DataFrame:
    """Set read_help where it is 0 and the user is among the readers; nothing is inserted."""
    hit = readers.select("user_id").distinct().withColumn("_yes", F.lit(1))
    return users.join(hit, "user_id", "left").select("user_id", F.when((F.col("read_help") == 0) & F.col("_yes").isNotNull(), 1).otherwise(F.col("read_help")).alias("read_help"))


def cooled_down(events: DataFrame, key: list[str], ts: str, seconds: int) -> DataFrame:
    """Events with a gap of at least ``seconds`` to the one before them of the same key."""
    w = Window.partitionBy(*key).orderBy(ts, "seq")
    gap = F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.lag(ts).over(w).cast("timestamp"))
    return events.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= seconds))
