"""The domain bound to the benchmark tables, so that queries and their SQL share one definition.

Catalogue: ``part`` (brand = series, name = character, key = skin).  Draws: purchases (pool A) and views
(pool B) in ``events``.  Ballots: days, with clicks, views and errors as votes.  Replies: turns of
``conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import names

CATALOG_SQL = """catalog AS (
  SELECT p_partkey AS item_id, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS pool,
         p_brand || '_' || replace(p_name, ' ', '-') || '_' || p_partkey || '.png' AS file_name,
         p_type AS kind FROM part),
named AS (
  SELECT item_id, pool, file_name, kind, regexp_replace(file_name, '^(\\.*[^.].*)\\.[^.]*$', '\\1') AS stem,
         split_part(file_name, '_', 1) AS series,
         split_part(regexp_replace(file_name, '^(\\.*[^.].*)\\.[^.]*$', '\\1'), '_', 2) AS "character" FROM catalog)"""

DRAWS_SQL = """draws AS (
  SELECT e.event_id AS seq, e.ts, e.user_id, CASE WHEN e.event_type = 'purchase' THEN 'A' ELSE 'B' END AS pool, n.stem AS card
  FROM events e JOIN named n ON n.item_id = e.event_id % (SELECT count(*) FROM part)
  WHERE e.event_type IN ('purchase', 'view'))"""

HOLDING_SQL = """holding AS (
  SELECT user_id, pool, arg_max(card, (ts, seq)) AS card, max(ts) AS ts, max(seq) AS seq FROM draws GROUP BY user_id, pool)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, pool, file_name, kind, stem, series, character."""
    name = F.concat_ws("_", "p_brand", F.replace("p_name", F.lit(" "), F.lit("-")), F.concat(F.col("p_partkey").cast("string"), F.lit(".png")))
    stem = names.stem(F.col("file_name"))
    return (
        table(spark, sf_dir, "part")
        .select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("B").alias("pool"), name.alias("file_name"), F.col("p_type").alias("kind"))
        .withColumn("stem", stem)
        .withColumns({"series": names.series(F.col("file_name")), "character": names.character(F.col("stem"))})
    )


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, user_id, pool, card: who drew which card when."""
    items = catalog(spark, sf_dir).select("item_id", F.col("stem").alias("card"))
    size = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))  # one row
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "view"))
    keyed = events.crossJoin(F.broadcast(size)).withColumn("item_id", F.col("event_id") % F.col("n"))
    return keyed.join(items, "item_id").select(
        F.col("event_id").alias("seq"), "ts", "user_id", F.when(F.col("event_type") == "purchase", "A").otherwise("B").alias("pool"), "card"
    )
