"""Reply chains: who wrote the message at the root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.operators.joins import skew_join
from cardloom.operators.lineage import Rounds

#: So many messages may meet in one task; with more, frequent roots are spread.
FEW_MESSAGES = 1_000_000


def roots(messages: DataFrame, rounds: int = 40) -> DataFrame:
    """message_id, root_id, sender_id of every message; a parent that is missing gives sender 0.

    ``messages``: message_id, reply_to (null at a root), sender_id.  Pointer jumping: each round
    doubles how far every message looks, so a chain of n takes log2(n) joins, where walking it takes n.
    Messages in a cycle have no root and get sender 0, as do messages without an id (null).

    Many messages look at one root in the end, so what is known of a root is joined by broadcast if it is frequent.
    """
    rounds_of = Rounds(messages.sparkSession)
    hops = rounds_of.written(messages.select("message_id", F.coalesce("reply_to", "message_id").alias("root_id")).where("message_id is not null"))

    few = hops.count() <= FEW_MESSAGES

    def met(facts: DataFrame, fact: str) -> DataFrame:
        """``hops`` with what is known of each root, or null."""
        if few:
            return hops.join(facts, "root_id", "left")
        looked_at = hops.groupBy("root_id").agg(F.count(F.lit(1)).alias("n"))
        known = rounds_of.written(looked_at.join(facts, "root_id", "left").select("root_id", fact, "n"))
        return skew_join(hops, known, ["root_id"], "n")

    for _ in range(rounds):
        jumped = met(hops.select(F.col("message_id").alias("root_id"), F.col("root_id").alias("_next")), "_next")
        jumped = rounds_of.written(jumped.select("message_id", F.coalesce("_next", "root_id").alias("root_id"), (F.col("_next") != F.col("root_id")).alias("_moved")))
        rounds_of.drop(jumped)
        hops = jumped.drop("_moved")
        if not jumped.where("_moved").limit(1).count():
            break
    ends = messages.where("reply_to is null").select(F.col("message_id").alias("root_id"), "sender_id")
    found = met(ends, "sender_id").select("message_id", "root_id", F.coalesce("sender_id", F.lit(0)).alias("sender_id"))
    nameless = messages.where("message_id is null").select("message_id", F.col("message_id").alias("root_id"), F.lit(0).cast(dict(found.dtypes)["sender_id"]).alias("sender_id"))
    return found.unionByName(nameless)
