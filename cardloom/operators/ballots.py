"""Ballots in batch: one vote a voter, early decisions, a time limit, one result.

``votes``: ballot, voter, choice (agree, disagree, abstain), ts, seq.  ``ballots``: ballot, owner, opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_time(votes: DataFrame, ballots: DataFrame, seconds: int) -> DataFrame:
    """Votes on known ballots from their opening until they close; other reactions are dropped."""
    limit = F.expr(f"opened + interval {seconds} seconds")
    known = votes.where(F.col("choice").isin("agree", "disagree", "abstain")).join(ballots, "ballot")
    return known.where((F.col("ts") >= F.col("opened")) & (F.col("ts") < limit))


def first_votes(votes: DataFrame) -> DataFrame:
    """Only the first vote of each voter counts."""
    carried = [c for c in votes.columns if c not in ("ballot", "voter")]
    return votes.groupBy("ballot", "voter").agg(F.min_by(F.struct(*carried), F.struct("ts", "seq")).alias("_v")).select("ballot", "voter", "_v.*")


def decisions(first: DataFrame, superusers: list[int]) -> DataFrame:
    """The first vote for or against by the owner or a superuser decides at once."""
    deciding = (F.col("voter") == F.col("owner")) | F.col("voter").isin(superusers)
    hits = first.where(deciding & F.col("choice").isin("agree", "disagree"))
    return hits.groupBy("ballot").agg(F.min(F.struct("ts", "seq", "choice", "voter")).alias("d")).select("ballot", F.col("d.ts").alias("decided_at"), F.col("d.seq").alias("decided_seq"), F.col("d.choice").alias("decision"))


def results(votes: DataFrame, ballots: DataFrame, seconds: int, superusers: list[int]) -> DataFrame:
    """One row for each ballot: tallies of what counted, whether it was decided early, and the result.

    Votes after the deciding one do not count.  Undecided, an item is removed only with a vote for it and
    more for than against.
    """
    first = first_votes(in_time(votes, ballots, seconds))
    decided = decisions(first, superusers)
    counted = first.join(decided, "ballot", "left").where(F.col("decided_at").isNull() | (F.struct("ts", "seq") <= F.struct("decided_at", "decided_seq")))
    tally = counted.groupBy("ballot").agg(*[F.count_if(F.col("choice") == c).alias(c) for c in ("agree", "disagree", "abstain")], F.max("decision").alias("decision"))
    out = ballots.join(tally, "ballot", "left").fillna(0, ["agree", "disagree", "abstain"])
    remove = F.when(F.col("decision").isNotNull(), F.col("decision") == "agree").otherwise((F.col("agree") >= 1) & (F.col("agree") > F.col("disagree")))
    return out.select("ballot", "owner", "agree", "disagree", "abstain", F.col("decision").isNotNull().alias("early"), F.when(remove, "remove").otherwise("keep").alias("result"))


def voters(first: DataFrame) -> DataFrame:
    """The voters of each choice, sorted."""
    lists = [F.sort_array(F.collect_set(F.when(F.col("choice") == c, F.col("voter")))).alias(c) for c in ("agree", "disagree", "abstain")]
    return first.groupBy("ballot").agg(*lists)


def open_requests(requests: DataFrame, active: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests for images that have neither an active nor a stored ballot."""
    return requests.join(active.select("image").unionByName(stored.select("image")).distinct(), "image", "left_anti")
