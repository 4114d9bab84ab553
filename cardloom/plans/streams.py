"""Streaming queries, run over the events table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.plans.registry import query
from cardloom.plans.state import _BALLOTS, SECONDS, SUPERUSERS, _votes
from cardloom.streaming import ballots, common, confirmations, dialogs


@query(_BALLOTS + f""", ends AS (SELECT ballot, opened, (SELECT min(f.ts) FROM first_votes f WHERE f.ballot = b.ballot AND f.choice IN ('agree', 'disagree') AND (f.voter = f.owner OR f.voter IN (1))) AS decided_ts FROM ballots b)
SELECT ballot, tally.owner, agree, disagree, abstain, decision IS NOT NULL AS early, CASE WHEN CASE WHEN decision IS NOT NULL THEN decision = 'agree' ELSE agree >= 1 AND agree > disagree END THEN 'remove' ELSE 'keep' END AS result
FROM tally JOIN ends USING (ballot) WHERE coalesce(decided_ts, opened + INTERVAL {SECONDS} SECOND) < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def vote_stream(spark, sf_dir):
    """Ballots by a stateful stream; those that close, or are decided, before the last watermark."""
    stream = common.event_stream(spark, sf_dir)
    opened = F.broadcast(_votes(spark, sf_dir)[1].select("ballot", "owner"))  # a row a day
    choice = F.when(F.col("event_type") == "click", "agree").when(F.col("event_type") == "view", "disagree").when(F.col("event_type") == "error", "abstain")
    votes = stream.select(F.unix_date(F.to_date("ts")).cast("long").alias("ballot"), F.col("user_id").alias("voter"), choice.alias("choice"), "ts", F.col("event_id").alias("seq"))
    return common.drained(ballots.results(votes.join(opened, "ballot"), SECONDS, SUPERUSERS), "ballots")


@query("""WITH e AS (SELECT user_id, ts, event_id AS seq, date_trunc('day', ts) AS message, CASE event_type WHEN 'signup' THEN 'ask' WHEN 'click' THEN 'accept' ELSE 'decline' END AS kind FROM events WHERE event_type IN ('signup', 'click', 'error')),
n AS (SELECT a.user_id, a.ts, a.seq, arg_min(b.kind, (b.ts, b.seq)) AS kind, min(b.ts) AS answered FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND (a.ts, a.seq) < (b.ts, b.seq) AND (b.kind = 'ask' OR b.message = a.message) WHERE a.kind = 'ask' GROUP BY ALL),
o AS (SELECT *, CASE WHEN answered < ts + INTERVAL 6 HOUR THEN CASE kind WHEN 'ask' THEN 'superseded' WHEN 'accept' THEN 'accepted' ELSE 'declined' END ELSE 'timeout' END AS outcome FROM n)
SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS asked_at, outcome FROM o WHERE outcome <> 'timeout' OR ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 10 MINUTE
  OR EXISTS (SELECT 1 FROM e x WHERE x.user_id = o.user_id AND x.ts >= o.ts + INTERVAL 6 HOUR)""")
def confirm_stream(spark, sf_dir):
    """Confirmation sessions by a stateful stream: sign-ups ask, clicks accept, errors decline; a day's events refer to one message."""
    kind = F.when(F.col("event_type") == "signup", "ask").when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "error", "decline")
    message = F.unix_date(F.to_date("ts")).cast("long")
    stream = common.event_stream(spark, sf_dir).select("user_id", kind.alias("kind"), message.alias("message"), "ts", F.col("event_id").alias("seq")).where("kind is not null")
    return common.drained(confirmations.outcomes(stream, 6 * 3600), "confirmations").select("user_id", F.unix_timestamp("asked_at").alias("asked_at"), "outcome")


@query("""WITH t AS (SELECT user_id, event_id, event_type, ts, count(*) FILTER (event_type IN ('view', 'purchase')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS unusable FROM events),
x AS (SELECT *, lead(event_id) OVER w AS answer_seq, lead(event_type) OVER w AS answer, lead(unusable) OVER w AS unusable_then FROM t WHERE event_type NOT IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id AS asked_seq, answer_seq, CASE answer WHEN 'click' THEN 'renamed' WHEN 'error' THEN 'cancelled' ELSE 'asked_again' END AS outcome, 1 + unusable_then - unusable AS prompts FROM x WHERE event_type = 'signup' AND answer_seq IS NOT NULL""")
def rename_session(spark, sf_dir):
    """Rename dialogs by a stateful stream: sign-ups request, clicks give a usable name, errors cancel, all else is asked for again."""
    kind = F.when(F.col("event_type") == "signup", "request").when(F.col("event_type") == "click", "name").when(F.col("event_type") == "error", "cancel").otherwise("unusable")
    stream = common.event_stream(spark, sf_dir).select("user_id", kind.alias("kind"), "ts", F.col("event_id").alias("seq"))
    return common.drained(dialogs.dialogs(stream), "dialogs")
