"""Point lookups, gates, routing and dialogs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cardloom.functions import commands, text
from cardloom.operators import ballots
from cardloom.plans.catalogue import _ALIASES, _held
from cardloom.plans.registry import query
from cardloom.plans.state import _BALLOTS, SECONDS, SUPERUSERS, _votes
from cardloom.sources.tables import CATALOG_SQL, DRAWS_SQL, HOLDING_SQL, draws, table

_HELD = f"WITH {CATALOG_SQL}, {DRAWS_SQL}, {HOLDING_SQL} "


@query(_HELD + "SELECT user_id, card FROM holding WHERE user_id = 8 AND pool = 'A'")
def card_of_user(spark, sf_dir):
    """The card that one user holds in one pool.  The key filter reaches the events scan."""
    return _held(spark, sf_dir).where((F.col("user_id") == 8) & (F.col("pool") == "A")).select("user_id", "card")


@query(_HELD + "SELECT user_id, card FROM holding WHERE pool = 'B'")
def cards_of_pool(spark, sf_dir):
    """All cards held in a pool."""
    return _held(spark, sf_dir).where(F.col("pool") == "B").select("user_id", "card")


@query(f"WITH {CATALOG_SQL}, {DRAWS_SQL} SELECT user_id, pool, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_time FROM draws GROUP BY user_id, pool")
def last_trigger_time(spark, sf_dir):
    """When each user last drew, as text."""
    return draws(spark, sf_dir).groupBy("user_id", "pool").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_time"))


@query("SELECT DISTINCT event_id % 300 AS image FROM events WHERE event_type = 'view' AND event_id % 7 = 0 AND event_id % 300 IN (SELECT event_id % 300 FROM events WHERE event_type = 'purchase')")
def has_stored_ballot(spark, sf_dir):
    """Which asked-for images have a stored ballot."""
    events = table(spark, sf_dir, "events").withColumn("image", F.col("event_id") % 300)
    asked = events.where("event_type = 'purchase'").select("image")
    return events.where("event_type = 'view' and event_id % 7 = 0").select("image").distinct().join(asked, "image", "left_semi")


_MESSAGES = ["抽老婆", "抽原神老婆", "抽老公", "抽老婆老公", "查看老婆", "老婆改名 x_y", "老公概率十", "这是男的", "投票删除", "帮助抽游戏立绘", "hello"]
_ROUTES = ["draw_a", "draw_a", "draw_b", None, "view_a", "rename_a", "share_b", "move_b_to_a", "vote", "help", None]


@query(f"SELECT unnest([{', '.join(map(repr, _MESSAGES))}]) AS message, unnest([{', '.join('NULL' if r is None else repr(r) for r in _ROUTES)}]) AS command")
def command_route(spark, sf_dir):
    """Messages routed to commands."""
    return spark.createDataFrame([(m,) for m in _MESSAGES], "message string").select("message", commands.command(F.col("message")).alias("command"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'model_not_ready' WHEN user_id % 3 = 0 THEN 'pass' WHEN event_id % 5 = 0 THEN 'confirmation_pending' ELSE 'ask_terms' END AS gate FROM events""")
def gate_chain(spark, sf_dir):
    """The first gate that stops each command."""
    gate = commands.gate(F.col("event_id") % 11 != 0, F.col("user_id") % 3 == 0, F.col("event_id") % 5 == 0)
    return table(spark, sf_dir, "events").select("event_id", gate.alias("gate"))


@query("SELECT event_id FROM events WHERE CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(floor(epoch(ts)) AS BIGINT) + (event_id % 5 - 2) * 60 END > CAST(floor(epoch(ts)) AS BIGINT)")
def mute_gate(spark, sf_dir):
    """Events while a mute is still on."""
    now = F.col("ts").cast("timestamp")
    until = F.when(F.col("event_id") % 4 == 0, 0).otherwise(F.unix_timestamp(now) + (F.col("event_id") % 5 - 2) * 60)
    return table(spark, sf_dir, "events").where(commands.is_muted(until, now)).select("event_id")


@query("""WITH likes AS (SELECT event_id, user_id, CASE WHEN event_id % 6 = 0 THEN [] ELSE [{'emoji_id': CASE event_id % 4 WHEN 0 THEN '38' WHEN 1 THEN '417' WHEN 2 THEN '277' ELSE '1' END}, {'emoji_id': '38'}] END AS likes FROM events WHERE event_type = 'click')
SELECT event_id, user_id, CASE likes[1].emoji_id WHEN '38' THEN 'agree' WHEN '417' THEN 'disagree' WHEN '277' THEN 'abstain' END AS choice FROM likes WHERE likes[1].emoji_id IS NOT NULL""")
def reaction_source(spark, sf_dir):
    """Emoji notices: only the first reaction counts, and only three codes are votes."""
    code = F.when(F.col("event_id") % 4 == 0, "38").when(F.col("event_id") % 4 == 1, "417").when(F.col("event_id") % 4 == 2, "277").otherwise("1")
    one = F.struct(code.alias("emoji_id"))
    likes = F.when(F.col("event_id") % 6 != 0, F.array(one, F.struct(F.lit("38").alias("emoji_id")))).otherwise(F.array().cast("array<struct<emoji_id:string>>"))
    first = F.get("likes", F.lit(0))["emoji_id"]
    # The codes of the three reactions.
    choice = F.when(first == "38", "agree").when(first == "417", "disagree").when(first == "277", "abstain")
    return table(spark, sf_dir, "events").where("event_type = 'click'").withColumn("likes", likes).where(first.isNotNull()).select("event_id", "user_id", choice.alias("choice"))


@query(_BALLOTS + " SELECT ballot, voter, voter = owner AS is_owner, voter IN (1) AS is_superuser FROM first_votes")
def voter_roles(spark, sf_dir):
    """Who of the voters can decide."""
    votes, opened = _votes(spark, sf_dir)
    first = ballots.first_votes(ballots.in_time(votes, opened, SECONDS))
    return first.select("ballot", "voter", (F.col("voter") == F.col("owner")).alias("is_owner"), F.col("voter").isin(SUPERUSERS).alias("is_superuser"))


@query(f"""WITH a AS (SELECT unnest([{', '.join(repr(a) for a, _ in _ALIASES)}]) AS alias, unnest([{', '.join(repr(n) for _, n in _ALIASES)}]) AS name)
SELECT alias, name, count(p_partkey) AS items, min(p_size) AS smallest FROM a LEFT JOIN part ON p_type = name GROUP BY alias, name""")
def series_info(spark, sf_dir):
    """Two hops: alias to name, name to what is known of it."""
    known = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.count(F.lit(1)).alias("items"), F.min("p_size").alias("smallest"))
    aliases = spark.createDataFrame(_ALIASES, "alias string, name string")
    return aliases.join(known, "name", "left").select("alias", "name", F.coalesce("items", F.lit(0)).alias("items"), "smallest")


@query("""WITH e AS (SELECT event_id, user_id, event_type, ts, lead(event_id) OVER w AS answer_id, lead(event_type) OVER w AS answer, lead(ts) OVER w AS answered FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, answer_id, CASE answer WHEN 'error' THEN 'cancelled' WHEN 'signup' THEN 'asked_again' ELSE 'renamed' END AS outcome, CAST(floor(epoch(answered)) - floor(epoch(ts)) AS BIGINT) AS seconds FROM e WHERE event_type = 'signup' AND answer_id IS NOT NULL""")
def rename_dialog(spark, sf_dir):
    """A rename waits for the user's next message: a name, a cancellation, or another request."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    turns = table(spark, sf_dir, "events").withColumns({"answer_id": F.lead("event_id").over(w), "answer": F.lead("event_type").over(w), "answered": F.lead("ts").over(w)})
    outcome = F.when(F.col("answer") == "error", "cancelled").when(F.col("answer") == "signup", "asked_again").otherwise("renamed")
    seconds = F.unix_timestamp(F.col("answered").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return turns.where("event_type = 'signup' and answer_id is not null").select("event_id", "user_id", "answer_id", outcome.alias("outcome"), seconds.alias("seconds"))


@query("SELECT c_custkey, trim(lower(c_mktsegment)) AS folded, replace(c_name, '#', '') AS squeezed, CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT) AS number, length(c_name) AS width FROM customer")
def scalar_texts(spark, sf_dir):
    """Folding, removal, capture and length of texts."""
    number = F.regexp_extract("c_name", r"(\d+)", 1).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", text.trimmed(F.lower("c_mktsegment")).alias("folded"), F.replace("c_name", F.lit("#"), F.lit("")).alias("squeezed"), number.alias("number"), F.length("c_name").cast("long").alias("width"))
