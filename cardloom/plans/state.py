"""Queries on state from events: holdings, histories, ballots, replies, scores, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import names, text
from cardloom.operators import ballots, holdings, replies, scoring
from cardloom.plans.catalogue import _held
from cardloom.plans.registry import query
from cardloom.sources import images
from cardloom.sources.tables import CATALOG_SQL, DRAWS_SQL, HOLDING_SQL, catalog, draws, table

_DRAWS = f"WITH {CATALOG_SQL}, {DRAWS_SQL} "
_HELD = f"WITH {CATALOG_SQL}, {DRAWS_SQL}, {HOLDING_SQL} "


@query(_HELD + "SELECT user_id, pool, card, ts FROM holding")
def current_holding(spark, sf_dir):
    """The last card of each user and pool."""
    return _held(spark, sf_dir).select("user_id", "pool", "card", "ts")


@query(_HELD + "SELECT user_id, card FROM holding WHERE pool = 'A' AND lower(card) LIKE 'brand#1_%'")
def held_like_prefix(spark, sf_dir):
    """Holdings of a series by LIKE as it is: the underscore is a wildcard and catches longer numbers too."""
    return _held(spark, sf_dir).where((F.col("pool") == "A") & F.lower("card").like("brand#1_%")).select("user_id", "card")


@query(_HELD + "SELECT user_id, card FROM holding WHERE pool = 'A' AND lower(split_part(card, '_', 1)) = 'brand#1'")
def held_in_series(spark, sf_dir):
    """Holdings of exactly one series."""
    return _held(spark, sf_dir).where((F.col("pool") == "A") & (F.lower(names.series(F.col("card"))) == "brand#1")).select("user_id", "card")


@query(_HELD + "SELECT pool, lower(split_part(card, '_', 2)) AS \"character\", count(*) AS holders FROM holding GROUP BY ALL")
def held_characters(spark, sf_dir):
    held = _held(spark, sf_dir).select("pool", F.lower(names.character(F.col("card"))).alias("character"))
    return held.groupBy("pool", "character").agg(F.count(F.lit(1)).alias("holders"))


@query(_HELD + ", deletes AS (SELECT user_id, max(ts) AS deleted FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT user_id, pool, card FROM holding LEFT JOIN deletes USING (user_id) WHERE deleted IS NULL OR deleted < ts")
def holding_after_delete(spark, sf_dir):
    """Holdings that no later delete (an error event) removed."""
    deletes = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "ts")
    return holdings.without_deleted(_held(spark, sf_dir), deletes, ["user_id"]).select("user_id", "pool", "card")


@query("SELECT u.user_id, CAST(CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 END AS INT) AS read_help FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND event_id % 40 = 0) t USING (user_id)")
def user_get_or_create(spark, sf_dir):
    """Every user with the accepted flag, 0 by default."""
    events = table(spark, sf_dir, "events")
    return holdings.get_or_create(events.select("user_id").distinct(), events.where("event_type = 'signup' and event_id % 40 = 0"))


@query("""WITH users AS (SELECT user_id, max(CASE WHEN event_type = 'signup' AND event_id % 40 = 0 THEN 1 ELSE 0 END) AS read_help FROM events GROUP BY user_id)
SELECT user_id, CAST(CASE WHEN read_help = 0 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'click' AND event_id % 50 = 0) THEN 1 ELSE read_help END AS INT) AS read_help FROM users""")
def mark_terms(spark, sf_dir):
    """Accepting the terms sets the flag once and inserts nobody."""
    events = table(spark, sf_dir, "events")
    return holdings.mark_read(user_get_or_create(spark, sf_dir), events.where("event_type = 'click' and event_id % 50 = 0"))


@query(_DRAWS + "SELECT user_id, pool, list(card ORDER BY ts, seq) AS history, count(*) AS total_count, max(ts) AS last_draw_time FROM draws GROUP BY user_id, pool")
def history_list(spark, sf_dir):
    """All draws of each user and pool, in order."""
    return holdings.history(draws(spark, sf_dir), ["user_id", "pool"], ["ts", "seq"], F.col("card"))


@query(_DRAWS + "SELECT seq, user_id, pool, count(*) OVER (PARTITION BY user_id, pool ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS running_total FROM draws")
def history_total(spark, sf_dir):
    """The running number of draws."""
    return holdings.running_total(draws(spark, sf_dir), ["user_id", "pool"], ["ts", "seq"]).select("seq", "user_id", "pool", "running_total")


@query(_DRAWS + """SELECT user_id, pool, CAST(to_json(list({'timestamp': strftime(ts, '%Y-%m-%d %H:%M:%S'), 'card_name': card} ORDER BY ts, seq)) AS VARCHAR) AS history, count(*) AS total_count FROM draws GROUP BY user_id, pool""")
def history_json(spark, sf_dir):
    """Histories as JSON text."""
    entry = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("card").alias("card_name"))
    return holdings.history(draws(spark, sf_dir), ["user_id", "pool"], ["ts", "seq"], entry).select("user_id", "pool", F.to_json("history").alias("history"), "total_count")


@query(_DRAWS + "SELECT user_id, pool, 2 * count(*) + (SELECT count(*) FROM events e WHERE e.user_id = d.user_id AND e.event_type = 'signup') AS faithful_count FROM draws d GROUP BY user_id, pool")
def history_faithful_count(spark, sf_dir):
    """The count as the original log keeps it: a draw is logged twice, a rename once more."""
    n = draws(spark, sf_dir).groupBy("user_id", "pool").agg(F.count(F.lit(1)).alias("n"))
    renames = table(spark, sf_dir, "events").where("event_type = 'signup'").groupBy("user_id").agg(F.count(F.lit(1)).alias("r"))
    return n.join(renames, "user_id", "left").select("user_id", "pool", (2 * F.col("n") + F.coalesce("r", F.lit(0))).alias("faithful_count"))


@query(_HELD + """SELECT h.user_id, h.pool, string_agg(n.file_name, ', ' ORDER BY n.item_id) AS moved, count(*) AS files FROM holding h
JOIN named n ON n.series = split_part(h.card, '_', 1) AND n."character" = split_part(h.card, '_', 2) AND n.pool = h.pool GROUP BY h.user_id, h.pool""")
def move_log_join(spark, sf_dir):
    """What a re-classification of each holding would move, as one delimited line."""
    held = _held(spark, sf_dir).select("user_id", "pool", names.series(F.col("card")).alias("series"), names.character(F.col("card")).alias("character"))
    files = held.join(catalog(spark, sf_dir), ["pool", "series", "character"])
    listed = F.sort_array(F.collect_list(F.struct("item_id", "file_name")))
    return files.groupBy("user_id", "pool").agg(F.array_join(F.transform(listed, lambda x: x["file_name"]), ", ").alias("moved"), F.count(F.lit(1)).alias("files"))


@query(_DRAWS + ", g AS (SELECT seq, user_id, pool, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id, pool ORDER BY ts, seq))) AS BIGINT) AS gap FROM draws) SELECT seq, user_id, pool, gap FROM g WHERE gap IS NULL OR gap >= 36000")
def cooldown_gap(spark, sf_dir):
    """Draws at least ten hours after the one before."""
    return holdings.cooled_down(draws(spark, sf_dir), ["user_id", "pool"], "ts", 36000).select("seq", "user_id", "pool", "gap")


# -- ballots ---------------------------------------------------------------------

SECONDS, SUPERUSERS = 6 * 3600, [1]

_BALLOTS = f"""WITH votes AS (
  SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) // 86400 AS ballot, user_id AS voter, event_id AS seq, ts,
         CASE event_type WHEN 'click' THEN 'agree' WHEN 'view' THEN 'disagree' WHEN 'error' THEN 'abstain' END AS choice FROM events),
ballots AS (SELECT ballot, min(voter) AS owner, min(ts) AS opened FROM votes GROUP BY ballot),
timely AS (SELECT v.*, owner, opened FROM votes v JOIN ballots b USING (ballot) WHERE choice IS NOT NULL AND ts >= opened AND ts < opened + INTERVAL {SECONDS} SECOND),
first_votes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ballot, voter ORDER BY ts, seq) AS k FROM timely) WHERE k = 1),
decided AS (SELECT ballot, min((ts, seq)) AS at, arg_min(choice, (ts, seq)) AS decision FROM first_votes WHERE choice IN ('agree', 'disagree') AND (voter = owner OR voter IN (1)) GROUP BY ballot),
counted AS (SELECT f.*, decision FROM first_votes f LEFT JOIN decided d USING (ballot) WHERE d.at IS NULL OR (ts, seq) <= d.at),
tally AS (SELECT b.ballot, b.owner, count(*) FILTER (choice = 'agree') AS agree, count(*) FILTER (choice = 'disagree') AS disagree, count(*) FILTER (choice = 'abstain') AS abstain, max(decision) AS decision
  FROM ballots b LEFT JOIN counted c ON b.ballot = c.ballot GROUP BY b.ballot, b.owner)"""


def votes_of(events):
    """ballot, voter, choice, ts, seq from events; a day is a ballot."""
    choice = F.when(F.col("event_type") == "click", "agree").when(F.col("event_type") == "view", "disagree").when(F.col("event_type") == "error", "abstain")
    return events.select(F.unix_date(F.to_date("ts")).cast("long").alias("ballot"), F.col("user_id").alias("voter"), choice.alias("choice"), "ts", F.col("event_id").alias("seq"))


def ballots_of(votes):
    return votes.groupBy("ballot").agg(F.min("voter").alias("owner"), F.min("ts").alias("opened"))


def _votes(spark, sf_dir):
    votes = votes_of(table(spark, sf_dir, "events"))
    return votes, ballots_of(votes)


@query(_BALLOTS + " SELECT ballot, voter, choice, seq FROM first_votes")
def ballot_first_votes(spark, sf_dir):
    """The vote of each voter that counts."""
    votes, opened = _votes(spark, sf_dir)
    return ballots.first_votes(ballots.in_time(votes, opened, SECONDS)).select("ballot", "voter", "choice", "seq")


@query(_BALLOTS + " SELECT ballot, agree, disagree, abstain FROM tally")
def ballot_tally(spark, sf_dir):
    votes, opened = _votes(spark, sf_dir)
    return ballots.results(votes, opened, SECONDS, SUPERUSERS).select("ballot", "agree", "disagree", "abstain")


@query(_BALLOTS + " SELECT ballot, owner, decision IS NOT NULL AS early, CASE WHEN CASE WHEN decision IS NOT NULL THEN decision = 'agree' ELSE agree >= 1 AND agree > disagree END THEN 'remove' ELSE 'keep' END AS result FROM tally")
def ballot_result(spark, sf_dir):
    """The result of each ballot."""
    votes, opened = _votes(spark, sf_dir)
    return ballots.results(votes, opened, SECONDS, SUPERUSERS).select("ballot", "owner", "early", "result")


@query(_BALLOTS + """ SELECT ballot, arg_min(choice, (ts, seq)) AS decision, arg_min(seq, (ts, seq)) AS decided_seq FROM first_votes
WHERE choice IN ('agree', 'disagree') AND (voter = owner OR voter IN (1)) GROUP BY ballot""")
def ballot_early_result(spark, sf_dir):
    """The vote that decided a ballot before its time."""
    votes, opened = _votes(spark, sf_dir)
    return ballots.decisions(ballots.first_votes(ballots.in_time(votes, opened, SECONDS)), SUPERUSERS).select("ballot", "decision", "decided_seq")


@query(_BALLOTS + """ SELECT ballot, coalesce(list(DISTINCT voter ORDER BY voter) FILTER (choice = 'agree'), []) AS agree, coalesce(list(DISTINCT voter ORDER BY voter) FILTER (choice = 'disagree'), []) AS disagree,
coalesce(list(DISTINCT voter ORDER BY voter) FILTER (choice = 'abstain'), []) AS abstain FROM first_votes GROUP BY ballot""")
def ballot_voters_by_choice(spark, sf_dir):
    votes, opened = _votes(spark, sf_dir)
    return ballots.voters(ballots.first_votes(ballots.in_time(votes, opened, SECONDS)))


@query("""SELECT event_id, event_id % 300 AS image FROM events WHERE event_type = 'purchase' AND event_id % 300 NOT IN (SELECT event_id % 300 FROM events WHERE event_type = 'click' AND event_id % 3 = 0)
AND event_id % 300 NOT IN (SELECT event_id % 300 FROM events WHERE event_type = 'view' AND event_id % 7 = 0)""")
def ballot_open_filter(spark, sf_dir):
    """Requests for images without an active or stored ballot."""
    events = table(spark, sf_dir, "events").withColumn("image", F.col("event_id") % 300)
    asked, active, stored = events.where("event_type = 'purchase'"), events.where("event_type = 'click' and event_id % 3 = 0"), events.where("event_type = 'view' and event_id % 7 = 0")
    return ballots.open_requests(asked.select("event_id", "image"), active, stored)


# -- replies -----------------------------------------------------------------------


@query("""WITH RECURSIVE m AS (SELECT conv_id * 1000 + turn AS message_id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS reply_to, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS sender FROM conversations),
w AS (SELECT message_id, message_id AS root_id, sender FROM m WHERE reply_to IS NULL UNION ALL SELECT m.message_id, w.root_id, w.sender FROM m JOIN w ON m.reply_to = w.message_id)
SELECT DISTINCT m.message_id, coalesce(w.root_id, m.message_id) AS root_id, CAST(coalesce(w.sender, 0) AS INT) AS sender_id FROM m LEFT JOIN w USING (message_id)""")
def reply_root(spark, sf_dir):
    """The root and its sender of every message."""
    role = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("reply_to"), role.alias("sender_id"))
    return replies.roots(turns.dropDuplicates(["message_id"])).select("message_id", "root_id", F.col("sender_id").cast("int").alias("sender_id"))


# -- tag scores --------------------------------------------------------------------

#: Four tags in sixty-four for each group, and four that name both.
_TAGS = [{0: "boy", 4: "girl", 8: "boy_girl"}.get(i % 16, "other") + f"_{i}" for i in range(64)]
_SCORES = f"""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: 1 / (1 + exp(-20 * CAST(x AS DOUBLE)))) AS v, [{', '.join(map(repr, _TAGS))}] AS tags FROM embeddings),
g AS (SELECT vec_id, list_sum([v[i] FOR i IN range(1, 65) IF contains(tags[i], 'boy')]) AS b, list_sum([v[i] FOR i IN range(1, 65) IF contains(tags[i], 'girl')]) AS g FROM s),
c AS (SELECT vec_id, round(CASE WHEN b + g > 0 THEN b / (b + g) ELSE b END, 6) AS boy, round(CASE WHEN b + g > 0 THEN g / (b + g) ELSE g END, 6) AS girl FROM g)"""


def _scores(spark, sf_dir):
    scores = F.transform("embedding", lambda x: 1 / (1 + F.exp(-20 * x.cast("double"))))
    tags = F.array(*[F.lit(t) for t in _TAGS])
    return scoring.confidence(table(spark, sf_dir, "embeddings").select("vec_id", scores.alias("scores"), tags.alias("tags")))


@query(_SCORES + " SELECT vec_id, boy, girl FROM c")
def tag_confidence(spark, sf_dir):
    """Shares of two tag groups."""
    return _scores(spark, sf_dir).select("vec_id", "boy", "girl")


@query(_SCORES + " SELECT vec_id, boy FROM c WHERE boy > 0.6")
def tag_suspicious(spark, sf_dir):
    """Scores above the threshold."""
    return scoring.suspicious(_scores(spark, sf_dir), "boy").select("vec_id", "boy")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding), 6) AS mean FROM embeddings")
def score_udf(spark, sf_dir):
    """A model hook: batches go to a scorer that each worker makes once (here, the mean)."""

    def make():
        def score(batch):
            return batch[["vec_id"]].assign(mean=[round(float(sum(map(float, v))) / len(v), 6) for v in batch["embedding"]])

        return score

    return scoring.with_model(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), make, "vec_id long, mean double")


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 200 ELSE 50 END) AS v FROM embeddings),
m AS (SELECT vec_id, list_sum(v) / 64.0 / 255 AS mean, list_max(v) = list_min(v) OR vec_id = (SELECT min(vec_id) FROM embeddings) AS broken FROM p)
SELECT vec_id, CASE WHEN broken THEN 0.0 ELSE round(mean, 4) END AS boy, CASE WHEN broken THEN 0.0 ELSE round(1 - mean, 4) END AS girl FROM m""")
def image_scores(spark, sf_dir):
    """Vectors as grey images of 8 by 8, decoded and scored; one is cut off and gets no score."""
    pixels = F.unhex(F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "C8").otherwise("32")), ""))
    whole = F.concat(F.encode(F.lit("P5 8 8 255\n"), "utf-8"), pixels)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("content"))
    first = rows.agg(F.min("vec_id").alias("_first"))  # one row
    rows = rows.crossJoin(F.broadcast(first)).withColumn("content", F.when(F.col("vec_id") == F.col("_first"), F.substring("content", 1, 40)).otherwise(F.col("content")))

    def make():
        return lambda x: (float(x.mean(dtype="float64")), 1 - float(x.mean(dtype="float64")))

    found = images.scored(rows.select(F.col("vec_id").cast("string").alias("file_name"), "content"), make)
    return found.select(F.col("file_name").cast("long").alias("vec_id"), F.round("boy", 4).alias("boy"), F.round("girl", 4).alias("girl"))


# -- texts -------------------------------------------------------------------------


@query("""WITH t AS (SELECT event_id, event_id * 37 AS s FROM events)
SELECT event_id, CASE WHEN s >= 86400 THEN (s // 86400) || 'd' ELSE '' END || CASE WHEN s // 3600 % 24 > 0 THEN (s // 3600 % 24) || 'h' ELSE '' END
|| CASE WHEN s // 60 % 60 > 0 THEN (s // 60 % 60) || 'm' ELSE '' END || CASE WHEN s % 60 > 0 OR s < 60 THEN (s % 60) || 's' ELSE '' END AS shown FROM t""")
def format_elapsed(spark, sf_dir):
    """Seconds as days, hours, minutes, seconds."""
    return table(spark, sf_dir, "events").select("event_id", text.elapsed(F.col("event_id") * 37).alias("shown"))


_NUMERALS = {"一": 1, "十": 10, "十二": 12, "二十": 20, "二十三": 23, "一百": 100, "一百二十": 120, "二百三十四": 234, "一百五": 1005, "二二": 22, "百": 100, "十五": 15, "九百九十九": 999, "x": None}


@query("SELECT unnest([" + ", ".join(map(repr, _NUMERALS)) + "]) AS numeral, unnest([" + ", ".join("NULL" if v is None else str(v) for v in _NUMERALS.values()) + "])::INT AS value")
def numeral_parse(spark, sf_dir):
    """Chinese numerals, with their documented oddities."""
    return spark.createDataFrame([(n,) for n in _NUMERALS], "numeral string").select("numeral", text.numeral(F.col("numeral")).cast("int").alias("value"))


@query("WITH t AS (SELECT p_partkey AS item_id, CAST(p_partkey % 999 + 1 AS INT) AS value FROM part) SELECT item_id, value FROM t WHERE value < 100 OR value // 10 % 10 > 0 OR value % 10 = 0")
def numeral_values(spark, sf_dir):
    """Numbers below a thousand written as numerals and parsed again (those that need no zero between their digits)."""
    n = F.col("n")
    digit = F.array(*[F.lit(x) for x in ("", *text.DIGITS)])
    h, t, u = (F.expr(x) for x in ("n div 100", "n div 10 % 10", "n % 10"))
    tens = F.when(t == 0, "").otherwise(F.concat(F.when((h == 0) & (t == 1), "").otherwise(F.get(digit, t.cast("int"))), F.lit(text.TEN)))
    written = F.concat(F.when(h > 0, F.concat(F.get(digit, h.cast("int")), F.lit(text.HUNDRED))).otherwise(""), tens, F.get(digit, u.cast("int")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), (F.col("p_partkey") % 999 + 1).alias("n"))
    return rows.where((n < 100) | (t > 0) | (u == 0)).select("item_id", text.numeral(written).cast("int").alias("value"))


@query(r"SELECT doc_id, trim(split_part(split_part(text, 'the ', 2), chr(10), 1)) AS found FROM documents WHERE contains(text, 'the ')")
def between_markers(spark, sf_dir):
    """What stands between a marker and the end of the line."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("the ")))
    return docs.select("doc_id", text.between(F.col("text"), "the ").alias("found"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, to_json({'id': event_id, 'kind': event_type}) AS packed FROM events")
def props_json(spark, sf_dir):
    """JSON in and out."""
    props = F.from_json("props", "k int")
    packed = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    return table(spark, sf_dir, "events").select("event_id", props["k"].alias("k"), packed.alias("packed"))
