"""Queries on stored logs, changes to the catalogue, command arguments and the alias file."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import commands, names, text
from cardloom.operators import ballots, lineage, pools
from cardloom.plans.catalogue import _ALIASES, _held
from cardloom.plans.registry import query
from cardloom.plans.state import _BALLOTS, SECONDS, SUPERUSERS, _votes, history_json, move_log_join
from cardloom.sources import files, logs
from cardloom.sources.tables import CATALOG_SQL, DRAWS_SQL, HOLDING_SQL, catalog, draws, table

_DRAWS = f"WITH {CATALOG_SQL}, {DRAWS_SQL} "
_HELD = f"WITH {CATALOG_SQL}, {DRAWS_SQL}, {HOLDING_SQL} "


# -- stored logs -------------------------------------------------------------------


@query(_HELD + """, f AS (SELECT h.user_id, h.pool, h.ts, n.file_name, row_number() OVER (PARTITION BY h.user_id, h.pool ORDER BY n.item_id) AS k FROM holding h
JOIN named n ON n.series = split_part(h.card, '_', 1) AND n."character" = split_part(h.card, '_', 2) AND n.pool = h.pool)
SELECT CAST(user_id AS VARCHAR) AS user_id, pool AS card_type, 'move_' || lower(pool) AS command, CAST(k - 1 AS INT) AS k, file_name AS image, CAST(floor(epoch(ts)) AS BIGINT) AS used FROM f""")
def move_log(spark, sf_dir):
    """Moves appended to their log, a pool at a time, and read back with their lists."""
    folder = lineage.new_folder(spark, "logs")
    logs.create(spark, folder)
    lines = move_log_join(spark, sf_dir).join(_held(spark, sf_dir).select("user_id", "pool", "ts"), ["user_id", "pool"])
    rows = lines.select(F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("move_"), F.lower("pool")).alias("command"), F.col("moved").alias("moved_images"), F.col("ts").alias("usage_time"), F.col("pool").alias("card_type"))
    for pool in ("A", "B"):
        logs.append(rows.where(F.col("card_type") == pool), folder, "moves")
    back = logs.moves(spark, folder).select("*", F.posexplode("moved_images").alias("k", "image"))
    return back.select("user_id", "card_type", "command", "k", "image", F.unix_timestamp("usage_time").alias("used"))


@query(_BALLOTS + """ SELECT 'image_' || ballot AS image_name, CAST(owner AS VARCHAR) AS owner, CASE WHEN CASE WHEN decision IS NOT NULL THEN decision = 'agree' ELSE agree >= 1 AND agree > disagree END THEN 'remove' ELSE 'keep' END AS result,
CAST(agree AS INT) AS agree, CAST(disagree AS INT) AS disagree FROM tally""")
def ballot_store(spark, sf_dir):
    """Ballots saved twice, first without votes; the last save of an image is its ballot, and its lists hold who counted."""
    folder = lineage.new_folder(spark, "logs")
    logs.create(spark, folder)
    votes, opened = _votes(spark, sf_dir)
    first = ballots.first_votes(ballots.in_time(votes, opened, SECONDS))
    decided = ballots.decisions(first, SUPERUSERS)
    counted = first.join(decided, "ballot", "left").where(F.col("decided_at").isNull() | (F.struct("ts", "seq") <= F.struct("decided_at", "decided_seq")))
    lists = ballots.voters(counted.select("ballot", F.col("voter").cast("string").alias("voter"), "choice"))
    saved = ballots.results(votes, opened, SECONDS, SUPERUSERS).select("ballot", "owner", "result").join(lists, "ballot", "left").join(opened.select("ballot", "opened"), "ballot")
    kinds = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("agree", "disagree", "abstain")]
    row = [F.col("owner").cast("string").alias("owner_user_id"), F.concat(F.lit("image_"), F.col("ballot").cast("string")).alias("image_name")]
    logs.append(saved.select(F.lit(1).alias("id"), *row, F.lit("keep").alias("vote_result"), F.col("opened").alias("vote_time")), folder, "votes")
    logs.append(saved.select(F.lit(2).alias("id"), *row, F.col("result").alias("vote_result"), F.expr(f"opened + interval {SECONDS} seconds").alias("vote_time"), F.struct(*kinds).alias("voters")), folder, "votes")
    back = logs.ballots(spark, folder)
    return back.select("image_name", F.col("owner_user_id").alias("owner"), F.col("vote_result").alias("result"), F.size("voters.agree").alias("agree"), F.size("voters.disagree").alias("disagree"))


@query(_DRAWS + "SELECT CAST(user_id AS VARCHAR) AS user_id, pool, CAST(row_number() OVER (PARTITION BY user_id, pool ORDER BY ts, seq) - 1 AS INT) AS k, card, strftime(ts, '%Y-%m-%d %H:%M:%S') AS drawn, count(*) OVER (PARTITION BY user_id, pool) AS total_count FROM draws")
def history_decode(spark, sf_dir):
    """Histories stored as JSON and decoded again."""
    folder = lineage.new_folder(spark, "logs")
    logs.create(spark, folder)
    rows = history_json(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id"), F.col("pool").alias("card_type"), "history", "total_count")
    logs.append(rows, folder, "history")
    back = logs.histories(spark, folder).select("user_id", F.col("card_type").alias("pool"), "total_count", F.posexplode("history").alias("k", "x"))
    return back.select("user_id", "pool", "k", F.col("x.card_name").alias("card"), F.col("x.timestamp").alias("drawn"), "total_count")


@query(_DRAWS + "SELECT user_id, pool, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_draw FROM draws GROUP BY user_id, pool")
def parse_time(spark, sf_dir):
    """Times written as text and parsed again."""
    last = draws(spark, sf_dir).groupBy("user_id", "pool").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("at"))
    return last.select("user_id", "pool", F.unix_timestamp("at", "yyyy-MM-dd HH:mm:ss").alias("last_draw"))


# -- changes to the catalogue ----------------------------------------------------------


_MOVES = """asked AS (SELECT h.user_id, h.card, h.pool, CASE h.pool WHEN 'A' THEN 'B' ELSE 'A' END AS "to", h.ts, h.seq FROM holding h WHERE h.user_id IN (SELECT user_id FROM events WHERE event_type = 'error')),
found AS (SELECT a.*, n.item_id, n.file_name, n.stem, row_number() OVER (PARTITION BY n.item_id ORDER BY a.ts, a.seq) = 1 AS ok FROM asked a
  JOIN named n ON n.pool = a.pool AND n.series = split_part(a.card, '_', 1) AND n."character" = split_part(a.card, '_', 2))"""


def _found(spark, sf_dir):
    """Users with an error event ask to move what they hold to the other pool."""
    users = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id").distinct()
    asked = _held(spark, sf_dir).join(users, "user_id", "left_semi").withColumn("to", F.when(F.col("pool") == "A", "B").otherwise("A"))
    return pools.requested(catalog(spark, sf_dir), asked.select("user_id", "card", "pool", "to", "ts", "seq"))


@query(f"WITH {CATALOG_SQL}, {DRAWS_SQL}, {HOLDING_SQL}, {_MOVES} SELECT n.item_id, coalesce(f.\"to\", n.pool) AS pool FROM named n LEFT JOIN found f ON f.item_id = n.item_id AND f.ok")
def reclassified(spark, sf_dir):
    """The catalogue after users moved what they hold to the other pool."""
    return pools.moved(catalog(spark, sf_dir), _found(spark, sf_dir)).select("item_id", "pool")


@query(f"""WITH {CATALOG_SQL}, {DRAWS_SQL}, {HOLDING_SQL}, {_MOVES} SELECT user_id, card, coalesce(string_agg(stem, ', ' ORDER BY item_id) FILTER (ok), '') AS moved, coalesce(string_agg(file_name, ', ' ORDER BY item_id) FILTER (NOT ok), '') AS failed FROM found GROUP BY user_id, card, "to", seq""")
def reclassify_report(spark, sf_dir):
    """What each request moved, and what it could not move as an earlier one had."""
    found = pools.report(_found(spark, sf_dir))
    return found.select("user_id", "card", F.array_join("moved", ", ").alias("moved"), F.array_join("failed", ", ").alias("failed"))


@query(_HELD + "SELECT h.user_id, h.pool, arg_min(n.file_name, n.item_id) AS first_file, count(*) AS files, CASE WHEN count(*) > 2 THEN 'forward' ELSE 'inline' END AS mode FROM holding h JOIN named n ON n.series = split_part(h.card, '_', 1) AND n.\"character\" = split_part(h.card, '_', 2) GROUP BY h.user_id, h.pool")
def reply_mode(spark, sf_dir):
    """The first file of each held character, how many there are, and how they are sent."""
    held = _held(spark, sf_dir).select("user_id", "pool", names.two_part(F.col("card")).alias("_id"))
    items = catalog(spark, sf_dir).select("item_id", "file_name", names.two_part(F.col("stem")).alias("_id"))
    found = held.join(items, "_id").groupBy("user_id", "pool").agg(F.min_by("file_name", "item_id").alias("first_file"), F.count(F.lit(1)).alias("files"))
    return found.withColumn("mode", commands.reply_mode(F.col("files")))


# -- command arguments and the alias file ------------------------------------------------


_MESSAGES = """messages AS (SELECT item_id, CASE item_id % 6 WHEN 0 THEN '抽' || series || '老婆' WHEN 1 THEN '老婆改名 ' || stem || ' ' WHEN 2 THEN '老婆概率' || item_id % 40 WHEN 3 THEN '老公概率' || ['一', '二十', '三十五', '一百二'][CAST(item_id % 4 + 1 AS INT)]
  WHEN 4 THEN '投票删除' || file_name ELSE '抽' || CASE WHEN item_id % 5 = 0 THEN '' ELSE ' ' || kind || ' ' END END AS message FROM named)"""


def _messages(spark, sf_dir):
    m = F.col("item_id") % 6
    number = F.get(F.array(*[F.lit(x) for x in ("一", "二十", "三十五", "一百二")]), (F.col("item_id") % 4).cast("int"))
    drawn = F.when(F.col("item_id") % 5 == 0, "").otherwise(F.concat(F.lit(" "), F.col("kind"), F.lit(" ")))
    message = (
        F.when(m == 0, F.concat(F.lit("抽"), F.col("series"), F.lit("老婆"))).when(m == 1, F.concat(F.lit("老婆改名 "), F.col("stem"), F.lit(" ")))
        .when(m == 2, F.concat(F.lit("老婆概率"), (F.col("item_id") % 40).cast("string"))).when(m == 3, F.concat(F.lit("老公概率"), number))
        .when(m == 4, F.concat(F.lit("投票删除"), F.col("file_name"))).otherwise(F.concat(F.lit("抽"), drawn))
    )
    return catalog(spark, sf_dir).select("item_id", message.alias("message"))


@query(f"""WITH {CATALOG_SQL}, {_MESSAGES} SELECT item_id, CASE WHEN message LIKE '抽%' AND message LIKE '%老婆%' AND message NOT LIKE '%老公%' THEN 'draw_a' WHEN message LIKE '老婆改名%' THEN 'rename_a' WHEN message LIKE '老婆概率%' THEN 'share_a'
WHEN message LIKE '老公概率%' THEN 'share_b' WHEN message LIKE '投票删除%' THEN 'vote' END AS command,
CASE WHEN message LIKE '老婆改名%' OR message LIKE '老婆概率%' OR message LIKE '老公概率%' OR message LIKE '投票删除%' THEN nullif(trim(substr(message, 5)), '') END AS argument FROM messages""")
def command_argument(spark, sf_dir):
    """The command of each message and what follows its prefix."""
    return _messages(spark, sf_dir).select("item_id", commands.command(F.col("message")).alias("command"), commands.argument(F.col("message")).alias("argument"))


@query(f"""WITH {CATALOG_SQL}, {_MESSAGES} SELECT item_id, CASE item_id % 6 WHEN 2 THEN nullif(item_id % 40, -1) WHEN 3 THEN [1, 20, 35, 1002][CAST(item_id % 4 + 1 AS INT)] END::INT AS wanted FROM messages WHERE message LIKE '%概率%'""")
def share_limit(spark, sf_dir):
    """How many rows a share command asks for, in digits or numerals."""
    rows = _messages(spark, sf_dir).where(F.contains("message", F.lit("概率")))
    return rows.select("item_id", text.number_after(F.col("message"), "概率").alias("wanted"))


@query(f"""WITH {CATALOG_SQL}, {_MESSAGES} SELECT item_id, trim(replace(lower(substr(message, 2)), '老婆', '')) AS target FROM messages WHERE message LIKE '抽%'""")
def draw_target(spark, sf_dir):
    """What a draw command asks for between its verb and its noun, either of which may stand alone."""
    rows = _messages(spark, sf_dir).where(F.startswith("message", F.lit("抽")))
    return rows.select("item_id", text.optional_target(F.col("message"), "抽", "老婆").alias("target"))


@query(f"SELECT lower(x.alias) AS alias, arg_max(x.name, x.k) AS name FROM (SELECT unnest([{', '.join(repr(a) for a, _ in _ALIASES)}, {', '.join(repr(n) for n in dict.fromkeys(n for _, n in _ALIASES))}]) AS alias, unnest([{', '.join(repr(n) for _, n in _ALIASES)}, {', '.join(repr(n) for n in dict.fromkeys(n for _, n in _ALIASES))}]) AS name, unnest(range({len(_ALIASES) + len({n for _, n in _ALIASES})})) AS k) x GROUP BY 1")
def alias_file(spark, sf_dir):
    """The alias dictionary, written as a file and loaded from it."""
    entries = [f"  - name: {name}\n    aliases:\n" + "".join(f"      - {a}\n" for a, n in _ALIASES if n == name) for name in dict.fromkeys(n for _, n in _ALIASES)]
    folder = lineage.new_folder(spark, "aliases")
    spark.createDataFrame([("games:\n" + "".join(entries),)], "value string").coalesce(1).write.text(folder)
    return files.alias_file(spark, folder)


@query("SELECT 'doc-' || doc_id AS file_name, text IS NOT NULL AND doc_id % 4 <> 0 AS ok FROM documents")
def verified_files(spark, sf_dir):
    """Files against the digests that are expected of them; every fourth expectation is of another content."""
    docs = table(spark, sf_dir, "documents").withColumn("file_name", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    wanted = F.upper(F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256))
    return files.verified(docs.select("file_name", F.sha2("text", 256).alias("sha256")), docs.select("file_name", wanted.alias("sha256")))
