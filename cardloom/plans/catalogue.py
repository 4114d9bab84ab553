"""Queries on the catalogue: names, statistics, availability, siblings, renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import names, text
from cardloom.operators import holdings, matching, selection, stats
from cardloom.plans.registry import query
from cardloom.sources.tables import CATALOG_SQL, DRAWS_SQL, HOLDING_SQL, catalog, draws, table

_NAMED = f"WITH {CATALOG_SQL} "
_HELD = f"WITH {CATALOG_SQL}, {DRAWS_SQL}, {HOLDING_SQL} "
_STATS = """stats AS (
  SELECT pool, series, CAST(count(*) AS BIGINT) AS items, count(DISTINCT "character") AS characters,
         round(100.0 * count(*) / max(total), 6) AS share, round(count(*) / count(DISTINCT "character"), 6) AS avg_skins
  FROM (SELECT *, count(*) OVER (PARTITION BY pool) AS total FROM named) WHERE stem LIKE '%\\_%' ESCAPE '\\' GROUP BY pool, series)"""
_RANKED = f"WITH {CATALOG_SQL}, {_STATS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY items DESC, series) AS rank FROM stats) "


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, pool, card, ts: what every user holds in each pool."""
    return holdings.last_wins(draws(spark, sf_dir).withColumn("at", F.col("ts")), ["user_id", "pool"], ["at", "seq"], ["card", "ts", "seq"])


# -- names -------------------------------------------------------------------


@query(_NAMED + """SELECT item_id, pool, file_name, series, "character", stem FROM named""")
def catalog_names(spark, sf_dir):
    """The catalogue with the parts of its names."""
    return catalog(spark, sf_dir).select("item_id", "pool", "file_name", "series", "character", "stem")


@query(_NAMED + "SELECT item_id, stem, substr(file_name, length(stem) + 1) AS ext FROM named")
def stem_split(spark, sf_dir):
    return catalog(spark, sf_dir).select("item_id", "stem", names.extension(F.col("file_name")).alias("ext"))


@query(_NAMED + "SELECT item_id, array_to_string(string_split(stem, '_')[3:], '_') AS suffix FROM named")
def suffix_project(spark, sf_dir):
    return catalog(spark, sf_dir).select("item_id", names.suffix(F.col("stem")).alias("suffix"))


@query(_NAMED + r"SELECT item_id, stem FROM named WHERE regexp_matches(replace(stem, '-', CASE WHEN item_id % 3 = 0 THEN ' ' ELSE '-' END), '^[^\s_]+(_[^\s_]+)+$')")
def name_grammar_filter(spark, sf_dir):
    """Names that a rename may give; every third is spoilt by a space first."""
    spoilt = F.replace("stem", F.lit("-"), F.when(F.col("item_id") % 3 == 0, " ").otherwise("-"))
    return catalog(spark, sf_dir).where(names.is_new_name(spoilt)).select("item_id", "stem")


@query("SELECT p_partkey AS item_id FROM part WHERE length(p_name) - length(replace(p_name, ' ', '')) >= 1")
def underscore_filter(spark, sf_dir):
    """Names with at least one separator (in this table a space)."""
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return table(spark, sf_dir, "part").where(names.is_listed(name)).select(F.col("p_partkey").alias("item_id"))


@query(_NAMED + """SELECT a.item_id AS a, b.item_id AS b FROM named a JOIN named b ON a.series = b.series AND a."character" = b."character" WHERE a.item_id < b.item_id""")
def two_part_key_match(spark, sf_dir):
    """Pairs of files of one character, from all items."""
    a, b = catalog(spark, sf_dir).alias("a"), catalog(spark, sf_dir).alias("b")
    on = [names.two_part(F.col("a.stem")) == names.two_part(F.col("b.stem"))]
    joined = a.join(b, on).where("a.item_id < b.item_id").where(names.same_character(F.col("a.stem"), F.col("b.stem")))
    return joined.select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"))


_PREFIXES = ("Brand#1_hot", "Brand#2_red-ring", "Brand#2", "Brand#1_old-rod", "Brand#25_")


def _prefixes(spark):
    return spark.createDataFrame([(p,) for p in _PREFIXES], "prefix string")


_PREFIX_SQL = f"WITH {CATALOG_SQL}, prefixes AS (SELECT unnest([{', '.join(repr(p) for p in _PREFIXES)}]) AS prefix) "


@query(_PREFIX_SQL + "SELECT prefix, item_id FROM named, prefixes WHERE starts_with(stem, prefix) AND (stem = prefix OR substr(stem, length(prefix) + 1, 1) = '_')")
def prefix_boundary_match(spark, sf_dir):
    """A prefix counts only up to a boundary."""
    rows = catalog(spark, sf_dir).join(F.broadcast(_prefixes(spark)), names.starts_whole(F.col("stem"), F.col("prefix")))
    return rows.select("prefix", "item_id")


@query(_PREFIX_SQL + "SELECT prefix, item_id FROM named, prefixes WHERE starts_with(stem, prefix)")
def prefix_no_boundary_match(spark, sf_dir):
    rows = catalog(spark, sf_dir).join(F.broadcast(_prefixes(spark)), names.starts_plain(F.col("stem"), F.col("prefix")))
    return rows.select("prefix", "item_id")


@query(_HELD + "SELECT h.user_id, h.pool, n.item_id FROM holding h JOIN named n ON n.stem = h.card")
def exact_stem_match(spark, sf_dir):
    """The file of each holding by its whole stem."""
    items = catalog(spark, sf_dir).select("item_id", "stem")
    return _held(spark, sf_dir).join(items, F.col("card") == F.col("stem")).select("user_id", "pool", "item_id")


@query(_NAMED + "SELECT series, item_id FROM named WHERE contains(lower(series), 'brand#1')")
def series_containing(spark, sf_dir):
    """A wanted series also matches longer names that contain it."""
    return catalog(spark, sf_dir).where(F.contains(F.lower("series"), F.lit("brand#1"))).select("series", "item_id")


# -- statistics ----------------------------------------------------------------


@query(f"WITH {CATALOG_SQL}, {_STATS} SELECT * FROM stats")
def game_stats(spark, sf_dir):
    """The flagship: per pool and series items, characters, share and mean skins."""
    return stats.series_stats(catalog(spark, sf_dir))


@query(_RANKED + "SELECT pool, series, items, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 12")
def game_stats_top_k(spark, sf_dir):
    """The twelve largest series of each pool."""
    return stats.top(stats.series_stats(catalog(spark, sf_dir)), ["pool"], 12).select("pool", "series", "items", "rank")


@query(_RANKED + "SELECT pool, series, CAST(rank AS INT) AS rank, CAST((rank - 1) // 10 + 1 AS BIGINT) AS page, printf('%.2f%%', round(share, 2)) AS shown FROM ranked")
def game_stats_pages(spark, sf_dir):
    """Ranked series on pages of ten."""
    out = stats.ranked(stats.series_stats(catalog(spark, sf_dir)), ["pool"])
    return out.select("pool", "series", "rank", "page", text.percent(F.round("share", 2)).alias("shown"))


@query(_RANKED + "SELECT pool, CAST((rank - 1) // 10 + 1 AS BIGINT) AS page, string_agg(rank || '. ' || series || ': ' || items || ' (' || printf('%.2f%%', round(share, 2)) || ')', chr(10) ORDER BY rank) AS shown FROM ranked GROUP BY 1, 2")
def stats_page_text(spark, sf_dir):
    """The text of each page of ten ranked series."""
    out = stats.ranked(stats.series_stats(catalog(spark, sf_dir)), ["pool"])
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("series"), F.lit(": "), F.col("items").cast("string"), F.lit(" ("), text.percent(F.round("share", 2)), F.lit(")"))
    return out.groupBy("pool", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("shown"))


@query(_NAMED + "SELECT pool, count(*) AS items, round(100.0 * count(*) / (SELECT count(*) FROM named), 6) AS share FROM named GROUP BY pool")
def pool_share(spark, sf_dir):
    items = catalog(spark, sf_dir).groupBy("pool").agg(F.count(F.lit(1)).alias("items"))
    total = items.agg(F.sum("items").alias("_total"))  # one row
    return items.crossJoin(F.broadcast(total)).select("pool", "items", F.round(100.0 * F.col("items") / F.col("_total"), 6).alias("share"))


@query(_NAMED + "SELECT DISTINCT pool, lower(series) AS series FROM named")
def series_set(spark, sf_dir):
    return catalog(spark, sf_dir).select("pool", F.lower("series").alias("series")).distinct()


@query(_RANKED + "SELECT pool, max(length(series || ': ' || items)) AS width FROM ranked GROUP BY pool")
def widest_line(spark, sf_dir):
    """The longest line of each pool's listing."""
    lines = stats.series_stats(catalog(spark, sf_dir)).withColumn("line", F.concat(F.col("series"), F.lit(": "), F.col("items").cast("string")))
    return lines.groupBy("pool").agg(F.max(F.length("line")).cast("long").alias("width"))


# -- availability, sampling, siblings -------------------------------------------


_FREE_NAME = """free AS (SELECT n.* FROM named n WHERE NOT EXISTS (
  SELECT 1 FROM holding h WHERE h.pool = n.pool AND lower(split_part(h.card, '_', 2)) = lower(n."character")))"""
_FREE_BOTH = """free AS (SELECT n.* FROM named n WHERE NOT EXISTS (
  SELECT 1 FROM holding h WHERE h.pool = n.pool AND lower(split_part(h.card, '_', 2)) = lower(n."character") AND lower(split_part(h.card, '_', 1)) = lower(n.series)))"""


def _held_names(spark, sf_dir):
    return _held(spark, sf_dir).select("pool", names.series(F.col("card")).alias("series"), names.character(F.col("card")).alias("character"))


@query(f"WITH {CATALOG_SQL}, {DRAWS_SQL}, {HOLDING_SQL}, {_FREE_NAME} SELECT pool, item_id FROM free")
def available_char_only(spark, sf_dir):
    """What can be drawn if a held character blocks its name in every series (the original rule)."""
    return selection.available(catalog(spark, sf_dir), _held_names(spark, sf_dir), ["character"]).select("pool", "item_id")


@query(f"WITH {CATALOG_SQL}, {DRAWS_SQL}, {HOLDING_SQL}, {_FREE_BOTH} SELECT pool, item_id FROM free")
def available_game_char(spark, sf_dir):
    """What can be drawn if a held character blocks only itself."""
    return selection.available(catalog(spark, sf_dir), _held_names(spark, sf_dir), ["series", "character"]).select("pool", "item_id")


@query(f"WITH {CATALOG_SQL}, {DRAWS_SQL}, {HOLDING_SQL}, {_FREE_BOTH} SELECT pool, item_id FROM free WHERE contains(lower(series), 'brand#2')")
def available_in_game(spark, sf_dir):
    """The same within a wanted series."""
    wanted = catalog(spark, sf_dir).where(F.contains(F.lower("series"), F.lit("brand#2")))
    return selection.available(wanted, _held_names(spark, sf_dir), ["series", "character"]).select("pool", "item_id")


@query(f"WITH {CATALOG_SQL}, {DRAWS_SQL}, {HOLDING_SQL}, {_FREE_BOTH} SELECT pool, arg_min(item_id, (md5('7:' || item_id), item_id)) AS item_id FROM free GROUP BY pool")
def random_pick_seeded(spark, sf_dir):
    """One free item of each pool, uniformly and reproducibly."""
    free = selection.available(catalog(spark, sf_dir), _held_names(spark, sf_dir), ["series", "character"])
    return selection.pick_one(free.select("pool", "item_id"), ["pool"], "item_id", "7")


@query(_HELD + """SELECT h.user_id, h.pool, n.item_id FROM holding h JOIN named n ON n.series = split_part(h.card, '_', 1) AND n."character" = split_part(h.card, '_', 2)""")
def siblings(spark, sf_dir):
    """All files of each held character."""
    return selection.siblings(_held(spark, sf_dir), catalog(spark, sf_dir)).select("user_id", "pool", "item_id")


@query(_NAMED + """SELECT item_id, count(*) OVER (PARTITION BY pool, series, "character") - 1 AS others FROM named""")
def sibling_count(spark, sf_dir):
    return selection.sibling_count(catalog(spark, sf_dir)).select("item_id", "others")


_VOTED = """voted AS (SELECT DISTINCT split_part(card, '_', 1) AS series, split_part(card, '_', 2) AS "character" FROM draws WHERE pool = 'A')"""


@query(f"""WITH {CATALOG_SQL}, {DRAWS_SQL}, {_VOTED}, a AS (SELECT n.pool, n.item_id FROM named n JOIN voted v ON n.series = v.series AND n."character" = v."character" WHERE n.pool = 'A'),
b AS (SELECT n.pool, n.item_id FROM named n JOIN voted v ON n.series = v.series AND n."character" = v."character" WHERE n.pool = 'B') SELECT * FROM b UNION ALL SELECT * FROM a""")
def pool_union_match(spark, sf_dir):
    """Files of the characters that were drawn from pool A, in either pool, in one bag."""
    keys = draws(spark, sf_dir).where("pool = 'A'").select(names.two_part(F.col("card")).alias("_id")).distinct()
    items = catalog(spark, sf_dir).withColumn("_id", names.two_part(F.col("stem")))
    matched = [items.where(F.col("pool") == p).join(keys, "_id", "left_semi") for p in ("B", "A")]
    return matched[0].unionByName(matched[1]).select("pool", "item_id")


# -- aliases and fuzzy matching ---------------------------------------------------


_ALIASES = [("eco", "ECONOMY"), ("econ", "ECONOMY"), ("sm", "SMALL"), ("med", "MEDIUM"), ("pro", "PROMO"), ("std", "STANDARD"), ("lg", "LARGE"), ("economy", "ECONOMY")]
_WANTED = ["eco", "ECON", "sm", "Std", "unknown", "LARGE", "pro"]


@query(
    f"""WITH a AS (SELECT unnest([{', '.join(repr(a) for a, _ in _ALIASES)}]) AS alias, unnest([{', '.join(repr(n) for _, n in _ALIASES)}]) AS name),
q AS (SELECT unnest([{', '.join(map(repr, _WANTED))}]) AS query)
SELECT query, coalesce(lower(name), lower(query)) AS name, (SELECT count(*) FROM part WHERE lower(p_type) = coalesce(lower(name), lower(query))) AS items
FROM q LEFT JOIN a ON lower(query) = alias"""
)
def alias_normalise(spark, sf_dir):
    """Canonical names of what users typed, and how many items each has."""
    wanted = spark.createDataFrame([(w,) for w in _WANTED], "query string")
    found = matching.normalised(wanted, spark.createDataFrame(_ALIASES, "alias string, name string"))
    kinds = table(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("name")).agg(F.count(F.lit(1)).alias("items"))
    return found.join(kinds, "name", "left").select("query", "name", F.coalesce("items", F.lit(0)).alias("items"))


_TYPED = ["red widgt", "gold bolt", "zzzzzz", "hot ring", "anvil", "small ring x"]
#: Windows of the shorter string's length: of names that score at least the threshold one of them has the score.
_FUZZY = f"""WITH q AS (SELECT unnest([{', '.join(map(repr, _TYPED))}]) AS query), n AS (SELECT DISTINCT p_name AS name FROM part),
s AS (SELECT query, name, CASE WHEN length(query) <= length(name) THEN query ELSE name END AS a, CASE WHEN length(query) <= length(name) THEN name ELSE query END AS b FROM q, n),
w AS (SELECT query, name, a, substr(b, i, length(a)) AS x FROM (SELECT *, unnest(range(1, length(b) - length(a) + 2)) AS i FROM s)),
m AS (SELECT query, name, length(a) AS n, CAST((1::HUGEINT << length(a)) - 1 AS HUGEINT) AS whole,
  list_transform(string_split(x, ''), lambda c: list_sum(list_transform(range(1, length(a) + 1), lambda p: CASE WHEN substr(a, p, 1) = c THEN 1::HUGEINT << (p - 1) ELSE 0::HUGEINT END))) AS places FROM w),
r AS (SELECT query, name, n, list_reduce(list_concat([whole], list_transform(places, lambda p: CAST(p AS HUGEINT))), lambda v, p: ((v + (v & p)) | (v & xor(whole, v & p))) & whole) AS v FROM m),
scored AS (SELECT query, name, CASE WHEN max(ratio) > 0.995 THEN 100 ELSE round_even(100 * max(ratio), 0) END + CASE WHEN length(name) > length(query) AND contains(name, query) THEN 10.0 ELSE 0.0 END AS score
  FROM (SELECT query, name, 1.0::DOUBLE * (n - bit_count(v)) / n AS ratio FROM r) GROUP BY query, name)"""


def _typed(spark):
    return spark.createDataFrame([(w,) for w in _TYPED], "query string")


def _part_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))


@query()
def fuzzy_scores(spark, sf_dir):
    """The score of each typed name with each name of the library."""
    return matching.scores(_typed(spark), _part_names(spark, sf_dir)).select("query", "name", "score")


@query(_FUZZY + ", best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (query = name) DESC, score DESC, name) AS k FROM scored) SELECT query, name, score FROM best WHERE k = 1 AND score >= 70")
def fuzzy_top1(spark, sf_dir):
    """The exact name, or the best of at least 70."""
    return matching.best_match(_typed(spark), _part_names(spark, sf_dir))


#: Pairs with scores worked out by hand from the definition.
_BY_HAND = [
    ("abcd", "abxcd", 75.0), ("abc", "xabcx", 110.0), ("abc", "abc", 100.0), ("abc", "abd", 67.0), ("abcdef", "abc", 100.0), ("ab", "xayb", 50.0), ("kitten", "sitting", 67.0),
    ("abcd", "dcba", 25.0), ("xyz", "abc", 0.0), ("hot ring", "hot rings", 110.0), ("hot rimg", "hot ring", 88.0), ("ring hot", "hot ring", 50.0), ("old rod", "cold rod", 110.0), ("red widgt", "red widget", 89.0),
]


@query("SELECT unnest([" + ", ".join(repr(q) for q, _, _ in _BY_HAND) + "]) AS query, unnest([" + ", ".join(repr(n) for _, n, _ in _BY_HAND) + "]) AS name, unnest([" + ", ".join(f"{s}::DOUBLE" for _, _, s in _BY_HAND) + "]) AS score")
def fuzzy_pairs(spark, sf_dir):
    """Scores of pairs that were worked out by hand."""
    pairs = spark.createDataFrame([(q, n) for q, n, _ in _BY_HAND], "query string, name string")
    return pairs.select("query", "name", text.similarity(F.col("query"), F.col("name")).alias("score"))


# -- renames ------------------------------------------------------------------


_RENAMES_SQL = """renames AS (
  SELECT d.user_id, n.stem AS old_name, split_part(n.stem, '_', 1) || '_new-' || (d.event_id % 9) || CASE WHEN d.event_id % 2 = 0 THEN '_' || n.item_id ELSE '' END AS new_name, d.ts, d.event_id AS seq
  FROM events d JOIN named n ON n.item_id = d.event_id % (SELECT count(*) FROM part) WHERE d.event_type = 'signup')"""
_FIRST_SQL = "firsts AS (SELECT user_id, old_name, arg_min(new_name, (ts, seq)) AS new_name FROM renames GROUP BY user_id, old_name)"


def _renames(spark, sf_dir):
    """Sign-ups stand for renames of the item with the event's number."""
    items = catalog(spark, sf_dir).select("item_id", "stem")
    size = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    events = table(spark, sf_dir, "events").where("event_type = 'signup'").crossJoin(F.broadcast(size)).withColumn("item_id", F.expr("event_id % n"))
    new = F.concat(names.series(F.col("stem")), F.lit("_new-"), (F.col("event_id") % 9).cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("_"), F.col("item_id").cast("string"))).otherwise(""))
    return events.join(items, "item_id").select("user_id", F.col("stem").alias("old_name"), new.alias("new_name"), "ts", F.col("event_id").alias("seq"))


@query(f"WITH {CATALOG_SQL}, {_RENAMES_SQL}, {_FIRST_SQL} SELECT * FROM firsts")
def first_rename(spark, sf_dir):
    """The first rename of each user and item wins."""
    return holdings.first_wins(_renames(spark, sf_dir), ["user_id", "old_name"], ["ts", "seq"], ["new_name"])


@query(f"WITH {CATALOG_SQL}, {_RENAMES_SQL} SELECT item_id, stem FROM named WHERE stem NOT IN (SELECT old_name FROM renames)")
def skip_renamed(spark, sf_dir):
    """Files that were never renamed."""
    return selection.not_renamed(catalog(spark, sf_dir), _renames(spark, sf_dir)).select("item_id", "stem")


@query(
    f"""WITH {CATALOG_SQL}, {_RENAMES_SQL}, x AS (SELECT DISTINCT n.item_id, n.file_name, n.stem, r.new_name, array_to_string(string_split(n.stem, '_')[3:], '_') AS old_s, array_to_string(string_split(r.new_name, '_')[3:], '_') AS new_s
FROM named n JOIN renames r ON n.stem = r.old_name AND split_part(n.stem, '_', 1) = split_part(r.new_name, '_', 1))
SELECT item_id, new_name, CASE WHEN old_s = new_s THEN new_name ELSE array_to_string(string_split(new_name, '_')[1:2], '_') || CASE WHEN old_s <> '' THEN '_' || old_s ELSE '' END END || substr(file_name, length(stem) + 1) AS new_file FROM x"""
)
def rename_projection(spark, sf_dir):
    """The file names that renames within a series give."""
    items = catalog(spark, sf_dir).select("item_id", "file_name", "stem")
    joined = items.join(_renames(spark, sf_dir), F.col("stem") == F.col("old_name")).where(names.same_series(F.col("stem"), F.col("new_name")))
    return joined.select("item_id", "new_name", names.renamed(F.col("file_name"), F.col("new_name")).alias("new_file")).distinct()
