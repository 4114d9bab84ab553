"""Secrets in texts, and who owns them: native DataFrame expressions throughout.

Three kinds are found by their form (assign, access, hex).  Beyond those, a long token of
letters and digits is a candidate if it looks random: a run without a separator whose letters and digits
alternate and whose characters have a high entropy.  Candidates of all documents are aggregated by
the hash of their value: in how many repositories and by how many owners does
it occur?  What many owners share, or many repositories of few owners, is a widely copied example; what
belongs to few of either looks like a live credential and is added as kind ``owned``.  Base spans
are always kept; the frequency tells for each document how many of its values are copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.frames import cut

#: Fixed patterns of the base kinds, in the order that breaks ties.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Candidates of the method: long tokens.
CANDIDATE = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}"
#: A candidate has a run of letters and digits that looks random: so many characters, digits in three places
#: with letters between them, and so many bits of entropy a character.  Measured on 20,000 made ones of each:
#: 97 % of random tokens of 20 to 40 characters in base 36 pass and 81 % in base 62, no slug of words, dates, numbers
#: and versions, 2 % of names of words and numbers run together.
RUN, MIXED, LEAST_BITS = r"[A-Za-z0-9]{16,}", r"[0-9][A-Za-z]+[0-9]+[A-Za-z]+[0-9]", 3.0
#: More owners than these, or more repositories, share an example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
#: A value that more than one in so many occurrences has is joined by broadcast (so there are fewer than
#: that); copies of a verdict for rows that share key and text.
HOT, LOTS = 10_000, 8
KINDS = ("assign", "access", "hex", "owned")


def _q(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def spans(text: str, pattern: str, kind: int, group: int, least: int) -> str:
    """SQL for the leftmost non-overlapping matches of a pattern, as array<struct<s, k, e, v>>.

    The texts between the matches and the matches themselves give the places in code
    points; matches whose ``group`` has fewer than ``least`` characters are dropped.
    """
    q = _q(pattern)
    found = f"regexp_extract_all({text}, {q}, 0)"
    values = f"regexp_extract_all({text}, {q}, {group})"
    parts = f"transform(split({text}, {q}, -1), x -> length(x))"
    state = f"""aggregate(sequence(0, size(f) - 1), named_struct('at', 0, 'out', cast(array() as array<struct<s: int, k: int, e: int, v: string>>)),
        (a, i) -> named_struct('at', a.at + g[i] + length(f[i]),
            'out', if(length(v[i]) >= {least}, concat(a.out, array(named_struct('s', a.at + g[i], 'k', {kind}, 'e', a.at + g[i] + length(f[i]), 'v', v[i]))), a.out)),
        a -> a.out)"""
    # transform over a one-element array names the parts once
    return f"""transform(array(named_struct('f', {found}, 'g', {parts}, 'v', {values})), t -> {state.replace('size(f)', 'size(t.f)').replace(' g[i]', ' t.g[i]').replace('f[i]', 't.f[i]').replace('v[i]', 't.v[i]')})[0]"""


def _guarded(text: str, cheap: str, expensive: str) -> str:
    """Only texts that pass a cheap test are searched."""
    return f"CASE WHEN {cheap} THEN {expensive} ELSE cast(array() as array<struct<s: int, k: int, e: int, v: string>>) END"


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base`` and ``others``: base spans and the candidates that overlap none of them."""
    t = f"coalesce({text}, '')"
    base = [
        _guarded(t, f"{t} RLIKE r'(?i:passw|secret|token|api_?key)'", spans(t, ASSIGN, 0, 2, 12)),
        _guarded(t, f"contains({t}, 'AKIA')", spans(t, ACCESS, 1, 0, 18)),
        # runs of 16 and more are those of any length without the short ones
        _guarded(t, f"{t} RLIKE r'[0-9a-f]{{16}}'", spans(t, HEX.replace("+", "{16,}"), 2, 0, 16)),
    ]
    other = _guarded(t, f"{t} RLIKE r'[A-Za-z0-9_-]{{20}}'", spans(t, CANDIDATE, 3, 0, 20))
    out = docs.withColumn("base", F.expr(f"array_sort(concat({', '.join(base)}))")).withColumn("others", F.expr(other))
    return out.withColumn("others", F.expr(f"filter(others, x -> {_random('x.v')} AND NOT exists(base, b -> b.s < x.e AND x.s < b.e))"))


def _random(value: str) -> str:
    """SQL: does a part of the value look random?"""
    bits = "-aggregate(transform(array_distinct(split(r, '')), c -> (length(r) - length(replace(r, c, ''))) / length(r)), 0D, (a, p) -> a + p * log2(p))"
    return f"exists(regexp_extract_all({value}, r'({RUN})', 1), r -> r RLIKE r'{MIXED}' AND round({bits}, 6) >= {LEAST_BITS})"


def ownership(found: DataFrame) -> DataFrame:
    """value, owners, repositories, n: of each candidate's hash in all documents, and how often it was found.

    ``found``: value, owner, repository.  Rows are reduced to distinct ones before
    each shuffle, so a value that a third of all documents hold is no burden.
    """
    places = found.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = places.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"))
    return owners.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("r").alias("repositories"), F.sum("n").alias("n"))


def _told(each: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``copied`` to rows with a value; the few values that many rows hold are not brought together."""
    copied = (F.col("owners") > MAX_OWNERS) | (F.col("repositories") > MAX_REPOSITORIES)
    known = cut(known.select("value", copied.alias("copied"), "n"))
    total = known.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > total // HOT  # of fewer than HOT values
    hot = F.broadcast(known.where(often).select("value", F.col("copied").alias("_hot")))
    rows = each.join(hot, "value", "left")
    rare = rows.where("_hot is null").drop("_hot").join(known.where(~often).select("value", "copied"), "value")
    return rows.where("_hot is not null").withColumnRenamed("_hot", "copied").unionByName(rare)


def _joined(array: str) -> str:
    """SQL: kind:start:end of each span, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({array}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def find_secrets(docs: DataFrame, owner: Column, repository: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of every whole text.

    Returns key, n_assign, n_access, n_hex, base_sha256, spans, n_owned (added spans),
    n_copied and n_live (base values that are / are not widely copied), and ``found``: array of (s, k, e, v) of all spans in order.

    Edge cases: a null text is empty; null owners or repositories count as one more owner or
    repository; rows that share key and text get equal results; null keys are kept; an
    empty table gives an empty result; other columns are ignored.
    """
    none = "cast(array() as array<struct<s: int, k: int, e: int, v: string>>)"
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"))
    rows = scanned(rows, "_text").select("_key", F.xxhash64("_text").alias("_hash"), "owner", "repository", "base", "others")
    rows = cut(rows)
    some = rows.where("size(base) + size(others) > 0")
    each = some.withColumn("x", F.explode(F.concat("base", "others")))
    each = each.select("_key", "_hash", "owner", "repository", "x", F.sha2("x.v", 256).alias("value"))
    # One row for each document with a candidate; rows that share key and text have the same spans.
    distinct = each.groupBy("_key", "_hash", "x", "value").agg(F.lit(1).alias("_one")).drop("_one")
    told = _told(distinct, ownership(each.select("value", "owner", "repository")))
    base = F.col("x.k") < 3
    verdicts = told.groupBy(F.col("_key").alias("_k"), F.col("_hash").alias("_h")).agg(
        F.collect_list(F.when(~base & ~F.col("copied"), F.col("x"))).alias("added"),
        F.count_if(base & F.col("copied")).alias("n_copied"),
        F.count_if(base & ~F.col("copied")).alias("n_live"),
    )
    # Rows that share key and text are dealt out; which lot a row is in does not matter, as each has the verdict.
    lots = verdicts.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1))))
    dealt = some.withColumn("_lot", (F.monotonically_increasing_id() % LOTS).cast("int"))
    joined = dealt.join(lots, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")) & (F.col("_lot") == F.col("_l")))
    out = joined.select("_key", "_hash", "base", "added", "n_copied", "n_live").unionByName(
        rows.where("size(base) + size(others) = 0").select("_key", "_hash", "base", F.expr(f"{none} as added"), F.lit(0).cast("long").alias("n_copied"), F.lit(0).cast("long").alias("n_live"))
    )
    out = out.select(
        F.col("_key").alias(key),
        *[F.expr(f"cast(size(filter(base, x -> x.k = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.expr(f"sha2({_joined('base')}, 256)").alias("base_sha256"),
        F.expr("array_sort(concat(base, added))").alias("found"),
        F.expr("cast(size(added) as bigint)").alias("n_owned"),
        "n_copied",
        "n_live",
        "_hash",
    )
    return out.withColumn("spans", F.expr(_joined("found")))
