"""Text functions as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Chinese numerals.
DIGITS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
TEN, HUNDRED = "十", "百"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _digit(c: Column, default: int) -> Column:
    table = {**DIGITS, TEN: 10, HUNDRED: 100}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], F.lit(default))


def numeral(c: Column) -> Column:
    """Chinese numerals as int; null if nothing is found.

    Right up to ``X百Y十Z``.  As documented: a digit after the hundreds without tens continues
    the number decimally (百五 is 1005), and digits in a row are read as such (二二 is 22).
    """
    has_hundred = F.contains(c, F.lit(HUNDRED))
    head = F.split_part(c, F.lit(HUNDRED), F.lit(1))
    hundreds = F.when(has_hundred, F.when(head == "", F.lit(100)).otherwise(_digit(head, 1) * 100)).otherwise(F.lit(0))
    rest = F.when(has_hundred, F.split_part(c, F.lit(HUNDRED), F.lit(2))).otherwise(c)
    before, after = F.split_part(rest, F.lit(TEN), F.lit(1)), F.split_part(rest, F.lit(TEN), F.lit(2))
    tens = F.when(before == "", F.lit(10)).otherwise(_digit(before, 1) * 10) + F.when(after == "", F.lit(0)).otherwise(_digit(after, 0))
    plain = F.aggregate(F.regexp_extract_all(rest, F.lit("([" + "".join(DIGITS) + "])"), F.lit(1)), hundreds, lambda total, d: total * 10 + _digit(d, 0))
    value = F.when(F.contains(rest, F.lit(TEN)), hundreds + tens).otherwise(plain)
    return F.when(value > 0, value)


def number_after(c: Column, keyword: str) -> Column:
    """The count that follows a keyword, in digits or numerals; null without one."""
    token = F.regexp_extract(c, keyword + r"(\d+|[" + "".join(DIGITS) + TEN + HUNDRED + "]+)", 1)
    return F.when(token == "", F.lit(None).cast("int")).when(token.rlike(r"^\d+$"), token.try_cast("int")).otherwise(numeral(token))


def elapsed(seconds: Column, units: tuple[str, str, str, str] = ("d", "h", "m", "s")) -> Column:
    """Seconds as days, hours, minutes and seconds; zero parts are left out, zero is "0s"."""
    day, hour, minute, second = units
    total = seconds.cast("long")
    parts = [(F.floor(total / 86400), day), (F.floor(total / 3600) % 24, hour), (F.floor(total / 60) % 60, minute)]
    shown = [F.when(v > 0, F.concat(v.cast("string"), F.lit(u))) for v, u in parts]
    last = F.when((total % 60 > 0) | (total < 60), F.concat((total % 60).cast("string"), F.lit(second)))
    return F.concat_ws("", *shown, last)


def between(c: Column, marker: str) -> Column:
    """The trimmed text between a marker and the end of its line; empty without the marker."""
    after = F.split_part(c, F.lit(marker), F.lit(2))
    return trimmed(F.split_part(after, F.lit("\n"), F.lit(1)))


def optional_target(c: Column, verb: str, noun: str) -> Column:
    """What stands between a verb and an optional noun before or after it, trimmed and in lower case."""
    return trimmed(F.lower(F.regexp_extract(c, f"^{verb}(?:{noun})?(.*?)(?:{noun})?$", 1)))


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """Runs (place in a, place in b, length) that a least edit path keeps, and an empty run at both ends' place.

    Of several least paths the one that, from the end, goes on inserting or deleting where it did so, else keeps, else
    replaces, else inserts, else deletes.
    """
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    cost = [list(range(len(y) + 1))]
    for i, c in enumerate(x, 1):
        above, row = cost[-1], [i]
        for j, d in enumerate(y, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (c != d)))
        cost.append(row)
    kept, i, j, going = [], len(x), len(y), None
    while i or j:
        here = cost[i][j]
        inserts, deletes = j > 0 and here == cost[i][j - 1] + 1, i > 0 and here == cost[i - 1][j] + 1
        if going == "insert" and inserts:
            j -= 1
        elif going == "delete" and deletes:
            i -= 1
        elif i and j and x[i - 1] == y[j - 1] and here == cost[i - 1][j - 1]:
            i, j, going = i - 1, j - 1, None
            kept.append((head + i, head + j))
        elif i and j and here == cost[i - 1][j - 1] + 1:
            i, j, going = i - 1, j - 1, None
        elif inserts and going is None:
            j, going = j - 1, "insert"
        else:
            i, going = i - 1, "delete"
    places = [(k, k) for k in range(head)] + kept[::-1] + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    runs: list[list[int]] = []
    for i, j in places:
        if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j:
            runs[-1][2] += 1
        else:
            runs.append([i, j, 1])
    return [(i, j, n) for i, j, n in runs] + [(len(a), len(b), 0)]


def common_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence by the length of both (bit-parallel, a bit for each character of ``a``)."""
    if not a or not b:
        return float(len(a) == len(b))
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = free = (1 << len(a)) - 1
    for c in b:
        hit = free & places.get(c, 0)
        free = (free + hit | free & ~hit) & full
    return 2 * (len(a) - free.bit_count()) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> int:
    """0 to 100: the best ratio of the shorter string with a window of the other that begins where a kept run aligns them.

    Equal strings have 100, an empty and another one 0; a ratio over 0.995 counts as 1; rounded, halves to even.
    """
    if a == b:
        return 100
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0
    starts = {max(j - i, 0) for i, j, _ in matching_blocks(short, long)}
    best = max(common_ratio(short, long[k : k + len(short)]) for k in starts)
    return 100 if best > 0.995 else round(100 * best)


def score(query: str, name: str) -> float:
    """The partial ratio, and ten more if the name is longer than the query and contains it."""
    return float(partial_ratio(query, name) + (10 if len(name) > len(query) and query in name else 0))


def similarity(query: Column, name: Column) -> Column:
    """:func:`score` of two columns; null where either is.  The edit path has no built-in form, so Arrow batches go to Python,
    and each distinct pair of a batch is scored once."""

    @F.pandas_udf("double")
    def scored(queries: pd.Series, names: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(queries, names, strict=True):
            if pair not in known:
                known[pair] = None if pair[0] is None or pair[1] is None else score(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return scored(query, name)


def percent(share: Column) -> Column:
    return F.format_string("%.2f%%", share)
