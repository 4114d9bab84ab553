"""Item names ``series_character[_suffix...].ext`` as Column expressions.

The name is the record: everything here is a built-in expression, so it stays in
generated code and filters on it reach the scan where the source allows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A new name: two or more parts without spaces, joined by single underscores.
NEW_NAME = r"^[^\s_]+(_[^\s_]+)+$"
_EXTENSION = r"^(\.*[^.].*)\.[^.]*$"


def stem(file_name: Column) -> Column:
    """The name without its last extension; leading dots are part of the name."""
    return F.regexp_replace(file_name, _EXTENSION, "$1")


def extension(file_name: Column) -> Column:
    """The last extension with its dot, or the empty string."""
    return F.substring(file_name, F.length(stem(file_name)) + 1, F.length(file_name))


def part(name: Column, i: int) -> Column:
    """The i-th part (from 1), or the empty string."""
    return F.split_part(name, F.lit("_"), F.lit(i))


def series(name: Column) -> Column:
    return part(name, 1)


def character(name: Column) -> Column:
    return part(name, 2)


def suffix(name: Column) -> Column:
    """Everything after the second part, or the empty string."""
    parts = F.split(name, "_")
    return F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), "_")


def two_part(name: Column) -> Column:
    """The identity of a character: the first two parts."""
    return F.array_join(F.slice(F.split(name, "_"), 1, 2), "_")


def underscores(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("_"), F.lit("")))


def is_listed(file_name: Column) -> Column:
    """Names that can be drawn and counted hold an underscore anywhere, the extension included."""
    return underscores(file_name) >= 1


def is_new_name(name: Column) -> Column:
    return name.rlike(NEW_NAME)


def starts_plain(name: Column, prefix: Column) -> Column:
    return F.startswith(name, prefix)


def starts_whole(name: Column, prefix: Column) -> Column:
    """Starts with the prefix, and ends there or goes on with an underscore."""
    return F.startswith(name, prefix) & ((name == prefix) | (F.substring(name, F.length(prefix) + 1, F.lit(1)) == "_"))


def same_character(a: Column, b: Column) -> Column:
    """Equal first two parts; a name with fewer parts equals nothing."""
    return (F.size(F.split(a, "_")) >= 2) & (F.size(F.split(b, "_")) >= 2) & (two_part(a) == two_part(b))


def same_series(a: Column, b: Column) -> Column:
    return series(a) == series(b)


def renamed(file_name: Column, new_name: Column) -> Column:
    """The file's name after its character is renamed to ``new_name`` (given with parts).

    Keeps the extension.  A suffix equal to that of the new name is not doubled; any other is kept.
    """
    old = stem(file_name)
    kept = F.concat_ws("_", two_part(new_name), F.when(suffix(old) != "", suffix(old)))
    return F.concat(F.when(suffix(old) == suffix(new_name), new_name).otherwise(kept), extension(file_name))
