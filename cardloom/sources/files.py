"""File sources: an item library in folders, images, and an alias dictionary in YAML."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import names
from cardloom.sources.schemas import ALIASES


def library(spark: SparkSession, folders: dict[str, str], digest: bool = False) -> DataFrame:
    """pool, file_name, bytes (and sha256) of all files in each pool's folder.

    Without ``digest`` the contents are never read: only path and length columns are selected.
    """
    out = None
    for pool, folder in folders.items():
        files = spark.read.format("binaryFile").load(folder)
        cols = [F.lit(pool).alias("pool"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes")]
        files = files.select(*cols, *([F.sha2("content", 256).alias("sha256")] if digest else []))
        out = files if out is None else out.unionByName(files)
    return out


def listed(files: DataFrame) -> DataFrame:
    """Only files whose names can be drawn, with their parts."""
    stem = names.stem(F.col("file_name"))
    return files.where(names.is_listed(F.col("file_name"))).withColumns(
        {"stem": stem, "series": names.series(stem), "character": names.character(stem), "suffix": names.suffix(stem)}
    )


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """file_name, ok of each expected file (file_name, sha256): whether it is there with that digest; one that is missing is not ok.

    ``files``: as :func:`library` gives them with digests.  The digest's case does not matter.
    """
    found = files.select(F.col("file_name").alias("_name"), F.col("sha256").alias("_digest")).distinct()
    joined = expected.join(found, (F.col("file_name") == F.col("_name")) & (F.lower("sha256") == F.col("_digest")), "left")
    return joined.groupBy("file_name").agg(F.max(F.col("_name").isNotNull()).alias("ok"))


def alias_table(entries: DataFrame) -> DataFrame:
    """(alias, name): every name, alias, short and English name in lower case; later entries win.

    ``entries``: position, name, aliases, short_name, en_name.
    """
    words = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")), F.array("short_name", "en_name"))
    rows = entries.select("position", "name", F.posexplode(words).alias("k", "alias")).where("alias is not null and alias <> ''")
    return rows.groupBy(F.lower("alias").alias("alias")).agg(F.max_by("name", F.struct("position", "k")).alias("name"))


def parsed_aliases(text: str) -> list[tuple]:
    """position, name, aliases, short_name, en_name of a dictionary in the YAML of this form: a list ``games`` of mappings
    of scalars and lists of scalars, lists as blocks or in brackets, scalars bare or in quotes, comments after ``#``."""
    games: list[dict] = []
    key = None
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        body = line.strip()
        if not body or body == "games:":
            continue
        starts_entry = re.match(r"-\s+(\w+):(?:\s+(.*))?$", body)
        pair = starts_entry or re.match(r"(\w+):(?:\s+(.*))?$", body)
        if starts_entry:
            games.append({})
        if pair and games:
            key, value = pair[1], (pair[2] or "").strip()
            inline = re.match(r"\[(.*)\]$", value)
            games[-1][key] = [_scalar(x) for x in inline[1].split(",") if x.strip()] if inline else _scalar(value) if value else []
        elif body.startswith("- ") and games and isinstance(games[-1].get(key), list):
            games[-1][key].append(_scalar(body[2:]))
        else:
            raise ValueError(f"not an entry of the dictionary: {raw!r}")
    return [(i, g["name"], g.get("aliases") or [], g.get("short_name") or None, g.get("en_name") or None) for i, g in enumerate(games)]


def _scalar(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def alias_file(spark: SparkSession, path: str) -> DataFrame:
    """(alias, name) from a dictionary file, read on the driver as it is small; empty if it is missing or cannot be read."""
    try:
        entries = parsed_aliases(spark.read.text(path, wholetext=True).first()[0])
    except (AnalysisException, ValueError, KeyError, TypeError):
        entries = []
    return alias_table(spark.createDataFrame(entries, ALIASES))
