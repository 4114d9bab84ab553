"""What can be drawn: availability, sampling, siblings, renames."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions import names


def available(catalog: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
    """Catalogue rows whose key nobody holds in that pool.  A bag difference: duplicates stay.

    ``by``: ``["character"]`` blocks a character's name in every series,
    ``["series", "character"]`` only the character itself.  Keys are compared in lower case.
    """
    keys = held.select("pool", *[F.lower(c).alias(f"_{c}") for c in by]).distinct()
    on = [catalog["pool"] == keys["pool"]] + [F.lower(catalog[c]) == keys[f"_{c}"] for c in by]
    return catalog.join(keys, on, "left_anti")


def pick_one(rows: DataFrame, by: list[str], key: str, seed: str) -> DataFrame:
    """One row of each group, uniformly by a seeded hash of the key: reproducible sampling."""
    order = F.struct(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))).alias("h"), F.col(key).alias("k"))
    return rows.groupBy(*by).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in by]), order).alias("_r")).select(*by, "_r.*")


def siblings(card: DataFrame, catalog: DataFrame) -> DataFrame:
    """All files of the drawn cards' characters.  An equi-join on the identity; the prefix rule is the residual."""
    left = card.withColumn("_id", names.two_part(F.col("card")))
    right = catalog.withColumn("_id", names.two_part(F.col("stem")))
    return left.join(right.drop("pool"), "_id").where(names.starts_whole(F.col("stem"), F.col("_id"))).drop("_id")


def sibling_count(catalog: DataFrame) -> DataFrame:
    """How many other files each file's character has: counts with partial sums, joined to the files."""
    by = ["pool", "series", "character"]
    counts = catalog.groupBy(*by).agg((F.count(F.lit(1)) - 1).alias("others"))
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in by], "others")
    on = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    return catalog.join(counts, on).drop(*[f"_{c}" for c in by])


def not_renamed(files: DataFrame, renames: DataFrame) -> DataFrame:
    """Files whose stem was not renamed before; stems are compared with stems."""
    return files.join(renames.select(F.col("old_name").alias("_old")).distinct(), F.col("stem") == F.col("_old"), "left_anti")
