"""Sharding by jump consistent hashing.

The hash maps a 64-bit key to one of n shards without a ring table: it follows
the key's own random sequence of "jumps", the shard counts at which the key
would have moved, and stops at the last one below n.  A key so moves
only into the shard that was appended, and a fraction 1/(n+1) of keys moves.
(J. Lamping, E. Veach: A Fast, Minimal Memory, Consistent Hash Algorithm, 2014.)
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.frames import gapless

#: Fixed value: the multiplier of the 64-bit linear congruential generator in the paper.
LCG = np.uint64(2862933555777941757)
#: Null keys are placed as this key.
NULL_KEY = -1
_KEY = "_jump_sharding_key"


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard 0 .. shards-1 of each 64-bit key."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.full(len(state), -1, np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = ahead[live]
        state[live] = state[live] * LCG + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((shard[live] + 1) * (2147483648.0 / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def shard_column(key: Column, shards: int) -> Column:
    """Shard of a long key column; null keys go where ``NULL_KEY`` goes."""

    @F.pandas_udf("int")
    def placed(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return placed(F.coalesce(key, F.lit(NULL_KEY)).cast("long"))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row into one of ``shards`` shards by its key alone.

    Adds size (UTF-8 bytes of the text, 0 for null, plus 1), text_crc32, law,
    shard, slot (0, 1, 2, ... within the shard, by key) and grown_shard (the
    shard when one more is appended).  A key that is not a long is hashed to
    one first.  Only the key goes to Python; sizes and checksums are computed in the JVM.

    Edge cases: a null key is placed as ``NULL_KEY``; rows that share a key
    share a shard and get different slots; a null text counts as empty; an
    empty table gives an empty result; other columns are kept, but columns
    named like an added one are replaced.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kind = dict(docs.dtypes)[key]
    long_key = F.col(key).cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    placed = docs.select(
        *[c for c in docs.columns if c not in made],
        long_key.alias(_KEY),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_column(long_key, shards).alias("shard"),
        shard_column(long_key, shards + 1).alias("grown_shard"),
    )
    return gapless(placed, ["shard"], _KEY, "slot", ties=("size", "text_crc32")).drop(_KEY)
