"""Document fingerprints by locally consistent parsing.

A text is a sequence of bytes.  On each level runs of one symbol become one
symbol with a count; deterministic coin tossing then relabels each symbol by
the lowest bit in which it differs from its left neighbour, again and again until at
most six labels are left; a phrase begins at each local maximum of the labels
and its name, a hash of what it holds, is a symbol of the next level.  Whether
a phrase begins depends on a few neighbours alone, so equal
substrings get equal phrases inside, wherever they stand.
(K. Mehlhorn, R. Sundar, C. Uhrig 1997; S. Sahinalp, U. Vishkin 1996.)

The fingerprint is the ``KEEP`` least hashed names of the phrases of level
``LEVEL`` (about 27 bytes each), an unbiased sample of the set; a text that
shrinks to a single symbol earlier gives that symbol.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.frames import bucketed, parts
from cardloom.llm.workers import in_batches
from cardloom.llm.words import flat, slices

#: Level of the phrases, names kept in a fingerprint, hex digits of each.
LEVEL, KEEP, DIGITS = 3, 64, 8

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _toss_table(labels: int) -> np.ndarray:
    """One coin toss of labels below ``labels``: [left, right] -> new label."""
    left, right = np.meshgrid(np.arange(labels), np.arange(labels), indexing="ij")
    differ = left ^ right
    low = np.where(differ, differ & -differ, 1)
    bit = np.log2(low).astype(np.int64)
    return (2 * bit + (right >> bit & 1)).astype(np.uint8)


_BYTES = _toss_table(256).ravel()
_SMALL = _toss_table(128).ravel()
_POWERS = _mix(np.arange(1, 129, dtype=_U)) | _U(1)
_BYTE_NAMES = _mix(np.arange(256, dtype=_U) + _U(0x9E3779B97F4A7C15))


def _tossed(symbols: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Labels below 6; neighbours differ (but at the start of a text).

    The number of tosses is fixed, so a label depends on a few symbols to its left and on
    nothing else: bytes have 256 symbols, then 16, 8 and 6 labels, names 2^64, then 128, 14, 8 and 6.
    """
    again = 2 if symbols.dtype == np.uint8 else 3
    if symbols.dtype == np.uint8:
        label = np.empty(len(symbols), np.uint8)
        label[1:] = _BYTES[(symbols[:-1].astype(np.uint16) << 8) | symbols[1:]]
        label[heads] = symbols[heads] & 1
    else:
        differ = symbols[1:] ^ symbols[:-1]
        low = differ & (~differ + _U(1))
        bit = (np.frexp(low.astype(np.float64))[1] - 1).clip(0).astype(_U)
        label = np.empty(len(symbols), np.uint8)
        label[1:] = (2 * bit + (symbols[1:] >> bit & _U(1))).astype(np.uint8)
        label[heads] = (symbols[heads] & _U(1)).astype(np.uint8)
    for _ in range(again):
        after = np.empty_like(label)
        after[1:] = _SMALL[(label[:-1].astype(np.uint16) << 7) | label[1:]]
        after[heads] = label[heads] & 1
        label = after
    return label


def parse_level(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the next level and where each text's begin.

    ``symbols``: the non-empty texts' symbols in a row; ``starts``: where each begins.
    """
    keep = np.empty(len(symbols), bool)
    keep[:1] = True
    keep[1:] = symbols[1:] != symbols[:-1]
    keep[starts] = True
    at = np.flatnonzero(keep)
    runs = np.diff(at, append=len(symbols))
    symbols = symbols[at]
    starts = np.searchsorted(at, starts)

    label = _tossed(symbols, starts)
    begins = np.zeros(len(symbols), bool)
    begins[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    # the first and last symbol of a text have one neighbour and begin no phrase by themselves
    begins[starts[1:] - 1] = False
    begins[starts] = True
    first = np.flatnonzero(begins)

    with np.errstate(over="ignore"):
        name = _BYTE_NAMES[symbols] if symbols.dtype == np.uint8 else symbols.copy()
        longer = np.flatnonzero(runs > 1)
        name[longer] = _mix(name[longer] + runs[longer].astype(_U) * _U(0xD6E8FEB86659FD93))
        inside = np.arange(len(symbols)) - np.repeat(first, np.diff(first, append=len(symbols)))
        names = _mix(np.add.reduceat(name * _POWERS[inside & 127], first))
    return names, np.searchsorted(first, starts)


def least_names(data: np.ndarray, offsets: np.ndarray, level: int = LEVEL, keep: int = KEEP) -> list[np.ndarray]:
    """The ``keep`` least distinct hashed phrase names of each text, ascending."""
    sizes = np.diff(offsets)
    out: list[np.ndarray] = [np.zeros(0, _U)] * len(sizes)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    symbols, starts = data, offsets[full]
    for _ in range(level):
        symbols, starts = parse_level(symbols, starts)
    hashed = _mix(symbols ^ _U(0x5851F42D4C957F2D)) >> _U(64 - 4 * DIGITS)
    for i, a, b in zip(full.tolist(), starts.tolist(), np.append(starts[1:], len(hashed)).tolist(), strict=True):
        out[i] = np.unique(hashed[a:b])[:keep]
    return out


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Estimated Jaccard similarity of the phrase sets: the share of the union's least names in both.

    Two empty fingerprints are alike (1), an empty and another one are not (0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    same = np.flatnonzero(both[1:] == both[:-1])
    union = len(both) - len(same)
    if union <= keep:
        return len(same) / union
    # the least `keep` of the union: the last of them bounds those in both
    distinct = np.delete(both, same)
    return int((both[same] <= distinct[keep - 1]).sum()) / keep


def text_of(names: np.ndarray) -> str:
    return names.astype(f">u{DIGITS // 2}").tobytes().hex()


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_rows: int = 256) -> DataFrame:
    """Fingerprint every text, its half-edited form, and compare with the next document.

    The edited text replaces the last floor(n_chars / 2) code points by the first as
    many (or all) of the next document's, by descending key; the next after the
    last is the first.  Returns key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (concatenated hex names), near_edited, near_next.

    The texts are shuffled once, into buckets of consecutive keys of about equally many rows (at least ``bucket_rows``); a bucket also
    gets the first row of the bucket that follows.

    Edge cases: a null text is empty and has the empty fingerprint; a null key
    sorts last; rows that share a key are ordered by their texts (by a hash of them, if one key has a large part of
    all rows, which is then dealt out to several buckets); with one row it is its own next; an empty table gives an empty result; other columns are ignored.
    """
    spark, n = docs.sparkSession, parts(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # descending keys, nulls last: the complement ascends
    rows = rows.withColumn("_down", F.coalesce(F.bitwise_not("_key"), F.lit(2**63 - 1)))
    schema = f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    bucket, mixed = bucketed(rows, "_down", ("_text",), bucket_rows)
    rows = rows.withColumns({"_mixed": mixed, "_bucket": bucket})
    # One row for each bucket: its first row's place in the order.
    tops = {r["_bucket"]: r["top"] for r in rows.groupBy("_bucket").agg(F.min(F.struct("_down", "_mixed")).alias("top")).collect()}
    if not tops:
        return spark.createDataFrame([], schema)
    order = sorted(tops)
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True))
    # a row for each bucket, so as many as eight times the partitions of a shuffle
    known = F.broadcast(spark.createDataFrame([(b, tops[b], before[b]) for b in order], "_bucket int, _top struct<_down: long, _mixed: long>, _target int"))
    own, guest = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("guest")), F.struct(F.col("_target").alias("b"), F.lit(1).alias("guest"))
    dealt = rows.join(known, "_bucket").withColumn("_to", F.explode(F.when(F.struct("_down", "_mixed") == F.col("_top"), F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.select(F.col("_to.b").alias("_bucket"), F.col("_to.guest").alias("_guest"), "_key", "_down", "_mixed", "_text")
    dealt = dealt.repartition(n, "_bucket").sortWithinPartitions("_bucket", "_guest", "_down", "_mixed", "_text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in (part for b in batches for part in slices(b, "_text")):
            both = pa.concat_batches([held, batch]) if held is not None else batch
            if both.num_rows > 1:
                yield _compared(both, key)
            held = both.slice(both.num_rows - 1)

    return in_batches(dealt.select("_bucket", "_guest", "_key", "_text"), compare, schema)


def _compared(rows: pa.RecordBatch, key: str) -> pa.RecordBatch:
    """Results of all rows but the last, which is only looked at as the next one.

    Rows are in order; a row's next is the following one if that is in its bucket.  Rows
    brought in from another bucket (the last of a bucket) give no result themselves.
    """
    bucket, guest = rows.column("_bucket").to_numpy(), rows.column("_guest").to_numpy()
    texts = rows.column("_text").to_pylist()
    wanted = [i for i in range(len(texts) - 1) if not guest[i]]
    if any(bucket[i] != bucket[i + 1] for i in wanted):
        raise AssertionError("a bucket has no row after its last one")
    edited, sizes = [], []
    for i in wanted:
        size = len(texts[i])
        half = size // 2
        edited.append((texts[i][: size - half] + texts[i + 1][:half]).encode())
        sizes.append(size)
    names = least_names(*flat(rows.column("_text")))
    new_names = least_names(*flat(pa.array(edited, pa.large_binary()).cast(pa.large_string()))) if edited else []
    return pa.RecordBatch.from_pydict(
        {
            key: rows.column("_key").take(pa.array(wanted, pa.int64())),
            "n_chars": pa.array(sizes, pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
            "fingerprint": pa.array([text_of(names[i]) for i in wanted], pa.string()),
            "edited_fingerprint": pa.array([text_of(x) for x in new_names], pa.string()),
            "near_edited": pa.array([likeness(names[i], x) for i, x in zip(wanted, new_names, strict=True)], pa.float64()),
            "near_next": pa.array([likeness(names[i], names[i + 1]) for i in wanted], pa.float64()),
        }
    )
