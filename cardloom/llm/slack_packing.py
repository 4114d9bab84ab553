"""Packing documents into training windows by minimum bin slack.

Every document's ids (and one end id) are cut into pieces of a whole window and one
shorter remainder.  Whole pieces fill a window alone.  The remainders are
packed by their lengths: a plan is made from how many remainders there are of
each length (at most ``capacity`` - 1 numbers, however large the corpus).  Each
step anchors the longest remaining length and asks a bitset subset-sum dynamic
program which multiset of the other lengths comes closest to the capacity;
walking back through the bitsets gives how many of each length it takes.  The
found pattern is repeated as often as the counts allow, so the number of
patterns follows the number of lengths, not of documents.
(Minimum bin slack: J. Gupta, J. Ho, A New Heuristic Algorithm for the
One-Dimensional Bin-Packing Problem, 1999.)
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.frames import cut, gapless
from cardloom.llm.workers import in_batches
from cardloom.llm.words import slices


def slack(fill: int, capacity: int) -> int:
    """Padding of a window with ``fill`` ids: none at a power of two."""
    return 0 if fill & (fill - 1) == 0 else capacity - fill


def closest(counts: dict[int, int], anchor: int, capacity: int) -> list[tuple[int, int]]:
    """The multiset with ``anchor`` and the least slack, as (length, times).

    ``counts`` is what remains, anchor included.  Bit i of ``reach`` says that some
    multiset of the lengths so far sums to i.
    """
    room = capacity - anchor
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        times = min(counts[length] - (length == anchor), room // length)
        if times < 1:
            continue
        before, block = reach, 1
        while times:  # 1, 2, 4, ... copies at once
            take = min(block, times)
            reach |= (reach << (take * length)) & mask
            times -= take
            block *= 2
        if reach != before:
            steps.append((length, before))
        if reach >> room & 1:
            break
    sums = [i for i in range(room + 1) if reach >> i & 1] if not reach >> room & 1 else [room]
    best = min(sums, key=lambda i: (slack(anchor + i, capacity), -i))
    used = {anchor: 1}
    for length, before in reversed(steps):
        while not before >> best & 1:
            used[length] = used.get(length, 0) + 1
            best -= length
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """(pattern, repeats) until every remainder is placed; a pattern is [(length, times), ...]."""
    left = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a length is not between 1 and the capacity")
    made = []
    while left:
        pattern = closest(left, max(left), capacity)
        repeats = min(left[k] // m for k, m in pattern)
        made.append((pattern, repeats))
        for k, m in pattern:
            left[k] -= m * repeats
            if not left[k]:
                del left[k]
    return made


def _placer(patterns: list[tuple[list[tuple[int, int]], int]]):
    """A function (length, rank within the length) -> (sequence_id, offset) on arrays.

    Rank r of a length belongs to the pattern whose share of that length holds r.
    """
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, repeats in patterns:
        offset = 0
        for k, m in pattern:
            rows.setdefault(k, []).append((taken.get(k, 0), m, sequence, offset))
            taken[k] = taken.get(k, 0) + m * repeats
            offset += k * m
        sequence += repeats
    tables = {k: np.array(v, np.int64).T for k, v in rows.items()}

    def place(lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k in np.unique(lengths):
            at = np.flatnonzero(lengths == k)
            first, times, base, start = tables[int(k)]
            row = np.searchsorted(first, ranks[at], "right") - 1
            inside = ranks[at] - first[row]
            ids[at] = base[row] + inside // times[row]
            offsets[at] = start[row] + inside % times[row] * k
        return ids, offsets

    return place


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of every piece of every document."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cardloom.llm.token_ids import encoder

        encode = encoder(tokenizer).encode
        for batch in (part for b in batches for part in slices(b, "text")):
            ids, at = encode(batch.column("text"))
            row, start, length, crc, out_ids = [], [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[at[i] : at[i + 1]], end_id).astype("<u4")
                for s in range(0, len(own), capacity):
                    piece = own[s : s + capacity]
                    row.append(i)
                    start.append(s)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece))
                    if with_ids:
                        out_ids.append(piece.astype(np.int32))
            doc_tokens = np.diff(at) + 1
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(doc_tokens[row], pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(out_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return in_batches(docs.select(F.col("doc_id").cast("long"), "text"), cut_up, schema, keep=True)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``capacity`` ids.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and with ``with_ids`` the ids themselves.  Each id of each document,
    its end id included, lies in exactly one piece.  Sequences are meant to be
    padded to ``capacity`` unless their length is a power of two.

    Edge cases: a null or empty text is one piece with the end id alone; a null
    doc_id stays null; rows that share a doc_id are separate documents; an empty
    table gives an empty result; other columns are ignored.
    """
    cut_up = cut(pieces(docs, tokenizer, capacity, end_id, with_ids))
    # At most `capacity` rows: one for each length.
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = _placer(plan(counts, capacity))
    ranked = gapless(cut_up, ["length"], "doc_id", "_rank", ties=("start", "ids_crc32", "doc_tokens"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            ids, offsets = place(columns["length"].to_numpy(), columns.pop("_rank").to_numpy())
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(ids), "offset": pa.array(offsets)})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return in_batches(ranked, put, schema, keep=True)
