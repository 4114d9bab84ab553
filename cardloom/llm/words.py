"""Vectorised word work on Arrow text batches.

A word is a maximal run of bytes other than space, tab, line feed, vertical
tab, form feed and carriage return (``[^\\x20\\x09-\\x0D]+``; in UTF-8 these bytes
occur in no other character).  Everything here works on the flat UTF-8 buffer
of a batch, never on Python strings one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: At most so many bytes of text are worked on at once (a longer text alone).
SLICE_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that begin a code point.
IS_FIRST = (np.arange(256) & 0xC0) != 0x80


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` has about ``limit`` bytes."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, and where each text begins; null is empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def coded(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number the distinct byte strings: codes of each, and the distinct ones.

    ``starts``: where each string begins in ``data``; it ends where the next begins.
    """
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    offsets = np.append(starts, len(data)).astype(np.int64)
    strings = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    found = strings.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number the distinct integers in order of appearance: codes, distinct values."""
    found = pa.array(values).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_numpy(zero_copy_only=False)


class Words:
    """The words of a batch of texts.

    ``code``: each word's number among the distinct words, ``distinct``: those,
    ``doc``: the text it stands in, ``first``: where each text's words begin.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n_docs = len(offsets) - 1
        inside = ~IS_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        begins[heads] = inside[heads]
        at = np.flatnonzero(begins)
        packed = np.cumsum(inside)
        self.code, self.distinct = coded(data[inside], packed[at] - 1)
        self.first = np.searchsorted(at, offsets)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        self.inside = inside

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many elements of ``mask`` are true in each text."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]
