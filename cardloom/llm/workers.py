"""Memory of Python workers.

A worker lives on from task to task and from operator to operator.  What it has learnt
(a vocabulary's pieces) is kept while the same operator runs and dropped when another begins, and
free memory goes back to the system after each task.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of an Arrow batch: texts can be long.
BATCH_ROWS = 1000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

_held: dict[tuple[str, str], object] = {}


def held(kind: str, path: str, make: Callable[[str], object]):
    """What this worker has made of ``path``; anything else it holds is dropped."""
    key = (kind, path)
    if key not in _held:
        make_room()
        _held[key] = make(path)
    return _held[key]


def give_back() -> None:
    """Return free memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library: nothing to return
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def make_room() -> None:
    _held.clear()
    give_back()


def in_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keep: bool = False) -> DataFrame:
    """``mapInArrow`` with small batches; ``keep``: the worker may go on holding what it has learnt.

    The session's limit of rows for a batch is lowered to ``BATCH_ROWS`` if it is higher or unset.
    """
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_SETTING, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            make_room()
        yield from work(batches)
        give_back()

    return df.mapInArrow(run, schema)
