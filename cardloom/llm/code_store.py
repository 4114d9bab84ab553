"""Token files of directly addressable codes.

An id is split into chunks of 8 bits.  Level 0 holds the lowest chunk of every id and
a bitmap that says which ids go on; level 1 holds the next chunk of those, and so
on.  A rank directory over each bitmap (ones before each block of 512 bits) tells where
an id goes on in the next level, so any id, or any run of ids, is read without
decoding what stands before it.
(N. Brisaboa, S. Ladra, G. Navarro, DACs: Bringing Direct Access to Variable-Length
Codes, 2013.)

A store is a folder of such files.  Documents lie in ascending key order across and within
files; every file has a table of its documents, and ``manifest`` (Parquet)
lists the files in order with the ids before each.  :func:`opened` reads single ids or runs of a file by seeking to
the bytes they need, and :func:`ids_at` those at any places of a store.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm.frames import parts, remove
from cardloom.llm.workers import in_batches
from cardloom.llm.words import slices

MAGIC = b"CLDAC001"
#: Bits of the bitmap that share an entry of the rank directory.
BLOCK = 512
#: A file is closed when it has so many ids, so a writer's memory is bounded.
FILE_IDS = 4 << 20

_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


class CodeArray:
    """Directly addressable codes of an array of unsigned ids."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int):
        self.levels, self.size = levels, size

    @classmethod
    def of(cls, ids: np.ndarray) -> CodeArray:
        rest, levels, size = ids.astype(np.uint32), [], len(ids)
        while len(rest) or not levels:
            more = rest > 255
            bits = np.packbits(more)
            ones = np.concatenate(([0], np.cumsum(np.add.reduceat(_ONES[bits], np.arange(0, len(bits), BLOCK // 8)) if len(bits) else [])))
            levels.append(((rest & 255).astype(np.uint8), bits, ones.astype(np.uint64)))
            rest = rest[more] >> 8
        return cls(levels, size)

    @staticmethod
    def _rank(bits: np.ndarray, ones: np.ndarray, i: int) -> int:
        """Ones before position i."""
        block = i // BLOCK
        n = int(ones[block]) + int(_ONES[bits[block * BLOCK // 8 : i // 8]].sum())
        return n + (int(bits[i // 8]) >> (8 - i % 8)).bit_count() if i % 8 else n

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value, shift = 0, 0
        for chunk, bits, ones in self.levels:
            value |= int(chunk[i]) << shift
            if not bits[i // 8] >> (7 - i % 8) & 1:
                break
            i = self._rank(bits, ones, i)
            shift += 8
        return value

    def run(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop``; those that go on lie side by side in the next level."""
        if not 0 <= start <= stop <= self.size:
            raise IndexError((start, stop))
        values, at, shift = np.zeros(stop - start, np.uint32), None, 0
        for chunk, bits, ones in self.levels:
            if start == stop:
                break
            got = chunk[start:stop].astype(np.uint32) << np.uint32(shift)
            if at is None:
                values |= got
            else:
                values[at] |= got
            more = np.flatnonzero(np.unpackbits(bits[start // 8 : (stop + 7) // 8])[start % 8 : start % 8 + stop - start])
            at = more if at is None else at[more]
            start = self._rank(bits, ones, start)
            stop = start + len(more)
            shift += 8
        return values


def to_bytes(keys: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: magic, sizes, keys, starts (one more), and per level its size, chunks, bitmap and directory."""
    codes = CodeArray.of(ids)
    out = [MAGIC, struct.pack("<QQQ", len(keys), len(ids), len(codes.levels)), keys.astype("<i8").tobytes(), starts.astype("<u8").tobytes()]
    for chunk, bits, ones in codes.levels:
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes(), bits.tobytes(), ones.astype("<u8").tobytes()]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


class _Stored:
    """An array in a file that reads what is asked for."""

    def __init__(self, file, at: int, kind: str, size: int):
        self.file, self.at, self.kind, self.size = file, at, np.dtype(kind), size

    def __getitem__(self, i):
        if isinstance(i, slice):
            a, b, _ = i.indices(self.size)
            self.file.seek(self.at + a * self.kind.itemsize)
            return np.frombuffer(self.file.read(max(b - a, 0) * self.kind.itemsize), self.kind)
        return self[i : i + 1][0]


def opened(file) -> tuple[_Stored, _Stored, CodeArray]:
    """Keys, starts and codes of a file that can seek; nothing is read but sizes until it is asked for.

    The sizes must add up to the file's; its checksum is not looked at, as that takes the whole file (see :func:`from_bytes`).
    """
    head = file.read(32)
    if head[:8] != MAGIC or len(head) < 32:
        raise ValueError("not a token file")
    n, size, depth = struct.unpack_from("<QQQ", head, 8)
    keys, starts = _Stored(file, 32, "<i8", n), _Stored(file, 32 + 8 * n, "<i8", n + 1)
    at, levels = 40 + 16 * n, []
    for _ in range(depth):
        told = _Stored(file, at, "<u8", 1)[:]
        if not len(told):
            raise ValueError("not a whole token file")
        length = int(told[0])
        n_bits = (length + 7) // 8
        n_ones = -(-n_bits // (BLOCK // 8)) + 1
        levels.append((_Stored(file, at + 8, "u1", length), _Stored(file, at + 8 + length, "u1", n_bits), _Stored(file, at + 8 + length + n_bits, "<u8", n_ones)))
        at += 8 + length + n_bits + 8 * n_ones
    file.seek(0, 2)
    if file.tell() != at + 4:
        raise ValueError("not a whole token file")
    return keys, starts, CodeArray(levels, size)


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, CodeArray]:
    """Keys, starts and codes of a file; a damaged file is an error."""
    if data[:8] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a whole token file")
    n, size, depth = struct.unpack_from("<QQQ", data, 8)
    at = 32
    keys = np.frombuffer(data, "<i8", n, at)
    starts = np.frombuffer(data, "<u8", n + 1, at + 8 * n).astype(np.int64)
    at += 16 * n + 8
    levels = []
    for _ in range(depth):
        (length,) = struct.unpack_from("<Q", data, at)
        n_bits = (length + 7) // 8
        n_ones = -(-n_bits // (BLOCK // 8)) + 1
        chunk = np.frombuffer(data, np.uint8, length, at + 8)
        bits = np.frombuffer(data, np.uint8, n_bits, at + 8 + length)
        ones = np.frombuffer(data, "<u8", n_ones, at + 8 + length + n_bits)
        levels.append((chunk, bits, ones))
        at += 8 + length + n_bits + 8 * n_ones
    return keys, starts, CodeArray(levels, size)


def write_store(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``end_id``, and write the ids into ``folder`` in ascending key order.

    ``folder`` is a URI that driver and executors share.  A file gets a name of its own
    for each attempt, and the manifest names those of the attempts that counted, so lost
    executors and repeated tasks do no harm.

    Edge cases: a null or empty text is the end id alone; a null key comes first and is
    stored as the least long; rows that share a key are ordered by text; an
    empty table gives a store without files; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.repartitionByRange(parts(spark), "_key").sortWithinPartitions("_key", "_text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from cardloom.llm.token_ids import encoder

        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer).encode
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        keys, ends, ids, size, number = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.dac"
            n = [len(k) for k in keys]
            body = to_bytes(np.concatenate(keys), np.concatenate([[0], *ends]), np.concatenate(ids))
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(body)
            return pa.RecordBatch.from_pydict({"part": [part], "number": [number], "name": [name], "n_docs": [sum(n)], "n_ids": [size]}, pa.schema([("part", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in (piece for b in batches for piece in slices(b, "_text")):
            got, at = encode(batch.column("_text"))
            with_end = np.insert(got, at[1:], end_id)
            at = at + np.arange(len(at))
            keys.append(batch.column("_key").to_numpy())
            ends.append(at[1:] + size)
            ids.append(with_end)
            size += len(with_end)
            if size >= FILE_IDS:
                yield close()
                keys, ends, ids, size, number = [], [], [], 0, number + 1
        if keys:
            yield close()

    # A row for each file, written by the tasks that counted.
    in_batches(rows, write, "part int, number int, name string, n_docs long, n_ids long", keep=True).write.parquet(f"{folder}/files")
    files = spark.read.parquet(f"{folder}/files")
    # Ids before each partition (as many rows as a shuffle has partitions), and before each file in it.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.withColumn("_earlier", earlier).join(F.broadcast(totals.select("part", before.alias("_before"))), "part")
    placed.select("name", "n_docs", "n_ids", (F.col("_before") + F.col("_earlier")).alias("before")).write.parquet(f"{folder}/manifest")
    remove(spark, f"{folder}/files")


def ids_at(spark: SparkSession, folder: str, places: DataFrame, place: str = "place") -> DataFrame:
    """place and id: the ids at any places (0, 1, 2, ... over the whole store) of a column, by seeking in the files.

    Each file is opened once by a task and only the bytes that the wanted ids need are read.  Places are dealt out to
    files by ranges of ``FILE_IDS``, of which a file touches few.

    Edge cases: a place that is null or outside the store gives no row; a place that is asked for twice gives two rows.
    """
    files = spark.read.parquet(f"{folder}/manifest").where("n_ids > 0").withColumn("_last", F.col("before") + F.col("n_ids") - 1)
    files = files.withColumn("_range", F.explode(F.expr(f"sequence(before div {FILE_IDS}, _last div {FILE_IDS})")))
    wanted = places.select(F.col(place).cast("long").alias("_place")).withColumn("_range", F.expr(f"_place div {FILE_IDS}"))
    found = wanted.join(files, "_range").where("_place between before and _last").select("name", (F.col("_place") - F.col("before")).alias("i"), F.col("_place").alias("place"))
    found = found.repartition(parts(spark), "name", F.expr(f"place div {FILE_IDS // 64}")).sortWithinPartitions("name", "i")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name, file, codes = None, None, None
        for batch in batches:
            ids = []
            for own, i in zip(batch.column("name").to_pylist(), batch.column("i").to_pylist(), strict=True):
                if own != name:
                    if file:
                        file.close()
                    name, file = own, fs.open_input_file(f"{base}/{own}")
                    codes = opened(file)[2]
                ids.append(codes[i])
            yield pa.RecordBatch.from_pydict({"place": batch.column("place"), "id": pa.array(ids, pa.int64())})
        if file:
            file.close()

    return in_batches(found, look, "place long, id long")


def read_store(spark: SparkSession, folder: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Read a store back: key, start (ids of all documents before), n_tokens, ids_crc32 (and ids)."""
    schema = f"{key} long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files = spark.read.parquet(f"{folder}/manifest").repartition(parts(spark), "name")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with fs.open_input_stream(f"{base}/{name}") as f:
                    keys, starts, codes = from_bytes(f.read())
                # one document at a time, by direct access
                runs = [codes.run(a, b) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                columns = {
                    key: pa.array(keys, pa.int64(), mask=keys == -(2**63)),
                    "start": pa.array(starts[:-1] + before),
                    "n_tokens": pa.array(np.diff(starts)),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4")) for x in runs], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([x.astype(np.int32) for x in runs], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return in_batches(files.select("name", "before"), read, schema)
