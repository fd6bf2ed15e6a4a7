"""Token ids of a corpus in one compressed file per shard: a wavelet matrix, with rank and select.

A shard's record is a header, the table of its documents and one bit-plane per bit of the largest id, from the highest
bit down. A plane holds the ids' bits in the order that the planes above left: zeros first, else in order (a stable
partition). Each plane is compressed by itself. Rank samples every ``SAMPLE`` bits make access, counting of an id and
lookup of its n-th occurrence cost one step per plane. Shards are rows of a Parquet table in the shared folder, so any
store that Spark reads will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm import tokens
from plumbline.llm._common import shared_folder, slices, text_of, texts

MAGIC = b"PLWM2\0\0\0"
#: Bits between rank samples; tokens after which a shard is closed.
SAMPLE, SHARD_TOKENS = 512, 1 << 18
SHARD_SCHEMA = "part int, place int, n_docs long, n_tokens long, shard binary"


def _packed(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


class WaveletMatrix:
    """A sequence of ids below 2**32 as bit-planes. Positions and occurrence numbers count from 0."""

    def __init__(self, size: int, planes: list[np.ndarray], zeros: list[int]):
        self.size, self.planes, self.zeros = size, planes, zeros
        self._samples: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max(initial=0))
        current = ids.astype(np.uint16 if top < 1 << 16 else np.uint32)
        planes, zeros = [], []
        for level in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (current & current.dtype.type(1 << level)).astype(bool)
            planes.append(np.packbits(ones, bitorder="little"))
            high = np.flatnonzero(ones)
            low = np.flatnonzero(~ones)
            zeros.append(len(low))
            current = np.concatenate([current.take(low), current.take(high)])
        return cls(len(ids), planes, zeros)

    def decode(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.size, kind)
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            ones = np.unpackbits(plane, count=self.size, bitorder="little").view(bool)
            before = np.empty_like(out)
            before[np.flatnonzero(~ones)], before[np.flatnonzero(ones)] = out[:zeros], out[zeros:] | kind(1 << level)
            out = before
        return out.astype(np.uint32)

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at >> 3]) >> (at & 7) & 1

    def _ones(self, level: int, end: int) -> int:
        """Ones among the first ``end`` bits of a plane."""
        if self._samples[level] is None:
            counts = np.bitwise_count(self.planes[level]).astype(np.int64)
            width = SAMPLE // 8
            counts = np.pad(counts, (0, -len(counts) % width)).reshape(-1, width).sum(axis=1)
            self._samples[level] = np.concatenate([[0], np.cumsum(counts)])
        block = end // SAMPLE
        start = block * SAMPLE
        tail = np.unpackbits(self.planes[level][start >> 3 : (end + 7) >> 3], count=end - start, bitorder="little").sum() if end > start else 0
        return int(self._samples[level][block]) + int(tail)

    def access(self, at: int) -> int:
        if not 0 <= at < self.size:
            raise IndexError(at)
        found = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, at), self._ones(level, at)
            found = found << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return found

    def _down(self, value: int, start: int, end: int) -> tuple[int, int]:
        """The range in which the occurrences of ``value`` in [start, end) stand below the last plane."""
        if value >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, start), self._ones(level, end)
            if value >> (len(self.planes) - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        first, last = self._down(value, start, self.size if end is None else end)
        return last - first

    def rank(self, value: int, end: int) -> int:
        return self.count(value, 0, end)

    def select(self, value: int, nth: int) -> int:
        """The position of the n-th occurrence, or -1."""
        first, last = self._down(value, 0, self.size)
        if not 0 <= nth < last - first:
            return -1
        at = first + nth
        for level in range(len(self.planes) - 1, -1, -1):
            one = value >> (len(self.planes) - 1 - level) & 1
            at = self._find(level, at - self.zeros[level] if one else at, one)
        return at

    def _find(self, level: int, nth: int, one: int) -> int:
        """The place of the n-th one (or zero) of a plane, by bisection over ranks."""
        low, high = 0, self.size
        while low < high:
            middle = (low + high) // 2
            ones = self._ones(level, middle + 1)
            if (ones if one else middle + 1 - ones) > nth:
                high = middle
            else:
                low = middle + 1
        return low

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file: magic, sizes, the document table, then each plane with its number of zeros."""
    matrix = WaveletMatrix.build(ids)
    table = [
        _packed(np.array([x if x is not None else 0 for x in doc_ids], "<i8")),
        _packed(np.array([x is None for x in doc_ids], "u1")),
        _packed(np.array(lengths, "<i8")),
        *map(_packed, matrix.planes),
    ]
    head = struct.pack(f"<8sQQI{len(matrix.planes)}Q{len(table)}Q", MAGIC, len(doc_ids), matrix.size, len(matrix.planes), *matrix.zeros, *map(len, table))
    return head + b"".join(table)


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """``doc_ids, lengths, matrix`` of a file that :func:`write_shard` made."""
    magic, n_docs, size, levels = struct.unpack_from("<8sQQI", data)
    if magic != MAGIC:
        raise ValueError("not a shard file")
    numbers = struct.unpack_from(f"<{2 * levels + 3}Q", data, 28)
    zeros, sizes, at, parts = list(numbers[:levels]), numbers[levels:], 28 + 8 * (2 * levels + 3), []
    for length in sizes:
        parts.append(zstandard.ZstdDecompressor().decompress(data[at : at + length]))
        at += length
    missing = np.frombuffer(parts[1], "u1")
    doc_ids = [None if gone else int(x) for x, gone in zip(np.frombuffer(parts[0], "<i8"), missing, strict=True)]
    if len(doc_ids) != n_docs:
        raise ValueError("shard file is damaged")
    return doc_ids, np.frombuffer(parts[2], "<i8"), WaveletMatrix(size, [np.frombuffer(p, "u1") for p in parts[3:]], zeros)


def write_ids(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> str:
    """Encode every whole text, append the end id, and write shards in ascending ``doc_id`` order; returns the path.

    One range shuffle sorts the documents; tasks write their range as shards of about ``shard_tokens`` ids, each closed
    at a document's end. Null ids come first; equal ids are ordered by text; a null text is empty. Without a path, a
    new one in the shared folder is taken. An empty table gives a table without shards."""
    if path is None:
        import uuid

        path = f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    source = tokenizer or tokens.tokenizer_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, size = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        held: list[bytes] = []

        def shard() -> pa.RecordBatch:
            data = write_shard(keys, [len(x) // 4 for x in held], np.frombuffer(b"".join(held), "<u4"))
            row = [[part], [place], [len(keys)], [size], [data]]
            return pa.record_batch([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "place", "n_docs", "n_tokens", "shard"])

        for batch in slices(batches):
            for key, ids in zip(batch.column(0).to_pylist(), tokens.encoded(texts(batch, "t"), source), strict=True):
                keys.append(key)
                held.append(ids)
                size += len(ids) // 4
                if size >= shard_tokens:
                    yield shard()
                    keys, held, size, place = [], [], 0, place + 1
        if keys:
            yield shard()

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("t")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "t")
    ordered.mapInArrow(write, SHARD_SCHEMA).write.option("compression", "none").option("parquet.page.size", 1 << 16).parquet(path)
    return path


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, place, shard_start``: ids in all shards before. Sums run inside a task's shards, then over tasks."""
    rows = _shards(spark, path).select("part", "place", "n_tokens")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("moved"))
    inside = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    own = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return rows.withColumn("own", own).join(totals, "part").select("part", "place", (F.col("moved") + F.col("own")).alias("shard_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the shard files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "place", "doc_id", "own", "n_tokens", "ids_crc32"]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        for batch in slices(batches, 1):
            part, place, data = (batch.column(i)[0].as_py() for i in range(3))
            doc_ids, lengths, matrix = read_shard(data)
            view, ends = memoryview(matrix.decode().astype("<u4").tobytes()), np.cumsum(lengths)
            own = ends - lengths
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(own.tolist(), ends.tolist(), strict=True)]
            columns = ([part] * len(doc_ids), [place] * len(doc_ids), doc_ids, own, lengths, sums)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = _shards(spark, path).select("part", "place", "shard").mapInArrow(read, "part int, place int, doc_id long, own long, n_tokens long, ids_crc32 long")
    joined = rows.join(shard_starts(spark, path), ["part", "place"])
    return joined.select("doc_id", (F.col("shard_start") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def id_counts(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """``id, n``: how often each id occurs, by rank in every shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            matrix = read_shard(batch.column(0)[0].as_py())[2]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([matrix.count(x) for x in ids], pa.int64())], ["id", "n"])

    return _shards(spark, path).select("shard").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def id_places(spark: SparkSession, path: str, value: int) -> DataFrame:
    """``doc_id, at``: every occurrence of an id as its place in a document, by select in every shard."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            doc_ids, lengths, matrix = read_shard(batch.column(0)[0].as_py())
            places, ends = np.array(matrix.occurrences(value), np.int64), np.cumsum(lengths)
            which = np.searchsorted(ends, places, side="right")
            yield pa.record_batch([pa.array([doc_ids[i] for i in which], pa.int64()), pa.array(places - (ends - lengths)[which], pa.int64())], ["doc_id", "at"])

    return _shards(spark, path).select("shard").mapInArrow(find, "doc_id long, at long")
