"""Pattern packing by non-negative least squares.

Documents become pieces of at most ``capacity`` tokens. The histogram of piece lengths, at most ``capacity`` counts
whatever the corpus holds, goes to the driver, which plans how many sequences of which make-up there are:

1. *Patterns*: lengths are rounded up to steps of ``capacity / grid`` tokens, rounded up itself; every way to fill the whole
   steps of a sequence with up to ``parts`` rounded lengths is a pattern. Non-negative least squares fits repeat counts of the patterns to the histogram; the
   counts are rounded down and laid out as ranges of equal sequences.
2. *Residuals*: what is left goes, longest first, to the open sequence it fits best. Sequences with equal room are
   handled together as a range, so the work follows the number of lengths, not of documents.

The plan is a table of runs: pieces of length L with ranks from r take sequences from s at offset o. A piece finds its
run by its length and its rank among the pieces of that length. Runs follow the lengths and how counts divide among
patterns, not the documents: a hundredfold corpus makes a few times as many.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm import tokens
from plumbline.llm._common import slices, small, stored, text_of, texts

CAPACITY = 4096
#: Steps of the grid, most pieces of a pattern, and the least piece of one in steps: smaller pieces are kept for the gaps.
GRID, PARTS, LEAST = 32, 4, 4
#: Ranges into which the ranks of one length are dealt, at least; the most pieces of one length that a range is to hold; and
#: the rows up to which the ranges' sizes are broadcast.
RANK_CHUNKS, CHUNK_PIECES, FEW_SIZES = 64, 1 << 20, 1 << 19


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids with the end id; only longer ones are cut.

    A null or empty text is one piece that holds the end id. Nothing is shuffled."""
    path = tokenizer or tokens.tokenizer_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    names, width = ["doc_id", "piece", "start", "length", "ids_crc32"], 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, out = batch.column(0).to_pylist(), []
            for key, ids in zip(keys, tokens.encoded(texts(batch, "t"), path), strict=True):
                for i, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    out.append((key, i, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("t")).mapInArrow(cut, schema)


def fit_non_negative(a: np.ndarray, b: np.ndarray, rounds: int = 400, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 with least ``|a x - b|``, by an active set: the column of steepest descent joins; columns that would turn negative leave."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        if slope.size == 0 or slope.max() <= tolerance * max(1.0, float(np.abs(b).max(initial=0))):
            break
        active[slope.argmax()] = True
        while True:
            inside = np.flatnonzero(active)
            goal = np.linalg.lstsq(a[:, inside], b, rcond=None)[0]
            if goal.min(initial=1.0) > 0:
                x[:] = 0
                x[inside] = goal
                break
            falling = goal <= 0
            step = np.min(x[inside][falling] / np.maximum(x[inside][falling] - goal[falling], 1e-300))
            x[inside] += step * (goal - x[inside])
            active[inside[x[inside] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


@cache
def patterns(total: int, parts: int, least: int = 1) -> np.ndarray:
    """All ways to write ``total`` as a sum of 2 to ``parts`` whole numbers from ``least``, as counts by number: one column each."""
    found: list[list[int]] = []

    def extend(chosen: list[int], left: int, most: int) -> None:
        if left == 0 and len(chosen) > 1:
            found.append(chosen)
        elif left and len(chosen) < parts:
            for part in range(min(left, most), least - 1, -1):
                extend([*chosen, part], left - part, part)

    extend([], total, total)
    counts = np.zeros((total + 1, len(found)))
    for column, chosen in enumerate(found):
        for part in chosen:
            counts[part, column] += 1
    return counts[1:]


class _Plan:
    """Runs laid out so far, pieces not yet laid out by length, and open ranges of sequences by the room they have."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left, self.rank = capacity, dict(histogram), dict.fromkeys(histogram, 0)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.room: dict[int, list[tuple[int, int]]] = {}
        self.sequences = 0

    def place(self, length: int, count: int, first: int, room: int) -> None:
        """``count`` pieces of ``length``, one into each of the sequences from ``first``, which have ``room``."""
        self.runs.append((length, self.rank[length], count, first, self.capacity - room))
        self.rank[length] += count
        self.left[length] -= count

    def opened(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def by_patterns(self, grid: int, parts: int, least: int) -> None:
        width = -(-self.capacity // grid)
        grid = self.capacity // width  # whole steps; a length beyond them is in no pattern
        least = min(least, grid)
        bins: list[list[int]] = [[] for _ in range(-(-self.capacity // width))]
        for length in sorted(self.left, reverse=True):
            if length < self.capacity:
                bins[-(-length // width) - 1].append(length)
        counts = np.array([sum(self.left[x] for x in own) for own in bins[:grid]], float)
        table = patterns(grid, parts, least)
        counts[: least - 1] = 0
        repeats = np.floor(fit_non_negative(table, counts) + 1e-9).astype(int)
        for column in np.argsort(-repeats, kind="stable"):
            slots = [i for i in range(grid - 1, -1, -1) for _ in range(int(table[i, column]))]
            need = {i: slots.count(i) for i in slots}
            wanted = min([int(repeats[column]), *(sum(self.left[x] for x in bins[i]) // n for i, n in need.items())])
            while wanted > 0:
                chosen: list[int] = []
                for i in slots:
                    chosen.append(next(x for x in bins[i] if self.left[x] > chosen.count(x)))
                run = min([wanted, *(self.left[x] // chosen.count(x) for x in chosen)])
                first, room = self.opened(run), self.capacity
                for length in chosen:
                    self.place(length, run, first, room)
                    room -= length
                self.room.setdefault(room, []).append((first, run))
                wanted -= run

    def by_best_fit(self) -> None:
        for length in sorted(self.left, reverse=True):
            while (count := self.left[length]) > 0:
                room = min((r for r, ranges in self.room.items() if r >= length and ranges), default=None)
                if room is None:
                    each = self.capacity // length
                    room, whole = self.capacity, -(-count // each)
                    self.room.setdefault(room, []).append((self.opened(whole), whole))
                first, size = self.room[room].pop()
                if not self.room[room]:
                    del self.room[room]
                run = min(count, size)
                self.place(length, run, first, room)
                if size > run:
                    self.room.setdefault(room, []).append((first + run, size - run))
                self.room.setdefault(room - length, []).append((first, run))


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID, parts: int = PARTS, least: int = LEAST) -> np.ndarray:
    """Runs ``(length, first rank, count, first sequence, offset)`` that hold every piece of the histogram once."""
    plan = _Plan({k: int(v) for k, v in histogram.items() if v}, capacity)
    if capacity in plan.left:
        plan.place(capacity, plan.left[capacity], plan.opened(plan.left[capacity]), capacity)
    plan.by_patterns(grid, parts, least)
    plan.by_best_fit()
    return np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 5)


def ranked(rows: DataFrame, chunks: int = RANK_CHUNKS) -> DataFrame:
    """Adds ``rank``, from 0 without gaps among the rows of one length.

    The rows of a length are dealt into ``chunks`` by a hash, ranked there, and moved up by the sizes of the chunks
    before; so a length that a third of all rows share is ranked by many tasks. Sizes are a row for each length and chunk;
    they are counted before they are broadcast."""
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    before = W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "chunk").agg(F.count("*").alias("size"))
    moved = small(stored(sizes.select("length", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("moved")), "ranks"), FEW_SIZES)
    inside = W.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    return dealt.withColumn("own", F.row_number().over(inside) - 1).join(moved, ["length", "chunk"]).withColumn("rank", F.col("moved") + F.col("own"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, grid: int = GRID, parts: int = PARTS, least: int = LEAST) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``sequence_id`` numbers the sequences from 0; ``offset`` is the place there, gapless from 0. Rows that repeat a
    document are packed again; a null ``doc_id`` is packed as any other, a null or empty text as the end id alone. An empty
    table gives no rows. Any capacity is packed by patterns first. Other columns aren't read, whatever their names."""
    cut = stored(pieces(docs, doc_id, text, capacity, tokenizer), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan_runs(histogram, capacity, grid, parts, least)
    shared = cut.sparkSession.sparkContext.broadcast(runs)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        starts = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            run = table[np.searchsorted(starts, batch["length"].to_numpy() * (1 << 44) + batch["rank"].to_numpy(), side="right") - 1]
            yield batch.drop(columns="rank").assign(sequence_id=run[:, 3] + batch["rank"].to_numpy() - run[:, 1], offset=run[:, 4])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    chunks = max(RANK_CHUNKS, -(-max(histogram.values(), default=0) // CHUNK_PIECES))
    return ranked(cut, chunks).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(assign, schema)
