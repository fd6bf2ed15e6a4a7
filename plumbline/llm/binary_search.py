"""Exact top-k search in Hamming space by incremental multi-index hashing.

A code of 64 bits is cut into segments; an index holds, for each segment, the codes sorted by its value. A query looks up
its own segment values first, then the values one bit away in one segment after another, then two bits, and so on. Once
the first ``j`` segments were searched to radius ``r + 1`` and the others to ``r``, every code within distance
``segments * (r + 1) + j - 1`` has been seen: a code farther in each segment than it was searched is farther in sum. A
query stops when its k-th verified distance is no more than that; no bound on candidates is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm._common import Scratch

BITS, SEGMENTS = 64, 4
#: Distinct codes of an index part, the most distinct queries of a block, and the fewest that are worth a task of their own.
PART_CODES, BLOCK_QUERIES, FEW_QUERIES = 1 << 19, 1 << 18, 256
#: Queries whose results a task holds before it hands them on.
BATCH_QUERIES = 4096


def code_of(embedding: Column) -> Column:
    """64 bits of an embedding as a long: the signs of its components, in order, folded over if there are more than 64.

    Component i sets bit ``i mod 64`` if more of the components that share the bit are positive than not. Null is no code."""
    size = F.size(embedding)
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda b: F.when(
            F.aggregate(
                F.filter(embedding, lambda x, i: (i % BITS) == b),
                F.lit(0),
                lambda n, x: n + F.when(x > 0, 1).otherwise(-1),
            ) > 0,
            F.call_function("shiftleft", F.lit(1).cast("long"), b),
        ).otherwise(F.lit(0).cast("long")),
    )
    return F.when(size > 0, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


@cache
def _flips(width: int, radius: int) -> np.ndarray:
    """All segment values with ``radius`` bits set."""
    return np.array([sum(1 << b for b in chosen) for chosen in combinations(range(width), radius)], np.uint64)


class MultiIndex:
    """Codes sorted by each segment's value. Codes are distinct; ``search`` gives every code that can be among the k nearest."""

    def __init__(self, codes: np.ndarray, segments: int = SEGMENTS):
        self.codes, self.segments, self.width = codes.astype(np.uint64), segments, BITS // segments
        self.order, self.starts = [], []
        for s in range(segments):
            values = self._values(self.codes, s)
            self.order.append(np.argsort(values, kind="stable"))
            self.starts.append(np.searchsorted(values[self.order[s]], np.arange((1 << self.width) + 1)))

    def _values(self, codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(s * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def search(self, query: np.uint64, k: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of codes, nearest first, until they stand for at least ``k`` rows and the last distance is
        covered. ``size`` is the number of rows of each code. All codes at the last distance are there, for ties."""
        seen = np.zeros(len(self.codes), bool)
        places, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        per_distance = np.zeros(BITS + 1, np.int64)
        for radius in range(self.width + 1):
            flips = _flips(self.width, radius)
            for s in range(self.segments):
                own = int(self._values(np.array([query], np.uint64), s)[0])
                values = (flips ^ np.uint64(own)).astype(np.int64)
                first, last = self.starts[s][values], self.starts[s][values + 1]
                busy = last > first
                first, counts = first[busy], (last - first)[busy]
                if len(counts):
                    steps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    found = self.order[s][np.repeat(first, counts) + steps]
                    found = found[~seen[found]]
                    seen[found] = True
                    d = np.bitwise_count(self.codes[found] ^ query).astype(np.int64)
                    places.append(found)
                    distances.append(d)
                    np.add.at(per_distance, d, size[found])
                covered = self.segments * radius + s
                if per_distance[: covered + 1].sum() >= k:
                    return self._sorted(places, distances, k, per_distance)
        return self._sorted(places, distances, k, per_distance)

    def _sorted(self, places: list, distances: list, k: int, per_distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        reached = np.flatnonzero(np.cumsum(per_distance) >= k)
        p, d = np.concatenate(places), np.concatenate(distances)
        keep = d <= (reached[0] if len(reached) else BITS)
        order = np.argsort(d[keep], kind="stable")
        return p[keep][order], d[keep][order]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, segments: int = SEGMENTS, part_codes: int = PART_CODES, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, neighbour_id, distance``: the k nearest other rows of each query by (distance, id), exact.

    ``rows`` and ``queries`` have ``id, code``; null ids or codes are left out of both. Rows with equal codes share one entry
    that holds its k + 1 least ids, which is all that a top k can show of them, so a vector that a third of all rows share
    is one entry; they are cut in each task before the exchange. Queries with equal codes are searched once. The query set
    meets all rows in blocks: parts of the index and blocks of queries, both bounded, meet as one row each, and a part's
    index is built once for the whole block. Blocks are large, so that a part is copied for few of them, but a small query
    set is dealt to as many tasks as there are cores. Each pair gives k rows a query. A repeated id counts once; an empty
    table gives no rows. Other columns aren't read, whatever their names."""
    scratch = Scratch(rows.sparkSession)
    entries = scratch.stored(_entries(rows, k + 1), "codes")
    asked = scratch.stored(queries.where("id is not null and code is not null").select("id", "code").distinct(), "queries")
    n, m = entries.count(), asked.select("code").distinct().count()
    parts, cores = max(1, -(-n // part_codes)), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-m // block_queries), min(-(-m // FEW_QUERIES), -(-cores // parts)))

    packed = (
        entries.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int"))
        .groupBy("part")
        .agg(F.collect_list(F.struct("code", "ids")).alias("entries"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    blocked = (
        asked.select("code").distinct()
        .withColumn("block", F.pmod(F.xxhash64(F.lit(1), "code"), F.lit(blocks)).cast("int"))
        .groupBy("block")
        .agg(F.collect_list("code").alias("codes"))
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, asked_codes in zip(batch["entries"], batch["codes"], strict=True):
                codes = np.array([e["code"] for e in own], np.int64).astype(np.uint64)
                ids = [e["ids"] for e in own]
                size = np.array([len(x) for x in ids], np.int64)
                index = MultiIndex(codes, segments)
                for start in range(0, len(asked_codes), BATCH_QUERIES):
                    out: list[tuple[int, int, int]] = []
                    for query in asked_codes[start : start + BATCH_QUERIES]:
                        places, distances = index.search(np.int64(query).astype(np.uint64), k + 1, size)
                        found = sorted((int(d), int(i)) for p, d in zip(places, distances, strict=True) for i in ids[p])[: k + 1]
                        out += [(int(query), i, d) for d, i in found]
                    yield pd.DataFrame(out, columns=["code", "neighbour_id", "distance"])

    pairs = packed.join(blocked, "block").select("entries", "codes")
    found = pairs.repartition(parts * blocks).mapInPandas(search, "code long, neighbour_id long, distance int")
    best = W.partitionBy("code").orderBy("distance", "neighbour_id")
    merged = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    joined = asked.withColumnRenamed("id", "query_id").join(merged, "code").where("query_id != neighbour_id")
    order = W.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance")


def _entries(rows: DataFrame, most: int) -> DataFrame:
    least = W.partitionBy("code").orderBy("id")
    known = rows.where("id is not null and code is not null").select("id", "code")
    first = known.withColumn("n", F.dense_rank().over(least)).where(F.col("n") <= most)
    return first.groupBy("code").agg(F.array_sort(F.collect_set("id")).alias("ids"))
