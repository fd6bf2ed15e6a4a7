"""Quality classifier: learned vectors of hashed words, word pairs and character n-grams, averaged per document; softmax output.

Training is numpy stochastic gradient descent over a bounded sample of labelled rows. Executors hash their features and
write them as a table; one task on an executor reads it and learns, so the driver holds the finished model only, and a lost
executor costs no more than that task. The output layer is linear in the document's average, so for scoring each feature's vector shrinks to one
number, its share of the log odds: the model that executors get is ``buckets`` floats, and a word's numbers are computed
once and remembered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm._common import Scratch, slices, sole, text_of, texts

#: Words a worker remembers.
MEMO_WORDS = 300_000
PAIR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows that training takes; of more, those with the least hash of their id.

    The training task holds six bytes for each distinct feature of each of these rows."""

    buckets: int = 1 << 18
    width: int = 12
    shortest: int = 3
    longest: int = 5
    epochs: int = 6
    rate: float = 0.4
    sample_rows: int = 6000
    seed: int = 7


class _Words:
    """Each word's own hash and the buckets of the word and its character n-grams, kept in growing arrays."""

    def __init__(self, settings: Settings, shares: np.ndarray | None = None):
        self.settings, self.shares, self.known = settings, shares, {}
        self.hashes = np.zeros(MEMO_WORDS, np.uint64)
        self.sums, self.counts = np.zeros(MEMO_WORDS), np.zeros(MEMO_WORDS)

    def grams(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the character n-grams of words framed by ``<`` and ``>``, and the place of each one's word in the list."""
        s = self.settings
        framed = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
        found, owners, rolled = [], [], np.zeros(len(framed), np.uint64)
        for n in range(1, s.longest + 1):
            size = len(framed) - n + 1
            if size <= 0:
                break
            rolled = rolled[:size] * np.uint64(0x100000001B3) + framed[n - 1 :]
            if n >= s.shortest:
                inside = owner[:size] == owner[n - 1 :]
                h = (rolled[inside] + np.uint64(n)) * PAIR
                found.append(((h ^ (h >> np.uint64(32))) % np.uint64(s.buckets)).astype(np.int64))
                owners.append(owner[:size][inside])
        return np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(owners or [np.zeros(0, np.int64)])

    def own(self, hashes: np.ndarray) -> np.ndarray:
        """Buckets of the words themselves."""
        return ((hashes >> np.uint64(7)) % np.uint64(self.settings.buckets)).astype(np.int64)

    def index(self, words: list[bytes]) -> np.ndarray:
        """Places of the words in the arrays."""
        known = self.known
        fresh = set(words).difference(known)
        if len(known) + len(fresh) > len(self.hashes):
            known.clear()
            fresh = set(words)
            if len(fresh) > len(self.hashes):
                self.hashes = np.zeros(2 * len(fresh), np.uint64)
                self.sums, self.counts = np.zeros(2 * len(fresh)), np.zeros(2 * len(fresh))
        if fresh:
            words_now, at = list(fresh), np.arange(len(known), len(known) + len(fresh))
            known.update(zip(words_now, at.tolist(), strict=True))
            self.hashes[at] = np.fromiter(map(xxhash.xxh3_64_intdigest, words_now), np.uint64, len(words_now))
            if self.shares is not None:
                found, owner = self.grams(words_now)
                self.sums[at] = np.bincount(owner, self.shares[found], len(words_now)) + self.shares[self.own(self.hashes[at])]
                self.counts[at] = np.bincount(owner, minlength=len(words_now)) + 1
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """Buckets of the pairs of neighbouring words."""
        h = self.hashes[at]
        mixed = (h[:-1] * PAIR) ^ (h[1:] + (h[:-1] >> np.uint64(29)))
        return ((mixed ^ (mixed >> np.uint64(32))) * PAIR >> np.uint64(20)).astype(np.int64) % self.settings.buckets


def features(words: _Words, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs, 65,535 times at most; an end mark makes that never empty."""
    split = text.split()
    at = words.index(split)
    own = [words.own(words.hashes[at]), words.grams(split)[0], words.pairs(at)]
    found, counts = np.unique(np.concatenate([np.zeros(1, np.int64), *own]), return_counts=True)
    return found.astype(np.int32), np.minimum(counts, 65_535).astype(np.uint16)


@dataclass(frozen=True, eq=False)
class Model:
    settings: Settings
    shares: np.ndarray  # each bucket's part of the log odds of label 1

    def score(self, texts: list[bytes]) -> np.ndarray:
        words = _scorer(self)
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            split = text.split()
            total, n = float(self.shares[0]), 1.0
            if split:
                at = words.index(split)
                pairs = words.pairs(at)
                total += words.sums[at].sum() + self.shares[pairs].sum(dtype=np.float64)
                n += words.counts[at].sum() + len(pairs)
            out[i] = 1 / (1 + np.exp(-np.clip(total / n, -60, 60)))
        return out


_last: list = [None, None]


def _scorer(model: Model) -> _Words:
    if _last[0] is not model:
        _last[:] = [model, _Words(model.settings, model.shares)]
    return _last[1]


Row = tuple[np.ndarray, np.ndarray, int]


def descend(rows: list[Row], settings: Settings = Settings()) -> Model:
    """Stochastic gradient descent, one document at a time, the rate falling to 0. Without rows, every score is one half.

    A row has the distinct features of a document, how often each occurs, and the label."""
    random = np.random.default_rng(settings.seed)
    vectors = ((random.random((settings.buckets, settings.width), np.float32) - 0.5) / settings.width).astype(np.float32)
    output = np.zeros((settings.width, 2), np.float32)
    steps, done = max(1, settings.epochs * len(rows)), 0
    for _ in range(settings.epochs):
        for i in random.permutation(len(rows)):
            found, counts, label = rows[i]
            share = counts / np.float32(counts.sum(dtype=np.int64))
            rate = settings.rate * (1 - done / steps)
            hidden = share @ vectors[found]
            odds = hidden @ output
            p = np.exp(odds - odds.max())
            p /= p.sum()
            p[label] -= 1
            back = output @ p
            output -= rate * np.outer(hidden, p)
            vectors[found] -= (rate * len(found) ** 0.5) * np.outer(share, back)
            done += 1
    return Model(settings, (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32))


def train(texts: list[bytes], labels: list[int], settings: Settings = Settings()) -> Model:
    """:func:`descend` over texts in memory."""
    words = _Words(settings)
    return descend([(*features(words, t), y) for t, y in zip(texts, labels, strict=True)], settings)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0. A null id isn't, but has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def featured(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``k, y, found, counts`` from ``k, y, t``: a text's :func:`features` as bytes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(settings)
        for batch in slices(batches, 256):
            each = [features(words, t) for t in texts(batch, "t")]
            found, counts = [f.tobytes() for f, _ in each], [c.tobytes() for _, c in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary()), pa.array(counts, pa.binary())], ["k", "y", "found", "counts"])

    return rows.select("k", "y", "t").mapInArrow(hashed, "k long, y int, found binary, counts binary")


def learned(table: DataFrame, settings: Settings = Settings()) -> Model:
    """:func:`descend` over a stored table of :func:`featured` rows, in one task."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in slices(batches, 256):
            for label, found, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows.append((np.frombuffer(found, np.int32), np.frombuffer(counts, np.uint16), label))
        yield pa.RecordBatch.from_arrays([pa.array([descend(rows, settings).shares.tobytes()], pa.binary())], ["shares"])

    one = table.repartition(1).sortWithinPartitions("k").select("y", "found", "counts").mapInArrow(learn, "shares binary").first()
    return Model(settings, np.frombuffer(one["shares"], np.float32)) if one else descend([], settings)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", settings: Settings = Settings()) -> Model:
    """Learn from labelled documents that aren't held out, at most ``settings.sample_rows`` of them, by their whole texts.

    Rows with a null id, text or label teach nothing; of differing labels of an id the least counts, and of rows that share
    an id one teaches, the same each time. Which ids are taken depends on the ids alone; they are at most ``sample_rows``,
    so they are broadcast to the scan. Without rows to learn from, every score is one half."""
    known = (
        labels.select(F.col(doc_id).cast("long").alias("k"), F.col(label).cast("int").alias("y"))
        .where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k")))
        .groupBy("k")
        .agg(F.min("y").alias("y"))
    )
    chosen = known.orderBy(F.xxhash64(F.lit(settings.seed), "k"), "k").limit(settings.sample_rows)
    rows = docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(chosen), "k")
    one = featured(rows, settings).groupBy("k").agg(F.min(F.struct("y", "found", "counts")).alias("x")).select("k", "x.*")
    scratch = Scratch(docs.sparkSession)
    model = learned(scratch.stored(one, "features"), settings)
    scratch.dropped()
    return model


def score_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``score``, the probability of label 1; null and empty texts are scored by the end mark alone.

    A kept column named ``score`` is replaced."""
    keep = tuple(c for c in keep if c != "score")
    shared = docs.sparkSession.sparkContext.broadcast((model.settings, model.shares))
    chosen = docs.select(*keep, text_of(text).alias("text for scoring"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _received(shared)
        for batch in slices(batches, 1024):
            scores = pa.array(own.score(texts(batch, "text for scoring")), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*keep, "score"])

    return chosen.mapInArrow(score, T.StructType([*chosen.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


_models: dict[int, Model] = {}


def _forget() -> None:
    _models.clear()
    _last[:] = [None, None]


def _received(shared: object) -> Model:
    """One model object per broadcast in a worker, so that what it remembers of words outlives a task."""
    sole("quality", _forget)
    value = shared.value
    found = next((m for m in _models.values() if m.shares is value[1]), None)
    if found is None:
        _models.clear()
        found = _models[0] = Model(*value)
    return found
