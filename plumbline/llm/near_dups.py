"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text's words give shingles of five words; equal shingles are labelled by occurrence. Each of ``SKETCHES`` hash orders
picks the ``PICKED`` least labelled shingles and keeps them in text order, so two texts agree in a sketch only if they
share those shingles in that order. Agreeing texts meet in a bucket; a pair counts as a link when a banded alignment of
its words proves an edit similarity, 1 less distance over the longer length, of ``SIMILARITY`` or more.

Recall: every pair that shares a bucket is verified or proven to be no link, so only pairs that share none are lost. Of
pairs of 200 words with a fifth of them replaced at random, the least that a link may share, nine in ten share a bucket
(``tests/llm`` measures it); with 15 % replaced 99 % do. Texts of few words keep few shingles: see README for them.

No bucket is expanded into pairs. Texts with the same words are one text from the start. Then

1. each text is verified against the least text that leads one of its buckets, one pair a text, and links are closed to
   classes; then against the leaders that are still of other classes, one pair for each such class;
2. in buckets that still hold several classes, texts of different classes are compared by their counts of hashed words; the
   largest class of a bucket meets the others once for all buckets it shares with them. A pair whose counts alone cost more edits than a link allows is none. Of the others, first a forest that spans each
   block's classes is verified and classes are closed again; in buckets where a pair of the forest was no link, all pairs
   that are still of different classes are verified.

A large group of copies is one class by step 2 and meets itself nowhere. A bucket whose other texts would fill more than
``CUT_BLOCKS`` blocks, such as those of a passage that many unlike texts share, is cut by rare words before: two texts
that are a link share one of the rarest words that make up a fifth of each, whatever the order of rarity. So its texts
meet only those that share such a word, once for all such buckets, and the work doesn't grow with the square of the
bucket. In fewer blocks each text stands a few times; its rare words are more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import Scratch, row_key, slices, sole, text_of, texts

WORDS, SIMILARITY = 5, 0.8
SKETCHES, PICKED = 64, 2
#: Texts of a bucket compared in one task.
BUCKET_TEXTS = 2048
#: Blocks up to which a bucket's other texts meet block by block, each text in a few of them; beyond, rare words cut the bucket.
CUT_BLOCKS = 4
#: Counters of hashed words, of a byte each, that bound the edits between two texts from below.
COUNTERS = 512
#: Counters of how many texts hold a word, by its hash; they only order words by rarity.
RARITY = 1 << 16
#: Words whose hash a worker remembers.
MEMO_WORDS = 300_000

_ANY_WORD, _PLAIN_WORD, _BEYOND = regex.compile(r"[\p{L}\p{M}\p{N}]+"), re.compile(r"[^\W_]+"), re.compile("[^\u0000-˿]")
_ASCII = str.maketrans({chr(i): chr(i) if chr(i).isalnum() else " " for i in range(128)})
_RANDOM = np.random.default_rng(20190705)
_XOR = _RANDOM.integers(0, 1 << 63, SKETCHES, np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = (_XOR >> np.uint64(11)).astype(np.uint32) | np.uint32(1)
_PLACE = _RANDOM.integers(0, 1 << 63, WORDS + PICKED, np.uint64) * np.uint64(2) + np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Lower-case runs of letters, marks and digits. Below U+0300 there are no marks, and the plain patterns say the same."""
    text = text.lower()
    if text.isascii():
        return text.translate(_ASCII).split()
    return _ANY_WORD.findall(text) if _BEYOND.search(text) else _PLAIN_WORD.findall(text)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_hashes = _Hashes()
_hash_of = _hashes.__getitem__


def word_hashes(own: list[str]) -> np.ndarray:
    sole("near_dups", _hashes.clear)
    return np.fromiter(map(_hash_of, own), np.uint64, len(own))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes of items with their occurrence, in order: the first of equal ones, the second, and so on."""
    n = len(hashes)
    order = np.argsort(hashes, kind="stable")
    in_order = hashes[order]
    fresh = np.concatenate([[True], in_order[1:] != in_order[:-1]])
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = (np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))).astype(np.uint64)
    return _mixed(hashes + occurrence * _GOLD)


def labelled_shingles(hashes: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of the shingles with their occurrence, in text order; a shorter text is one shingle."""
    if len(hashes) == 0:
        return np.zeros(0, np.uint64)
    n = max(1, len(hashes) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(size, len(hashes))):
        rolled += hashes[j : j + n] * _PLACE[j]
    return _labelled(_mixed(rolled))


def order_min_hash(shingles: np.ndarray, picked: int = PICKED) -> np.ndarray:
    """One hash per sketch, of the least labelled shingles in text order."""
    n, take = len(shingles), min(picked, len(shingles))
    out = np.empty(SKETCHES, np.uint64)
    upper = (shingles >> np.uint64(32)).astype(np.uint32)
    block = max(1, min(SKETCHES, (1 << 16) // n))
    for start in range(0, SKETCHES, block):
        s = slice(start, start + block)
        keys = upper[None, :] ^ _XOR[s, None].astype(np.uint32)
        keys *= _TIMES[s, None]
        keys ^= keys >> np.uint32(15)
        keys *= np.uint32(0x2C1B3C6D)
        row, least = np.arange(len(keys)), np.empty((len(keys), take), np.int64)
        for j in range(take):
            least[:, j] = keys.argmin(axis=1)
            keys[row, least[:, j]] = 0xFFFFFFFF
        least.sort(axis=1)
        total = np.zeros(len(keys), np.uint64)
        for j in range(take):
            total += shingles[least[:, j]] * _PLACE[WORDS + j]
        out[s] = _mixed(total + _XOR[s])
    return out


def alignment_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most + 1``.

    Equal ends are cut first. Then only the diagonals within ``most`` of the main one are followed: a window of
    ``2 * most + 1`` cells slides down one row a step, its vertical differences held as bits of two whole numbers."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    start, end = 0, 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    while end < len(a) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a:
        return len(b)
    m, n = len(a), len(b)
    most = min(most, n)
    width = 2 * most + 1
    full, middle = (1 << width) - 1, 1 << most
    where: dict = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    # Before column j, bit k of ``up`` and ``down`` tells whether row j - most + k of column j - 1 is one more or one less
    # than the row above. Rows below 1 equal row 0, so they neither rise nor fall; rows past the end of a match nothing.
    up, down = full ^ (middle - 1), 0
    distance = 0  # at the main diagonal
    for j in range(1, n + 1):
        hit = where.get(b[j - 1], 0)
        hit = (hit >> j - most - 1 if j > most else hit << most + 1 - j) & full
        free = (((hit & up) + up) ^ up) | hit | down  # the step along the diagonal costs nothing
        right_up, right_down = down | ~(free | up), free & up
        distance += not free & middle
        free = (free & full) >> 1  # from here on, bit k stands for one row further down
        up, down = (right_down | ~(free | right_up)) & full, free & right_up & full
    below = (middle - 1) ^ ((1 << most - (n - m)) - 1)  # rows m + 1 .. n of the last column
    distance += (down & below).bit_count() - (up & below).bit_count()
    return min(distance, most + 1)


def alike(a: list[str], b: list[str], similarity: float = SIMILARITY) -> bool:
    """Whether the edit similarity of two word lists is at least ``similarity``; two empty lists are alike."""
    longer = max(len(a), len(b))
    most = int(longer * (1 - similarity) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if longer - (Counter(a) & Counter(b)).total() > most:  # words that the other lacks cost an edit each
        return False
    return alignment_distance(a, b, most) <= most


def word_counts(hashes: np.ndarray) -> np.ndarray:
    """How many words fall to each of ``COUNTERS``, 255 at most."""
    return np.minimum(np.bincount((hashes % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS), 255).astype(np.uint8)


def least_edits(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distance by :func:`word_counts`, of one text to each of many.

    An edit takes at most one word from a counter and gives one to another; words that share a counter, and counts that
    are cut, only make the bound smaller."""
    either = np.maximum(many, one).sum(axis=1, dtype=np.int64)
    return either - np.minimum(many.sum(axis=1, dtype=np.int64), one.sum(dtype=np.int64))


def rare_words(hashes: np.ndarray, rarity: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Labelled words of a text of which it shares one with every text that is a link to it.

    A link of n words lacks at most ``n * (1 - similarity)`` labelled words of the other text. So of the first words in an
    order that is the same for all texts, one more than that, at least one is shared. ``rarity`` counts words by hash."""
    labelled = _labelled(hashes)
    order = np.lexsort((labelled, rarity[(hashes % np.uint64(len(rarity))).astype(np.int64)]))
    return labelled[order[: int(len(hashes) * (1 - similarity) + 1e-9) + 1]]


def spanning_forest(first: np.ndarray, second: np.ndarray, weight: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places of pairs ``first, second`` that join all groups the pairs join, without a cycle; heavy pairs come first.

    Each round every group takes its heaviest pair to another, so groups at least halve."""
    group, taken = group.copy(), []
    alive = np.arange(len(first))
    while True:
        a, b = group[first[alive]], group[second[alive]]
        alive, a, b = alive[a != b], a[a != b], b[a != b]
        if not len(alive):
            return np.array(taken, np.int64)
        ends, places = np.concatenate([a, b]), np.concatenate([alive, alive])
        order = np.lexsort((places, -weight[places], ends))
        _, heads = np.unique(ends[order], return_index=True)
        up = np.arange(group.max() + 1)

        def top(x: int, up: np.ndarray = up) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for place in np.unique(places[order][heads]):
            x, y = top(group[first[place]]), top(group[second[place]])
            if x != y:
                up[max(x, y)] = min(x, y)
                taken.append(place)
        group = np.array([top(x) for x in range(len(up))])[group]


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, r1, r2, k, n_words, sketch`` per row: the row's content key, the digest of its words (of the whole text, if
    it has no words), their number and its sketches."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("t"))
    r1, r2 = row_key("doc_id", "t")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, sizes, sketches = [], [], []
            for value in texts(batch, "t"):
                own = words(value.decode("utf-8", "replace"))
                keys.append(xxhash.xxh3_128_digest(" ".join(own).encode("utf-8", "replace") if own else b"\x00" + value))
                sizes.append(len(own))
                sketches.append(order_min_hash(labelled_shingles(word_hashes(own))).view(np.int64) if own else np.zeros(0, np.int64))
            out = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *out], ["doc_id", "r1", "r2", "k", "n_words", "sketch"])

    return rows.select("doc_id", r1.alias("r1"), r2.alias("r2"), "t").mapInArrow(sketch, "doc_id long, r1 long, r2 long, k binary, n_words int, sketch array<long>")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, root``: for each end of a link ``a, b`` the least end it is linked to, directly or not.

    Alternates large and small stars over edges from larger to smaller ends until they no longer change; a stage is a
    grouped minimum and a join, so a hub's edges are summed in many tasks and its join is one that Spark can split."""

    def linked_to_least(edges: DataFrame, both: bool) -> DataFrame:
        around = edges.union(edges.select("b", "a")) if both else edges
        least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        met = around.join(least, "a")
        if both:
            return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.where("m < a").select("a", F.col("m").alias("b"))
        return met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own)

    state = None
    edges = scratch.stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        state = now
        large = linked_to_least(edges, True).distinct()
        edges = scratch.stored(linked_to_least(large, False).where("a != b").distinct(), "edges")


def verified(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``a, b, linked`` for pairs of ids, by alignment of whole texts; ``docs`` has a text ``t`` for each ``id``."""
    left = docs.select(F.col("id").alias("a"), F.col("t").alias("ta"))
    right = docs.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            linked = [alike(words(x), words(y), similarity) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return rows.mapInArrow(align, "a long, b long, linked boolean")


def profiles(docs: DataFrame) -> DataFrame:
    """``id, n_words, marks, counts`` of texts ``id, t``: 32 bits of each sketch, and the word counts."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, marks, counts = [], [], []
            for value in texts(batch, "t"):
                hashes = word_hashes(words(value.decode("utf-8", "replace")))
                sizes.append(len(hashes))
                marks.append(order_min_hash(labelled_shingles(hashes)).astype(np.uint32).tobytes())
                counts.append(word_counts(hashes).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(marks, pa.binary()), pa.array(counts, pa.binary())], ["id", "n_words", "marks", "counts"])

    return docs.select("id", "t").mapInArrow(profile, "id long, n_words int, marks binary, counts binary")


def word_rarity(docs: DataFrame) -> np.ndarray:
    """In how many texts ``t`` the words of each of ``RARITY`` hash classes stand; that many numbers, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY, np.int64)
        for batch in slices(batches):
            for value in texts(batch, "t"):
                total[np.unique((word_hashes(words(value.decode("utf-8", "replace"))) % np.uint64(RARITY)).astype(np.int64))] += 1
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["w", "n"])

    out = np.zeros(RARITY, np.int64)
    for r in docs.select("t").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect():
        out[r["w"]] = r["n"]
    return out


def with_rare_words(docs: DataFrame, rarity: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """``id, word``: a row for each of the :func:`rare_words` of each text ``id, t``."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [rare_words(word_hashes(words(value.decode("utf-8", "replace"))), shared.value, similarity) for value in texts(batch, "t")]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))], ["id", "word"])

    return docs.select("id", "t").mapInArrow(explode, "id long, word long")


def _sizes(members: DataFrame, bucket_texts: int) -> DataFrame:
    """``h, largest, p, q`` of the buckets with several sides: the largest side, its number of blocks and that of the others."""
    by_side = members.groupBy("h", "side").agg(F.count("*").alias("n"))
    sizes = by_side.groupBy("h").agg(F.max_by("side", F.struct("n", "side")).alias("largest"), F.max("n").alias("n_largest"), F.sum("n").alias("n"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / bucket_texts)).cast("int")
    sizes = sizes.where("n > n_largest")
    return sizes.select("h", "largest", blocks(F.col("n_largest")).alias("p"), blocks(F.col("n") - F.col("n_largest")).alias("q"))


def _sided(classed: DataFrame) -> DataFrame:
    """``h, id, root, side, bucket`` of the texts in buckets ``h, id, root`` of several classes; texts of one side need no comparison.

    A bucket's largest class leaves it: its texts and all texts that meet them anywhere make one bucket of two sides for the
    class. So a large class, which shares many buckets with the same texts, meets them once. The other texts stay where
    they are, each class a side, and ``bucket`` is true there."""
    largest = classed.groupBy("h", "root").agg(F.count("*").alias("n")).groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("classes"))
    rows = classed.join(largest.where("classes > 1").select("h", "largest"), "h")
    of_class = F.xxhash64(F.lit("class"), "largest").alias("h")
    own = rows.where("root = largest").select(of_class, "id", "root", F.col("root").alias("side")).distinct()
    met = rows.where("root != largest").select(of_class, "id", "root", F.lit(-1).cast("long").alias("side")).distinct()
    rest = rows.where("root != largest").select("h", "id", "root", F.col("root").alias("side"), F.lit(True).alias("bucket"))
    return own.union(met).withColumn("bucket", F.lit(False)).union(rest)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns, from rows in their order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        fresh = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
        ends = [*(np.flatnonzero(fresh) + 1), batch.num_rows]
        if held and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for end in ends:
            held.append(batch.slice(start, end - start))
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
            start = end
    if held:
        yield pa.Table.from_batches(held)


def close_pairs(members: DataFrame, sizes: DataFrame, known: DataFrame, bucket_texts: int = BUCKET_TEXTS, similarity: float = SIMILARITY, forest: bool = False) -> DataFrame:
    """``h, a, b``: pairs of different sides and classes in a bucket that agree in a sketch and may be close enough by their
    lengths and word counts. With ``forest``, only as many of a block as join its classes, the closest first.

    A pair that shares several buckets is told in that of the first sketch in which it agrees, by 32 bits of each.
    ``members`` has ``h, id, root, side, bucket``, ``sizes`` is from :func:`_sizes`, ``known`` from :func:`profiles`. A bucket's largest
    side and its other texts are dealt into blocks of ``bucket_texts``; a block of others meets each block. So a task holds
    two blocks, however large the bucket is, and the largest side never meets itself. Where each is one block, they meet as
    they are, and no row is copied."""
    rows = members.join(sizes, "h").withColumn("other", F.col("side") != F.col("largest"))
    whole = rows.where("p = 1 and q = 1").select("h", F.lit(0).alias("x"), F.lit(0).alias("y"), "id", "root", "side", "bucket")
    place = F.pmod(F.xxhash64("id"), F.when(F.col("other"), F.col("q")).otherwise(F.col("p"))).cast("int")
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    others = F.sequence(F.lit(0), F.col("q") - 1)
    meets = F.when(
        F.col("other"),
        F.concat(
            F.transform(others, lambda j: pair(F.least(j, F.col("place")), F.greatest(j, F.col("place")))),
            F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda j: pair(F.col("place"), -1 - j)),
        ),
    ).otherwise(F.transform(others, lambda i: pair(i, -1 - F.col("place"))))
    dealt = rows.where("p > 1 or q > 1").withColumn("place", place).withColumn("meet", F.explode(meets))
    dealt = whole.union(dealt.select("h", F.col("meet.x").alias("x"), F.col("meet.y").alias("y"), "id", "root", "side", "bucket"))
    need = 1 - similarity

    def compared(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, root, side, size = (group.column(c).to_numpy() for c in ("id", "root", "side", "n_words"))
        marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint32).reshape(-1, SKETCHES)
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint8).reshape(-1, COUNTERS)
        first, second, weight = [], [], []
        own = np.uint32(group.column("h")[0].as_py() & 0xFFFFFFFF) if group.column("bucket")[0].as_py() else None
        for i in range(len(ids) - 1):
            most = (np.maximum(size[i + 1 :], size[i]) * need + 1e-9).astype(np.int64)
            rest = np.flatnonzero((side[i + 1 :] != side[i]) & (root[i + 1 :] != root[i]) & (np.abs(size[i + 1 :] - size[i]) <= most))
            if len(rest):
                most, rest = most[rest], rest + i + 1
                edits = least_edits(counts[i], counts[rest])
                agree = marks[rest] == marks[i]
                fit = (edits <= most) & agree.any(axis=1)
                if own is not None:
                    fit &= marks[i][agree.argmax(axis=1)] == own
                first.append(np.full(fit.sum(), i))
                second.append(rest[fit])
                weight.append(-(edits / np.maximum(most, 1))[fit])
        if not first:
            return ids[:0], ids[:0]
        first, second, weight = map(np.concatenate, (first, second, weight))
        if forest and len(first):
            chosen = spanning_forest(first, second, weight, np.unique(root, return_inverse=True)[1])
            first, second = first[chosen], second[chosen]
        return np.minimum(ids[first], ids[second]), np.maximum(ids[first], ids[second])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            a, b = compared(group)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), group.column("h")[0].as_py())), pa.array(a), pa.array(b)], ["h", "a", "b"])

    ordered = dealt.join(known, "id").select("h", "x", "y", "id", "root", "side", "bucket", "n_words", "marks", "counts").repartition("h", "x", "y").sortWithinPartitions("h", "x", "y", "id")
    return ordered.mapInArrow(compare, "h long, a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bucket_texts: int = BUCKET_TEXTS) -> DataFrame:
    """``doc_id, r1, r2, class_id, kept``: one row per row of ``docs``.

    Rows linked directly or by others share a class; ``class_id`` is its least id. ``kept`` marks one row of each class: a row
    with that id, of several the first by content. Null ids come last; a class of null ids has a null ``class_id``. A null
    text is empty; texts without words are alike only if equal. ``r1, r2`` is :func:`row_key` of id and text, null as empty.
    An empty table gives no rows. Other columns of ``docs`` aren't read, whatever their names."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.stored(sketched(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "sketches")
    nodes = scratch.stored(rows.dropDuplicates(["k"]).select(F.monotonically_increasing_id().alias("id"), "k", "r1", "r2", "n_words", "sketch"), "nodes")
    bands = nodes.where("n_words > 0").select("id", F.explode("sketch").alias("h"))
    buckets = scratch.stored(bands.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1").select("h", "leader"), "buckets")
    members = scratch.stored(bands.join(buckets, "h").select("h", "id", "leader"), "members")
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("t"))
    r1, r2 = row_key("doc_id", "t")
    chosen = nodes.select("id", "r1", "r2").join(members.select("id").distinct(), "id", "left_semi")
    keyed = whole.select(r1.alias("r1"), r2.alias("r2"), "t").join(chosen.hint("shuffle_hash"), ["r1", "r2"])
    keyed = scratch.stored(keyed.dropDuplicates(["r1", "r2"]).select("id", "t"), "texts", "zstd")

    failed: list[DataFrame] = []
    labels = members.select("id", F.col("id").alias("root")).where("false")

    def in_classes(df: DataFrame, column: str, root: str) -> DataFrame:
        """Adds the class of a text; a text without links is its own."""
        own = labels.select(F.col("id").alias(column), F.col("root").alias(root))
        return df.join(own, column, "left").withColumn(root, F.coalesce(root, column))

    def settle(pairs: DataFrame) -> None:
        """Verify pairs that weren't yet. Classes that links join become one."""
        nonlocal labels
        if failed:
            pairs = pairs.join(reduce(DataFrame.union, failed), ["a", "b"], "left_anti")
        seen = scratch.stored(verified(pairs, keyed, similarity), "verified")
        failed.append(seen.where("not linked").select("a", "b"))
        links = seen.where("linked").select("a", "b")
        if not links.limit(1).count():
            return
        between = in_classes(in_classes(links, "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        joined = components(between, scratch)  # of classes by their least texts, which have no label of their own
        onward = joined.select(F.col("id").alias("root"), F.col("root").alias("onto"))
        labels = scratch.stored(labels.join(onward, "root", "left").select("id", F.coalesce("onto", "root").alias("root")).union(joined), "labels")

    led = members.where("id != leader").select("id", "leader")
    settle(led.groupBy("id").agg(F.min("leader").alias("a")).select("a", F.col("id").alias("b")))
    apart = in_classes(led.distinct(), "leader", "led").groupBy("id", "led").agg(F.min("leader").alias("a"))
    settle(in_classes(apart, "id", "root").where("root != led").select("a", F.col("id").alias("b")))

    cut = scratch.stored(_sided(in_classes(members.select("h", "id"), "id", "root")), "open")
    sizes = scratch.stored(_sizes(cut, bucket_texts), "sizes")
    at = lambda df: keyed.join(df.select("id").distinct(), "id")
    known = scratch.stored(profiles(at(cut)), "profiles")
    if sizes.where(F.col("q") > CUT_BLOCKS).limit(1).count():
        full = cut.join(sizes.where(F.col("q") > CUT_BLOCKS).select("h"), "h")
        crowded = scratch.stored(at(full), "crowded")
        rare = with_rare_words(crowded, word_rarity(crowded), similarity)
        # A text has the same rare words in all its crowded buckets: it is dealt once for each word, not for each bucket as well.
        dealt = full.select("id", "root").distinct().join(rare, "id").select(F.xxhash64(F.lit("word"), "word").alias("h"), "id", "root", F.col("root").alias("side"), F.lit(False).alias("bucket"))
        cut = scratch.stored(cut.join(sizes.where(F.col("q") <= CUT_BLOCKS).select("h"), "h").select("h", "id", "root", "side", "bucket").union(dealt), "cut")
        sizes = scratch.stored(_sizes(cut, bucket_texts), "sizes")
    forest = scratch.stored(close_pairs(cut, sizes, known, bucket_texts, similarity, True), "forest")
    settle(forest.select("a", "b").distinct())
    unsettled = forest.join(reduce(DataFrame.union, failed).distinct(), ["a", "b"], "left_semi").select("h").distinct()
    rest = in_classes(cut.select("h", "id", "side", "bucket").join(unsettled, "h", "left_semi"), "id", "root")
    rest = scratch.stored(rest.withColumn("side", F.when(F.col("side") < 0, F.col("side")).otherwise(F.col("root"))), "rest")
    settle(close_pairs(rest, _sizes(rest, bucket_texts), known, bucket_texts, similarity).select("a", "b").distinct())

    found = rows.select("doc_id", "r1", "r2", "row", "k").join(nodes.select("k", "id"), "k")
    found = scratch.stored(in_classes(found, "id", "root").select("doc_id", "r1", "r2", "row", "root"), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "r1", "r2", "row")
    best = found.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1").select("root", "best.doc_id", "best.row")
    best = scratch.stored(best.select("root", F.col("doc_id").alias("class_id"), F.col("row").alias("stays")), "best")
    out = found.join(best, "root", "left").select(
        "doc_id", "r1", "r2",
        F.when(F.col("stays").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("row") == F.col("stays"), F.lit(True)).alias("kept"),
    )
    out = scratch.stored(out, "near_duplicates")
    scratch.dropped(out)
    return out


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, less those whose near duplicate stays: one row of each class.

    Of rows alike in id and text, whatever else they hold, one stays. Names that begin with ``__pl`` are reserved."""
    found = near_duplicates(docs, doc_id, text)
    row = (F.col("r1").alias("__pl_r1"), F.col("r2").alias("__pl_r2"))
    stays = found.where("kept").select(*row)
    gone = found.where("not kept").select(*row).join(stays, ["__pl_r1", "__pl_r2"], "left_anti").distinct()
    repeated = found.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    own = docs.columns
    keyed = docs.withColumns({"__pl_i": F.col(doc_id).cast("long"), "__pl_t": text_of(text)})
    r1, r2 = row_key("__pl_i", "__pl_t")
    left = keyed.withColumns({"__pl_r1": r1, "__pl_r2": r2}).join(gone.hint("shuffle_hash"), ["__pl_r1", "__pl_r2"], "left_anti")
    return (left.dropDuplicates(["__pl_r1", "__pl_r2"]) if repeated else left).select(*own)
