"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

Each paragraph piece is hashed to a wide vector; a document's fingerprint is the sum of its pieces' vectors, lane by
lane, modulo a power of two. So equality doesn't depend on the pieces' order, and a piece is added or taken away by one
vector addition. There are two kinds of lanes:

* ``wide``: 16 lanes modulo 2**32 of uniform hash words. 512 bits decide equality.
* ``signs``: 128 lanes modulo 2**32, two to a long, that count one bit of two more hashes. A text has fewer than 2**31
  characters, so no lane runs over. Doubled, less the number of pieces, they are sums of random signs, so the squared
  length of the difference of two documents' lanes estimates how many pieces they don't share. That grades likeness from
  0 to 1.

A fingerprint as text holds the number of pieces and both kinds of lanes, so likeness can be had from fingerprints alone.

A paragraph is a line; a line of several sentences is cut after ``.``, ``!`` or ``?`` and a space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm._common import stored, text_of

PIECE_ENDS = "\n|(?<=[.!?]) "
WIDE_SEEDS, SIGN_SEEDS = tuple(range(101, 109)), (211, 223)
LANE_BITS, LANES_IN_LONG = 32, 2
_LOW = 0xFFFFFFFF
_ONES = sum(1 << (LANE_BITS * k) for k in range(LANES_IN_LONG))
_LANE = (1 << LANE_BITS) - 1


def _hashes(pieces: Column, seed: int) -> Column:
    return F.transform(pieces, lambda piece: F.xxhash64(F.lit(seed), piece))


def _total(hashes: Column, part) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda total, h: total + part(h))


def with_fingerprint(df: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """Adds ``{prefix}pieces`` (their number), ``{prefix}wide`` and ``{prefix}signs`` (arrays of longs). Null text gives null arrays.

    Row by row, nothing is shuffled; an empty text is one empty piece."""
    seeds = [*WIDE_SEEDS, *SIGN_SEEDS]
    cut = df.withColumn("_pieces", F.split(text, PIECE_ENDS))
    hashed = cut.withColumn("_hashes", F.array(*[_hashes(F.col("_pieces"), s) for s in seeds]))
    each = [F.get("_hashes", F.lit(i)) for i in range(len(seeds))]
    wide = [
        _total(h, lambda x, s=shift: F.shiftrightunsigned(x, s).bitwiseAND(F.lit(_LOW))).bitwiseAND(F.lit(_LOW))
        for h in each[: len(WIDE_SEEDS)]
        for shift in (0, 32)
    ]
    signs = [_total(h, lambda x, s=i: F.shiftrightunsigned(x, s).bitwiseAND(F.lit(_ONES))) for h in each[len(WIDE_SEEDS) :] for i in range(LANE_BITS)]
    known = F.col("_pieces").isNotNull()
    return hashed.withColumns(
        {
            f"{prefix}pieces": F.when(known, F.size("_pieces").cast("long")),
            f"{prefix}wide": F.when(known, F.array(*wide)),
            f"{prefix}signs": F.when(known, F.array(*signs)),
        }
    ).drop("_pieces", "_hashes")


def combined(wide: Column, other: Column, remove: bool = False) -> Column:
    """The ``wide`` lanes after the other's pieces are inserted, or deleted with ``remove``."""
    return F.zip_with(wide, other, lambda a, b: F.pmod(a - b if remove else a + b, F.lit(1 << 32)))


def as_text(wide: Column, pieces: Column | None = None, signs: Column | None = None) -> Column:
    """A fingerprint as hexadecimal digits: 8 for each of the ``wide`` lanes; then, if given, 16 for the number of pieces and
    for each long of ``signs``."""
    digits = [F.array_join(F.transform(wide, lambda x: F.lpad(F.hex(x), 8, "0")), "")]
    if signs is not None:
        digits += [F.lpad(F.hex(pieces), 16, "0"), F.array_join(F.transform(signs, lambda x: F.lpad(F.hex(x), 16, "0")), "")]
    return F.lower(F.concat(*digits))


def read_text(digits: Column) -> Column:
    """``(wide, pieces, signs)`` of a fingerprint as text."""
    number = lambda at, n: F.conv(F.substr(digits, at, F.lit(n)), 16, -10).cast("long")
    lanes = 2 * len(WIDE_SEEDS)
    first = 8 * lanes + 17
    return F.struct(
        F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda i: number(i * 8 + 1, 8)).alias("wide"),
        number(F.lit(8 * lanes + 1), 16).alias("pieces"),
        F.transform(F.sequence(F.lit(0), F.lit(len(SIGN_SEEDS) * LANE_BITS - 1)), lambda i: number(i * 16 + first, 16)).alias("signs"),
    )


def likeness(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Likeness of two documents by their ``signs`` lanes and numbers of pieces: 1 for equal multisets, about 0 for disjoint ones."""

    def summed(term) -> Column:
        def lanes(p: Column, q: Column) -> Column:
            out = F.lit(0.0)
            for k in range(LANES_IN_LONG):
                x = F.shiftrightunsigned(p, LANE_BITS * k).bitwiseAND(F.lit(_LANE)) * 2 - n
                y = F.shiftrightunsigned(q, LANE_BITS * k).bitwiseAND(F.lit(_LANE)) * 2 - m
                out = out + term(x.cast("double"), y.cast("double"))
            return out

        return F.aggregate(F.zip_with(a, b, lanes), F.lit(0.0), lambda total, x: total + x)

    apart, both = summed(lambda x, y: (x - y) * (x - y)), summed(lambda x, y: x * x + y * y)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / F.greatest(both, F.lit(1.0))))


def successors(sizes: DataFrame) -> DataFrame:
    """For each ``doc_id`` the next in descending order, after the last the first, and before it the previous one.

    ``doc_id, next_id, previous_id, previous_chars`` from a stored ``doc_id, n_chars, slot`` whose ``slot`` numbers ranges of ids.
    Neighbours come from windows inside the ranges; only the ranges' ends, one row a range, meet in one task."""
    inside = W.partitionBy("slot").orderBy(F.desc("doc_id"))
    own = sizes.select(
        "slot", "doc_id",
        F.lead("doc_id").over(inside).alias("next_own"),
        F.lag("doc_id").over(inside).alias("previous_own"), F.lag("n_chars").over(inside).alias("chars_own"),
    )
    ends = sizes.groupBy("slot").agg(F.max("doc_id").alias("head"), F.min_by(F.struct("doc_id", "n_chars"), "doc_id").alias("tail"))
    order, whole = W.orderBy(F.desc("slot")), W.orderBy(F.desc("slot")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select(
        "slot",
        F.coalesce(F.lead("head").over(order), F.first("head").over(whole)).alias("next_head"),
        F.coalesce(F.lag("tail").over(order), F.last("tail").over(whole)).alias("previous_tail"),
    )
    first = F.col("previous_own").isNull()
    return own.join(ends, "slot").select(
        "doc_id",
        F.coalesce("next_own", "next_head").alias("next_id"),
        F.coalesce("previous_own", F.col("previous_tail.doc_id")).alias("previous_id"),
        F.when(first, F.col("previous_tail.n_chars")).otherwise(F.col("chars_own")).alias("previous_chars"),
    )


def against_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text and of the next document, and how alike they are.

    The edited text is the document with its last ``floor(n_chars / 2)`` code points replaced by as many, or all, of the
    first of the next document in descending id order. Text crosses the network twice: all of it once by id, and then of
    each document only the part that its predecessor takes.

    A null text is empty. Rows with a null id have no next document, so their edited columns are null. Where rows share an
    id, each has its own row here, and the least of their texts is what the predecessor takes. One row per row of ``docs``:
    ``doc_id, n_chars, edited, pieces, wide, signs, edited_pieces, edited_wide, edited_signs, near_edited, near_next``. An empty
    table gives no rows. Other columns of ``docs`` aren't read, whatever their names."""
    # Another name than the table's: both uses of the rows then plan alike, and their exchange runs once.
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("t"))
    sizes = rows.where("id is not null").groupBy(F.col("id").alias("doc_id")).agg(F.max(F.char_length("t")).cast("long").alias("n_chars"), F.count("*").alias("rows"))
    sizes = stored(sizes.repartitionByRange("doc_id").withColumn("slot", F.spark_partition_id()), "ids")
    repeated = sizes.where("rows > 1").limit(1).count() > 0
    ring = stored(successors(sizes), "ring").withColumnRenamed("doc_id", "id")
    placed = with_fingerprint(rows.where("id is not null").join(ring.hint("shuffle_hash"), "id"), F.col("t"))
    taken = placed.select(
        F.col("previous_id").alias("id"),
        F.expr("substring(t, 1, int(previous_chars div 2))").alias("given"),
        F.col("signs").alias("next_signs"), F.col("pieces").alias("next_pieces"),
        *([F.col("t").alias("whole")] if repeated else []),
    )
    if repeated:
        least = W.partitionBy("id").orderBy("whole")
        taken = taken.withColumn("n", F.row_number().over(least)).where("n = 1").drop("n", "whole")
    joined = placed.join(taken, "id").withColumn("n_chars", F.char_length("t").cast("long"))
    edited = joined.withColumn("edited", F.expr("concat(substring(t, 1, int(n_chars - n_chars div 2)), substring(given, 1, int(n_chars div 2)))"))
    done = with_fingerprint(edited, F.col("edited"), "edited_")
    near = lambda other: likeness(F.col("signs"), F.col("pieces"), F.col(f"{other}_signs"), F.col(f"{other}_pieces")).alias(f"near_{other}")
    prints = [f"{of}{part}" for of in ("", "edited_") for part in ("pieces", "wide", "signs")]
    found = done.select(F.col("id").alias("doc_id"), "n_chars", "edited", *prints, near("edited"), near("next"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    without_id = with_fingerprint(rows.where("id is null"), F.col("t")).select(
        F.col("id").alias("doc_id"), F.char_length("t").cast("long").alias("n_chars"), none("string", "edited"), "pieces", "wide", "signs",
        none("long", "edited_pieces"), none("array<bigint>", "edited_wide"), none("array<bigint>", "edited_signs"), none("double", "near_edited"), none("double", "near_next"),
    )
    return found.union(without_id)
