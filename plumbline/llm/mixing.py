"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probability; DataFrame functions only.

Documents are counted into cells of source, language and topic. Raking scales the cells' token weights to each marginal's
targets in turn, round after round, until all three marginals are met. A cell's factor, raked weight over tokens, becomes
its documents' probability after one multiplier, solved exactly so that the expected tokens meet the budget with no
probability over 1. Sums over cells are grouped sums and joins, so no task needs all cells, unless a count shows that they
are few; the driver sees totals only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm._common import Scratch, small, text_of

MARGINS = ("source", "lang", "topic")
#: Targets are the marginals' token shares to this power; share of all tokens that the sample may hold.
TEMPERATURE, BUDGET = 0.7, 0.6
#: Raking ends when no marginal is off its target by more than this share of all tokens, or after so many rounds.
TOLERANCE, ROUNDS = 1e-12, 60
#: Cells up to which probabilities are broadcast to the documents, and one task rakes so many rounds at a time.
FEW_CELLS, ROUNDS_AT_ONCE = 100_000, 8
SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def word_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")


def topic_of(text: Column, words: Column) -> Column:
    """A stand-in for tables without a topic column: ``table`` if cells are parted by bars, else the class of length."""
    return F.when(text.contains(" | "), "table").when(words < 100, "brief").when(words < 1000, "article").otherwise("long")


def with_cells(docs: DataFrame, topic: Column | None = None, text: str = "text") -> DataFrame:
    """Adds ``__pl_source, __pl_lang, __pl_topic, __pl_tokens``; a null source or language is ``unknown``, a null text is empty."""
    counted = docs.withColumn("__pl_tokens", word_count(text_of(text)))
    return counted.withColumns(
        {
            "__pl_source": F.coalesce(F.col("source").cast("string"), F.lit("unknown")),
            "__pl_lang": F.coalesce(F.col("lang").cast("string"), F.lit("unknown")),
            "__pl_topic": F.coalesce(topic if topic is not None else topic_of(text_of(text), F.col("__pl_tokens")), F.lit("unknown")),
        }
    )


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temperature: float = TEMPERATURE, rounds: int = ROUNDS, tolerance: float = TOLERANCE, few_cells: int = FEW_CELLS, scratch: Scratch | None = None) -> tuple[DataFrame, float]:
    """``source, lang, topic, tokens, weight`` from ``source, lang, topic, tokens``, whose marginals of ``weight`` meet the
    targets, and the gap that is left: the most by which a marginal is off, as a share of all tokens.

    ``targets`` gives shares by value for some margins (values it leaves out get share 0); other margins get their token
    share to the power ``temperature``. Targets are scaled to the tokens of all cells. Cells without tokens weigh 0. Targets
    that no weights of these cells can meet leave a gap after ``rounds``; so does a share of a value without tokens."""
    scratch = scratch or Scratch(cells.sparkSession)
    now = cells.select(*MARGINS, F.col("tokens").cast("double").alias("tokens"), F.col("tokens").cast("double").alias("weight"))
    total = now.agg(F.sum("tokens")).first()[0] or 0.0
    for m in MARGINS:
        given = (targets or {}).get(m)
        sums = now.groupBy(m).agg(F.sum("tokens").alias("sum"))
        share = F.pow("sum", F.lit(float(temperature))) if given is None else F.coalesce(*[F.when(F.col(m) == k, F.lit(float(v))) for k, v in given.items()], F.lit(0.0))
        shares = scratch.stored(sums.select(m, share.alias("share")), "shares")
        whole = shares.agg(F.sum("share")).first()[0] or 0.0
        now = now.join(shares.select(m, (F.col("share") * (total / whole if whole else 0.0)).alias(f"target_{m}")), m)
    now, gap, done = scratch.stored(now, "raking"), float("inf"), 0
    few = now.limit(few_cells + 1).count() <= few_cells

    def raked(df: DataFrame, m: str) -> DataFrame:
        if few:
            df = df.withColumn("sum", F.sum("weight").over(W.partitionBy(m)))
        else:
            df = df.join(df.groupBy(m).agg(F.sum("weight").alias("sum")), m)
        return df.withColumn("weight", F.when(F.col("sum") > 0, F.col("weight") * F.col(f"target_{m}") / F.col("sum")).otherwise(0.0)).drop("sum")

    def off(m: str) -> DataFrame:
        return now.groupBy(m).agg(F.abs(F.sum("weight") - F.first(f"target_{m}")).alias("off")).select("off")

    while total and gap > tolerance and done < rounds:
        at_once = min(ROUNDS_AT_ONCE if few else 1, rounds - done)
        now = now.repartition(1) if few else now
        for _ in range(at_once):
            for m in MARGINS:
                now = raked(now, m)
        now, done = scratch.stored(now, "raking"), done + at_once
        gap = off("source").union(off("lang")).union(off("topic")).agg(F.max("off")).first()[0] / total
    return now.select(*MARGINS, "tokens", "weight"), gap if total else 0.0


def calibrate(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Adds ``probability = min(1, l * weight / tokens)`` with the ``l`` at which expected tokens are ``budget`` of all.

    Cells whose probability would pass 1 are certain; ``l`` is what is left of the budget over the weight of the others. It
    grows as cells become certain, so the certain ones are found in a few rounds, each a sum over cells. If no ``l`` is
    enough, every cell with weight is certain."""
    rows = raked.withColumn("_f", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    most, sure = (rows.agg(F.sum("tokens")).first()[0] or 0.0) * budget, 0.0
    while True:
        certain = F.col("_f") >= sure if sure else F.lit(False)
        n, held, rest = rows.agg(F.count_if(certain), F.sum(F.when(certain, F.col("tokens")).otherwise(0.0)), F.sum(F.when(certain, 0.0).otherwise(F.col("weight")))).first()
        if not rest or most <= (held or 0.0):
            probability = F.when(F.col("_f") > 0, 1.0).otherwise(0.0)
            break
        scale = (most - held) / rest
        if rows.where(~certain & (F.col("_f") * scale > 1)).limit(1).count() == 0:
            probability = F.when(certain, 1.0).otherwise(F.least(F.lit(1.0), F.lit(scale) * F.col("_f")))
            break
        sure = 1 / scale
    return rows.withColumn("probability", probability).select(*MARGINS, "tokens", "weight", "probability")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone: the first 32 bits of its md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def probabilities(docs: DataFrame, topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, temperature: float = TEMPERATURE, rounds: int = ROUNDS, budget: float = BUDGET, few_cells: int = FEW_CELLS) -> DataFrame:
    """``source, lang, topic, tokens, weight, probability, gap``: one row per cell, stored. ``gap`` is what raking left, in each row."""
    scratch = Scratch(docs.sparkSession)
    named = with_cells(docs, topic)
    cells = named.groupBy(F.col("__pl_source").alias("source"), F.col("__pl_lang").alias("lang"), F.col("__pl_topic").alias("topic")).agg(F.sum("__pl_tokens").alias("tokens"))
    raked, gap = rake(scratch.stored(cells, "cells"), targets, temperature, rounds, few_cells=few_cells, scratch=scratch)
    out = scratch.stored(calibrate(raked, budget).withColumn("gap", F.lit(gap)), "mix")
    scratch.dropped(out)
    return out


def mix(docs: DataFrame, topic: Column | None = None, **settings: object) -> DataFrame:
    """All rows and columns of ``docs`` with ``topic, n_tokens, probability, kept`` added (replaced, if there).

    Cells are few, so documents meet them by a broadcast behind a count; a hot source is never shuffled then. Documents
    alike in id share their fate; documents without tokens are never kept. A null source, language or topic is ``unknown``,
    a null text has no tokens. An empty table gives no rows. Names that begin with ``__pl`` are reserved."""
    table = probabilities(docs, topic, **settings)
    cells = table.select(F.col("source").alias("__pl_source"), F.col("lang").alias("__pl_lang"), F.col("topic").alias("__pl_topic"), F.col("probability").alias("__pl_p"))
    own = [c for c in docs.columns if c not in ("topic", "n_tokens", "probability", "kept")]
    joined = with_cells(docs, topic).join(small(cells, FEW_CELLS), ["__pl_source", "__pl_lang", "__pl_topic"], "left")
    p = F.when(F.col("__pl_tokens") > 0, F.coalesce(F.col("__pl_p"), F.lit(0.0))).otherwise(0.0)
    return joined.select(*own, F.col("__pl_topic").alias("topic"), F.col("__pl_tokens").alias("n_tokens"), p.alias("probability"), (draw(F.col("doc_id")) < p).alias("kept"))
