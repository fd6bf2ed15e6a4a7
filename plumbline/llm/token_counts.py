"""Exact length histogram: documents by encoded length; suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm import tokens
from plumbline.llm._common import slices, text_of, texts

#: Lengths of one block of the two-level suffix sums.
BLOCK = 1024


def token_lengths(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per document: ``length``, its ids with the end id. A null or empty text has length 1.

    Only the text column is read; no row is shuffled."""
    path = tokenizer or tokens.tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lengths = [len(ids) // 4 for ids in tokens.encoded(texts(batch, "t"), path)]
            yield pa.record_batch([pa.array(lengths, pa.int64())], ["length"])

    return docs.select(text_of(text).alias("t")).mapInArrow(count, "length long")


def length_histogram(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``length, n_docs``: partial counts in each task, so a length that a third of all documents share is no hot key."""
    return token_lengths(docs, text, tokenizer).groupBy("length").agg(F.count("*").alias("n_docs"))


def length_curve(histogram: DataFrame) -> DataFrame:
    """Suffix sums over ``length, n_docs``, one row per distinct length L:

    ``n_docs, n_tokens`` at L; ``docs_from, tokens_from`` over lengths of at least L; ``docs_to, tokens_to`` over
    lengths of at most L; ``truncated_total``, the tokens left if each document is cut to L; ``quantile``, the share of
    documents of at most L. Sums run inside blocks of lengths, then over block totals, so no window sees all rows.
    An empty histogram gives no rows."""
    rows = histogram.select(
        "length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.expr(f"length div {BLOCK}").alias("block")
    )
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    above = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    totals = totals.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(whole).alias("d_all"),
        F.sum("t").over(whole).alias("t_all"),
    )
    inside = W.partitionBy("block").orderBy(F.desc("length"))
    summed = (
        rows.join(totals, "block")
        .withColumn("docs_from", F.sum("n_docs").over(inside) + F.col("d_above"))
        .withColumn("tokens_from", F.sum("n_tokens").over(inside) + F.col("t_above"))
    )
    docs_to, tokens_to = F.expr("d_all - docs_from + n_docs"), F.expr("t_all - tokens_from + n_tokens")
    return summed.select(
        "length", "n_docs", "n_tokens", "docs_from", "tokens_from", docs_to.alias("docs_to"), tokens_to.alias("tokens_to"),
        F.expr("t_all - tokens_from + length * docs_from").alias("truncated_total"),
        (docs_to / F.col("d_all")).alias("quantile"),
    )


def truncated_totals(curve: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, total_tokens, truncated_docs, truncated_total`` for any limits, in the histogram or not."""
    n, tokens_here = F.col("n_docs"), F.col("n_tokens")
    rows = [
        F.struct(
            F.lit(int(limit)).cast("long").alias("context_limit"),
            F.coalesce(F.sum(tokens_here), F.lit(0)).alias("total_tokens"),
            F.coalesce(F.sum(F.when(F.col("length") > limit, n).otherwise(0)), F.lit(0)).alias("truncated_docs"),
            F.coalesce(F.sum(F.when(F.col("length") > limit, limit * n).otherwise(tokens_here)), F.lit(0)).alias("truncated_total"),
        )
        for limit in limits
    ]
    return curve.agg(F.array(*rows).alias("answers")).select(F.inline("answers"))


def length_quantiles(curve: DataFrame, shares: list[float]) -> DataFrame:
    """``share, length``: the least length that at least that share of all documents does not exceed."""
    asked = [F.min(F.when(F.col("quantile") >= q, F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)]
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares)])
    return curve.agg(*asked).select(F.inline(pairs))
