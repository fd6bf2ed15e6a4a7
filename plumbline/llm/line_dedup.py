"""Line dedup: lines whose key stands in many documents go from every document; in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import row_key, small, stored, text_of

MIN_CHARS, MIN_DOCUMENTS = 1, 10
#: Frequent keys up to which the join broadcasts them; beyond, it shuffles and splits skewed keys.
BROADCAST_KEYS = 500_000
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased; no other letter changes."""
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def drop_common_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, text: str = "text") -> DataFrame:
    """The same rows with ``text`` replaced by its kept lines, and ``n_lines, n_dropped`` added; other columns stay.

    A document's lines are exploded to 128-bit key hashes once and stored; a hash found in ``min_documents`` documents
    marks its places; the places of each document meet its text, and kept lines are joined by position. The distinct count
    aggregates by (hash, document) first, so a line of every third document is no hot key. A null text is one empty line
    and stays null. Rows alike in id and text count as one document and are all kept. Columns of ``docs`` named
    ``n_lines`` or ``n_dropped`` are replaced; names that begin with ``__pl`` are reserved."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    id_columns = ["doc_id"] if "doc_id" in docs.columns else []
    k1, k2 = row_key(*id_columns, text)
    lines = docs.select(k1.alias("__pl_k1"), k2.alias("__pl_k2"), F.posexplode(F.split(text_of(text), "\n")).alias("__pl_at", "__pl_line"))
    keyed = lines.select("__pl_k1", "__pl_k2", "__pl_at", line_key(F.col("__pl_line")).alias("__pl_key")).where(F.char_length("__pl_key") >= min_chars)
    places = stored(keyed.select("__pl_k1", "__pl_k2", "__pl_at", F.xxhash64(F.lit(3), "__pl_key").alias("__pl_h1"), F.xxhash64(F.lit(5), "__pl_key").alias("__pl_h2")), "lines")
    counts = places.select("__pl_h1", "__pl_h2", "__pl_k1", "__pl_k2").distinct().groupBy("__pl_h1", "__pl_h2").agg(F.count("*").alias("__pl_n"))
    frequent = stored(counts.where(F.col("__pl_n") >= min_documents).select("__pl_h1", "__pl_h2"), "frequent")
    hits = places.join(small(frequent, BROADCAST_KEYS), ["__pl_h1", "__pl_h2"]).groupBy("__pl_k1", "__pl_k2").agg(F.collect_set("__pl_at").alias("__pl_gone"))
    joined = docs.select(*own, k1.alias("__pl_k1"), k2.alias("__pl_k2")).join(hits.hint("shuffle_hash"), ["__pl_k1", "__pl_k2"], "left")
    split = joined.withColumn("__pl_lines", F.split(text_of(text), "\n"))
    n_lines = F.size("__pl_lines").cast("long")
    left = F.array_except(F.sequence(F.lit(0), F.size("__pl_lines") - 1), F.col("__pl_gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("__pl_lines"), i)), "\n")
    return split.select(
        *[F.when(F.col("__pl_gone").isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(c) for c in own],
        n_lines.alias("n_lines"),
        F.when(F.col("__pl_gone").isNull(), 0).otherwise(F.size("__pl_gone")).cast("long").alias("n_dropped"),
    )
