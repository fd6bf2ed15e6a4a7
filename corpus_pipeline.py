"""A training-data pipeline over ``documents``: each stage works on what the stage before kept.

Stages, in order: documents that the quality classifier rejects go; lines common to many documents go; of each group of near
duplicates one document stays; sources, languages and topics are mixed to target weights; what is left is packed.

Every stage reads the five columns of ``documents`` by name, so extra columns, whatever they are called, don't matter. Any
column may be null. An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, mixing, near_dups, packing, quality
from plumbline.llm._common import DOCUMENT_COLUMNS, stored
from plumbline.llm.queries import KEEP_SCORE


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``KEEP_SCORE``; repeated rows have equal scores.

    A null or empty text has the score of a text without words. Without labels that may be learned from every score is one
    half, and every document stays."""
    rows = docs.select(*DOCUMENT_COLUMNS)
    model = quality.fit(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_documents(rows, model, DOCUMENT_COLUMNS).where(F.col("score") >= KEEP_SCORE).select(*DOCUMENT_COLUMNS)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; ``n_chars`` is counted again. All rows stay, also those left empty.

    A null text is one empty line and stays null, with 0 characters; rows alike in id and text count as one document."""
    kept = line_dedup.drop_common_lines(docs.select(*DOCUMENT_COLUMNS))
    return kept.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*DOCUMENT_COLUMNS)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least id, null ids last; of rows alike in id and text one.

    Null and empty texts are one group; texts without words are alike only if equal."""
    return near_dups.keep_one(docs.select(*DOCUMENT_COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probability; rows that share an id share their fate, a null id is an id like others.

    A null source or language counts as ``unknown``; texts without words are never drawn."""
    return mixing.mix(docs.select(*DOCUMENT_COLUMNS)).where("kept").select(*DOCUMENT_COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed into sequences; a null or empty text is the end id alone, and repeated
    rows are packed again."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("MinHash near-dedup", near_duplicate_filter),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", sequence_packing),
]

#: The classifier, the near-duplicate sketches and the tokenizer can't be expressed in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = stored(docs, f"stage{place}")
    return docs
