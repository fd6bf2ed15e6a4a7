"""One query per operator over its whole table, with production parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import binary_search, fingerprints, licenses, line_dedup, mixing, near_dups, packing, quality, token_counts, wavelet

#: Scores from which a document is predicted to have label 1.
KEEP_SCORE = 0.3
NEIGHBOURS, QUERY_STEP = 10, 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: its near-duplicate class, the least id there, and whether it is the row that stays.

    Null ids come last and have a null class among themselves; null and empty texts are alike; see ``near_dups``.
    """
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per encoded length: how many documents have it and, for that length as a limit, totals and truncated totals.

    Null and empty texts have the length of the end id; an empty table gives no rows.
    """
    return token_counts.length_curve(token_counts.length_histogram(_table(spark, sf_dir, "documents")))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: its cell, tokens, calibrated probability and whether it is drawn.

    Null sources and languages are ``unknown`` to raking and null here; texts without words are never drawn.
    """
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: whether its label was kept from training, its score, and the prediction.

    Null and empty texts have the score of a text without words; a null id is not held out, but no label is learned for it.
    """
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: fingerprints of its text and its edited text, and how like they are to each other and the next.

    A null text is empty; a null id has no next document, so what follows from it is null.
    """
    found = fingerprints.against_edits(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        *[fingerprints.as_text(F.col(f"{of}wide"), F.col(f"{of}pieces"), F.col(f"{of}signs")).alias(f"{of}fingerprint") for of in ("", "edited_")],
        "near_edited", "near_next",
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: words, base places, labels and a score. A null text is empty: no words, no labels, score 0."""
    return licenses.summarised(licenses.scan(_table(spark, sf_dir, "documents")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document: where its ids are and its place in a sequence. A null or empty text is the end id alone."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of each vector whose id is divisible by 20, by Hamming distance of codes, then id.

    Vectors that are null or empty and null ids take no part; fewer rows than ten give fewer neighbours.
    """
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), binary_search.code_of(F.col("embedding")).alias("code"))
    return binary_search.nearest(rows, rows.where(F.col("id") % QUERY_STEP == 0), NEIGHBOURS)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: its lines, how many go, and the digest of what is left. A null text is one empty line."""
    kept = line_dedup.drop_common_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, read back from the shard files: where its ids begin, how many, and their checksum.

    A null or empty text is the end id alone; null ids come first.
    """
    return wavelet.read_documents(spark, wavelet.write_ids(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_token_counts, op3_source_mixing, op4_quality_classifier, op5_fingerprints,
        op6_license_scan, op7_packing, op8_exact_search, op9_line_dedup, op10_token_files,
    )
}

_CODES = """codes AS (SELECT vec_id, list_reduce(list_transform(range(64), lambda b:
  CASE WHEN embedding[b + 1] > 0 THEN 1::UBIGINT << b ELSE 0::UBIGINT END), lambda x, y: x | y) AS code
  FROM embeddings)"""

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _mixing_sql(rounds: int = 40) -> str:
    """The same raking as a chain of common table expressions."""
    topic = "CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN n < 100 THEN 'brief' WHEN n < 1000 THEN 'article' ELSE 'long' END"
    steps = [
        "d AS (SELECT doc_id, source, lang, text, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS n FROM documents)",
        f"t AS (SELECT doc_id, source, lang, coalesce(source, 'unknown') AS s, coalesce(lang, 'unknown') AS l, {topic} AS t, n FROM d)",
        "c AS (SELECT s, l, t, sum(n)::DOUBLE AS n FROM t GROUP BY ALL)",
    ]
    for m in "slt":
        steps.append(f"m_{m} AS (SELECT {m}, pow(sum(n), {mixing.TEMPERATURE}) AS share FROM c GROUP BY {m})")
        steps.append(f"g_{m} AS (SELECT {m}, (SELECT sum(n) FROM c) * share / (SELECT sum(share) FROM m_{m}) AS target FROM m_{m})")
    steps.append("w0 AS MATERIALIZED (SELECT s, l, t, n, n AS w, g_s.target AS a_s, g_l.target AS a_l, g_t.target AS a_t FROM c JOIN g_s USING (s) JOIN g_l USING (l) JOIN g_t USING (t))")
    last = "w0"
    for i in range(rounds):
        for m in "slt":
            now = f"w{i + 1}{m}"
            scaled = f"CASE WHEN sum(w) OVER (PARTITION BY {m}) > 0 THEN w * a_{m} / sum(w) OVER (PARTITION BY {m}) ELSE 0 END"
            steps.append(f"{now} AS MATERIALIZED (SELECT s, l, t, n, {scaled} AS w, a_s, a_l, a_t FROM {last})")
            last = now
    steps += [
        f"f AS (SELECT s, l, t, n, w, CASE WHEN n > 0 THEN w / n ELSE 0 END AS f FROM {last})",
        f"r AS (SELECT *, sum(n) OVER () * {mixing.BUDGET} - coalesce(sum(n) OVER (ORDER BY f DESC, s, l, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS here, sum(w) OVER (ORDER BY f DESC, s, l, t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM f)",
        "z AS (SELECT arg_max(here / rest, f) AS z FROM r WHERE rest > 0 AND here > 0 AND here / rest * f <= 1)",
        "p AS (SELECT s, l, t, coalesce(least(1, z * f), CASE WHEN f > 0 THEN 1 ELSE 0 END) AS p FROM r, z)",
    ]
    kept = "(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0)::DOUBLE < p"
    return f"WITH {', '.join(steps)} SELECT doc_id, source, lang, t AS topic, n AS n_tokens, round(CASE WHEN n > 0 THEN p ELSE 0 END, 6) AS probability, n > 0 AND {kept} AS kept FROM t JOIN p USING (s, l, t)"


ORACLE: dict[str, str] = {
    "op3_source_mixing": _mixing_sql(),
    "op8_exact_search": f"""WITH {_CODES},
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, bit_count(xor(q.code, c.code))::INTEGER AS distance
  FROM codes q JOIN codes c ON q.vec_id % {QUERY_STEP} = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= {NEIGHBOURS}""",
    "op9_line_dedup": f"""WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCUMENTS}),
marked AS (SELECT doc_id, place, line, key IN (SELECT key FROM common) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
