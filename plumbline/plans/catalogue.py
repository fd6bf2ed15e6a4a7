"""The named queries over the driver's tables. Default lexicons hit nothing there, so most texts get a fixed sentence appended."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql import Window as W

from plumbline.functions import lexicon as L
from plumbline.functions import text as T
from plumbline.operators import corpus, evaluate, rewrite
from plumbline.plans.score import COUNTS, analyze, analyze_with_findings, measure, result_json, with_findings
from plumbline.sources import files

SPIKES = (
    "The road bends past the mill.",
    "The bridge is a testament to patience, and a rich tapestry of work.",
    "In conclusion, we walked home.",
    "The robust tool is a powerful and vibrant choice.",
    "We packed bread, cheese, and apples.",
    "It's not a race, it's a walk.",
    "Perhaps it might rain somewhat later.",
    "He stopped — then ran -- then — fell — down -- again.",
    "It’s not about speed, it’s about care; the world of cars isn’t ours.",
    "We navigate the world of maps to unlock the world of charts.",
    "She left at 5 p.m. He came from the U.S. economy desk.",
    "Dr. Reed said no. Then Mrs. Hale slowly, quietly and finally laughed (really?) \"Done.\" Next.",
)
PAIR_LIMIT, GATE, SWEEP = 15, 25, evaluate.THRESHOLDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spike(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SPIKES)), (F.pmod(key, F.lit(len(SPIKES))) + 1).cast("int"))


def spiked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files.spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "lang", "source", F.concat(T.as_text(F.col("text")), F.lit(" "), spike(F.col("doc_id"))).alias("text"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(spiked(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, without their texts, beside the labels."""
    small = scored(spark, sf_dir).select("doc_id", "score", "grade", "cv", *COUNTS.values())
    return small.join(table(spark, sf_dir, "labels"), "doc_id")


def q_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    per100 = lambda c: F.when(F.col("n_words") > 0, T.rounded(F.col(c) * 100.0 / F.col("n_words"), 2)).otherwise(0.0)
    docs = files.spread(table(spark, sf_dir, "documents"))
    return measure(docs).select("doc_id", "n_words", "adverbs", "dashes", per100("adverbs").alias("adverb_rate"), per100("dashes").alias("dash_rate"))


def q_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measure(spiked(spark, sf_dir))
    return rows.select("doc_id", "n_sentences", "n_lengths", "sum_lengths", "sum_squares", F.get("sentences", F.lit(0)).alias("first_sentence"), F.try_element_at("sentences", F.lit(-1)).alias("last_sentence"))


def q_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "n_sentences", T.rounded(F.col("cv"), 4).alias("cv"), "uniform")


def q_lexical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(spiked(spark, sf_dir)).select("doc_id", "banned", "hollow")


def q_findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of findings by rule, in one pass over the rows."""
    rows = measure(spiked(spark, sf_dir))
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.sum(c).alias("findings"), F.count_if(F.col(c) > 0).alias("documents")) for rule, c in COUNTS.items()])
    return rows.agg(each.alias("e")).select(F.inline("e"))


def _rule(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """Documents with a count over 0. A filter would be pushed below the count, and all before it done twice; unfolding isn't."""
    counted = measure(spiked(spark, sf_dir))
    return counted.select("doc_id", F.explode(F.filter(F.array(column), lambda n: n > 0)).alias(column))


def q_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ("high", "med", "low", "rhythm_points", "adverb_points", "dash_points", "triad_points")
    return scored(spark, sf_dir).select("doc_id", *[F.col(c).cast("long").alias(c) for c in parts], F.col("total").cast("long").alias("total"), "score", "grade")


def q_grade_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("lang").agg(*[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCDF"], F.sum("score").alias("sum_score"), F.count("*").alias("n"))


def q_rank_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.rank_worst(scored(spark, sf_dir).select("doc_id", "score", "grade"), "doc_id", 50)


def q_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.scan_summary(scored(spark, sf_dir), "doc_id")


def q_source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.gate(scored(spark, sf_dir), "source", GATE)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are paragraphs, with blocks of no words, a line of a carriage return alone, and blanks between."""
    tail = F.lit("\n\n---\n\t\n123 456\n\nfirst half\n\r\nsecond half\n \n\n  \nlast words here.")
    return spiked(spark, sf_dir).select("doc_id", F.concat(F.replace("text", F.lit("\n"), F.lit("\n \t\n")), tail).alias("text"))


def q_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.analyze_paragraphs(_blocks(spark, sf_dir))
    return rows.select("doc_id", F.col("index").cast("long").alias("index"), "snippet", "n_words", "score", "grade")


def q_paragraph_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.paragraph_table(corpus.analyze_paragraphs(_blocks(spark, sf_dir)))


def q_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = files.spread(table(spark, sf_dir, "pages")).withColumn("visible", T.strip_html(F.col("html")))
    return analyze(pages, "visible").select("page_id", "visible", "n_words", "score", "grade")


def q_strip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.lit("# Title\n```\ncode ~~~\n"), F.substring("text", 1, 40), F.lit("\n~~~\n```\n> quoted\n<b>"), F.col("text"), F.lit("</b>\n| a | b |\n~~~\nopen"))
    return spiked(spark, sf_dir).select("doc_id", F.sha2(T.strip_markdown(wrapped), 256).alias("prose_sha256"))


def q_transcript_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.transcript_tail(table(spark, sf_dir, "conversations"))


def q_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.harvest(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = files.spread(table(spark, sf_dir, "conversations"))
    return analyze(turns.withColumn("text", F.concat(T.as_text(F.col("text")), F.lit(" "), spike(F.col("conv_id") * 5 + F.col("turn")))))


def q_role_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = evaluate.arm_summary(_turns(spark, sf_dir), "role")
    return summary.withColumn("dominant", evaluate.dominant_grade(summary))


def q_role_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.against_baseline(evaluate.arm_summary(_turns(spark, sf_dir), "role"), "role", "user")


def q_confusion(spark: SparkSession, sf_dir: str, thresholds: tuple[int, ...] = (10,)) -> DataFrame:
    rows = evaluate.confusion(labelled(spark, sf_dir), F.col("quality") == 0, thresholds)
    return rows.select("threshold", "tp", "fp", "tn", "fn", *[T.rounded(F.col(c), 6).alias(c) for c in ("recall", "specificity", "precision", "accuracy", "f1")])


def q_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.confusion(labelled(spark, sf_dir), F.col("quality") == 0, SWEEP)
    r, s = evaluate.wilson(F.col("tp"), F.col("tp") + F.col("fn")), evaluate.wilson(F.col("tn"), F.col("tn") + F.col("fp"))
    return rows.select("threshold", *[T.rounded(c[e], 6).alias(f"{n}_{e}") for n, c in (("recall", r), ("specificity", s)) for e in ("low", "high")])


def q_rule_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rule_diagnostics(labelled(spark, sf_dir), F.col("quality") == 0)


def q_score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_distribution(labelled(spark, sf_dir), "quality")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent user and assistant turns as instruction pairs."""
    turn = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"output": F.lead("text").over(turn), "next_role": F.lead("role").over(turn)})
    kept = rows.where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    return kept.select("conv_id", "turn", F.col("text").alias("input"), F.concat("output", F.lit(" "), spike(F.col("conv_id"))).alias("output"))


def q_filter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.filter_pairs(analyze(pairs(spark, sf_dir), "output"), PAIR_LIMIT).select("conv_id", "turn", "score", "kept")


def q_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).withColumn("source", F.concat(F.lit("s"), F.pmod("conv_id", F.lit(7)).cast("string")))
    return evaluate.holdout(rows, "source", "input").select("conv_id", "turn", "source", "held")


def q_apply_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = rewrite.fix_report(analyze(spiked(spark, sf_dir)), counted=(*L.BANNED, *L.HOLLOW)).select("doc_id", "text", "fixed", "applied", "skipped", "score")
    return rewrite.rescored(report).select("doc_id", F.sha2("fixed", 256).alias("fixed_sha256"), "applied", "skipped", "before", "after")


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff made of each document's lines: every third line is added to a Markdown file, others to files of no prose."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("diff_id"), F.split(T.as_text(F.col("text")), "\n").alias("lines"))

    def lines(raw: Column, at: Column) -> Column:
        head = F.when(at % 3 == 0, F.concat(F.lit("+++ b/notes/f"), F.pmod(at, F.lit(2)).cast("string"), F.lit(".md\tnow"))).when(at % 3 == 1, F.lit("+++ b/src/x.py")).otherwise(F.lit("+++ /dev/null"))
        return F.concat(head, F.lit("\n+"), raw)

    return docs.select("diff_id", F.array_join(F.transform("lines", lines), "\n").alias("text"))


def q_diff_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.added_prose_by_file(corpus.diff_lines(_diffs(spark, sf_dir)))


def q_diff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.scored_diff(corpus.diff_lines(_diffs(spark, sf_dir))).select("diff_id", "file", "n_words", "score", "grade")


def q_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.looks_readable(F.col("text")).alias("readable"), (T.visible_length(T.as_text(F.col("text"))) >= 20).alias("enough"))


def q_share_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analyze_with_findings(spiked(spark, sf_dir))
    payload = corpus.share_payload(F.col("grade"), F.col("score"), corpus.top_tells(F.col("findings")), F.col("n_words"))
    return rows.select("doc_id", payload.alias("payload"), corpus.tell_summary(F.col("findings"), F.col("uniform")).alias("tells"))


def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.format_report(analyze_with_findings(spiked(spark, sf_dir))).select("doc_id", "report")


def q_result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze_with_findings(spiked(spark, sf_dir)).select("doc_id", result_json().alias("result"))


def q_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with enough words to be shown a score, in two of the languages."""
    rows = corpus.in_languages(spiked(spark, sf_dir), ("en", "fr")).withColumn("page_words", T.page_words(F.col("text")))
    shown = analyze(rows.where(F.col("page_words") >= L.LEAST_PAGE_WORDS))
    return shown.select("doc_id", "page_words", "grade", corpus.verdict(F.col("grade")).alias("verdict"), corpus.bucket(F.col("grade")).alias("bucket"))


def q_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.diagnostics(with_findings(spiked(spark, sf_dir)))


def q_rules_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fired_rules(scored(spark, sf_dir))


def q_kept_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pairs(spark, sf_dir)
    return evaluate.kept_pairs(analyze(own, "output"), own.columns, PAIR_LIMIT)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("sample"))


def q_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, each with the English document of its id as an arm's output, or none."""
    arms = table(spark, sf_dir, "documents").where(F.col("lang") == "en").select(F.col("doc_id").alias("id"), "text")
    return evaluate.outputs_of(_samples(spark, sf_dir), arms)


def q_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return evaluate.paired(_samples(spark, sf_dir), ids).select("id", "sample")


def q_first_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.first_outputs(pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "output"), "id")


def q_corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break the protocol: repeated ids, empty texts, unknown labels, labels without a document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    per_id = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.char_length("text"), F.lit(0)) == 0).alias("e"), F.count_if(F.col("source").isNull()).alias("s"))
    joined = per_id.join(labels, "doc_id", "full")
    return joined.agg(
        F.count_if(F.col("n") > 1).alias("repeated_ids"), F.coalesce(F.sum("e"), F.lit(0)).alias("empty_texts"), F.coalesce(F.sum("s"), F.lit(0)).alias("without_source"),
        F.count_if(F.col("quality").isNotNull() & ~F.col("quality").isin(0, 1)).alias("unknown_labels"), F.count_if(F.col("n").isNull()).alias("labels_without_document"),
    )


def q_binary_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a PDF, a DOCX and an EPUB of several parts, made in the tasks and read back as text."""
    import io
    import zipfile
    import zlib
    from html import escape

    import pandas as pd

    def archive(parts: dict[str, str]) -> bytes:
        with zipfile.ZipFile(held := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in parts.items():
                z.writestr(name, body)
        return held.getvalue()

    def pdf(line: str) -> bytes:
        shown = re.sub(r"([()\\])", r"\\\1", re.sub("[^ -~]+", " ", line))
        return b"%PDF<</Length 1/Filter/FlateDecode>>\nstream\n" + zlib.compress(f"BT ({shown}) Tj ET".encode("latin-1")) + b"\nendstream<</Filter/DCTDecode>>stream\n(no)Tj\nendstream"

    def pack(batches):
        for batch in batches:
            out = []
            for page, body in zip(batch["page_id"], batch["html"], strict=True):
                out.append((f"{page}.pdf", pdf(body or "")))
                out.append((f"{page}.docx", archive({"word/document.xml": f"<w:p><w:r>{escape(body or '', quote=False)}</w:r></w:p><w:p>page<w:tab/>{page}</w:p>"})))
                parts = {"OEBPS/nav.xhtml": "skip", "OEBPS/navigation.xhtml": body or "", "OEBPS/title page.html": "skip", "OEBPS/discovery.xhtm": "<p>", "OEBPS/last.HTM": f"<p>part of {page}</p>"}
                out.append((f"{page}.epub", archive(parts)))
            yield pd.DataFrame(out, columns=["path", "content"])

    schema = T_.StructType([T_.StructField("path", T_.StringType()), T_.StructField("content", T_.BinaryType())])
    books = table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(pack, schema)
    return files.read_binary(books).select("path", F.sha2("text", 256).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        q_words, q_sentences, q_rhythm, q_lexical_hits, q_findings_by_rule, q_score, q_grade_by_lang, q_rank_worst, q_scan_summary,
        q_source_gate, q_paragraphs, q_strip_html, q_strip_markdown, q_transcript_tail, q_harvest, q_role_style, q_role_deltas, q_confusion,
        q_wilson, q_rule_diagnostics, q_score_distribution, q_filter_pairs, q_holdout_split, q_apply_fixes, q_diff_added, q_readable,
        q_share_payload, q_report, q_corpus_audit, q_binary_sources, q_paragraph_table, q_diff_scores, q_result_json, q_verdicts,
        q_diagnostics, q_rules_fired, q_kept_pairs, q_outputs, q_paired, q_first_outputs,
    )
} | {"q_sweep": partial(q_confusion, thresholds=SWEEP)} | {f"q_{c}": partial(_rule, column=c) for c in ("triads", "pivots", "hedges", "openers")}
