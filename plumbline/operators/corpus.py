"""Operators over many texts: paragraphs, rankings, gates, diffs, transcripts, reports, share payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import lexicon as L
from plumbline.functions import text as T
from plumbline.plans.score import COUNTS, analyze


#: Blank lines between paragraphs; a line of a carriage return alone isn't blank.
BLANK_LINE = r"\n[ \t]*\n"


def paragraphs(df: DataFrame, key: str = "doc_id", text: str = "text", separator: str = BLANK_LINE) -> DataFrame:
    """``key, index, paragraph``: blocks with words, numbered from 0 in order, each in its document's own row set."""
    blocks = F.filter(F.transform(F.split(T.as_text(F.col(text)), separator), T.trim_space), lambda p: F.lower(p).rlike("[a-z]"))
    return df.select(key, F.posexplode(blocks).alias("index", "paragraph"))


def analyze_paragraphs(df: DataFrame, key: str = "doc_id", text: str = "text", separator: str = BLANK_LINE) -> DataFrame:
    """One scored row per paragraph: ``key, index, snippet, n_words, score, grade`` and counts by rule."""
    scored = analyze(paragraphs(df, key, text, separator), "paragraph")
    return scored.withColumn("snippet", F.left(T.collapse_space(F.col("paragraph")), F.lit(80)))


def paragraph_table(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, place, line``: each document's paragraphs worst first, ties in order, with their first four rules or ``clean``."""
    fired = F.array_compact(F.array(*[F.when(F.col(c) > 0, rule) for rule, c in COUNTS.items()]))
    tells = F.when(F.size(fired) == 0, "clean").otherwise(F.array_join(F.slice(fired, 1, 4), ", "))
    cut = F.when(F.char_length("snippet") >= 80, "…").otherwise("")
    line = F.concat(
        F.lit("  "), "grade", F.lit("  "), F.lpad(F.col("score").cast("string"), 3, " "), F.lit("   ¶"), (F.col("index") + 1).cast("string"),
        F.lit("  “"), "snippet", cut, F.lit("”  · "), F.col("n_words").cast("string"), F.lit("w · "), tells,
    )
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "index")).cast("long")
    return scored.select(key, place.alias("place"), line.alias("line"))


def rank_worst(scored: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Worst first, ties by key; with ``most``, a bounded top list instead of a whole sort."""
    ordered = scored.orderBy(F.desc("score"), key)
    return ordered.limit(most) if most else ordered


def scan_summary(scored: DataFrame, key: str) -> DataFrame:
    """``files, mean_score, worst``: how many, their rounded mean and the worst, ties to the least key."""
    worst = F.max_by(F.col(key), F.struct(F.col("score"), -F.col(key))) if dict(scored.dtypes)[key] != "string" else F.min_by(key, F.struct(-F.col("score"), F.col(key)))
    return scored.agg(F.count("*").alias("files"), T.rounded(F.sum("score") / F.count("*")).alias("mean_score"), worst.alias("worst"))


def gate(scored: DataFrame, group: str, limit: int = 25) -> DataFrame:
    """Per group ``n, worst, failed``: whether any score is over the limit."""
    return scored.groupBy(group).agg(F.count("*").alias("n"), F.max("score").alias("worst"), F.bool_or(F.col("score") > limit).alias("failed"))


def diff_lines(df: DataFrame, diff: str = "diff_id", text: str = "text") -> DataFrame:
    """``diff, pos, line`` of unified diffs, a row a line."""
    return df.select(diff, F.posexplode(F.split(T.as_text(F.col(text)), "\n")).alias("pos", "line"))


def added_prose_by_file(lines: DataFrame, diff: str = "diff_id", pos: str = "pos", line: str = "line") -> DataFrame:
    """``diff, file, added``: the lines a unified diff adds to prose files, in order; one window per diff carries the file down."""
    head = F.col(line).startswith("+++ ")
    path = T.trim_space(F.regexp_replace(F.regexp_replace(F.substr(F.col(line), F.lit(5)), "^b/", ""), "\t.*$", ""))
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))
    file = F.when(head, F.when((path != "/dev/null") & extension.isin(*L.PROSE_EXTENSIONS), path).otherwise(""))
    order = W.partitionBy(diff).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    placed = lines.withColumn("file", F.last(file, ignorenulls=True).over(order))
    added = placed.where((F.col("file") != "") & F.col(line).startswith("+") & ~F.col(line).startswith("+++"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct(pos, F.substr(F.col(line), F.lit(2)).alias("l")))), lambda x: F.concat(x["l"], F.lit("\n")))
    return added.groupBy(diff, "file").agg(F.array_join(joined, "").alias("added"))


def scored_diff(lines: DataFrame, diff: str = "diff_id", pos: str = "pos", line: str = "line", least: int = 20) -> DataFrame:
    """:func:`added_prose_by_file` with scores, for files that gain at least ``least`` visible characters."""
    added = added_prose_by_file(lines, diff, pos, line)
    return analyze(added.where(T.visible_length(F.col("added")) >= least), "added")


def transcript_tail(turns: DataFrame, n: int = 6, own_role: str = "assistant") -> DataFrame:
    """``conv_id, transcript``: the last n messages, labelled, each cut to 500 characters, all to 4,000."""
    last = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    body = F.left(T.collapse_space(T.as_text(F.col("text"))), F.lit(500))
    label = F.when(F.col("role") == own_role, "You: ").otherwise("Them: ")
    kept = turns.withColumn("n", F.row_number().over(last)).where(F.col("n") <= n).withColumn("said", F.when(body != "", F.concat(label, body)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "said"))), lambda x: x["said"])
    return kept.groupBy("conv_id").agg(F.left(F.array_join(ordered, "\n"), F.lit(4000)).alias("transcript"))


def harvest(posts: DataFrame, group: str, order: str, text: str = "text", most: int = 8000) -> DataFrame:
    """``group, harvested``: a group's lines of at least 20 characters with white space, no interface words, first seen only, joined.

    Lines that begin beyond the first ``most`` characters are left out before lines meet in one row."""
    lines = posts.select(F.col(group).alias("_group"), F.col(order).alias("_order"), F.posexplode(F.split(T.as_text(F.col(text)), "\n")).alias("_at", "_raw"))
    lines = lines.withColumn("l", T.trim_space(F.col("_raw")))
    kept = lines.where((F.char_length("l") >= 20) & F.col("l").rlike(L.WS) & ~F.col("l").rlike(L.CHROME))
    first = kept.groupBy("_group", "l").agg(F.min(F.struct("_order", "_at")).alias("seen"))
    before = W.partitionBy("_group").orderBy("seen").rowsBetween(W.unboundedPreceding, -1)
    near = first.withColumn("before", F.coalesce(F.sum(F.char_length("l") + 1).over(before), F.lit(0))).where(F.col("before") < most)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seen", "l"))), lambda x: x["l"])
    return near.groupBy(F.col("_group").alias(group)).agg(F.left(F.array_join(ordered, "\n"), F.lit(most)).alias("harvested"))


def voice_sample(c: Column, least: int = 120, raw: int = 4000, sent: int = 12000, is_raw: bool = False) -> Column:
    """The sample that may be sent: null under ``least`` visible characters, else trimmed, then cut to ``sent`` characters, or
    to ``raw`` if it goes out as it is (``is_raw``)."""
    bare = T.trim_space(T.as_text(c))
    return F.when(T.visible_length(bare) >= least, F.left(bare, F.lit(raw if is_raw else sent)))


def verdict(grade: Column) -> Column:
    """What a grade says."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in L.VERDICTS.items() for x in pair]), grade)


def bucket(grade: Column) -> Column:
    """The class of a grade: good, warn or bad."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in L.BUCKETS.items() for x in pair]), grade)


def in_languages(df: DataFrame, languages: tuple[str, ...], column: str = "lang") -> DataFrame:
    """Rows in one of the listed languages; an empty list lets none through, and neither does a null language."""
    return df.where(F.col(column).isin(*languages)) if languages else df.where(F.lit(False))


def diagnostics(scored: DataFrame, key: str = "doc_id", text: str = "text", most: int = 50) -> DataFrame:
    """``key, rule, start, stop``: where an editor marks findings. Every place of a snippet counts, in any case and with any
    white space, at most ``most`` a finding; places of one rule that begin alike are one. Offsets count code points from 0;
    snippets of fewer than three characters have no place. A text is looked through where it lies: only places are grouped."""
    spelled = lambda s: F.regexp_replace(F.regexp_replace(s, r"([.*+?^${}()|\[\]\\])", r"\\$1"), f"{L.WS}+", f"{L.WS}+".replace("\\", "\\\\"))
    trimmed = F.transform("findings", lambda f: F.struct(f["rule"].alias("rule"), T.trim_space(f["snippet"]).alias("s")))
    marks = F.transform(F.array_distinct(F.filter(trimmed, lambda m: F.char_length(m["s"]) >= 3)), lambda m: F.struct(m["rule"].alias("rule"), F.concat(F.lit("(?iu)"), spelled(m["s"])).alias("p")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["part"])
        end = begin + F.char_length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("stop")))).alias("out"))

    def places(m: Column) -> Column:
        hits = F.slice(F.regexp_extract_all(F.col(text), m["p"], F.lit(0)), 1, most)
        each = F.zip_with(F.slice(F.split(F.col(text), m["p"], most + 1), F.lit(1), F.size(hits)), hits, lambda part, hit: F.struct(part.alias("part"), hit.alias("hit")))
        return F.transform(F.aggregate(each, start, step)["out"], lambda x: F.struct(m["rule"].alias("rule"), x["start"].alias("start"), x["stop"].alias("stop")))

    rows = scored.select(key, F.inline(F.flatten(F.transform(marks, places))))
    return rows.groupBy(key, "rule", "start").agg(F.max("stop").alias("stop"))


def tell_summary(findings: Column, uniform: Column) -> Column:
    """Rules in order with their first three snippets, after a note on uniform rhythm."""
    rules = F.array_distinct(F.transform(findings, lambda f: f["rule"]))
    shown = lambda r: F.transform(F.slice(F.filter(findings, lambda f: f["rule"] == r), 1, 3), lambda f: F.concat(F.lit('"'), f["snippet"], F.lit('"')))
    parts = F.transform(rules, lambda r: F.concat(r, F.lit(" ("), F.array_join(shown(r), ", "), F.lit(")")))
    return F.array_join(F.concat(F.when(uniform, F.array(F.lit(L.UNIFORM_NOTE))).otherwise(F.array().cast("array<string>")), parts), "; ")


def top_tells(findings: Column, most: int = 3) -> Column:
    """The rules with most findings, the first seen first among equals."""
    rules = F.array_distinct(F.transform(findings, lambda f: f["rule"]))
    counted = F.transform(rules, lambda r, i: F.struct((-F.size(F.filter(findings, lambda f: f["rule"] == r))).alias("n"), i.alias("i"), r.alias("r")))
    return F.slice(F.transform(F.array_sort(counted), lambda x: x["r"]), 1, most)


def share_payload(grade: Column, score: Column, tells: Column, n_words: Column) -> Column:
    """Grade, score, tells and words as base64url JSON; never the text."""
    return T.base64url(F.encode(F.to_json(F.struct(grade.alias("g"), score.alias("s"), tells.alias("t"), n_words.alias("w"))), "UTF-8"))


def read_payload(c: Column) -> Column:
    """The struct back, or null if it isn't one: a grade of A to F, the score clamped, at most three tells."""
    back = F.from_json(F.decode(F.unbase64(F.translate(c, "-_", "+/")), "UTF-8"), "g string, s int, t array<string>, w int")
    return F.when(back["g"].rlike("^[A-F]$") & back["s"].isNotNull(), F.struct(back["g"].alias("grade"), F.greatest(F.lit(0), F.least(F.lit(100), back["s"])).alias("score"), F.slice(F.coalesce(back["t"], F.array()), 1, 3).alias("tells"), F.coalesce(back["w"], F.lit(0)).alias("words")))


def format_report(rows: DataFrame) -> DataFrame:
    """Adds ``report`` to scored rows with findings: score, metrics as they are shown, and each rule's first six snippets."""
    findings = F.col("findings")
    rules = F.array_distinct(F.transform(findings, lambda f: f["rule"]))

    def line(r: Column) -> Column:
        own = F.transform(F.filter(findings, lambda f: f["rule"] == r), lambda f: F.concat(F.lit('"'), f["snippet"], F.lit('"')))
        more = F.when(F.size(own) > 6, F.concat(F.lit(" …+"), (F.size(own) - 6).cast("string"))).otherwise("")
        return F.concat(F.lit("  "), r, F.lit(" ("), F.size(own).cast("string"), F.lit("): "), F.array_join(F.slice(own, 1, 6), ", "), more)

    n = F.size(findings)
    shown = lambda c, digits: T.number_text(F.col(c), digits)
    head = [
        F.concat(F.lit("Score "), F.col("score").cast("string"), F.lit("/100  ·  grade "), F.col("grade")),
        F.lit("─" * 46),
        F.concat(F.lit("words "), F.col("n_words").cast("string"), F.lit("   sentences "), F.col("n_sentences").cast("string"), F.lit("   avg len "), shown("avg_length", 1)),
        F.concat(F.lit("rhythm variance (CV) "), shown("cv", 2), F.when(F.col("uniform"), "  ⚠ too uniform").otherwise("  ok")),
        F.concat(F.lit("adverb rate "), shown("adverb_rate", 1), F.lit("/100   em-dash rate "), shown("dash_rate", 1), F.lit("/100   triad density "), shown("triad_density", 2)),
        F.lit(""),
        F.when(n == 0, "No lexical tells found.").otherwise(F.concat(n.cast("string"), F.when(n == 1, " finding:").otherwise(" findings:"))),
    ]
    return rows.withColumn("report", F.array_join(F.concat(F.array(*head), F.transform(rules, line)), "\n"))
