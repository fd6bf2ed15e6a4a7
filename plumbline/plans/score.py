"""Score a table of texts: metrics, findings by rule, points, grade. Row by row; nothing is shuffled."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import lexicon as L
from plumbline.functions import text as T

COUNTS = {"banned-phrase": "banned", "hollow-confidence": "hollow", "triad": "triads", "negation-pivot": "pivots", "hedge-stack": "hedges", "cliche-opener": "openers"}
_PIVOT = "(?i)" + L.ascii_bounds("|".join(f"(?:{p})" for p in L.PIVOTS))
_TRIAD = "(?i)" + L.ascii_bounds(L.TRIAD)
_HEDGE = L.ascii_bounds(rf"\b(?:{L.alternation(L.HEDGES)})\b")
_HEDGE_SIGN = f"[^{L.LETTERS}0123456789_]{L.branching(L.HEDGES)}"
_OPENER, _OPENER_REACH = f"^(?:{L.alternation(L.OPENERS)})[ ,]", max(map(len, L.OPENERS)) + 1


def phrase_hits(lower: Column, phrases: tuple[str, ...]) -> Column:
    """Hits of all phrases in lower-case text, by one pass for each group of phrases that can't overlap."""
    total = F.lit(0)
    for group in L.overlap_free(phrases):
        total = total + F.regexp_count(lower, F.lit(L.bounded(group)))
    return total.cast("long")


def any_phrase(lower: Column, *lists: tuple[str, ...]) -> Column:
    """Whether a phrase may stand in lower-case text: by how it begins and what is before it, in one pass for all lists."""
    phrases = tuple(p for own in lists for p in own)
    return F.concat(F.lit(" "), lower).rlike(f"[^{L.LETTERS}']{L.branching(phrases)}") if phrases else F.lit(False)


def is_pivot(s: Column) -> Column:
    return s.rlike(L.PIVOT_SIGN) & s.rlike(_PIVOT)


def triads_in(s: Column) -> Column:
    return F.when(s.rlike(L.TRIAD_SIGN), F.regexp_extract_all(s, F.lit(_TRIAD), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _hedged(lower: Column) -> Column:
    return F.concat(F.lit(" "), lower).rlike(_HEDGE_SIGN) & (F.size(F.array_distinct(F.regexp_extract_all(lower, F.lit(_HEDGE), F.lit(0)))) >= 2)


def _opened(lower: Column) -> Column:
    return F.left(lower, F.lit(_OPENER_REACH)).rlike(_OPENER)


def is_hedge_stack(s: Column) -> Column:
    return _hedged(F.lower(s))


def is_cliche_opener(s: Column) -> Column:
    return _opened(F.lower(s))


def grade_of(score: Column) -> Column:
    out = F.when(score <= L.GRADES[0][1], L.GRADES[0][0])
    for grade, most in L.GRADES[1:]:
        out = out.when(score <= most, grade)
    return out.otherwise("F")


def _prepared(df: DataFrame, text: str, banned: tuple[str, ...], hollow: tuple[str, ...]) -> DataFrame:
    """Adds, for what follows, ``_over, _norm, _lower, _sentences, _lows``, ``_any`` and the sentences or parts of them that fire by rule."""
    fits = T.within_size(F.col(text))
    norm = df.withColumns({"_over": ~fits, "_norm": T.normalize_quotes(T.as_text(F.when(fits, F.col(text))))})
    split = norm.withColumns({"_lower": F.lower("_norm"), "_sentences": T.split_sentences(F.col("_norm"))})
    ss, low = F.col("_sentences"), lambda i: F.get(F.col("_lows"), i)
    fired = {"_triads": F.flatten(F.transform(ss, triads_in)), "_pivots": F.filter(ss, is_pivot), "_hedges": F.filter(ss, lambda s, i: _hedged(low(i))), "_openers": F.filter(ss, lambda s, i: _opened(low(i)))}
    split = split.withColumn("_lows", F.transform(ss, F.lower))
    return split.withColumns({"_any": any_phrase(F.col("_lower"), banned, hollow), **fired})


_PREPARED = ("_over", "_norm", "_lower", "_sentences", "_lows", "_any", "_triads", "_pivots", "_hedges", "_openers", "_phrases")


def measure(df: DataFrame, text: str = "text", banned: tuple[str, ...] = L.BANNED, hollow: tuple[str, ...] = L.HOLLOW, findings: bool = False) -> DataFrame:
    """Adds ``sentences`` (the list), counts by rule, ``n_words, n_sentences, n_lengths, sum_lengths, sum_squares, adverbs, dashes``
    and ``oversize``; with ``findings`` also those of :func:`with_findings`, from the same split.

    A null text is empty. A text over the size limit is flagged and counted as empty. The split is evaluated once. No word
    reaches over a sentence's end, so the words of the sentences are all words."""
    staged, zero = _prepared(df, text, banned, hollow), F.lit(0).cast("long")
    if findings:
        staged = staged.withColumn("_phrases", _phrase_finds(banned, hollow))

    def hits(rule: str, phrases: tuple[str, ...]) -> Column:
        if findings:
            return F.size(F.filter("_phrases", lambda f: f["rule"] == rule)).cast("long")
        return F.when(F.col("_any"), phrase_hits(F.col("_lower"), phrases)).otherwise(zero)

    dashed = reduce(or_, (F.col("_norm").contains(dash) for dash in L.DASHES.split("|")))
    staged = staged.withColumn("_lengths", F.filter(F.transform("_lows", lambda s: F.regexp_count(s, F.lit(L.STRAIGHT_WORD))), lambda n: n > 0))
    staged = staged.withColumns(
        {
            "oversize": F.col("_over"),
            "sentences": F.col("_sentences"),
            "n_sentences": F.size("_sentences").cast("long"),
            "n_lengths": F.size("_lengths").cast("long"),
            "sum_lengths": F.aggregate("_lengths", zero, lambda a, n: a + n),
            "sum_squares": F.aggregate("_lengths", zero, lambda a, n: a + n * n),
            "adverbs": F.when(F.col("_lower").rlike(L.ADVERB_SIGN), F.regexp_count("_lower", F.lit(L.ANY_ADVERB))).otherwise(F.regexp_count("_lower", F.lit(L.ADVERB))).cast("long"),
            "dashes": F.when(dashed, F.regexp_count("_norm", F.lit(L.DASHES))).otherwise(0).cast("long"),
            "banned": hits("banned-phrase", banned),
            "hollow": hits("hollow-confidence", hollow),
            **{c: F.size(f"_{c}").cast("long") for c in ("triads", "pivots", "hedges", "openers")},
        }
        | ({"findings": _all_finds(F.col("_phrases"))} if findings else {})
    )
    return staged.withColumn("n_words", F.col("sum_lengths")).drop(*_PREPARED, "_lengths")


def variation() -> Column:
    """Coefficient of variation of sentence lengths, from whole-number sums."""
    n, s, q = (F.col(c).cast("double") for c in ("n_lengths", "sum_lengths", "sum_squares"))
    return F.when((F.col("n_lengths") > 1) & (s > 0), F.sqrt(n * q - s * s) / s).otherwise(0.0)


def graded(measured: DataFrame) -> DataFrame:
    """Adds rates, points and ``score, grade`` to measured rows; ``total`` isn't clamped. Flagged texts have no score and no grade."""
    words, sentences = F.col("n_words"), F.col("n_sentences")
    per100 = lambda c: F.when(words > 0, F.col(c) * 100.0 / words).otherwise(0.0)
    rows = measured.withColumns(
        {
            "cv": variation(),
            "avg_length": F.when(F.col("n_lengths") > 0, F.col("sum_lengths").cast("double") / F.col("n_lengths")).otherwise(0.0),
            "adverb_rate": per100("adverbs"),
            "dash_rate": per100("dashes"),
            "triad_density": F.when(sentences > 0, F.col("triads").cast("double") / sentences).otherwise(0.0),
            "high": 6 * (F.col("banned") + F.col("pivots")),
            "med": 4 * F.col("hollow"),
            "low": 2 * (F.col("triads") + F.col("hedges") + F.col("openers")),
        }
    ).withColumn("uniform", (sentences >= 5) & (F.col("cv") < 0.4))
    over = lambda c, most, times: F.when(F.col(c) > most, T.rounded((F.col(c) - most) * times)).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumns(
        {
            "rhythm_points": F.when(F.col("uniform"), T.rounded((0.4 - F.col("cv")) * 60)).otherwise(F.lit(0).cast("long")),
            "adverb_points": over("adverb_rate", 5, 2),
            "dash_points": over("dash_rate", 2.5, 3),
            "triad_points": over("triad_density", 0.25, 40),
        }
    )
    parts = ("high", "med", "low", "rhythm_points", "adverb_points", "dash_points", "triad_points")
    total = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
    rows = rows.withColumn("total", total)
    rows = rows.withColumn("score", F.when(~F.col("oversize"), F.least(F.lit(100).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("total")))))
    return rows.withColumn("grade", F.when(~F.col("oversize"), grade_of(F.col("score"))))


def analyze(df: DataFrame, text: str = "text", banned: tuple[str, ...] = L.BANNED, hollow: tuple[str, ...] = L.HOLLOW) -> DataFrame:
    """``df`` with every metric, count, subtotal, ``score`` and ``grade``. One row a row; ``oversize`` flags texts over the size limit."""
    return graded(measure(df, text, banned, hollow))


def analyze_with_findings(df: DataFrame, text: str = "text", banned: tuple[str, ...] = L.BANNED, hollow: tuple[str, ...] = L.HOLLOW) -> DataFrame:
    """:func:`analyze` and :func:`with_findings` of one split; each text is read once for both."""
    return graded(measure(df, text, banned, hollow, findings=True))


def rejected(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is over the size limit."""
    return df.where(~T.within_size(F.col(text)))


def result_json() -> Column:
    """A scored row with findings as JSON: score, grade, breakdown, metrics as they are shown, findings."""
    shown = lambda c, digits: T.rounded(F.col(c), digits)
    lexical = F.struct("high", "med", "low", (F.col("high") + F.col("med") + F.col("low")).alias("total"))
    points = {"uniformRhythm": "rhythm_points", "adverbs": "adverb_points", "emDashes": "dash_points", "triads": "triad_points"}
    structural = F.struct(*[F.col(c).cast("long").alias(k) for k, c in points.items()], sum((F.col(c) for c in points.values()), F.lit(0)).cast("long").alias("total"))
    metrics = F.struct(
        F.col("n_words").alias("words"), F.col("n_sentences").alias("sentences"), shown("avg_length", 1).alias("avgSentenceLength"),
        shown("cv", 2).alias("sentenceLengthCV"), F.col("uniform").alias("uniformRhythm"), shown("adverb_rate", 1).alias("adverbRate"),
        shown("dash_rate", 1).alias("emDashRate"), shown("triad_density", 2).alias("triadDensity"),
    )
    found = F.transform("findings", lambda f: F.struct(f["rule"].alias("rule"), f["severity"].alias("severity"), f["snippet"].alias("snippet"), f["start"].alias("start"), f["stop"].alias("end")))
    breakdown = F.struct(lexical.alias("lexical"), structural.alias("structural"), F.col("total").cast("long").alias("total"))
    return F.to_json(F.struct("score", "grade", breakdown.alias("breakdown"), metrics.alias("metrics"), found.alias("findings")))


def _phrase_findings(norm: Column, low: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    """``(rule, severity, snippet, start, stop)`` of every hit, by list, phrase and place; offsets count code points from 0."""
    table = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in (("p", p), ("at", L.bounded((p,))), ("rule", rule), ("severity", L.SEVERITY[rule]))]) for rule, own in lists.items() for p in own])

    def hits(x: Column) -> Column:
        width = F.char_length(x["p"])
        parts = F.split(low, x["at"])
        ends = F.aggregate(
            F.slice(parts, F.lit(1), F.size(parts) - 1),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, p: F.struct((a["at"] + F.char_length(p) + width).alias("at"), F.concat(a["out"], F.array(a["at"] + F.char_length(p))).alias("out")),
        )["out"]
        found = lambda at: F.struct(x["rule"].alias("rule"), x["severity"].alias("severity"), F.substr(norm, at + 1, width).alias("snippet"), at.alias("start"), (at + width).alias("stop"))
        return F.transform(ends, found)

    return F.flatten(F.transform(F.filter(table, lambda x: low.contains(x["p"])), hits))


_FINDINGS = "array<struct<rule:string,severity:string,snippet:string,start:int,stop:int>>"


def _finding(rule: str, snippet: Column) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(F.lit(rule).alias("rule"), F.lit(L.SEVERITY[rule]).alias("severity"), snippet.alias("snippet"), none.alias("start"), none.alias("stop"))


def _phrase_finds(banned: tuple[str, ...], hollow: tuple[str, ...]) -> Column:
    """Findings of phrases in prepared rows; one look for any phrase spares most texts the look for each."""
    phrases = _phrase_findings(F.col("_norm"), F.col("_lower"), {"banned-phrase": banned, "hollow-confidence": hollow}) if banned or hollow else F.array()
    return F.when(F.col("_any"), phrases.cast(_FINDINGS)).otherwise(F.array().cast(_FINDINGS))


def _all_finds(phrases: Column) -> Column:
    """All findings of prepared rows, in order of rule, then list, then place."""
    first = lambda column, rule, most: F.transform(column, lambda s: _finding(rule, F.left(s, F.lit(most))))
    parts = [
        phrases,
        F.transform("_triads", lambda s: _finding("triad", s)),
        first("_pivots", "negation-pivot", 80),
        first("_hedges", "hedge-stack", 80),
        first("_openers", "cliche-opener", 50),
    ]
    return F.concat(*[p.cast(_FINDINGS) for p in parts])


def with_findings(df: DataFrame, text: str = "text", banned: tuple[str, ...] = L.BANNED, hollow: tuple[str, ...] = L.HOLLOW) -> DataFrame:
    """Adds ``findings``, in order of rule, then list, then place; only phrases have offsets. A text over the size limit has none."""
    return _prepared(df, text, banned, hollow).withColumn("findings", _all_finds(_phrase_finds(banned, hollow))).drop(*_PREPARED)
