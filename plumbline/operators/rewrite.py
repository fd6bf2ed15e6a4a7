"""Mechanical rewriting of stock phrases; Column expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import lexicon as L
from plumbline.functions import text as T
from plumbline.plans.score import COUNTS, analyze, any_phrase

_QUOTE = "['‘’‛ʼ]"
_EDGE = f"[A-Za-z{_QUOTE[1:]}"
#: Stands between parts in :func:`tidy`; a text that holds it already is cut there too.
_CUT = "\x01\x02"
#: The only letters beyond ASCII of which the lower case begins with one of a-z; they bound a phrase in a text, but not in its lower case.
_UNLIKE = ("\u0130", "\u212a")


def _pattern(fixes: dict[str, str]) -> str:
    """One expression of all phrases; deleted ones take the comma or ``that`` behind them along. No two of the default ones overlap."""
    spell = lambda p: re.escape(p).replace(r"\ ", " ").replace(r"\-", "-").replace("'", _QUOTE)
    by_length = sorted(fixes, key=lambda p: (-len(p), p))
    gone = "|".join(spell(p) for p in by_length if not fixes[p])
    swapped = "|".join(spell(p) for p in by_length if fixes[p])
    tail = f"{L.WS}*,?{L.WS}*(?:that{L.WS}+)?"
    either = [f"(?:{gone})(?!{_EDGE}){tail}"] * bool(gone) + [f"(?:{swapped})(?!{_EDGE})"] * bool(swapped)
    return f"(?i)(?<!{_EDGE})(?:{'|'.join(either)})"


def fixed_phrases(c: Column, fixes: dict[str, str] | None = None, some: Column | None = None) -> Column:
    """``(text, applied)``: phrases replaced, keeping a capital at their start, and how many were.

    The text is cut around the hits once, and each hit is looked up; so the work doesn't grow with the table of fixes. One look
    for how the phrases begin spares most texts that, or ``some``, if it is known where no phrase of the table stands."""
    fixes = L.FIXES if fixes is None else fixes
    if not fixes:
        return F.struct(c.alias("text"), F.lit(0).cast("long").alias("applied"))
    table = F.create_map(*[F.lit(x) for p, new in fixes.items() if new for x in (p, new)]) if any(fixes.values()) else F.create_map(F.lit(""), F.lit(""))

    def new_words(hit: Column) -> Column:
        new = F.coalesce(F.try_element_at(table, F.lower(T.normalize_quotes(hit))), F.lit(""))
        return F.when(hit.rlike("^[A-Z]"), F.concat(F.upper(F.left(new, F.lit(1))), F.substr(new, F.lit(2)))).otherwise(new)

    def rewritten(text: Column, hits: Column) -> Column:
        joined = F.array_join(F.zip_with(F.split(text, _pattern(fixes)), hits, lambda part, hit: F.concat(part, F.coalesce(new_words(hit), F.lit("")))), "")
        return F.struct(F.when(F.size(hits) > 0, joined).otherwise(text).alias("text"), F.size(hits).cast("long").alias("applied"))

    plain = tuple(p.lower().translate(str.maketrans("‘’‛ʼ“”", "''''\"\"")) for p in fixes)
    begun = lambda text: any_phrase(F.lower(T.normalize_quotes(text)), plain) if some is None else some
    found = lambda text: T.let(F.regexp_extract_all(text, F.lit(_pattern(fixes)), F.lit(0)), lambda hits: rewritten(text, hits))
    return T.let(c, lambda text: F.when(begun(text) | text.contains(_UNLIKE[0]) | text.contains(_UNLIKE[1]), found(text)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("applied"))))


def swap_phrases(c: Column, fixes: dict[str, str] | None = None) -> Column:
    """The text of :func:`fixed_phrases`."""
    return fixed_phrases(c, fixes)["text"]


def tidy(c: Column) -> Column:
    """Blanks collapsed, none before punctuation, nothing but text at the start, capitals after sentence ends, however far."""
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]{2,}", " "), "[ \t]+([,.;:!?])", "$1")
    c = T.let(c, lambda t: F.when(F.left(t, F.lit(1)).rlike(f"{L.WS}|[,;]"), F.regexp_replace(t, f"^(?:{L.WS}|[,;])+", "")).otherwise(t))
    capital = lambda p: F.when(F.left(p, F.lit(1)).rlike("^[a-z]"), F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))).otherwise(p)
    cut = F.regexp_replace(c, f"([.!?]{L.WS}+)(?=[a-z])", f"$1{_CUT}")
    return T.let(cut, lambda t: F.when(t.contains(_CUT), F.array_join(F.transform(F.split(t, _CUT), capital), "")).otherwise(capital(t)))


def apply_fixes(c: Column, fixes: dict[str, str] | None = None) -> Column:
    """The rewritten text; a null text is empty."""
    return tidy(swap_phrases(T.as_text(c), fixes))


def fix_report(scored: DataFrame, text: str = "text", fixes: dict[str, str] | None = None, counted: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``fixed``, ``applied`` and ``skipped``, the findings that are left to a person, to scored rows.

    ``counted`` are the phrases that the rows' ``banned`` and ``hollow`` count. If every fix is among them, a text without any
    of them is known to need none."""
    found = sum((F.col(c) for c in COUNTS.values()), F.lit(0))
    some = F.col("banned") + F.col("hollow") > 0 if set(L.FIXES if fixes is None else fixes) <= set(counted) else None
    done = scored.withColumn("_fix", fixed_phrases(T.as_text(F.when(~F.col("oversize"), F.col(text))), fixes, some))
    return done.withColumns({"fixed": tidy(F.col("_fix.text")), "applied": F.col("_fix.applied"), "skipped": found - F.col("_fix.applied")}).drop("_fix")


def rescored(report: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``before`` and ``after``, the scores of the text and of ``fixed``, to the rows of :func:`fix_report`. A text that is left
    as it was has the score that it had, and isn't measured again."""
    same = F.col("_same")
    kept = report.withColumns({"_same": F.coalesce(F.col("fixed") == F.col(text), F.lit(False)), "before": F.col("score")})
    again = analyze(kept.withColumn("_again", F.when(~same, F.col("fixed"))), "_again")
    return again.withColumn("after", F.when(same, F.col("before")).otherwise(F.col("score"))).drop("_same", "_again")
