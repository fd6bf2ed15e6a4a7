"""Text as Column expressions: normalise, split, clean. None of them shuffles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import lexicon as L

_END = "\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once for all its uses there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_quotes(c: Column) -> Column:
    """Curly quotes to straight ones, one character for one. A text of ASCII alone is left as it is."""

    def straight(t: Column) -> Column:
        out = t
        for curly, plain in zip("‘’‛ʼ“”", "''''\"\"", strict=True):
            out = F.replace(out, F.lit(curly), F.lit(plain))
        return F.when(F.octet_length(t) == F.char_length(t), t).otherwise(out)

    return let(c, straight)


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^{L.WS}+|{L.WS}+\\z", "")


def collapse_space(c: Column) -> Column:
    narrow = let(c, lambda t: F.when(F.octet_length(t) == F.char_length(t), t).otherwise(F.regexp_replace(t, L.WIDE_SPACE, " ")))
    return F.btrim(F.regexp_replace(narrow, L.UNEVEN_SPACE, " "))


def words(c: Column) -> Column:
    """Lower-case words of ASCII letters, apostrophes and hyphens."""
    return F.regexp_extract_all(F.lower(c), F.lit(L.WORD), F.lit(0))


#: A blank behind closing punctuation and at most one closer: only there can a sentence end.
_CANDIDATE = r""" (?<=[.!?…] |[.!?…]["')\]] )"""


def _abbreviated(lower: Column, abbreviations: tuple[str, ...]) -> Column:
    """Whether what stands before a lower-case token's closing marks is an abbreviation."""
    known = [re.escape(a) for a in abbreviations if re.fullmatch("[a-z.]*[a-z]", a)]
    return lower.rlike(rf"""(?<![a-z.])(?:{"|".join(known)})[.!?"')\]]*\z""") if known else F.lit(False)


def ends_sentence(token: Column, following: Column, abbreviations: tuple[str, ...] = L.ABBREVIATIONS) -> Column:
    """Whether a closed token ends a sentence: it is no abbreviation, and, if a dotted initialism, only before a capital."""
    lower = F.lower(token)
    initialism = lower.rlike(r"""^[a-z](?:\.[a-z])*\.?["')\]]*\z""")
    capital = F.coalesce(following, F.lit("")).rlike(r"""^["'(\[]*[A-Z]""")
    return ~_abbreviated(lower, abbreviations) & (~initialism | capital)


def split_sentences(c: Column, abbreviations: tuple[str, ...] = L.ABBREVIATIONS) -> Column:
    """Trimmed sentences in order; an empty or null text has none.

    The text is cut at every place where a sentence may end; only the tokens there are looked at."""
    clean = collapse_space(F.replace(as_text(c), F.lit(_END), F.lit(" ")))
    mark = lambda t, following: F.when(ends_sentence(F.substring_index(t, " ", -1), following, abbreviations), _END).otherwise(" ")
    marked = let(F.split(clean, _CANDIDATE), lambda ts: F.array_join(F.transform(ts, lambda t, i: F.concat(t, mark(t, F.get(ts, i + 1)))), ""))
    return F.filter(F.transform(F.split(marked, _END), lambda s: F.btrim(s)), lambda s: s != "")


def strip_markdown(c: Column) -> Column:
    """Prose lines: fenced blocks and lines that begin with ``>``, ``|``, ``#`` or ``<`` go, and so do inline tags.

    A fence closes on the marker that opened it; one left open takes the rest."""
    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        bare = trim_space(line)
        marker = F.when(bare.startswith("```"), "```").when(bare.startswith("~~~"), "~~~").otherwise("")
        fence = F.when(marker == "", acc["fence"]).when(acc["fence"] == "", marker).when(acc["fence"] == marker, "").otherwise(acc["fence"])
        dropped = (marker != "") | (acc["fence"] != "") | bare.rlike("^[>|#<]")
        out = F.when(dropped, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.regexp_replace(line, "<[^>]+>", ""))))
        return F.struct(fence.alias("fence"), out.alias("out"))

    return F.array_join(F.aggregate(F.split(as_text(c), "\n"), start, step)["out"], "\n")


def code_point(n: Column) -> Column:
    """The character of a code point; nothing beyond the last or among surrogates."""
    return F.when((n >= 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("")


def _decoded(text: Column, pattern: str, prefix: str, base: int) -> Column:
    """Each reference that matches ``pattern`` as its character; what a reference gives is not looked at again."""

    def character(ref: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(ref, prefix, ""), ";", "")
        number = F.conv(digits, base, 10).cast("long") if base != 10 else digits.cast("long")
        return F.when(F.char_length(digits) <= 8, F.coalesce(code_point(F.when(digits == "", F.lit(0).cast("long")).otherwise(number)), F.lit(""))).otherwise("")

    parts, refs = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.array_join(F.zip_with(parts, F.transform(refs, character), lambda part, c: F.concat(part, F.coalesce(c, F.lit("")))), "")
    return F.when(text.contains("&#"), joined).otherwise(text)


def decode_numeric(c: Column) -> Column:
    """Decimal, then hexadecimal character references, each pass over its text once; surrogates and numbers beyond the last
    code point give nothing."""
    return let(let(c, lambda t: _decoded(t, "&#[0-9]+;", "^&#0*", 10)), lambda t: _decoded(t, "(?i)&#x[0-9a-f]+;", "^&#[xX]0*", 16))


def strip_html(c: Column) -> Column:
    """Visible text: no comments, scripts or styles; block ends are line breaks; named, then numeric references decoded."""
    s = as_text(c)
    for pattern, new in ((L.HTML_COMMENT, " "), (L.HTML_HIDDEN, " "), (L.HTML_BLOCK_END, "\n"), (L.HTML_BREAK, "\n"), (L.HTML_TAG, " ")):
        s = F.regexp_replace(s, pattern, new)
    for name, value in L.ENTITIES.items():
        s = F.replace(s, F.lit(name), F.lit(value))
    s = decode_numeric(s)
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[ \t]+", " "), " *\n *", "\n"), "\n{3,}", "\n\n")
    return trim_space(s)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def visible_length(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, f"{L.WS}+", ""))


def looks_readable(c: Column) -> Column:
    """At least 30 words of letters, of which more than 12 % are function words."""
    return let(
        F.regexp_extract_all(F.lower(as_text(c)), F.lit("[a-z]+"), F.lit(0)),
        lambda ws: (F.size(ws) >= 30) & (F.size(F.filter(ws, lambda w: w.isin(*L.FUNCTION_WORDS))) > F.size(ws) * 0.12),
    )


def within_size(c: Column) -> Column:
    return F.octet_length(as_text(c)) <= L.MAX_INPUT_BYTES


def rounded(c: Column, digits: int = 0) -> Column:
    """Half up on the binary value, the same in any engine."""
    scale = 10**digits
    return F.floor(c * scale + 0.5).cast("double") / scale if digits else F.floor(c + 0.5)


def base64url(c: Column) -> Column:
    return F.rtrim(F.translate(F.replace(F.base64(c), F.lit("\r\n"), F.lit("")), "+/", "-_"), F.lit("="))


def number_text(c: Column, digits: int) -> Column:
    """A number rounded to ``digits`` places as it is shown: without zeros at its end."""
    whole = rounded(c, digits)
    return F.regexp_replace(F.format_string(f"%.{digits}f", whole), r"\.?0+\z", "") if digits else F.format_string("%.0f", whole.cast("double"))


def page_words(c: Column) -> Column:
    """Words of a page, parted by white space."""
    blanks = lambda t: F.char_length(t) - F.char_length(F.replace(t, F.lit(" "), F.lit("")))
    return let(collapse_space(as_text(c)), lambda t: F.when(t == "", 0).otherwise(blanks(t) + 1)).cast("long")
