"""License scans by ordered signature rules, in DataFrame functions only, row by row without a shuffle.

The words of a text are taken once. Where a signature's keyword stands before a word that can follow one, a window of the
next words is cut, and the signatures of that keyword whose literal beginning is there are tried at its start. A detection inside a longer or equal one of at least its rank is
suppressed. Windows are short, so a detection's possible holders stand within a bounded stretch of the sorted list.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import text_of
from plumbline.llm.license_rules import SPAN, Signature, signatures

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Phrases of the base scan and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Letters whose lower case holds a letter of a-z though they aren't ASCII.
_ODD = ("K", "İ")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text after A-Z, and no other letter that would matter, are lower-cased."""
    odd = reduce(lambda a, b: a | b, [text.contains(x) for x in _ODD])
    return F.regexp_extract_all(F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text)), F.lit(WORD), F.lit(0))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", rules: list[Signature] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """The ``keep`` columns with

    ``n_words``; ``base``, the places of the base phrases as ``(start, label)``; ``found``, the detections that stand as
    ``(start, stop, label, rank, weight)`` in words from 0, by start; ``suppressed``, how many gave way. A null text is empty;
    an empty one has no words and no detections. Base places are never suppressed. An empty table gives no rows. Kept columns
    named as one of these four are replaced, and names that begin with an underscore are reserved."""
    keep = tuple(c for c in keep if c not in ("n_words", "base", "found", "suppressed"))
    rules, base = rules or signatures(), base or BASE
    keywords = sorted({r.keyword for r in rules} | {p.split(" ")[0] for p in base})
    alone = sorted({r.keyword for r in rules if r.second is None} | {p for p in base if " " not in p})
    seconds = sorted({r.second for r in rules if r.second} | {p.split(" ")[1] for p in base if " " in p})
    rows = docs.select(*keep, words_of(text_of(text)).alias("_words"))
    begins = lambda w, i: w.isin(keywords) & (w.isin(alone) | F.coalesce(F.get("_words", i + 1).isin(seconds), F.lit(False)))
    places = F.filter(F.transform(F.col("_words"), lambda w, i: F.when(begins(w, i), i)), lambda i: i.isNotNull())
    gated = F.arrays_overlap(F.col("_words"), F.array(*map(F.lit, keywords)))
    rows = rows.withColumn("_places", F.when(gated, places).otherwise(F.array().cast("array<int>")))
    window = lambda i: F.struct(i.alias("i"), F.get("_words", i).alias("w"), F.array_join(F.slice("_words", i + 1, SPAN), " ").alias("s"))
    rows = rows.withColumn("_windows", F.transform("_places", window))
    groups = _by_keyword(rules)

    def hits(x: Column) -> Column:
        """Detections that begin with a window; of those, only the ones that no other from the same start suppresses."""
        tried = F.filter(groups[x["w"]], lambda r: F.startswith(x["s"], r["head"]) & F.rlike(x["s"], r["pattern"]))
        found = F.transform(
            tried,
            lambda r: F.struct(
                x["i"].alias("start"),
                (x["i"] + F.size(F.split(F.regexp_substr(x["s"], r["pattern"]), " "))).alias("stop"),
                r["label"].alias("label"), r["rank"].alias("rank"), r["weight"].alias("weight"),
            ),
        )
        return _let(F.array_distinct(found), lambda own: F.struct(F.filter(own, lambda d: ~F.exists(own, lambda e: _over(e, d))).alias("stand"), F.size(own).alias("n")))

    rows = rows.select(*keep, F.size("_words").alias("_n"), "_windows", F.transform("_windows", hits).alias("_hits"))
    # Those that stand at one start differ in length, so at most SPAN of them: holders are within SPAN * SPAN places.
    reach = SPAN * SPAN

    def resolved(every: Column) -> Column:
        near = lambda i: F.slice(every, F.greatest(F.lit(1), i + 1 - reach), F.lit(2 * reach))
        return F.filter(every, lambda d, i: ~F.exists(near(i), lambda e: _over(e, d)))

    standing = _let(F.flatten(F.transform("_hits", lambda h: h["stand"])), resolved)
    seen = F.aggregate("_hits", F.lit(0), lambda n, h: n + h["n"])
    plain = F.flatten(F.array(*[_places(phrase, label) for phrase, label in base.items()]))
    done = rows.select(*keep, F.col("_n").cast("long").alias("n_words"), plain.alias("base"), standing.alias("found"), seen.alias("_seen"))
    return done.select(*keep, "n_words", "base", "found", (F.col("_seen") - F.size("found")).alias("suppressed"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once for all its uses there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _over(e: Column, d: Column) -> Column:
    """Whether detection e suppresses d: it holds d, and is longer with at least its rank, or as long with a higher one, or as
    long, of the same rank and of a lesser label."""
    longer = (e["stop"] - e["start"]) > (d["stop"] - d["start"])
    holds = (e["start"] <= d["start"]) & (e["stop"] >= d["stop"])
    above = (e["rank"] > d["rank"]) | ((e["rank"] == d["rank"]) & (e["label"] < d["label"]))
    return holds & ((longer & (e["rank"] >= d["rank"])) | (~longer & above))


def _places(phrase: str, label: str) -> Column:
    """Places of the windows that begin with a phrase."""
    begun = F.filter("_windows", lambda x: F.concat(x["s"], F.lit(" ")).startswith(f"{phrase} "))
    return F.transform(begun, lambda x: F.struct(x["i"].alias("start"), F.lit(label).alias("label")))


def _by_keyword(rules: list[Signature]) -> Column:
    """The rules of each keyword, as one literal that is parsed when the query is optimised."""
    table: dict[str, list[dict]] = {}
    for r in rules:
        table.setdefault(r.keyword, []).append({"head": r.head, "pattern": r.pattern, "label": r.label, "rank": r.rank, "weight": r.weight})
    return F.from_json(F.lit(json.dumps(table)), "map<string, array<struct<head:string, pattern:string, label:string, rank:int, weight:int>>>")


def summarised(scanned: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of :func:`scan`: counts, first and last base places, labels and a score, the surest detection's weight."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    base, own = F.transform("base", lambda b: b["label"]), F.transform("found", lambda d: d["label"])
    surest = F.coalesce(F.array_max(F.transform("found", lambda d: d["weight"])), F.lit(0)) / 100
    return scanned.select(
        *keep, "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("base") > 0, F.greatest(F.lit(0.7), surest)).otherwise(surest).cast("double").alias("score"),
    )
