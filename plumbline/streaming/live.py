"""Scores of a stream of edits: each key's last text of a burst, once the burst is over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.score import analyze


def debounced(edits: DataFrame, key: str = "doc_id", ts: str = "ts", text: str = "text", gap: str = "350 milliseconds", late: str = "10 seconds") -> DataFrame:
    """``key, window, text`` from a stream (or table) of edits: a burst ends after ``gap`` without an edit; state goes ``late`` after."""
    marked = edits.withWatermark(ts, late) if edits.isStreaming else edits
    return marked.groupBy(key, F.session_window(ts, gap).alias("window")).agg(F.max_by(text, ts).alias(text))


def scored_stream(edits: DataFrame, key: str = "doc_id", ts: str = "ts", text: str = "text", gap: str = "350 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The debounced edits with their score; scoring itself keeps no state."""
    return analyze(debounced(edits, key, ts, text, gap, late), text).select(key, "window", "score", "grade")
