"""Highlighted excerpts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from findgrain.functions import analyze
from findgrain.operators.requests import parse_request
from findgrain.sources.files import content_kind

MARK, UNMARK = "\x01", "\x02"
WIDTH, LEAD = 140, 40


def _matcher(query: str):
    """A word matches if it is a query word, begins with one of three letters or more, or shares a stem with one."""
    words = [w.lower() for a, b in analyze.spans(query) for w in analyze._CAMEL.split(query[a:b])]
    long = tuple(w for w in words if len(w) >= 3)
    stems = set(analyze.terms_of(query))

    def match(word: str) -> bool:
        low = word.lower()
        return low in words or bool(long) and low.startswith(long) or not stems.isdisjoint(analyze.terms_of(low))

    return match


def make_snippet(text: str | None, query: str | None) -> str | None:
    """The first line with a match, cut to a window around it, matches marked, blanks made single; None without a match."""
    cleaned = " ".join(t for t in (query or "").split() if ":" not in t and not t.startswith("-"))
    if not text or not cleaned:
        return None
    match = _matcher(cleaned)
    first = next((a for a, b in analyze.spans(text) if match(text[a:b])), None)
    if first is None:
        return None
    line = text.rfind("\n", 0, first) + 1
    stop = text.find("\n", first)
    stop = len(text) if stop < 0 else stop
    start = max(line, first - LEAD - 1)
    if start > line:
        # not in the middle of a word
        blank = next((i for i in range(start, first) if text[i].isspace()), None)
        start = start if blank is None else blank + 1
    end = min(stop, start + WIDTH)
    window, out, at = text[start:end], [], 0
    for a, b in analyze.spans(window):
        if match(window[a:b]):
            out += [window[at:a], MARK, window[a:b], UNMARK]
            at = b
    body = ("…" if start > line else "") + "".join(out) + window[at:] + ("…" if end < stop else "")
    plain = "".join(c if c in (MARK, UNMARK) or c.isprintable() and not c.isspace() else " " for c in body)
    return " ".join(plain.split())


@F.pandas_udf(StringType())
def snippet(text: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([make_snippet(t, q) for t, q in zip(text, query)], dtype="object")


def snippets(hits: DataFrame, contents: DataFrame, queries: DataFrame, shown: int = 20) -> DataFrame:
    """``(query_id, doc_id, snippet)`` for the first ``shown`` hits per query whose type has readable content."""
    rows = hits.where(F.col("rank") <= shown).join(contents.select("doc_id", "content"), "doc_id").join(queries.select("query_id", "query"), "query_id")
    rows = rows.where(content_kind(F.col("path")) != "unsupported")
    return rows.select("query_id", "doc_id", snippet("content", "query").alias("snippet"))


def plain_text(marked: Column) -> Column:
    return F.regexp_replace(marked, "[\x01\x02]", "")


def as_html(marked: Column) -> Column:
    return F.replace(F.replace(marked, F.lit(MARK), F.lit("<b>")), F.lit(UNMARK), F.lit("</b>"))


def searchable_text(query: str) -> str:
    return parse_request(query).text
