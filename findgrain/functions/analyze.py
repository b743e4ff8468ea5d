"""Analysis of text into terms: index terms, query words, spans."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from findgrain.functions import phonetic, stem
from findgrain.functions.text import nfc

# Words that are not indexed.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "should", "could", "may", "might", "must", "can", "this",
    "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
]

SEPARATORS = r"[\s\p{IsWhite_Space}!-/:-@\[-`{-~]+"
NOT_ALPHANUMERIC = r"[^\p{IsAlphabetic}\p{N}]+"


def split_camel(c: Column) -> Column:
    """A blank between a small letter and the capital after it."""
    return F.regexp_replace(c, r"(\p{javaLowerCase})(?=\p{javaUpperCase})", "$1 ")


def index_terms(text: Column, stop: bool = True) -> Column:
    """Unstemmed index terms in order. Null text has no terms."""
    words = F.split(F.lower(split_camel(nfc(F.coalesce(text, F.lit(""))))), SEPARATORS)
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS)) if stop else F.filter(words, lambda w: w != "")


def query_words(text: Column) -> Column:
    """Lower-case alphanumeric runs split at inner capitals; neither stop words nor stems."""
    words = F.split(F.lower(split_camel(F.coalesce(text, F.lit("")))), NOT_ALPHANUMERIC)
    return F.filter(words, lambda w: w != "")


@F.pandas_udf(StringType())
def stemmed(terms: pd.Series) -> pd.Series:
    """Stems, once per distinct term of a batch."""
    return terms.map({t: stem.stem(t) for t in terms.dropna().unique()})


@F.pandas_udf(StringType())
def stemmed_all(texts: pd.Series) -> pd.Series:
    """Stems of words divided by single blanks."""
    return texts.map(lambda t: t if t is None else " ".join(stem.stem(w) for w in t.split(" ")))


@F.pandas_udf(StringType())
def sound(terms: pd.Series) -> pd.Series:
    return terms.map({t: phonetic.phonetic_code(t) for t in terms.dropna().unique()})


_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
_SEPARATE = re.compile(r"[\s!-/:-@\[-`{-~]+")


def spans(text: str) -> list[tuple[int, int]]:
    """Alphanumeric runs of a text as offsets."""
    return [m.span() for m in _WORD.finditer(text)]


def terms_of(text: str, stems: bool = True) -> list[str]:
    """Index terms of a short string on the driver or in a UDF."""
    out = []
    for word in _SEPARATE.split(text):
        for part in _CAMEL.split(word):
            low = part.lower()
            if low and low not in _STOPPED:
                out.append(stem.stem(low) if stems else low)
    return out


_STOPPED = frozenset(STOP_WORDS)
