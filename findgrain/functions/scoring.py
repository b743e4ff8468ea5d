"""Scores: term relevance, names, places, age, clicks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findgrain.functions import analyze, paths

# Fixed values of the ranking.
K1, B = 1.2, 0.75
FIELD_NAME, FIELD_PATH, FIELD_CONTENT = 1, 2, 4
INDEX_WEIGHT = 20.0
CLICK_WEIGHT = 40.0
PROXIMITY = 1.5
FALLBACK_BELOW, FALLBACK_LIMIT, FALLBACK_SHARE, TRIGRAM_LEAST = 5, 20, 0.5, 0.5
RESULT_LIMIT = 100
DAY_NS = 86_400_000_000_000


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((F.greatest(n_docs - df, F.lit(0)) + 0.5) / (df + 0.5) + 1)


def bm25(tf: Column, doc_len: Column, avg_len: Column, weight: Column) -> Column:
    """``weight`` is the idf. Lengths below 1 count as 1."""
    norm = 1 - B + B * F.greatest(doc_len, F.lit(1)) / F.greatest(avg_len, F.lit(1.0))
    return weight * tf * (K1 + 1) / (tf + K1 * norm)


def field_boost(field: Column) -> Column:
    return F.when(field.bitwiseAND(FIELD_NAME) != 0, 3.0).when(field.bitwiseAND(FIELD_PATH) != 0, 1.5).otherwise(1.0)


def expansion_weight(distance: Column) -> Column:
    """Weight of a term that was not typed; null distance is a match by sound."""
    return F.when(distance <= 1, 0.6).when(distance == 2, 0.25).otherwise(0.15)


def fuzzy_radius(token: Column) -> Column:
    return F.when(F.length(token) >= 5, 2).otherwise(1)


def recency_boost(mtime_ns: Column, now_ns: Column | int) -> Column:
    """By whole days since the last change; a time ahead of ``now_ns`` is no days ago, a null one brings nothing."""
    now = F.lit(now_ns) if isinstance(now_ns, int) else now_ns
    days = F.floor(F.greatest(now - mtime_ns, F.lit(0)) / F.lit(DAY_NS))
    return F.when(days <= 1, 8.0).when(days <= 7, 5.0).when(days <= 30, 2.0).otherwise(0.0)


def location_boost(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.contains("/downloads/"), 35.0).when(p.contains("/documents/"), 30.0).when(p.contains("/desktop/"), 25.0).otherwise(0.0)


def click_boost(clicks: Column) -> Column:
    return CLICK_WEIGHT * F.log1p(F.coalesce(clicks, F.lit(0)))


def path_bonus(path: Column, words: Column) -> Column:
    """0.2 per query word the path contains, and with several words and hits the share of words hit."""
    p, n = F.lower(path), F.size(words)
    hits = F.size(F.filter(words, lambda w: p.contains(w)))
    # through an array of one, so that the words are looked for once
    bonus = F.transform(F.array(hits), lambda h: 0.2 * h + F.when((n > 1) & (h > 1), h / n).otherwise(0.0))
    return F.get(bonus, F.lit(0))


def with_path_bonus(rows: DataFrame, words: str = "words", path: str = "path", name: str = "bonus", longest: int = 1 << 30) -> DataFrame:
    """``path_bonus`` as a column, in steps of which each is computed once. With few words at most (``longest``) it is compiled whole."""
    p, n, h = F.col("b_path"), F.size(words), F.col("b_hits")
    out = rows.withColumn("b_path", F.lower(path))
    if longest <= 8:
        hits = F.lit(0)
        for i in range(longest):
            hits = hits + F.coalesce(p.contains(F.get(words, F.lit(i))).cast("int"), F.lit(0))
    else:
        hits = F.size(F.filter(words, lambda w: p.contains(w)))
    out = out.withColumn("b_hits", hits)
    return out.withColumn(name, 0.2 * h + F.when((n > 1) & (h > 1), h / n).otherwise(0.0)).drop("b_path", "b_hits")


@dataclass(frozen=True)
class NameParts:
    """What scoring by name needs of a path: computed once per file where many queries meet it."""

    name: Column
    stem: Column
    path: Column
    stem_words: Column
    location: Column

    @classmethod
    def of(cls, path: Column) -> NameParts:
        name = paths.file_name(path)
        stem = paths.stem(name)
        return cls(F.lower(name), F.lower(stem), F.lower(path), analyze.query_words(stem), location_boost(path))

    @classmethod
    def named(cls, prefix: str = "n_") -> NameParts:
        return cls(*[F.col(prefix + f) for f in cls.__dataclass_fields__])

    def columns(self, prefix: str = "n_") -> list[Column]:
        return [getattr(self, f).alias(prefix + f) for f in self.__dataclass_fields__]


def with_name_score(rows: DataFrame, query: str = "q", words: str = "words", path: str = "path", name: str = "name") -> DataFrame:
    """Adds how well a file name answers a query: layers for the whole phrase, for each word, for all words and their order.

    ``query`` is lower-case, ``words`` are its query words. 0 where nothing fits; above 0 the location boost is added. In steps, of
    which each is computed once. A filter on the score would move below it and compute it twice: better to go on with nulls.
    """
    f, q, n = NameParts.named(), F.col(query), F.size(words)
    each, at = F.col("s_each"), F.col("s_at")

    def points(w: Column) -> Column:
        return (
            F.when(F.array_contains(f.stem_words, w), 50.0)
            .when(f.stem.startswith(w), 35.0)
            .when(f.stem.contains(w) | f.name.contains(w), 22.0)
            .when(f.path.contains(w), 6.0)
            .otherwise(0.0)
        )

    out = rows.select("*", *NameParts.of(F.col(path)).columns())
    out = out.withColumn("s_each", F.transform(words, points)).withColumn("s_at", F.transform(words, lambda w: F.position(w, f.name)))
    whole = F.when((f.name == q) | (f.stem == q), 250.0).when(F.array_contains(f.stem_words, q), 180.0).otherwise(0.0)
    prefix = F.when(f.name.startswith(q) | f.stem.startswith(q), 160.0).otherwise(0.0)
    inside = F.when(f.name.contains(q) | f.stem.contains(q) | (q.contains("/") & f.path.contains(q)), 110.0).otherwise(0.0)
    some = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    every = F.when((n > 0) & (F.array_min(each) >= 22.0), 80.0).otherwise(0.0)
    ordered = F.when((n > 1) & (F.array_min(at) > 0) & (F.sort_array(at) == at), 50.0).otherwise(0.0)
    out = out.withColumn("s_sum", whole + prefix + inside + some + every + ordered)
    wrong_extension = q.contains(".") & ~f.name.contains(q) & ~f.path.contains(q)
    score = F.when(wrong_extension | (F.col("s_sum") <= 0), 0.0).otherwise(F.col("s_sum") + f.location)
    return out.select(*rows.columns, score.alias(name))


def name_gate(path: Column | NameParts, query: Column, words: Column, literal: Column) -> Column:
    """Whether a file is scored by name at all: its name, or for a literal query its path, contains the query or a word."""
    f = path if isinstance(path, NameParts) else NameParts.of(path)
    hay = F.when(literal, f.path).otherwise(f.name)
    return hay.contains(query) | F.exists(words, lambda w: hay.contains(w))


def trigrams(s: Column) -> Column:
    """Distinct runs of three letters."""
    return F.when(F.length(s) < 3, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3))))
    )


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def trigram_similarity(word: Column, name: Column) -> Column:
    """Shared distinct triples of a word and a name over the triples of both; 0 where either has fewer than three letters."""
    shared = F.size(F.array_intersect(trigrams(word), trigrams(F.lower(name))))
    whole = F.length(word) - 2 + F.length(name) - 2 - shared
    return F.when((F.length(word) < 3) | (F.length(name) < 3) | (shared == 0), 0.0).otherwise(shared / whole)


def path_priority(path: Column) -> Column:
    hot = path.contains("/Desktop/") | path.contains("/Documents/") | path.contains("/Downloads/")
    cold = path.contains("/.cache/") | path.contains("/.local/") | path.contains("/.config/")
    return F.when(hot, 100).when(cold, 1).otherwise(10)


def health_status(phantom_rate: Column, p99_ms: Column) -> Column:
    return (
        F.when((phantom_rate > 0.05) | (p99_ms > 350), "UNHEALTHY")
        .when((phantom_rate > 0.02) | (p99_ms > 150), "DEGRADED")
        .otherwise("HEALTHY")
    )


def memory_state(ratio: Column) -> Column:
    return F.when(ratio > 0.95, "Critical").when(ratio > 0.80, "Minimal").when(ratio > 0.65, "Reduced").otherwise("Normal")
