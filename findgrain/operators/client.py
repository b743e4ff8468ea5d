"""What a search window adds around the engine: chips, scopes, row details, history, progress, sampling."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findgrain.functions import paths

MIN_QUERY = 2
HISTORY = 50
# How the chips of a query look, in the order in which they are taken out of it. Chip sizes count in powers of 1024, unlike the filters.
CHIPS = {
    "kind": r"kind:(\w+)",
    "in": r"in:([\w~/.-]+)",
    "after": r"after:([\d-]+)",
    "before": r"before:([\d-]+)",
    "size": r"(?i)size:([><]\d+(?:mb|gb|kb))",
    "tag": r"tag:(\w+)",
    "content": r"content:\"([^\"]+)\"",
}


def chips(query: Column) -> dict[str, Column]:
    """The first value of each kind of chip, null without one; the words excluded; and the text that is left.

    A chip is taken out of the query wherever it stands in the same spelling. What is left is divided at blanks: a hyphen before
    letters, digits and underscores alone excludes that word, other words are the text.
    """
    out, rest = {}, query
    for name, pattern in CHIPS.items():
        pattern = "(?U)" + pattern
        token = F.regexp_extract(rest, pattern, 0)
        out[name] = F.nullif(F.regexp_extract(rest, pattern, 1), F.lit(""))
        rest = F.when(token == "", rest).otherwise(F.replace(rest, token, F.lit("")))
    words = F.filter(F.split(rest, r"(?U)\s+"), lambda w: w != "")
    excludes = lambda w: w.rlike(r"^-[\p{L}\p{N}_]+$")
    out["exclude"] = F.transform(F.filter(words, excludes), lambda w: F.substr(w, F.lit(2)))
    out["text"] = F.array_join(F.filter(words, lambda w: ~excludes(w)), " ")
    return out


def chip_bytes(size: str) -> int | None:
    m = re.fullmatch(r"[<>](\d+)(kb|mb|gb)", size.lower())
    return int(m[1]) << {"kb": 10, "mb": 20, "gb": 30}[m[2]] if m else None


def long_enough(query: Column) -> Column:
    return F.length(F.trim(query)) >= MIN_QUERY


def content_phrase(content: Column, phrase: Column) -> Column:
    """Whether a text contains a phrase, whatever the case; a null phrase asks nothing."""
    return phrase.isNull() | F.coalesce(F.lower(content).contains(F.lower(phrase)), F.lit(False))


def window_scope(path: Column, scope: str) -> Column:
    """``files`` shows all, ``applications`` only those, other scopes hold no files."""
    if scope == "files":
        return F.lit(True)
    return path.rlike(r"\.app/?$") if scope == "applications" else F.lit(False)


def display_path(path: Column, home: str) -> Column:
    return F.when(path == home, "~").when(path.startswith(home + "/"), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 20))).otherwise(path)


def readable_size(size: Column) -> Column:
    """Bytes in decimal units with one digit."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(size >= 1000**power, F.concat(F.round(size / 1000**power, 1).cast("string"), F.lit(" " + unit))).otherwise(out)
    return out


def row_details(rows: DataFrame, disk: DataFrame) -> DataFrame:
    """``rows`` (doc_id, path) with size and time of the file on disk, and whether it is missing."""
    there = disk.select("path", "size", "mtime_ns", F.lit(True).alias("there"))
    out = rows.select("doc_id", "path").join(there, "path", "left")
    when = F.date_format(F.timestamp_micros(F.expr("mtime_ns div 1000")), "yyyy-MM-dd HH:mm")
    return out.select("doc_id", "path", readable_size(F.col("size")).alias("size"), when.alias("modified"), F.col("there").isNull().alias("missing"))


def boundary_rows(hits: DataFrame) -> DataFrame:
    """Rows handed to a client: id, path, score, name; a path with a NUL cannot be handed over."""
    return hits.where(F.instr("path", "\0") == 0).select("doc_id", "path", "score", paths.file_name(F.col("path")).alias("name"))


def history(log: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The last queries ``(ts, query)`` without immediate repetitions, per ``user``."""
    by = Window.partitionBy("user").orderBy("ts", "query")
    once = log.where("trim(query) <> ''").withColumn("was", F.lag("query").over(by)).where("was is null or was <> query").drop("was")
    return once.withColumn("k", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("ts"), F.desc("query")))).where(F.col("k") <= keep).drop("k")


def eta_minutes(elapsed_s: float, done: float) -> int | None:
    """Minutes left, once three seconds and two percent are over."""
    if elapsed_s < 3 or done <= 0.02 or done >= 1:
        return None
    return max(1, math.ceil(elapsed_s * (1 - done) / done / 60))


def minutes_left(elapsed_s: Column, done: Column) -> Column:
    """The same for a table of tasks."""
    known = (elapsed_s >= 3) & (done > 0.02) & (done < 1)
    return F.when(known, F.greatest(F.lit(1).cast("long"), F.ceil(elapsed_s * (1 - done) / done / 60)))


def sampled(key: Column, share: float, seed: int = 0) -> Column:
    """A fixed share of keys, the same in every run: where injected faults strike."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)


def after_calls(order: Column, by: Column, n: int) -> Column:
    """Whether a call comes after the first ``n`` of its kind."""
    return F.row_number().over(Window.partitionBy(by).orderBy(order)) > n


class Provider(Protocol):
    """An outside source of results for a batch of queries."""

    def provide(self, queries: DataFrame) -> DataFrame:
        """``(query_id, doc_id, path)`` for ``(query_id, query)``; ``doc_id`` may be null."""


def provided(providers: Sequence[Provider], queries: DataFrame) -> DataFrame | None:
    """The rows of all providers, each path once a query; one that fails has none."""
    out = None
    for p in providers:
        try:
            rows = p.provide(queries).select("query_id", F.col("doc_id").cast("long").alias("doc_id"), "path")
        except Exception:
            continue
        out = rows if out is None else out.unionByName(rows)
    return None if out is None else out.groupBy("query_id", "path").agg(F.min("doc_id").alias("doc_id"))


def prefix_seed(files: DataFrame, prefix: str) -> DataFrame:
    """Files whose name starts with a one-word query, at score 1 and exact."""
    name = F.lower(paths.file_name(F.col("path")))
    return files.where(name.startswith(prefix.lower())).select("doc_id", F.lit(1.0).alias("score"), F.lit(True).alias("exact"))


def word_counts(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """``(query_id, doc_id, raw)``: how many of a query's terms a file has, as a provider of hits beside the ranked one."""
    return postings.join(terms.select("query_id", "term").distinct(), "term").groupBy("query_id", "doc_id").agg(F.countDistinct("term").alias("raw"))


def union_providers(*hits: DataFrame) -> DataFrame:
    """Hits of several providers ``(query_id, doc_id, raw, exact)``: each normalised by its best, then summed."""
    out = None
    for h in hits:
        top = h.groupBy("query_id").agg(F.max("raw").alias("top"))
        part = h.join(top, "query_id").select("query_id", "doc_id", (F.col("raw") / F.col("top")).alias("score"), "exact")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"), F.max("exact").alias("exact"))
