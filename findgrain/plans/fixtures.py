"""Inputs of the registered queries, derived from the test tables alike here and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findgrain.session import read_table

#: The moment at which ages are measured: 2025-03-01 00:00 UTC.
NOW_NS = 1_740_787_200_000_000_000

#: The stated set of queries.
QUERIES = [
    (1, "report"),
    (2, "meeting notes"),
    (3, "inventory"),
    (4, "travel plan kind:doc"),
    (5, "summary in:documents -draft"),
    (6, "reprot"),
    (7, "invoice copy size:>300"),
    (8, "CHANGELOG"),
    (9, "field notes after:2024-06"),
    (10, "Budget Review tag:work"),
    (11, "notes.rst"),
    (12, "archive snapshot folder"),
    (13, "inventry"),
    (14, "before:2025 sketch"),
    (15, "lectureNotes"),
]


#: More queries for the low-level grammar and for chips.
ENGINE_QUERIES = [
    (21, "report exists"),
    (22, "find in:/Users/me draft ext:pdf"),
    (23, "check report exists"),
    (24, "in:/a notes in:/b ext:md ext:rst"),
    (25, "the 12:30"),
    (26, "12:30 of plan"),
    (27, "finding myFile a:b:c"),
    (28, "x after:2024 before:2025"),
]
CHIP_QUERIES = [
    (31, "tax kind:pdf -draft size:>2KB content:\"a b\" after:2024-05"),
    (32, "kind:pdf kind:md plan kind:pdf in:~/docs/x.y"),
    (33, "size:>5 size:<3gb tag:work,red before:now before:2024-1"),
    (34, "-a-b -c_1 - --d note"),
    (35, "content:\"\" mykind:py"),
]


def files(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select(
        "doc_id", "path", F.col("folder").alias("root"), "size", "mtime_ns", "tag", F.col("text").alias("content")
    )


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id int, query string")


def changes(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "Created").when(F.col("event_type") == "error", "Deleted").when(F.col("event_type") == "purchase", "Renamed")
    user = F.col("user_id").cast("string")
    return read_table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        "ts",
        kind.otherwise("Modified").alias("event_type"),
        F.concat(F.lit("/Users/me/Documents/u"), (F.col("user_id") % 7).cast("string"), F.lit("/file_"), user, F.lit(".txt")).alias("path"),
        F.floor("value").cast("long").alias("size"),
    )


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    """Opened results: the path of a file per usable result row."""
    found = read_table(spark, sf, "raw_results").where("exact and doc_id is not null").select("doc_id", F.col("query_id").alias("click_id"), F.col("found_at").alias("ts"))
    return found.join(read_table(spark, sf, "documents").select("doc_id", "path"), "doc_id").select("ts", "click_id", "path")


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "query_metrics").where("latency_ms >= 0")


def disk(spark: SparkSession, sf: str) -> DataFrame:
    """The last listing but repeated walks: path, root, size, mtime."""
    return _listing(spark, sf, F.max)


def indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The first listing."""
    return _listing(spark, sf, F.min)


def _listing(spark: SparkSession, sf: str, which) -> DataFrame:
    snaps = read_table(spark, sf, "index_snapshots")
    one = snaps.join(F.broadcast(snaps.agg(which("snapshot_id").alias("snapshot_id"))), "snapshot_id")
    row = F.max(F.struct("walked_at", "size", "mtime_ns", "root"))
    return one.groupBy("path").agg(row.alias("r")).select("path", "r.root", "r.size", "r.mtime_ns")
