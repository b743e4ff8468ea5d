"""Registered queries of the general data operators: incremental input, snapshots, change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findgrain.functions.events import EVENT_TYPES, event_code
from findgrain.operators import changes, incremental, snapshots
from findgrain.session import fresh_dir, read_table


def _typed_log(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "wal_entries").withColumn("code", event_code(F.col("event_type")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The next run over the files of the log. The tables hold no manifest of the runs before: it is taken over from what they had read."""
    upto = incremental.last_success(read_table(spark, sf, "index_runs")).first()["upto"]
    at = f"{sf}/wal_entries.parquet"
    columns = ["seq", "mtime_ns", "event_type", "received_at"]

    def read(names: list[str], arrived=None) -> DataFrame:
        log = spark.read.parquet(*names).where("seq is not null and received_at is not null")
        log = log.select(*columns, F.col("_metadata.file_path").alias("file"))
        log = log if arrived is None else log.where(arrived)
        is_checkpoint = event_code(F.col("event_type")) == EVENT_TYPES["Checkpoint"]
        return log.where(~F.coalesce(is_checkpoint, F.lit(False)))

    store = incremental.BatchStore(spark, fresh_dir(spark, "index-runs"))
    listing = incremental.list_files(spark, at)
    if upto is not None:
        after = F.col("received_at") > F.lit(upto)
        later = spark.read.parquet(at).where(after).select(F.col("_metadata.file_path").alias("file")).distinct()
        incremental.adopt(store, read([at], ~after), listing.join(later, "file", "left_anti"), key="seq", version="mtime_ns")
    new = incremental.new_entries(store, listing, lambda names: read(names, None if upto is None else F.col("received_at") > F.lit(upto)))
    return store.rows(new) if new is not None else read([at]).select("seq").limit(0)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.snapshot_changes(read_table(spark, sf, "index_snapshots"))


def p4_diff_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and ends of the lists of each root's diff."""
    return snapshots.list_sizes(snapshots.snapshot_changes(read_table(spark, sf, "index_snapshots"), carry=["root"]))


def p4_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The lists of each root's diff, paths on lines."""
    lists = snapshots.reconciliation_lists(snapshots.snapshot_changes(read_table(spark, sf, "index_snapshots"), carry=["root"]))
    return lists.withColumn("paths", F.array_join("paths", "\n"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    log = _typed_log(spark, sf).where(F.col("code") != EVENT_TYPES["Checkpoint"])
    return changes.apply_changes(log.withColumn("is_delete", F.col("code") == EVENT_TYPES["Deleted"]))


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p4_found, p4_diff_sizes, p4_lists, p6_found)}
