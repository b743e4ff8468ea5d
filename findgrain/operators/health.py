"""Index health, invariants and the comparison of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findgrain.functions.scoring import health_status
from findgrain.session import through_table


def running_counts(counts: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Adds ``upto`` and ``whole`` to ``(by, value, n)`` with one row a value: rows up to each value in order, and of the group.

    Range-sorted partitions sum up their own rows and start after those before, so a group with any number of distinct values spreads
    over partitions; only one row a group and partition meets in one place.
    """
    order = [*by, value]
    placed = through_table(counts.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "value-counts")
    sums = placed.groupBy(*by, "part").agg(F.sum("n").alias("m"))
    over = Window.partitionBy(*by)
    ends = sums.withColumn("before", F.sum("m").over(over.orderBy("part")) - F.col("m")).withColumn("whole", F.sum("m").over(over))
    ends = ends.select(*[F.col(c).alias(f"e_{c}") for c in by], F.col("part").alias("e_part"), "before", "whole")
    same = F.col("part") == F.col("e_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"e_{c}"))
    inside = F.sum("n").over(Window.partitionBy(*by, "part").orderBy(value))
    return placed.join(ends, same).select(*by, value, "n", (F.col("before") + inside).alias("upto"), "whole")


def ranked_percentile(values: DataFrame, value: str, pcts: list[int], by: list[str] | None = None) -> DataFrame:
    """``(by, p<n>)``: the value at index floor(n * pct / 100) of the sorted values, exactly, without gathering them.

    Counts per distinct value are summed up in order, over range partitions, so neither rows nor distinct values of a group meet in one task.
    Null values do not count.
    """
    by = by or []
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    run = running_counts(counts, by)
    at = lambda p: F.expr(f"whole * {p} div 100")
    return run.groupBy(*by).agg(*[F.min(F.when(F.col("upto") > at(p), F.col("v"))).alias(f"p{p}") for p in pcts])


def zero_result_rate(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    rate = F.coalesce(F.avg((F.col("result_count") == 0).cast("int")), F.lit(0.0))
    return log.groupBy(*(by or [])).agg(F.count("result_count").alias("queries"), rate.alias("zero_rate"))


def retention(log: DataFrame, now, days: int = 7) -> DataFrame:
    """Rows of the last ``days`` days before ``now`` (a column or a literal)."""
    return log.where(F.col("ts") >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS"))


def order_statistic(rows: DataFrame, value: str, index: Column, bucket: Column) -> DataFrame:
    """One row ``(value)``: the value at ``index`` (a function of the number of rows ``whole``, from 0) in sorted order.

    ``bucket`` is a coarse, order-keeping form of the value with few different results. Counts per bucket tell which one holds the
    index; only that one's distinct values are sorted. No rows give no row.
    """
    ok = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), bucket.alias("bucket"))
    per = ok.groupBy("bucket").agg(F.count("*").alias("n"))
    run = running_counts(per, [], "bucket").withColumn("index", index.cast("long"))
    one = run.where("upto > index and upto - n <= index").select("bucket", (F.col("index") - F.col("upto") + F.col("n")).alias("left"))
    inside = ok.join(F.broadcast(one), "bucket").groupBy("v", "left").agg(F.count("*").alias("n"))
    return running_counts(inside.select(F.col("left").alias("g"), "v", "n"), ["g"]).where("upto > g and upto - n <= g").select(F.col("v").alias("value"))


def oldest_dropped(log: DataFrame, share: float = 0.1) -> DataFrame:
    """The log without its oldest share, by the exact time under which it falls."""
    edge = order_statistic(log, "ts", F.floor(F.col("whole") * share), F.date_trunc("hour", F.col("ts")))
    return log.join(F.broadcast(edge), F.col("ts") >= F.col("value")).drop("value")


def integrity(indexed: DataFrame, disk: DataFrame, share: float | None = None) -> DataFrame:
    """One row: share of indexed files missing on disk, of those changed since, and whether to reconcile.

    ``share`` checks only that share of the files, chosen by a hash of the path; None checks all.
    """
    rows = indexed if share is None else indexed.where(F.pmod(F.xxhash64("path"), F.lit(1000)) < share * 1000)
    both = rows.select("path", F.col("mtime_ns").alias("im")).join(disk.select("path", F.col("mtime_ns").alias("dm"), F.lit(True).alias("there")), "path", "left")
    missing = F.col("there").isNull()
    stale = ~missing & ~F.col("im").eqNullSafe(F.col("dm"))
    rates = both.agg(
        F.count("*").alias("checked"),
        F.coalesce(F.avg(missing.cast("int")), F.lit(0.0)).alias("phantom_rate"),
        F.coalesce(F.avg(stale.cast("int")), F.lit(0.0)).alias("stale_rate"),
    )
    return rates.withColumn("reconcile", F.col("phantom_rate") > 0.05)


def content_coverage(files: DataFrame, eligible: Column, processed: Column) -> DataFrame:
    """Share of eligible files whose content is indexed; 1 where none is eligible."""
    return files.agg(F.count_if(eligible).alias("eligible"), F.coalesce(F.avg(F.when(eligible, processed.cast("int"))), F.lit(1.0)).alias("coverage"))


def status(integrity_row: DataFrame, latency_row: DataFrame) -> DataFrame:
    return integrity_row.join(F.broadcast(latency_row)).withColumn("status", health_status(F.col("phantom_rate"), F.col("p99")))


def sequence_breaks(log: DataFrame, block: int = 1 << 16) -> DataFrame:
    """``(seq, next_seq)`` where a log's sequence numbers do not go up by one.

    Neighbours are looked for inside blocks of numbers, then the ends of blocks meet.
    """
    once = log.select("seq").distinct().withColumn("block", F.expr(f"(seq - pmod(seq, {block})) div {block}"))
    inner = once.withColumn("next_seq", F.lead("seq").over(Window.partitionBy("block").orderBy("seq")))
    ends = once.groupBy("block").agg(F.min("seq").alias("first"), F.max("seq").alias("seq"))
    across = ends.withColumn("next_seq", F.lead("first").over(Window.orderBy("block"))).select("seq", "next_seq")
    return inner.select("seq", "next_seq").unionByName(across).where("next_seq <> seq + 1")


def duplicate_ids(files: DataFrame) -> DataFrame:
    return files.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")


def orphan_postings(postings: DataFrame, files: DataFrame) -> DataFrame:
    """Posting rows per id that no file has."""
    return postings.groupBy("doc_id").agg(F.count("*").alias("n")).join(files.select("doc_id"), "doc_id", "left_anti")


def shared_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").intersect(b.select("doc_id"))


def rank_biased_overlap(a: DataFrame, b: DataFrame, p: float = 0.9) -> DataFrame:
    """``(list_id, rbo)``: extrapolated overlap of two rankings ``(list_id, rank, doc_id)`` with ranks from 1 without gaps.

    An item in both lists adds to the agreement from the deeper of its two ranks on; a list pair missing on one side has overlap 0.
    """
    depth = a.select("list_id", "rank").unionByName(b.select("list_id", "rank")).groupBy("list_id").agg(F.max("rank").alias("n"))
    both = a.select("list_id", "doc_id", F.col("rank").alias("ra")).join(b.select("list_id", "doc_id", F.col("rank").alias("rb")), ["list_id", "doc_id"])
    met = both.groupBy("list_id", F.greatest("ra", "rb").alias("d")).agg(F.count("*").alias("x"))
    levels = depth.select("list_id", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("d"))
    run = levels.join(met, ["list_id", "d"], "left").withColumn("x", F.sum(F.coalesce("x", F.lit(0))).over(Window.partitionBy("list_id").orderBy("d")))
    agree = F.col("x") / F.col("d")
    total = (1 - p) * F.sum(agree * F.pow(F.lit(p), F.col("d") - 1))
    last = F.max(F.when(F.col("d") == F.col("n"), agree * F.pow(F.lit(p), F.col("n"))))
    return run.groupBy("list_id").agg((total + last).alias("rbo"))


def shadow_gate(scores: DataFrame, least: float = 0.7) -> DataFrame:
    """One row: the tenth percentile of scores at index 10 * (n - 1) / 100 and whether it reaches ``least``."""
    row = order_statistic(scores, "rbo", F.expr("10 * (whole - 1) div 100"), F.floor(F.col("rbo") * 1000)).select(F.col("value").alias("p10"))
    return row.withColumn("passes", F.col("p10") >= least)
