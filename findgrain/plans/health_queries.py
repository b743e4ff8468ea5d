"""Registered queries of index maintenance, health and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from findgrain.operators import health, maintenance
from findgrain.operators import index as ix
from findgrain.plans import fixtures
from findgrain.session import read_table
from findgrain.sources.files import content_kind
from findgrain.streaming import changes as stream
from findgrain.streaming import log


def latency_percentiles(spark, sf):
    """Exact nearest-rank latencies per day."""
    queries = fixtures.query_log(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return health.ranked_percentile(queries, "latency_ms", [50, 99], ["day"])


def zero_result_rate(spark, sf):
    rates = health.zero_result_rate(fixtures.query_log(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day"])
    return rates.select("day", "queries", F.round("zero_rate", 6).alias("zero_rate"))


def retention(spark, sf):
    """Queries per day in the seven days before a date."""
    kept = health.retention(fixtures.query_log(spark, sf), "2025-02-16 00:00:00")
    return kept.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def oldest_dropped(spark, sf):
    kept = health.oldest_dropped(fixtures.query_log(spark, sf).select("ts", "query_id"))
    return kept.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def integrity_rates(spark, sf):
    rates = health.integrity(fixtures.indexed(spark, sf), fixtures.disk(spark, sf))
    return rates.select("checked", F.round("phantom_rate", 6).alias("phantom_rate"), F.round("stale_rate", 6).alias("stale_rate"), "reconcile")


def content_coverage(spark, sf):
    files = fixtures.files(spark, sf).where("path is not null")
    row = health.content_coverage(files, content_kind(F.col("path")) != "unsupported", F.coalesce(F.length("content"), F.lit(0)) > 0)
    return row.select("eligible", F.round("coverage", 6).alias("coverage"))


def health_status(spark, sf):
    rates = health.integrity(fixtures.indexed(spark, sf), fixtures.disk(spark, sf))
    latency = health.ranked_percentile(fixtures.query_log(spark, sf), "latency_ms", [50, 99])
    return health.status(rates, latency).select("checked", "p50", "p99", "status")


def reconcile_diff(spark, sf):
    """What brings the first listing to the last."""
    return maintenance.reconcile(fixtures.disk(spark, sf), fixtures.indexed(spark, sf))


def reconcile_readable(spark, sf):
    """The same where only some roots can be read."""
    disk = fixtures.disk(spark, sf).where("root = '/Users/baba'")
    return maintenance.reconcile(disk, fixtures.indexed(spark, sf), ["/Users/baba"])


def path_differences(spark, sf):
    return maintenance.path_differences(fixtures.disk(spark, sf), fixtures.indexed(spark, sf))


def identity_allocate(spark, sf):
    """Ids of files by volume and inode: known ones stay, new ones go on from the greatest."""
    log = read_table(spark, sf, "wal_entries").where("inode is not null")
    pairs = log.groupBy("volume_uuid", "inode").agg(F.min("doc_id").alias("doc_id"), F.min("seq").alias("first_seq"))
    known = pairs.where("doc_id is not null and inode % 2 = 0").groupBy("volume_uuid", "inode").agg(F.min("doc_id").alias("doc_id"))
    return maintenance.allocate_ids(known, pairs, ["volume_uuid", "inode"])


def _split(spark, sf):
    files = fixtures.files(spark, sf).where("path is not null")
    base = ix.build_index(files.where("doc_id % 10 < 8"))
    # some files of the base come again with other content
    again = files.where("doc_id % 10 = 7").withColumn("content", F.concat(F.coalesce("content", F.lit("")), F.lit(" rewritten file")))
    new = ix.build_index(files.where("doc_id % 10 >= 8").unionByName(again))
    removed = files.where("doc_id % 10 = 6").select("doc_id")
    return base, new, removed


def delta_merge(spark, sf):
    """Postings per term after a batch is committed and merged into the next generation."""
    base, new, removed = _split(spark, sf)
    none = ix.Index(base.files.limit(0), base.postings.limit(0))
    delta, dead = maintenance.commit_batch(base, none, base.files.select("doc_id").limit(0), new, removed)
    whole = maintenance.merged(base, delta, dead)
    return whole.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def dead_set_search(spark, sf):
    """Live postings of a term in base and delta."""
    base, new, removed = _split(spark, sf)
    dead = removed.unionByName(new.files.select("doc_id"))
    live = maintenance.live_postings(base.postings, new.postings, dead)
    return live.where("term in ('rewritten', 'snapshot', 'report')").select("term", "doc_id", "field", "tf")


def change_log_latest_state(spark, sf):
    return stream.latest_per_path(fixtures.changes(spark, sf))


def log_monotonicity(spark, sf):
    """Gaps in the numbers of the change log."""
    return health.sequence_breaks(read_table(spark, sf, "wal_entries"))


def replay_after_seq(spark, sf):
    """Entries after a snapshot, up to the first unreadable one."""
    log = read_table(spark, sf, "wal_entries").select("seq", "event_type", "path")
    bad = log.where("event_type = '?'")
    return stream.replay_after(log, 41_000, bad).select("seq").distinct()


def event_dedup_100ms(spark, sf):
    """Entries of the log kept when a path's entries within 100 ms of the last kept one are dropped."""
    log = read_table(spark, sf, "wal_entries").where("path <> ''").groupBy("seq").agg(F.min("path").alias("path"), F.min("timestamp_us").alias("us"))
    return stream.dedup_batch(log).select("path", "us", "seq")


def event_debounce(spark, sf):
    log = read_table(spark, sf, "wal_entries").where("path <> ''").select("path", F.timestamp_micros("timestamp_us").alias("ts")).distinct()
    out = stream.debounce(log)
    return out.select("path", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


def log_append(spark, sf):
    """The changes as records of a log, numbered in order with a checkpoint after every 256."""
    entries = fixtures.changes(spark, sf).withColumnRenamed("seq", "event_id")
    return log.numbered(entries, 0, ["event_id"]).select("seq", "event_type", "path")


def subtree_deletes(spark, sf):
    gone = spark.createDataFrame([("/Users/baba/Documents",), ("/Volumes/team/Projects/lantern/docs",), ("/Users/bace/Desk",)], "path string")
    return stream.subtree_deletes(fixtures.files(spark, sf).where("path is not null"), gone)


def _rankings(spark, sf):
    """Results of queries ranked by score, and again by another score."""
    from pyspark.sql import Window

    ok = read_table(spark, sf, "raw_results").where("score >= 0 and score < 1e300 and not isnan(score)").groupBy(F.col("query_id").alias("list_id"), "doc_id").agg(F.max("score").alias("a"), F.min("score").alias("b"))
    rank = lambda c: ok.select("list_id", "doc_id", F.row_number().over(Window.partitionBy("list_id").orderBy(*c)).alias("rank"))
    return rank([F.desc("a"), F.col("doc_id")]), rank([F.desc(F.col("b") + F.col("doc_id") % 3), F.col("doc_id")])


def rbo_eval(spark, sf):
    scores = health.rank_biased_overlap(*_rankings(spark, sf))
    return scores.select("list_id", F.round("rbo", 12).alias("rbo"))


def rbo_gate(spark, sf):
    row = health.shadow_gate(health.rank_biased_overlap(*_rankings(spark, sf)))
    return row.select(F.round("p10", 12).alias("p10"), "passes")


def duplicate_ids(spark, sf):
    return health.duplicate_ids(read_table(spark, sf, "raw_results").select("doc_id"))


def orphan_postings(spark, sf):
    tokens = read_table(spark, sf, "tokens")
    return health.orphan_postings(tokens, read_table(spark, sf, "documents").select("doc_id").distinct())


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            latency_percentiles, zero_result_rate, retention, oldest_dropped, integrity_rates, content_coverage, health_status, reconcile_diff,
            reconcile_readable, path_differences, identity_allocate, delta_merge, dead_set_search, change_log_latest_state, log_monotonicity,
            replay_after_seq, event_dedup_100ms, event_debounce, log_append, subtree_deletes, rbo_eval, rbo_gate, duplicate_ids, orphan_postings,
        )
    }
