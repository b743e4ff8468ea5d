"""Registered queries of the llm operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findgrain.functions.events import event_code, event_name
from findgrain.functions.paths import with_plain_path
from findgrain.llm import leakage, mixing, quantiles, runs, sentences, terms
from findgrain.session import read_table, through_table

CHECKPOINT = 255
PCTS = [50, 90, 99]


def _runs(spark: SparkSession, sf: str, least: int) -> DataFrame:
    log = read_table(spark, sf, "wal_entries").select("seq", "timestamp_us", "event_type", "path", "received_at")
    log = with_plain_path(log.withColumn("code", F.nullif(event_code(F.col("event_type")), F.lit(CHECKPOINT))), "path", "file")
    return runs.collapse_runs(log, F.col("file"), F.col("code"), least=least)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf, 2).select("first_seq", "last_seq")


def p1_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Every run, single events too, as one event with its count and duration."""
    return _runs(spark, sf, 1).select("first_seq", "last_seq", event_name(F.col("kind")).alias("event_type"), "n", (F.col("last_ts") - F.col("first_ts")).alias("duration_us"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_frequencies(read_table(spark, sf, "tokens")).where("mark is not null").select("term", "mark")


def p2_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_frequencies(read_table(spark, sf, "tokens")).select("term", "occurrences", F.col("records").alias("files"), "mark")


def _day_percentiles(metrics: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    days = quantiles.build_digests(quantiles.counted_queries(metrics, column), ["metric_day"], "value")
    every = quantiles.merge_digests(days.select(F.lit("all").alias("metric_day"), "level", "node", "n"), ["metric_day"])
    return quantiles.percentiles(days, ["metric_day"], PCTS), quantiles.percentiles(every, ["metric_day"], PCTS)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    day, every = _day_percentiles(read_table(spark, sf, "query_metrics"), "latency_ms")
    both = day.join(F.broadcast(every.select("pct", F.col("value").alias("whole"))), "pct")  # one row per percentile
    return both.where(F.col("value") > 1.5 * F.col("whole")).select("metric_day", "pct")


def p5_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of latency and of result counts per day and, from the days' digests, over all days."""
    metrics = read_table(spark, sf, "query_metrics")
    out = None
    for column in ("latency_ms", "result_count"):
        day, every = _day_percentiles(metrics, column)
        part = day.unionByName(every).withColumn("metric", F.lit(column))
        out = part if out is None else out.unionByName(part)
    return out.select("metric", "metric_day", "pct", "value", "size")


def p5_rank_error(spark: SparkSession, sf: str) -> DataFrame:
    """Whether digests of a hundredth, in which nodes are merged at any size, keep their bound: ranks per day within it, those over all days within twice."""
    metrics, eps, out = read_table(spark, sf, "query_metrics"), 0.01, None
    for column in ("latency_ms", "result_count"):
        values = quantiles.counted_queries(metrics, column)
        days = quantiles.build_digests(values, ["metric_day"], "value", eps=eps)
        every = quantiles.merge_digests(days.select(F.lit("all").alias("metric_day"), "level", "node", "n"), ["metric_day"], eps=eps)
        for digests, rows, bound in ((days, values, eps), (every, values.withColumn("metric_day", F.lit("all")), 2 * eps)):
            errors = quantiles.rank_errors(quantiles.percentiles(digests, ["metric_day"], PCTS), rows, ["metric_day"], "value")
            part = errors.select(F.lit(column).alias("metric"), "metric_day", "pct", "size", (F.col("error") <= bound * F.col("size")).alias("within"))
            out = part if out is None else out.unionByName(part)
    return out


def _unusable(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("score")
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")) | (s < 0)
    return read_table(spark, sf, "raw_results").where(bad).select(F.col("doc_id").alias("record"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The value asked for is n ln(N/d); it decides among the terms that the ratio test finds over-represented, and an exact check follows."""
    scored = terms.distinctive_terms(read_table(spark, sf, "tokens"), _unusable(spark, sf))
    return terms.best_terms(scored).select(F.col("record").alias("doc_id"), "term")


def p7_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Log-likelihood ratio and weight of every term of every file."""
    scored = terms.distinctive_terms(read_table(spark, sf, "tokens"))
    return scored.select(F.col("record").alias("doc_id"), "term", "n", F.col("records").alias("files"), F.round("llr", 4).alias("llr"), F.round("weight", 4).alias("weight"))


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the items in them, with matching windows; without verbatim ones the item is re-parameterised."""
    return leakage.find_leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"))


def p8_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the items in them where only numbers and their units may differ."""
    return leakage.find_leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"), names=False)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Of the leaks those with the item's very words."""
    return p8_leaks(spark, sf).where("verbatim > 0").select("doc_id", "item_id")


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, list[mixing.Planned], int]:
    sized = through_table(mixing.sized_documents(read_table(spark, sf, "documents")), "sized-documents")
    sources, total = mixing.read_sources(sized, read_table(spark, sf, "mix_targets"))
    plan = mixing.plan_mix(sources, total)
    return mixing.realise(sized, plan), plan, total


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that stay below their share in the realised mix with every document used as often as it may be."""
    return p9_shares(spark, sf).where("not reachable").select("source")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    mix, _, _ = _mix(spark, sf)
    return mix.select(F.col("doc").alias("doc_id"), "source", "tokens", "copies")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Planned and really reached shares of the mix."""
    return mixing.actual_shares(*_mix(spark, sf))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(read_table(spark, sf, "documents"))


def queries() -> dict:
    every = (
        p1_found,
        p1_collapsed,
        p2_found,
        p2_terms,
        p5_found,
        p5_percentiles,
        p5_rank_error,
        p7_found,
        p7_scores,
        p8_found,
        p8_leaks,
        p8_numbers,
        p9_found,
        p9_mix,
        p9_shares,
        p10_found,
    )
    return {f.__name__: f for f in every}
