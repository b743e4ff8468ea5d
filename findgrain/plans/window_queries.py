"""Registered queries of the rules around search: scopes, limits, details, policies, what a search window shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from findgrain.functions import analyze, paths, scoring
from findgrain.operators import client, maintenance, requests, search
from findgrain.operators import index as ix
from findgrain.plans import fixtures
from findgrain.session import fresh_dir, read_table
from findgrain.sources import files as sources

ROOTS = ["/u/a", "/u/a/", "/u/a/b", "/u/ab", "/v/../u/a/c", "/w//x/.", "/w/x"]
ODD_REQUESTS = [(1, "budget after:yesterday size:big"), (2, "x before:2024-13 size:>5tb after:2024-05"), (3, "plan kind: tag:"), (4, "after:1969 -"), (5, "")]


def _files(spark, sf):
    return fixtures.files(spark, sf).where("path is not null")


def access_scope(spark, sf):
    """Files that each access scope lets see."""
    p = F.col("path")
    return _files(spark, sf).select("doc_id", *[sources.in_access_scope(p, s, "/Users/baba").alias(s) for s in ("full", "limited", "denied")])


def volume_rules(spark, sf):
    """What holds for files on mounted volumes and others: shown, read, and how changes are noticed."""
    network = F.col("path").startswith("/Volumes/")
    opted = F.col("path").contains("/team/")
    return _files(spark, sf).select("doc_id", sources.queryable(F.col("path")).alias("shown"), sources.read_contents(network, opted).alias("read"), sources.watch_strategy(network).alias("watch"))


def window_scopes(spark, sf):
    p = F.col("path")
    return _files(spark, sf).select("doc_id", *[client.window_scope(p, s).alias(s) for s in ("files", "applications", "clipboard")])


def long_enough(spark, sf):
    """Query words of file names that are long enough to be searched for."""
    words = _files(spark, sf).select(F.explode(analyze.query_words(paths.file_name(F.col("path")))).alias("word")).distinct()
    return words.where(client.long_enough(F.col("word")))


def unread_filters(spark, sf):
    """Requests whose filters cannot be read: what is noted, and what is left."""
    r = requests.parse_requests(spark.createDataFrame(ODD_REQUESTS, "query_id int, query string"))
    return r.select("query_id", "text", F.array_join("unrecognised", ",").alias("unrecognised"), "from_day", "before_day", F.col("max_bytes").isNull().alias("unbounded"), F.array_join("excluded", ",").alias("excluded"))


def boundary_rows(spark, sf):
    return client.boundary_rows(_files(spark, sf).withColumn("score", F.lit(1.0)))


def word_spans(spark, sf):
    """The words of file names, cut out by their spans."""
    cut = F.udf(lambda t: "|".join(t[a:b] for a, b in analyze.spans(t)), "string", useArrow=True)
    return _files(spark, sf).select("doc_id", cut(paths.file_name(F.col("path"))).alias("words"))


def expansion_weights(spark, sf):
    """The weight of each edit distance within the radius, and of a match by sound."""
    rows = spark.createDataFrame([("0", 0), ("1", 1), ("2", 2), ("sound", None)], "found_by string, distance int")
    return rows.select("found_by", scoring.expansion_weight(F.col("distance")).alias("weight"))


def time_left(spark, sf):
    """Minutes left of work that took so long for a share of it."""
    log = read_table(spark, sf, "query_metrics").where("latency_ms is not null")
    seconds, done = F.col("latency_ms").cast("double"), F.pmod("query_id", F.lit(101)) / 100
    return log.select(F.col("query_id"), client.minutes_left(seconds, done).alias("minutes")).where("minutes is not null").distinct()


def memory_states(spark, sf):
    log = read_table(spark, sf, "query_metrics").where("latency_ms is not null")
    return log.groupBy(scoring.memory_state(F.col("latency_ms") / 100).alias("state")).agg(F.count("*").alias("n"))


def postings_bytes(spark, sf):
    return maintenance.postings_bytes(ix.postings_of(fixtures.files(spark, sf)))


def scope_hits(spark, sf):
    """Ranked hits of a word at or below a folder."""
    built = ix.build_index(fixtures.files(spark, sf))
    hits = search.index_hits(built, spark.createDataFrame([(1, "snapshot", 1.0, True)], "query_id int, term string, weight double, exact boolean"))
    return maintenance.hits_in_scope(hits, built.files, "/Volumes/team").select("doc_id", F.round("raw", 6).alias("score"))


def _typed_clicks(spark, sf):
    return fixtures.clicks(spark, sf).withColumn("query", F.concat(F.lit("query "), F.pmod("click_id", F.lit(15)).cast("string")))


def top_queries(spark, sf):
    return maintenance.top_queries(_typed_clicks(spark, sf), 10)


def top_paths(spark, sf):
    return maintenance.top_paths(fixtures.clicks(spark, sf), 10)


def query_history(spark, sf):
    """The last queries of each user without immediate repetitions."""
    log = read_table(spark, sf, "query_metrics").where("latency_ms is not null").groupBy("query_id").agg(F.min("ts").alias("at"), F.min("latency_ms").alias("l"))
    log = log.select(F.pmod("query_id", F.lit(7)).alias("user"), F.struct("at", "query_id").alias("ts"), F.concat(F.lit("q"), F.pmod("l", F.lit(3)).cast("string")).alias("query"))
    return client.history(log).select("user", F.col("ts.query_id").alias("query_id"), "query")


def after_calls(spark, sf):
    """Events after the first hundred of their type."""
    log = read_table(spark, sf, "events").withColumn("late", client.after_calls(F.col("event_id"), F.col("event_type"), 100))
    return log.where("late").select("event_id")


def roots(spark, sf):
    """The roots that are left of a configuration with repeated and nested ones."""
    return spark.createDataFrame([(r,) for r in sources.Scope(roots=ROOTS).normalised().roots], "root string")


def text_cut(spark, sf):
    """The first hundred bytes of texts, never cut inside a character, and whether that is known to be all."""
    rows = _files(spark, sf).where((sources.content_kind(F.col("path")) == "text") & ~sources.never_indexed(F.col("path")) & F.col("content").isNotNull())
    cut = sources.extract(rows.select("doc_id", "path", F.col("content").cast("binary").alias("bytes")), limit=100)
    return cut.select("doc_id", F.col("content").alias("head"), "full")


def generation_round_trip(spark, sf):
    """Postings per term of an index written as a generation and loaded again."""
    store = maintenance.Generations(spark, fresh_dir(spark, "generation"))
    store.save(ix.build_index(fixtures.files(spark, sf)))
    loaded = store.load(verify=True)
    return loaded.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def name_segments(spark, sf):
    """Path components that contain each of some words, found by their rarest letter triple."""
    names = ix.vocabulary(ix._counted(ix.name_occurrences(fixtures.files(spark, sf)), False)).withColumn("is_name", F.lit(True))
    return search.segments_with(["note", "vent", "ar", "zzz", "résu", "2024"], ix.lookups(fixtures.files(spark, sf), names))


def permission_audit(spark, sf):
    """Changes of the mode of each path in the log; a path without one before has -1."""
    changes = maintenance.permission_changes(read_table(spark, sf, "wal_entries").select("path", "seq", "mode"))
    return changes.select("path", "seq", F.coalesce("was", F.lit(-1)).alias("was"), "mode")


def permission_state(spark, sf):
    return maintenance.permission_state(read_table(spark, sf, "wal_entries").select("path", "seq", "mode"))


def merge_due(spark, sf):
    """Whether a delta of each size, in hundreds of postings per first letter of a term, is due for a merge at 1,000 postings."""
    postings = ix.postings_of(fixtures.files(spark, sf)).withColumn("letter", F.substring("term", 1, 1))
    rows = [(letter, maintenance.needs_merge(ix.Index(None, postings.where(F.col("letter") == letter)), 1000)) for letter in "aeqxz"]
    return spark.createDataFrame(rows, "letter string, due boolean")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            access_scope, volume_rules, window_scopes, long_enough, unread_filters, boundary_rows, word_spans, expansion_weights, time_left,
            memory_states, postings_bytes, scope_hits, top_queries, top_paths, query_history, after_calls, roots, text_cut, generation_round_trip, name_segments, permission_audit, permission_state, merge_due,
        )
    }
