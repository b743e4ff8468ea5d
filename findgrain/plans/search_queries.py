"""Registered queries of the search operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findgrain.functions import analyze, distance, paths, scoring
from findgrain.operators import client, maintenance
from findgrain.operators import index as ix
from findgrain.operators import requests, search, snippets
from findgrain.plans import fixtures
from findgrain.plans.fixtures import NOW_NS
from findgrain.session import read_table, spread
from findgrain.sources import files as sources


def _index(spark: SparkSession, sf: str, stems: bool = False) -> ix.Index:
    return ix.build_index(fixtures.files(spark, sf), stems=stems)


def tokenize_terms(spark, sf):
    """Index terms of contents with their counts in the whole collection."""
    terms = fixtures.files(spark, sf).select(F.explode(analyze.index_terms(F.col("content"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n"))


def name_terms(spark, sf):
    """Terms of names and folders below the root per file, with their positions folded into counts and fields."""
    return ix._counted(ix.name_occurrences(fixtures.files(spark, sf)), False)


def query_tokens(spark, sf):
    """Query words of file names."""
    words = F.explode(analyze.query_words(paths.file_name(F.col("path")))).alias("word")
    return fixtures.files(spark, sf).select(words).groupBy("word").agg(F.count("*").alias("n"))


def postings(spark, sf):
    return ix.postings_of(spread(fixtures.files(spark, sf)))


def vocab(spark, sf):
    return ix.vocabulary(postings(spark, sf))


def doc_lengths(spark, sf):
    return ix.doc_lengths(postings(spark, sf))


def corpus_stats(spark, sf):
    built = ix.build_index(fixtures.files(spark, sf))
    return built.stats.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def _plain_terms(spark, rows):
    return spark.createDataFrame(rows, "query_id int, term string").select("query_id", "term", F.lit(1.0).alias("weight"), F.lit(True).alias("exact"))


def bm25_single_term(spark, sf):
    hits = search.index_hits(_index(spark, sf), _plain_terms(spark, [(1, "snapshot")]))
    return hits.select("doc_id", F.round("raw", 6).alias("score"))


def bm25_multi_term_or(spark, sf):
    terms = [(1, "index"), (1, "snapshot"), (2, "archive"), (2, "report"), (2, "report"), (3, "медиана"), (3, "fichier")]
    hits = search.index_hits(_index(spark, sf), _plain_terms(spark, terms))
    return hits.select("query_id", "doc_id", F.round("raw", 6).alias("score"))


def bm25_normalized(spark, sf):
    hits = search.normalised(search.index_hits(_index(spark, sf), _plain_terms(spark, [(1, "inventory"), (1, "merge"), (2, "notes")])))
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _asked(spark):
    return requests.prepared(requests.parse_requests(fixtures.queries(spark)))


def search_exact_batch(spark, sf):
    """Searches without term expansion or filters below the ranking: index, names, merge, top 100 per query."""
    rows = search.search(_index(spark, sf), fixtures.queries(spark), now_ns=NOW_NS, fuzzy=False)
    return rows.where("exact").select("query_id", "doc_id", "path", "score")


def search_batch_topk(spark, sf):
    """Full searches: expansion, fallback, clicks and filters."""
    clicks = maintenance.click_counts(fixtures.clicks(spark, sf))
    return search.search(_index(spark, sf, stems=True), fixtures.queries(spark), now_ns=NOW_NS, clicks=clicks)


def search_fuzzy_batch(spark, sf):
    """Full searches but for stems and sounds: near names, fallback, clicks and filters."""
    clicks = maintenance.click_counts(fixtures.clicks(spark, sf))
    return search.search(_index(spark, sf), fixtures.queries(spark), now_ns=NOW_NS, clicks=clicks, sounds=False)


def search_post_filtered(spark, sf):
    """The same without clicks and with filters applied after ranking."""
    return search.search(_index(spark, sf), fixtures.queries(spark), now_ns=NOW_NS, filter_mode="post", sounds=False)


def name_score(spark, sf):
    """Files scored by name: those in whose name, or path for a literal query, a word of the query is found."""
    files = fixtures.files(spark, sf).where("path is not null")
    index = ix.Index(files, None, found_by=_name_lookups(spark, sf))
    asked = _asked(spark)
    pairs = search.name_candidates(index, asked, asked.collect()).join(asked.select("query_id", "q", "words"), "query_id").join(files.select("doc_id", "path"), "doc_id")
    return scoring.with_name_score(pairs).select("query_id", "doc_id", F.col("name").alias("score")).where("score > 0")


def recency_boost(spark, sf):
    return fixtures.files(spark, sf).select("doc_id", scoring.recency_boost(F.col("mtime_ns"), NOW_NS).alias("boost"))


def location_boost(spark, sf):
    return fixtures.files(spark, sf).where("path is not null").select("doc_id", scoring.location_boost(F.col("path")).alias("boost"))


def click_boost(spark, sf):
    counts = maintenance.click_counts(fixtures.clicks(spark, sf))
    return counts.select("path", "clicks", F.round(scoring.click_boost(F.col("clicks")), 6).alias("boost"))


def proximity_folders(spark, sf):
    """Files in the folders of the last three clicked paths."""
    near = maintenance.recent_folders(fixtures.clicks(spark, sf))
    docs = fixtures.files(spark, sf).select("doc_id", paths.directory(F.col("path")).alias("folder"))
    return docs.join(F.broadcast(near), "folder", "left_semi").select("doc_id", "folder", F.lit(scoring.PROXIMITY).alias("boost"))


def top_clicked_terms(spark, sf):
    """The twenty query words clicked most."""
    words = F.explode(analyze.query_words(paths.file_name(F.col("path")))).alias("word")
    return fixtures.clicks(spark, sf).select(words).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20)


def path_bonus(spark, sf):
    asked = _asked(spark).select("query_id", "words")
    pairs = fixtures.files(spark, sf).select("doc_id", "path").where("path is not null").join(F.broadcast(asked))
    return pairs.select("query_id", "doc_id", F.round(scoring.path_bonus(F.col("path"), F.col("words")), 6).alias("bonus")).where("bonus > 0")


def filter_files(spark, sf):
    """Files that pass the filters of each query with filters."""
    r = requests.parse_requests(fixtures.queries(spark)).where("query rlike '(kind|in|after|before|size|tag):| -'")
    named = F.broadcast(r.select("query_id", *[F.col(c).alias(f"r_{c}") for c in r.columns if c not in ("query_id", "query")]))
    pairs = fixtures.files(spark, sf).where("path is not null").join(named)
    return pairs.where(requests.matches("r_")).select("query_id", "doc_id")


def parse_requests(spark, sf):
    r = requests.parse_requests(fixtures.queries(spark))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return r.select("query_id", "text", *[joined(c) for c in ("kinds", "folders", "excluded", "tags", "unrecognised")], "from_day", "before_day", F.col("min_bytes").cast("string").alias("min_bytes"), F.col("max_bytes").cast("string").alias("max_bytes"))


def query_intent(spark, sf):
    """The low-level reading of queries: words before stemming, intent, scope and filters with their values."""
    parsed = requests.parse_engine_query(F.col("query"))
    more = fixtures.ENGINE_QUERIES
    rows = fixtures.queries(spark).unionByName(spark.createDataFrame(more, "query_id int, query string"))
    pairs = F.array_join(F.transform(F.array_sort(F.map_keys(parsed["filters"])), lambda k: F.concat(k, F.lit("="), F.element_at(parsed["filters"], k))), ",")
    return rows.select("query_id", F.array_join(parsed["words"], " ").alias("words"), parsed["intent"].alias("intent"), parsed["scope"].alias("scope"), pairs.alias("filters"))


def _names(spark, sf):
    """All terms of names and folders, whatever their letters and digits."""
    return ix.vocabulary(ix._counted(ix.name_occurrences(fixtures.files(spark, sf)), False)).select("term")


def _name_lookups(spark, sf):
    names = _names(spark, sf).withColumn("is_name", F.lit(True))
    return ix.lookups(fixtures.files(spark, sf), names)


def fuzzy_terms_k1(spark, sf):
    """Names within one edit of query words of up to four letters, which have radius 1."""
    words = spark.createDataFrame([("scna",), ("plna",), ("lgo",), ("note",), ("idea",), ("spce",), ("copi",)], "term string")
    return search.fuzzy_matches(words, _name_lookups(spark, sf).forms).select("term", "name", "distance")


def fuzzy_terms_k2(spark, sf):
    words = spark.createDataFrame([("inventry",), ("sumary",), ("reprot",), ("skecth",), ("budgte",), ("trvl",)], "term string")
    return search.fuzzy_matches(words, _name_lookups(spark, sf).forms).select("term", "name", "distance")


def phonetic_terms(spark, sf):
    words = spark.createDataFrame([("inventari",), ("minits",), ("resipe",), ("skech",), ("bujet",)], "term string")
    return search.phonetic_matches(words, _name_lookups(spark, sf).sounds)


def stemmed_terms(spark, sf):
    terms = fixtures.files(spark, sf).select(F.explode(analyze.index_terms(F.col("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return terms.select("term", analyze.stemmed("term").alias("stem"), "n")


def snippet(spark, sf):
    """Excerpts for the first twenty hits of each query."""
    hits = search.search(_index(spark, sf, stems=True), fixtures.queries(spark), now_ns=NOW_NS)
    return snippets.snippets(hits, fixtures.files(spark, sf), fixtures.queries(spark))


def trigram_jaccard(spark, sf):
    """Names alike to a word in three tenths of their letter triples at least."""
    words = spark.createDataFrame([("inventory",), ("summaries",), ("quarterly",), ("changelogs",)], "word string")
    pairs = _names(spark, sf).join(F.broadcast(words))
    score = scoring.jaccard(scoring.trigrams(F.col("word")), scoring.trigrams(F.col("term")))
    return pairs.select("word", "term", F.round(score, 6).alias("score")).where("score >= 0.3")


def trigram_fallback(spark, sf):
    asked = spark.createDataFrame([(1, ["inventry"]), (2, ["traval", "plans"]), (3, ["minutess"])], "query_id int, words array<string>")
    files = fixtures.files(spark, sf).where("path is not null")
    rows = search.trigram_hits(ix.Index(files, None, found_by=_name_lookups(spark, sf)), asked).join(files.select("doc_id", "path"), "doc_id")
    tail = search.approximate_tail(rows.withColumn("score", F.round("score", 6)))
    return tail.select("query_id", "doc_id", "score")


def trigram_provider(spark, sf):
    """How many words of a query are like the name of a file, as a provider of approximate hits."""
    asked = spark.createDataFrame([(1, ["inventry"]), (2, ["traval", "plans"]), (3, ["minutess"])], "query_id int, words array<string>")
    files = fixtures.files(spark, sf).where("path is not null")
    return search.trigram_counts(ix.Index(files, None, found_by=_name_lookups(spark, sf)), asked)


def prefix_cache_topk(spark, sf):
    return maintenance.prefix_cache(fixtures.files(spark, sf).where("path is not null"), 5)


def prefix_search(spark, sf):
    """Files whose name starts with a word, as they seed a search for it."""
    files = fixtures.files(spark, sf)
    seeds = client.prefix_seed(files, "Inv").unionByName(client.prefix_seed(files, "not"))
    return seeds.join(files.select("doc_id", "path"), "doc_id").select("doc_id", "path", "score")


def substring_search(spark, sf):
    return fixtures.files(spark, sf).where(F.instr(F.lower(paths.file_name(F.col("path"))), "vent") > 0).select("doc_id", "path")


def path_scope(spark, sf):
    return fixtures.files(spark, sf).where(paths.under(F.col("path"), "/Volumes/team/Projects/lantern/docs")).select("doc_id", "path")


def path_parts(spark, sf):
    p = F.col("path")
    name = paths.file_name(p)
    return fixtures.files(spark, sf).where("path is not null").select("doc_id", name.alias("name"), paths.stem(name).alias("stem"), paths.extension(name).alias("ext"), paths.directory(p).alias("folder"), ix.relative_dir(p, F.col("root")).alias("below"))


def display_path(spark, sf):
    return fixtures.files(spark, sf).where("path is not null").select("doc_id", client.display_path(F.col("path"), "/Users/baba").alias("shown"), F.date_format(F.timestamp_millis(F.expr("mtime_ns div 1000000")), "yyyy-MM-dd").alias("modified"))


def content_kinds(spark, sf):
    kinds = sources.content_kind(F.col("path"))
    return fixtures.files(spark, sf).where("path is not null").groupBy(kinds.alias("kind")).agg(F.count("*").alias("n"))


def in_scope(spark, sf):
    """Files of an index over two roots with the usual exclusions, and why others are out."""
    scope = sources.Scope(roots=["/Users/baba", "/Volumes/team"], max_depth=6)
    p = F.col("path")
    rows = fixtures.files(spark, sf).where("path is not null")
    return rows.select("doc_id", sources.root_of(p, scope).alias("root"), sources.never_indexed(p).alias("secret"), sources.queryable(p).alias("queryable"), scoring.path_priority(p).alias("priority"))


def file_kinds(spark, sf):
    return fixtures.files(spark, sf).where("path is not null").select("doc_id", F.array_join(requests.file_kinds(F.col("path")), ",").alias("kinds"))


def content_fingerprints(spark, sf):
    """Files with the same whole content: size of each class of copies."""
    whole = F.sha2(F.col("content").cast("binary"), 256).alias("h")
    same = fixtures.files(spark, sf).where("content <> ''").groupBy(whole).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return same.where("copies > 1").select("first_doc", "copies")


def external_hits(spark, sf):
    """Rows of an outside provider for queries with few of their own."""
    f = fixtures.files(spark, sf).where("path is not null")
    own = f.where("path like '%inventory%'").select(F.lit(1).alias("query_id"), "doc_id", "path")
    extra = f.where("path like '%note%'").select(F.explode(F.array(F.lit(1), F.lit(2))).alias("query_id"), "doc_id", "path")
    return search.outside_hits(own, extra)


def query_chips(spark, sf):
    found = client.chips(F.col("query"))
    rows = fixtures.queries(spark).unionByName(spark.createDataFrame(fixtures.CHIP_QUERIES, "query_id int, query string"))
    return rows.select("query_id", *[(F.array_join(c, ",") if n == "exclude" else c).alias(n) for n, c in found.items()])


def row_details(spark, sf):
    """Size and time of indexed files on disk, and which are missing."""
    rows = fixtures.indexed(spark, sf).select(F.xxhash64("path").alias("doc_id"), "path")
    return client.row_details(rows, fixtures.disk(spark, sf)).select("path", "size", "modified", "missing")


def content_phrase(spark, sf):
    return fixtures.files(spark, sf).where(client.content_phrase(F.col("content"), F.lit("joke of the Week"))).select("doc_id")


def provider_union(spark, sf):
    """Ranked hits and counts of matching terms, each normalised, summed."""
    index = _index(spark, sf)
    terms = _plain_terms(spark, [(1, "index"), (1, "snapshot"), (2, "archive")])
    counted = client.word_counts(index.postings, terms).withColumn("exact", F.lit(False))
    both = client.union_providers(search.index_hits(index, terms), counted)
    return both.select("query_id", "doc_id", F.round("score", 6).alias("score"), "exact")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            tokenize_terms, name_terms, query_tokens, postings, vocab, doc_lengths, corpus_stats, bm25_single_term, bm25_multi_term_or,
            bm25_normalized, search_exact_batch, search_batch_topk, search_fuzzy_batch, search_post_filtered, name_score, recency_boost, location_boost,
            click_boost, proximity_folders, top_clicked_terms, path_bonus, filter_files, parse_requests, query_intent, fuzzy_terms_k1,
            fuzzy_terms_k2, phonetic_terms, stemmed_terms, snippet, trigram_jaccard, trigram_fallback, trigram_provider, prefix_cache_topk, prefix_search,
            substring_search, path_scope, path_parts, display_path, content_kinds, in_scope, file_kinds, content_fingerprints, external_hits, query_chips, row_details,
            content_phrase, provider_union,
        )
    }
