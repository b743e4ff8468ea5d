"""Batched search: every operator takes many queries, a single search is a batch of one."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from findgrain.functions import analyze, distance, phonetic, scoring, stem
from findgrain.functions.scoring import FALLBACK_BELOW, FALLBACK_LIMIT, FALLBACK_SHARE, INDEX_WEIGHT, RESULT_LIMIT, TRIGRAM_LEAST
from findgrain.operators import requests
from findgrain.operators.index import Index, Lookups
from findgrain.session import fresh_dir, local_rows, scratch, through_table

#: Queries that are answered together; larger batches go in blocks.
QUERY_BLOCK = 2_000


def _fuzzy_candidates(words: DataFrame, forms: DataFrame) -> DataFrame:
    word = words.select("term", scoring.fuzzy_radius(F.col("term")).alias("radius"))
    left = word.withColumn("form", F.explode(F.when(F.col("radius") == 2, distance.deletions(F.col("term"), 2)).otherwise(distance.deletions(F.col("term"), 1))))
    near = left.join(forms, "form").where(F.abs(F.length("term") - F.length("name")) <= F.col("radius"))
    return near.select("term", "name", "radius")


def fuzzy_matches(words: DataFrame, forms: DataFrame) -> DataFrame:
    """``(term, name, distance)``: vocabulary names near each distinct word, within 2 edits from five letters on, else 1.

    ``forms`` (form, name) are those of the vocabulary. Near words share a form with letters left out, so the search is an
    equi-join on such forms, not a comparison of all with all.
    """
    near = _fuzzy_candidates(words.select("term").distinct(), forms).distinct()
    return near.withColumn("distance", distance.osa_distance("term", "name")).where("distance <= radius").drop("radius")


def phonetic_matches(words: DataFrame, sounds: DataFrame) -> DataFrame:
    """``(term, name)`` with one phonetic code; words without a code match nothing. ``sounds`` (code, name) are those of the vocabulary."""
    w = words.select("term").distinct().withColumn("code", analyze.sound("term")).where("code <> ''")
    return w.join(sounds, "code").select("term", "name")


def expand(terms: DataFrame, known: list[tuple], lookups: Lookups, sounds: bool = True) -> DataFrame:
    """``(query_id, term, weight, exact)``: typed terms at weight 1 for each time they are typed, near names and, where fewer than three are near, names of like sound.

    ``known`` are the rows of ``terms`` (query_id, position, term) on the driver. A name is added once per query, by the first
    word that brings it, unless it was typed before; a typed term is always there.
    """
    distinct = sorted({t for _, _, t in known})
    words = local_rows(terms.sparkSession, [(t, phonetic.phonetic_code(t)) for t in distinct], "term string, code string")
    near = _fuzzy_candidates(words, lookups.forms).withColumn("heard", F.lit(False))
    alike = words.where("code <> ''" if sounds else "false").join(lookups.sounds, "code").select("term", "name", F.lit(0).alias("radius"), F.lit(True).alias("heard"))
    # one shuffle for both: candidates of a word meet, near ones are measured, and like sounds stay where few are near
    found = near.unionByName(alike).repartition("term").groupBy("term", "name").agg(F.max("radius").alias("radius"), F.max("heard").alias("heard"))
    found = found.withColumn("apart", F.when(F.col("radius") > 0, distance.osa_distance("term", "name")))
    found = found.withColumn("distance", F.when(F.col("apart") <= F.col("radius"), F.col("apart"))).where("distance is not null or heard")
    found = found.withColumn("n", F.count("distance").over(Window.partitionBy("term"))).where("(distance is not null or n < 3) and name <> term")
    extra = found.join(F.broadcast(terms), "term").select("query_id", F.col("name").alias("term"), "position", scoring.expansion_weight(F.col("distance")).alias("weight"), F.lit(False).alias("typed"))
    rows = terms.select("query_id", "term", "position", F.lit(1.0).alias("weight"), F.lit(True).alias("typed")).unionByName(extra)
    typed = F.col("typed")
    per = rows.groupBy("query_id", "term").agg(
        F.count_if(typed).alias("times"),
        F.min(F.when(typed, F.col("position"))).alias("typed_at"),
        F.min(F.when(~typed, F.col("position"))).alias("extra_at"),
        F.min_by(F.when(~typed, F.col("weight")), F.when(~typed, F.col("position"))).alias("extra"),
    )
    added = F.when(F.col("typed_at").isNull() | (F.col("typed_at") > F.col("extra_at")), F.col("extra"))
    return per.select("query_id", "term", (F.col("times") + F.coalesce(added, F.lit(0.0))).alias("weight"), (F.col("times") > 0).alias("exact"))


def few_or_table(rows: DataFrame, name: str, most: int = 100_000) -> DataFrame:
    """Rows read to the driver and broadcast to joins where there are at most ``most``; else kept as a table."""
    found = rows.limit(most + 1).toArrow()
    return F.broadcast(rows.sparkSession.createDataFrame(found, rows.schema)) if found.num_rows <= most else through_table(rows, name)


def index_hits(index: Index, expanded: DataFrame) -> DataFrame:
    """``(query_id, doc_id, raw, exact)``: BM25 of expanded terms, any of which may match, summed per file."""
    if index.terms is not None:
        df = index.terms.select("term", "df")
    else:
        df = index.postings.join(expanded.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    # one row for the driver: size and average length of the collection
    stats = index.totals
    wanted = expanded.join(df, "term").select("query_id", "term", "weight", "exact", scoring.idf(F.lit(stats["n_docs"]), F.col("df")).alias("idf"))
    wanted = few_or_table(wanted, "query-terms")
    hits = index.postings.join(wanted, "term").join(index.files.select("doc_id", "doc_len"), "doc_id")
    score = scoring.bm25(F.col("tf"), F.col("doc_len"), F.lit(stats["avg_len"]), F.col("idf")) * scoring.field_boost(F.col("field")) * F.col("weight")
    return hits.groupBy("query_id", "doc_id").agg(F.sum(score).alias("raw"), F.max("exact").alias("exact"))


def normalised(hits: DataFrame) -> DataFrame:
    top = hits.groupBy("query_id").agg(F.max("raw").alias("top"))
    return hits.join(top, "query_id").withColumn("score", F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(0.0)).drop("top")


def best(rows: DataFrame, limit: int, score: str = "score") -> DataFrame:
    """The first ``limit`` rows per query by score, then path, then id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "path", "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def segments_with(words: list[str], lookups: Lookups) -> DataFrame:
    """``(word, segment)``: path components that contain each of a stated set of distinct words.

    A word of three letters or more is looked for only in the components that have the rarest of its triples; only shorter ones
    are compared with all distinct components.
    """
    spark = lookups.triples.sparkSession
    of = {w: sorted({w[i : i + 3] for i in range(len(w) - 2)}) for w in words}
    asked = local_rows(spark, sorted({(t,) for ts in of.values() for t in ts}), "t string")
    # at most the triples of the words come back
    n = {r["t"]: r["n"] for r in lookups.triple_counts.join(F.broadcast(asked), "t").collect()}
    rarest = [(w, min(ts, key=n.get)) for w, ts in of.items() if ts and all(t in n for t in ts)]
    long = lookups.triples.join(F.broadcast(local_rows(spark, rarest, "word string, t string")), "t").where(F.col("segment").contains(F.col("word"))).select("word", "segment")
    short = [(w,) for w in words if 0 < len(w) < 3]
    if not short:
        return long
    within = lookups.placed.select("segment").distinct().join(F.broadcast(local_rows(spark, short, "word string")), F.col("segment").contains(F.col("word")))
    return long.unionByName(within.select("word", "segment"))


def name_candidates(index: Index, queries: DataFrame, known: list[Row]) -> DataFrame:
    """``(query_id, doc_id)``: files whose name, or for a literal query whose path, contains a word of the query, or all of a query without words.

    ``known`` are the rows of ``queries`` on the driver.
    """
    spark, id_type = queries.sparkSession, queries.schema["query_id"].dataType.simpleString()
    typed = sorted({(r["query_id"], r["literal"], w) for r in known for w in r["words"]})
    placed = segments_with(sorted({w for _, _, w in typed}), index.lookups).join(index.lookups.placed, "segment").select("word", "doc_id", "is_name")
    found = placed.join(F.broadcast(local_rows(spark, typed, f"query_id {id_type}, literal boolean, word string")), "word").where("literal or is_name").select("query_id", "doc_id")
    bare = [(r["query_id"], r["q"], r["literal"]) for r in known if not r["words"]]
    if bare:
        hay = F.lower(F.when(F.col("literal"), F.col("path")).otherwise(F.substring_index("path", "/", -1)))
        rest = F.broadcast(local_rows(spark, bare, f"query_id {id_type}, q string, literal boolean"))
        found = found.unionByName(index.files.select("doc_id", "path").join(rest, hay.contains(F.col("q"))).select("query_id", "doc_id"))
    # pairs are small and scoring them is not: their partitions stay as many as the session has
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "query_id", "doc_id").distinct()


def name_hits(index: Index, queries: DataFrame, known: list[Row], now_ns: int) -> DataFrame:
    """``(query_id, doc_id, score)``: names scored by query, with the age of the file; null where nothing of the name fits. Only files with a word of the query in them are scored."""
    pairs = name_candidates(index, queries, known).join(F.broadcast(queries.select("query_id", "q", "words")), "query_id")
    pairs = pairs.join(index.files.select("doc_id", "path", "mtime_ns"), "doc_id")
    named = scoring.with_name_score(pairs)
    return named.select("query_id", "doc_id", F.when(F.col("name") > 0, F.col("name") + scoring.recency_boost(F.col("mtime_ns"), now_ns)).alias("score"))


def _alike_names(index: Index, queries: DataFrame, least: float) -> DataFrame:
    """``(query_id, at, doc_id, like)``: files whose name is alike to a query word by at least ``least`` of their letter triples.

    Words meet distinct names on the letter triples they share, so only names with something in common are looked at.
    """
    words = queries.select("query_id", F.posexplode("words").alias("at", "word"))
    right = words.select("word").distinct().select("word", (F.length("word") - 2).alias("own"), F.explode(scoring.trigrams(F.col("word"))).alias("t"))
    # triples of the words of a stated query set
    shared = index.lookups.stem_triples.join(F.broadcast(right), "t").groupBy("word", "own", "stem", "size").agg(F.count("*").alias("k"))
    like = shared.withColumn("like", F.col("k") / (F.col("own") + F.col("size") - F.col("k"))).where(F.col("like") >= least)
    return like.select("word", "stem", "like").join(index.lookups.stems, "stem").join(words, "word").select("query_id", "at", "doc_id", "like")


def trigram_hits(index: Index, queries: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score)``: sums of similarities of at least one half between query words and names."""
    return _alike_names(index, queries, TRIGRAM_LEAST).groupBy("query_id", "doc_id").agg((INDEX_WEIGHT * F.sum("like")).alias("score"))


def trigram_counts(index: Index, queries: DataFrame, least: float = TRIGRAM_LEAST) -> DataFrame:
    """``(query_id, doc_id, raw, exact)``: how many words of a query the name of a file is alike to, as a provider beside the ranked one."""
    alike = _alike_names(index, queries, least).groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("raw"))
    return alike.withColumn("exact", F.lit(False))


def approximate_tail(rows: DataFrame) -> DataFrame:
    """Approximate rows at least half as good as the best, at most twenty per query."""
    top = rows.groupBy("query_id").agg(F.max("score").alias("top"))
    good = rows.join(top, "query_id").where(F.col("score") >= FALLBACK_SHARE * F.col("top")).drop("top")
    return best(good, FALLBACK_LIMIT).drop("rank")


def search(index: Index, queries: DataFrame, **options) -> DataFrame:
    """``(query_id, rank, doc_id, path, score, exact)`` for queries ``(query_id, query)``; see ``search_block`` for the options.

    Words are alternatives; index and name scores add up; approximate rows come only where fewer than five exact ones exist.
    Scores are rounded to six decimals and ties go to the smaller path. Filters apply to files before ranking (``push``)
    or to the ranked rows (``post``). Empty queries have no rows. ``clicks`` is ``(path, clicks)``.
    ``extra_hits`` ``(query_id, doc_id, path)`` of an outside provider fill up queries with fewer than five rows.

    The queries are a stated set: ``QUERY_BLOCK`` of them are read to the driver at a time, parsed, and answered at once. Their rows,
    at most ``limit`` a query, are complete when this returns, and no table is left behind; larger batches leave one table of rows.
    """
    spark = queries.sparkSession
    _ = index.totals
    parsed = requests.prepared(requests.parse_requests(queries), index.stems)
    schema = parsed.schema
    block = parsed.limit(QUERY_BLOCK + 1).collect()
    if len(block) <= QUERY_BLOCK:
        return _complete(spark, index, block, schema, options)
    kept = through_table(parsed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(2 * -(-parsed.count() // QUERY_BLOCK)))), "queries", ["block"])
    out = fresh_dir(spark, "search-rows")
    # twice as many blocks as are needed on average; one that is still too full is answered in slices
    for b in [r["block"] for r in kept.select("block").distinct().collect()]:
        rows = kept.where(F.col("block") == b).drop("block").select(schema.names).collect()
        for at in range(0, len(rows), QUERY_BLOCK):
            _complete(spark, index, rows[at : at + QUERY_BLOCK], schema, options).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def _complete(spark: SparkSession, index: Index, asked: list[Row], schema, options) -> DataFrame:
    with scratch(spark):
        rows = search_block(index, local_rows(spark, asked, schema), asked, **options)
        # at most QUERY_BLOCK times the limit
        found = rows.toArrow()
    return spark.createDataFrame(found, rows.schema)


def search_block(
    index: Index,
    asked: DataFrame,
    known: list[Row],
    *,
    now_ns: int,
    clicks: DataFrame | None = None,
    recent_folders: list[str] | None = None,
    fuzzy: bool = True,
    sounds: bool = True,
    filter_mode: str = "push",
    limit: int = RESULT_LIMIT,
    extra_hits: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``search`` for prepared queries, which ``known`` has on the driver."""
    spark, files, lookups = asked.sparkSession, index.files, index.lookups
    id_type = asked.schema["query_id"].dataType.simpleString()
    if not known:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, doc_id long, path string, score double, exact boolean")
    keys = [c for c in asked.columns if c != "query_id"]
    filters = any(r[c] for r in known for c in ("kinds", "folders", "excluded", "tags", "from_day", "before_day")) or any(r[c] is not None for r in known for c in ("min_bytes", "max_bytes"))
    attributes = files.select("doc_id", "path", "size", "mtime_ns", "tag", "is_dir")

    def filtered(rows: DataFrame) -> DataFrame:
        """Keeps rows whose file passes the filters of their query."""
        if not filters:
            return rows
        named = asked.select(F.col("query_id"), *[F.col(c).alias(f"r_{c}") for c in keys])
        return rows.join(named, "query_id").where(requests.matches("r_", F.col("is_dir"))).drop(*[f"r_{c}" for c in keys])

    with_path = lambda rows: rows.join(attributes if filters else attributes.select("doc_id", "path"), "doc_id")
    allowed = (lambda rows: filtered(with_path(rows))) if filter_mode == "push" else with_path

    typed = [(r["query_id"], i, stem.stem(t) if index.stems else t) for r in known for i, t in enumerate(r["terms"])]
    terms = local_rows(spark, typed, f"query_id {id_type}, position int, term string")
    if fuzzy:
        expanded = expand(terms, typed, lookups, sounds)
    else:
        expanded = terms.groupBy("query_id", "term").agg(F.count("*").cast("double").alias("weight")).withColumn("exact", F.lit(True))
    # as tables: hits are read once for the best of each query, once for all. Names do not wait for them
    with ThreadPoolExecutor(1) as beside:
        scored = beside.submit(lambda: through_table(name_hits(index, asked, known, now_ns), "name-hits"))
        hits = through_table(index_hits(index, expanded), "index-hits")
        named = scored.result()
    found = allowed(normalised(hits)).join(asked.select("query_id", "words"), "query_id")
    near = F.lit(False)
    for folder in recent_folders or []:
        near = near | (F.regexp_replace("path", "/[^/]*$", "") == folder)
    ranked = scoring.with_path_bonus(found, longest=max(len(r["words"]) for r in known)).withColumn("score", F.col("score") * F.when(near, scoring.PROXIMITY).otherwise(1.0) + F.col("bonus"))
    top = best(ranked, RESULT_LIMIT).select("query_id", "doc_id", (INDEX_WEIGHT * F.col("score")).alias("score"), "exact")

    if filter_mode == "push" and filters:
        named = allowed(named)
    named = named.select("query_id", "doc_id", "score", F.col("score").isNotNull().alias("exact"))
    merged = top.unionByName(named).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"), F.max("exact").alias("exact")).where("score is not null")
    merged = merged.join(files.select("doc_id", "path"), "doc_id")
    if clicks is not None:
        merged = merged.join(clicks.select("path", "clicks"), "path", "left")
        merged = merged.withColumn("score", F.col("score") + scoring.click_boost(F.col("clicks"))).drop("clicks")

    # as a table: counted, then ranked
    merged = through_table(merged.select("query_id", "doc_id", "path", "score", "exact"), "merged-hits")
    exact = merged.where("exact")
    # one row a query for the driver
    full = {r["query_id"] for r in exact.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= FALLBACK_BELOW).collect()}
    few = [(r["query_id"],) for r in known if r["query_id"] not in full]
    rows = exact
    if few:
        thin = F.broadcast(local_rows(spark, sorted(set(few)), f"query_id {id_type}"))
        alike = trigram_hits(index, asked.where(~F.col("literal")).join(thin, "query_id", "left_semi"))
        alike = allowed(alike).select("query_id", "doc_id", "path", "score")
        loose = (
            merged.where(~F.col("exact"))
            .join(thin, "query_id", "left_semi")
            .select("query_id", "doc_id", "path", "score")
            .unionByName(alike.join(exact.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"))
            .groupBy("query_id", "doc_id", "path")
            .agg(F.sum("score").alias("score"))
        )
        rows = exact.unionByName(approximate_tail(loose).select("query_id", "doc_id", "path", "score", F.lit(False).alias("exact")))
        if extra_hits is not None:
            rows = rows.unionByName(outside_hits(rows, extra_hits.join(thin, "query_id", "left_semi")))
    rows = best(rows.withColumn("score", F.round("score", 6)), limit)
    if filter_mode == "post" and filters:
        rows = filtered(rows.drop("path").join(attributes, "doc_id"))
    return rows.select("query_id", "rank", "doc_id", "path", "score", "exact")


def outside_hits(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """Rows of an outside provider: at most twenty, at score 0.5, for queries with fewer than five rows, without paths known already."""
    have = rows.groupBy("query_id").agg(F.count("*").alias("n"))
    thin = extra.join(have.where(F.col("n") >= FALLBACK_BELOW), "query_id", "left_anti")
    new = thin.join(rows.select("query_id", "path"), ["query_id", "path"], "left_anti")
    capped = new.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("path"))).where("k <= 20")
    return capped.select("query_id", "doc_id", "path", F.lit(0.5).alias("score"), F.lit(False).alias("exact"))
