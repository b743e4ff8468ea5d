"""Counts of terms: one occurrence per place, frequencies by bitmaps, and how distinctive a term is of a record."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findgrain.functions.text import fold_term
from findgrain.operators.maintenance import allocate_ids
from findgrain.session import through_table

HEAVY = 1000


def occurrences(tokens: DataFrame, *, record: str = "doc_id", term: str = "term", place: tuple[str, ...] = ("field", "token_pos")) -> DataFrame:
    """``(record, term)`` once per record and place.

    Terms are composed, lower-cased and trimmed; null and blank ones, and rows without record, are left out. Repeated rows count once;
    where copies of a place disagree the smallest term counts. A null place is a place like others.
    """
    rows = tokens.select(F.col(record).alias("record"), *[F.col(p).alias(f"place{i}") for i, p in enumerate(place)], fold_term(F.col(term)).alias("term"))
    rows = rows.where("record is not null and term is not null")
    places = [f"place{i}" for i in range(len(place))]
    return rows.groupBy("record", *places).agg(F.min("term").alias("term")).select("record", "term")


#: Record identifiers of one container of a bitmap.
CONTAINER = 1 << 16


def numbered(occ: DataFrame) -> DataFrame:
    """The same occurrences with records numbered densely from 1, for identifiers that are sparse or hashed, or no integers."""
    none = occ.select("record", F.lit(0).cast("long").alias("doc_id")).limit(0)
    ids = allocate_ids(none, occ.select("record").distinct(), ["record"])
    return occ.join(ids, "record").select("term", F.col("doc_id").alias("record"))


def vertical_index(occ: DataFrame) -> DataFrame:
    """``(term, chunk, words, n)``: per term a bitmap of record identifiers in containers of 65,536, with its occurrences.

    A container holds its non-zero 64-bit words only, each with its place: a rare term takes one row of one word, a common one
    a row per 65,536 identifiers of at most 1,024 words. Words are made by bitwise or before the shuffle, so a term in every record
    spreads over as many keys as it has words until they are small; then containers are put together.
    """
    bit = F.expr("shiftleft(1L, cast(pmod(record, 64) as int))")
    word = F.expr("(record - pmod(record, 64)) div 64")
    words = occ.select("term", word.alias("word"), bit.alias("bit")).groupBy("term", "word").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))
    per = CONTAINER // 64
    at = F.expr(f"pmod(word, {per})").cast("short")
    chunk = F.expr(f"(word - pmod(word, {per})) div {per}")
    return words.groupBy("term", chunk.alias("chunk")).agg(F.collect_list(F.struct(at.alias("at"), "bits")).alias("words"), F.sum("n").alias("n"))


def cardinality(words: Column) -> Column:
    """Records in a container."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w["bits"]))


def union_bitmaps(index: DataFrame, *by: str) -> DataFrame:
    """``(by, records)``: cardinality of the union of bitmaps, per ``by`` or over all."""
    words = index.select(*by, "chunk", F.explode("words").alias("w")).groupBy(*by, "chunk", "w.at").agg(F.bit_or("w.bits").alias("bits"))
    return words.groupBy(*by).agg(F.sum(F.bit_count("bits").cast("long")).alias("records"))


def term_frequencies(tokens: DataFrame, *, common_share: float = 0.1, dense: bool = True, **columns) -> DataFrame:
    """``(term, occurrences, records, mark)`` for every distinct term; mark is rare, common or null.

    ``rare``: in exactly one record. ``common``: in more than ``common_share`` of the records with at least one counted term.
    A term that is both, as can only be among fewer than ten records, is rare. No rows give no terms.
    ``dense`` says that records are integers without wide gaps; others (False) are numbered first.
    """
    occ = occurrences(tokens, **columns)
    index = through_table(vertical_index(occ if dense else numbered(through_table(occ, "occurrences"))), "term-index")
    # one row for the driver: the number of records
    everything = union_bitmaps(index).first()["records"] or 0
    # the containers of one term differ already, so its cardinality is the sum over them
    per = index.groupBy("term").agg(F.sum("n").alias("occurrences"), F.sum(cardinality(F.col("words"))).alias("records"))
    # records > share * everything, in whole numbers
    limit = int(Fraction(str(common_share)) * everything)
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") > limit, "common")
    return per.withColumn("mark", mark)


def join_counts(rows: DataFrame, counts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of rows with one-row-a-key counts that no hot key can unbalance.

    ``weight`` is the number of rows a key has, ``total`` of all keys. At most ``HEAVY`` keys can have more than one
    ``HEAVY``-th of the total: those are broadcast, whatever the data. The others are joined by shuffle.
    """
    limit = total / HEAVY
    heavy = counts.where(F.col(weight) > limit)
    light = counts.where(F.col(weight) <= limit)
    on_heavy = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return on_heavy.unionByName(rest.join(light, key))


def log_likelihood(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Signed G-squared of the table [[a, b], [c, d]]: above zero where the term is over-represented in the record."""
    n = a + b + c + d

    def part(seen: Column, row: Column, col: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n / (row * col))).otherwise(F.lit(0.0))

    g = 2 * (part(a, a + b, a + c) + part(b, a + b, b + d) + part(c, c + d, a + c) + part(d, c + d, b + d))
    return F.when(a * (b + d) >= b * (a + c), g).otherwise(-g)


def distinctive_terms(tokens: DataFrame, only: DataFrame | None = None, **columns) -> DataFrame:
    """``(record, term, n, records, all_records, llr, weight)`` for every record and term.

    ``llr`` is the log-likelihood ratio of the two-by-two table of occurrences of this term and of others in this record and in the
    remaining collection. ``weight`` is n * ln(all_records / records) from the margins of the same table, rounded to 6 decimals.
    Counts cover all records; ``only`` (one column ``record``) restricts which records come out.

    Terms are counted as in ``occurrences``. A collection of one record has llr 0 for every term. No rows give no rows.
    """
    tf = through_table(occurrences(tokens, **columns).groupBy("record", "term").agg(F.count("*").alias("n")), "term-counts")
    per_term = tf.groupBy("term").agg(F.count("*").alias("records"), F.sum("n").alias("term_n"))
    per_record = tf.groupBy("record").agg(F.sum("n").alias("record_n"), F.count("*").alias("record_terms"))
    # one row for the driver: the margins of the collection
    total = per_record.agg(F.count("*").alias("records"), F.sum("record_n").alias("n"), F.sum("record_terms").alias("pairs")).first()
    pairs = total["pairs"] or 0
    rows = tf
    if only is not None:
        rows = tf.join(only.select("record").where("record is not null").distinct(), "record", "left_semi")
    rows = join_counts(rows, per_record, "record", "record_terms", pairs)
    rows = join_counts(rows, per_term, "term", "records", pairs)
    a, b = F.col("n"), F.col("term_n") - F.col("n")
    c = F.col("record_n") - F.col("n")
    d = F.lit(total["n"] or 0) - F.col("record_n") - b
    weight = F.round(F.col("n") * F.log(F.lit(float(total["records"])) / F.col("records")), 6)
    return rows.select(
        "record",
        "term",
        "n",
        "records",
        F.lit(total["records"]).alias("all_records"),
        log_likelihood(*[x.cast("double") for x in (a, b, c, d)]).alias("llr"),
        weight.alias("weight"),
    )


def best_terms(scored: DataFrame, *, least_records: int = 2) -> DataFrame:
    """``(record, term, by_ratio)``: per record the most distinctive term, of those in at least ``least_records`` records.

    Candidates are the terms that the two-by-two table shows over-represented in the record (``llr`` above zero). Among them the
    required value (``weight``) decides; ties go to the smaller term in byte order. An exact check follows: a term that is not over-represented but
    has a greater weight takes the place, and ``by_ratio`` is false there.
    """
    at = F.struct((-F.col("weight")).alias("w"), "term")
    candidate = F.min(F.when(F.col("llr") > 0, at))
    other = F.min(F.when(~(F.col("llr") > 0), at))
    best = scored.where(F.col("records") >= least_records).groupBy("record").agg(candidate.alias("c"), other.alias("o"))
    kept = F.col("o").isNull() | (F.col("c") <= F.col("o"))
    kept = F.coalesce(kept, F.lit(False))
    return best.select("record", F.when(kept, F.col("c.term")).otherwise(F.col("o.term")).alias("term"), kept.alias("by_ratio"))
