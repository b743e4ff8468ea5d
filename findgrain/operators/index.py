"""The inverted index as tables: files, postings, vocabulary, collection statistics."""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from findgrain.functions import analyze, distance, paths, scoring
from findgrain.functions.scoring import FIELD_CONTENT, FIELD_NAME, FIELD_PATH
from findgrain.session import spread, through_table


class Lookups:
    """Tables by which searches find names without looking at all of them.

    ``forms`` (form, name): every name term, and it with one or two letters left out. ``sounds`` (code, name): its phonetic code.
    ``triples`` (t, segment) and ``triple_counts`` (t, n): letter triples of distinct lower-case path components, ``placed``
    (segment, doc_id, is_name) the files that have them. ``stem_triples`` (t, stem, size) and ``stems`` (stem, doc_id): the
    same for file names without extension. With ``keep`` each is written as a table when it is first asked for.
    """

    NAMES = ("forms", "sounds", "triples", "triple_counts", "placed", "stem_triples", "stems")

    def __init__(self, made: dict[str, DataFrame], keep: bool = False):
        self._made, self._lock = dict(made), {name: threading.Lock() for name in self.NAMES}
        self._open = set(self.NAMES) if keep else set()

    def __getattr__(self, name: str) -> DataFrame:
        if name not in Lookups.NAMES:
            raise AttributeError(name)
        with self._lock[name]:
            if name in self._open:
                made = triple_counts(self.triples) if name == "triple_counts" else self._made[name]
                self._made[name] = through_table(made, name.replace("_", "-"), keep=True)
                self._open.discard(name)
            return self._made[name]

    def named(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.NAMES}

    def ready(self) -> Lookups:
        """Writes all that are open, side by side."""
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda name: getattr(self, name), self.NAMES))
        return self


@dataclass
class Index:
    """``files`` (doc_id, path, size, mtime_ns, tag, is_dir, doc_len), ``postings`` (term, doc_id, field, tf), with whether terms are stems.

    ``terms`` is the vocabulary and ``found_by`` the lookups of names as tables; where they are missing they are made when first asked for, and kept.
    """

    files: DataFrame
    postings: DataFrame
    stems: bool = False
    terms: DataFrame | None = None
    found_by: Lookups | None = None
    sizes: Row | None = None

    @property
    def vocabulary(self) -> DataFrame:
        """``(term, is_name, df)``; df counts postings, so a file with a term in both name and content counts twice."""
        if self.terms is None:
            self.terms = through_table(vocabulary(self.postings), "vocabulary", keep=True)
        return self.terms

    @property
    def lookups(self) -> Lookups:
        if self.found_by is None:
            self.found_by = Lookups(lookups(self.files, self.vocabulary).named(), keep=True)
        return self.found_by

    @property
    def stats(self) -> DataFrame:
        return collection_stats(self.files)

    @property
    def totals(self) -> Row:
        """The one row of ``stats``, read once."""
        if self.sizes is None:
            self.sizes = self.stats.first()
        return self.sizes


def triple_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("t").agg(F.count("*").alias("n"))


def lookups(files: DataFrame, vocabulary: DataFrame) -> Lookups:
    names = vocabulary.where("is_name").select(F.col("term").alias("name"))
    forms = names.select(F.explode(distance.deletions(F.col("name"), 2)).alias("form"), "name")
    sounds = names.select(analyze.sound("name").alias("code"), "name").where("code <> ''")
    split = files.where("path is not null").select("doc_id", F.split(F.lower("path"), "/").alias("parts"))
    every = split.select("doc_id", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "segment")).where("segment <> ''")
    placed = every.groupBy("segment", "doc_id").agg(F.max(F.col("at") == F.col("n") - 1).alias("is_name"))
    triples = placed.select("segment").distinct().select(F.explode(scoring.trigrams(F.col("segment"))).alias("t"), "segment")
    stem = F.lower(F.regexp_replace(paths.file_name(F.col("path")), r"\.[^.]*$", ""))
    stems = files.where("path is not null").select(stem.alias("stem"), "doc_id")
    stem_triples = stems.select("stem").distinct().select(F.explode(scoring.trigrams(F.col("stem"))).alias("t"), "stem", (F.length("stem") - 2).alias("size"))
    return Lookups(dict(forms=forms, sounds=sounds, triples=triples, triple_counts=triple_counts(triples), placed=placed, stem_triples=stem_triples, stems=stems))


def relative_dir(path: Column, root: Column) -> Column:
    """The folder of a file below its root; components above the root say nothing about it."""
    folder = paths.directory(path)
    below = F.when(folder.startswith(F.concat(root, F.lit("/"))), F.substring(folder, F.length(root) + 2, F.length(folder)))
    return F.when(root.isNull(), folder).when(folder == root, F.lit("")).otherwise(F.coalesce(below, folder))


def _counted(rows: DataFrame, stems: bool) -> DataFrame:
    """``(doc_id, term, field)`` occurrences to postings; counted before stemming, so that a stem is made once per pair."""
    counted = rows.groupBy("term", "doc_id").agg(F.bit_or("field").alias("field"), F.count("*").alias("tf"))
    if not stems:
        return counted
    stemmed = counted.withColumn("term", analyze.stemmed("term"))
    return stemmed.groupBy("term", "doc_id").agg(F.bit_or("field").alias("field"), F.sum("tf").alias("tf"))


def name_occurrences(files: DataFrame) -> DataFrame:
    name = F.explode(analyze.index_terms(paths.file_name(F.col("path"))))
    folder = F.explode(analyze.index_terms(relative_dir(F.col("path"), F.col("root"))))
    return files.select("doc_id", name.alias("term"), F.lit(FIELD_NAME).alias("field")).unionByName(
        files.select("doc_id", folder.alias("term"), F.lit(FIELD_PATH).alias("field"))
    )


def content_occurrences(files: DataFrame) -> DataFrame:
    return files.select("doc_id", F.explode(analyze.index_terms(F.col("content"))).alias("term"), F.lit(FIELD_CONTENT).alias("field"))


def postings_of(files: DataFrame, stems: bool = False) -> DataFrame:
    """One row per term, file and part: names with folders, and contents."""
    return _counted(name_occurrences(files), stems).unionByName(_counted(content_occurrences(files), stems))


def doc_lengths(postings: DataFrame) -> DataFrame:
    return postings.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))


def vocabulary(postings: DataFrame) -> DataFrame:
    is_name = F.max((F.col("field") != FIELD_CONTENT).cast("int")) == 1
    return postings.groupBy("term").agg(is_name.alias("is_name"), F.count("*").alias("df"))


def collection_stats(files: DataFrame) -> DataFrame:
    """One row; an empty collection has average length 1."""
    return files.agg(F.count("*").alias("n_docs"), F.greatest(F.coalesce(F.avg("doc_len"), F.lit(1.0)), F.lit(1.0)).alias("avg_len"))


def build_index(files: DataFrame, *, stems: bool = False) -> Index:
    """An index over ``files`` (doc_id, path, root, size, mtime_ns, tag, content, and is_dir where folders are among them), one row per id.

    Rows without id or path are left out. Null content has no terms. A folder is a document with a name and no content.
    """
    ok = files.where("doc_id is not null and path is not null")
    ok = ok.withColumn("is_dir", F.coalesce("is_dir", F.lit(False)) if "is_dir" in files.columns else F.lit(False))
    # as a table: lengths, vocabulary and searches read it, texts are analysed once
    postings = through_table(postings_of(spread(ok), stems), "postings")
    meta = ok.select("doc_id", "path", "root", "size", "mtime_ns", "tag", "is_dir")
    lengths = doc_lengths(postings)
    return Index(through_table(meta.join(lengths, "doc_id", "left").fillna(0, ["doc_len"]), "files"), postings, stems)
