"""The index as one object: build, load, change, merge, search, excerpts, clicks, health."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findgrain.operators import client, health, maintenance, search, snippets
from findgrain.operators.client import Provider
from findgrain.operators.index import Index, build_index
from findgrain.operators.maintenance import Generations
from findgrain.session import drop_tables, local_rows, spread, through_table
from findgrain.sources import files as sources
from findgrain.sources.files import Scope
from findgrain.streaming import changes as stream

CLICK_SCHEMA = "ts timestamp, query string, path string"
LOG_SCHEMA = "ts timestamp, latency_ms long, result_count long"


class IndexLocked(RuntimeError):
    """Another process writes this index."""


class SearchIndex:
    """An index in a folder that all executors share (any URI Spark can write to). ``base`` is an immutable generation, ``delta`` holds what came since, ``dead`` the ids it replaces."""

    def __init__(self, spark: SparkSession, folder: str, scope: Scope | None = None, stems: bool = True):
        self.spark, self.stems = spark, stems
        self.store = Generations(spark, folder)
        self.folder = self.store.folder
        self.started = maintenance.startup(self.folder)
        if self.started == "crash":
            maintenance.recover(self.store)
        self.scope = (scope or Scope.of(self.folder.read_json("config.json"))).normalised()
        if scope is not None:
            self.folder.write_json("config.json", asdict(self.scope))
        self.contents: DataFrame | None = None
        self.base = self.store.load() or build_index(self._no_files(), stems=stems)
        self.delta, self.dead = self._nothing()
        self._changed_at, self._changes = time.time(), 0  # of the last merge; files changed since
        self._reconciled_at = time.time()
        self._current: Index | None = None

    def _no_files(self) -> DataFrame:
        return self.spark.createDataFrame([], "doc_id long, path string, root string, size long, mtime_ns long, tag string, content string, is_dir boolean")

    def _nothing(self) -> tuple[Index, DataFrame]:
        return build_index(self._no_files(), stems=self.stems), self._no_files().select("doc_id")

    @property
    def current(self) -> Index:
        """Base without the dead, and delta; the base alone while nothing has changed."""
        if self._current is None:
            self._current = self.base if self._changes == 0 else maintenance.merged(self.base, self.delta, self.dead)
        return self._current

    def build(self, files: DataFrame) -> int:
        """A first or new generation from ``files`` (doc_id, path, root, size, mtime_ns, tag, content)."""
        self.contents = files
        self.base = build_index(files, stems=self.stems)
        self.delta, self.dead = self._nothing()
        self._changes, self._current = 0, None
        return self.merge()

    def build_in_two_phases(self, limit: int | None = None, extractors=None) -> Iterator[int]:
        """Generations of the files in scope: first with names alone, so that searches by name work early, then with contents.

        The second phase takes files that still have the path, size and time of the first; others are left to the next ``refresh``.
        """
        listed = through_table(self.scan(extractors, limit, names_only=True), "listed")
        self.base = build_index(listed, stems=self.stems)
        self.delta, self.dead = self._nothing()
        self._changes, self._current = 0, None
        yield self.merge()
        read = self.scan(extractors, limit)
        same = ["path", "size", "mtime_ns"]
        unchanged = listed.join(read.select(*same, F.col("content").alias("read")), [listed[c].eqNullSafe(read[c]) for c in same], "left").select(*[listed[c] for c in listed.columns if c != "content"], F.coalesce("read", F.lit("")).alias("content"))
        yield self.build(through_table(unchanged, "contents"))

    def scan(self, extractors=None, limit: int | None = None, names_only: bool = False) -> DataFrame:
        """Files and folders in scope on disk with contents (of each the first ``limit`` bytes where that is given) and stable ids."""
        return self._read(sources.scan(self.spark, self.scope), extractors, limit, names_only)

    def _read(self, entries: DataFrame, extractors=None, limit: int | None = None, names_only: bool = False) -> DataFrame:
        if names_only or not self.scope.index_content:
            found = entries.drop("uri").withColumn("content", F.lit(""))
        else:
            found = sources.extract(spread(entries), extractors, limit=limit)
        known = self.current.files.select("path", "doc_id")
        ids = maintenance.allocate_ids(known, entries.select("path"), ["path"])
        return found.join(ids, "path").select("doc_id", "path", "root", "size", "mtime_ns", F.lit(None).cast("string").alias("tag"), "content", "is_dir")

    def refresh(self, disk: DataFrame | None = None, readable_roots: list[str] | None = None) -> DataFrame:
        """Brings the index to the state of ``disk`` (by default a new scan); returns the actions taken.

        Files of roots that cannot be read now (by default those that cannot be listed) stay as they are.
        """
        roots = readable_roots if readable_roots is not None else sources.readable_roots(self.spark, self.scope)
        disk = through_table(self.scan() if disk is None else disk, "disk")
        todo = through_table(maintenance.reconcile(disk, self.current.files, roots), "reconcile")
        new = build_index(disk.join(todo.where("action <> 'delete'"), "path", "left_semi"), stems=self.stems)
        removed = self.current.files.join(todo.where("action = 'delete'"), "path", "left_semi").select("doc_id")
        self.apply(new, removed, todo.count())
        self._reconciled_at = time.time()
        return todo

    def refresh_if_due(self, every_s: float = 6 * 3600) -> bool:
        """The periodic full comparison with the disk, which makes up for lost events."""
        if time.time() - self._reconciled_at < every_s:
            return False
        self.refresh()
        return True

    def apply_paths(self, paths: list[str]) -> int:
        """Brings changed paths to their state on disk, whatever their events said; returns how many entries were put in or taken out.

        A path that is gone takes all below it along, a folder brings all that is in it. A file that comes with the size and time of
        one that goes in the same batch is that file renamed, and keeps its id. The paths are those of one batch of events.
        """
        entries = through_table(sources.stat(self.spark, paths, self.scope), "changed-entries")
        named = local_rows(self.spark, sorted({(p.rstrip("/"),) for p in paths}), "path string")
        gone = stream.subtree_deletes(self.current.files, named).join(entries.select("path"), "path", "left_anti")
        gone = through_table(gone.join(self.current.files.select("doc_id", "size", "mtime_ns", "is_dir"), "doc_id"), "gone")
        read = through_table(self._read(entries), "changed-files")
        fresh = read.join(self.current.files.select("path"), "path", "left_anti")
        # of several that could be the same file the smallest paths are paired
        by = Window.partitionBy("size", "mtime_ns").orderBy("path")
        old = gone.where("not is_dir and size is not null").select("size", "mtime_ns", F.col("doc_id").alias("old_id"), F.row_number().over(by).alias("k"))
        new = fresh.where("not is_dir and size is not null").select("path", "size", "mtime_ns", F.row_number().over(by).alias("k"))
        renamed = new.join(old, ["size", "mtime_ns", "k"]).select("path", "old_id")
        read = read.join(renamed, "path", "left").withColumn("doc_id", F.coalesce("old_id", "doc_id")).drop("old_id")
        n = read.count() + gone.count()
        if n:
            self.apply(build_index(read, stems=self.stems), gone.select("doc_id"), n)
        return n

    def follow(self, changes: DataFrame, checkpoint: str, once: bool = True):
        """Applies a stream of changes (path, seq, ...) batch by batch; a repeated batch reads the disk again and changes nothing."""

        def batch(latest: DataFrame, _: int) -> None:
            # the paths of one micro-batch
            self.apply_paths([r["path"] for r in latest.select("path").distinct().collect()])
            self.merge_if_due()

        return stream.apply_stream(changes, batch, checkpoint, once)

    def apply(self, new: Index, removed: DataFrame, changes: int = 1) -> None:
        """Takes a batch in: rows of ``new`` replace those of their ids, ids in ``removed`` go. ``changes`` counts its files."""
        delta, dead = maintenance.commit_batch(self.base, self.delta, self.dead, new, removed)
        # as tables: each batch starts from files, not from the plans of all batches before
        self.delta = Index(through_table(delta.files, "delta-files"), through_table(delta.postings, "delta-postings"), delta.stems)
        self.dead = through_table(dead, "dead")
        self._changes, self._current = self._changes + max(1, changes), None

    def merge(self, snapshot_seq: int = 0) -> int:
        """Writes base and delta as the next generation and removes older ones."""
        with self.store.writer() as mine:
            if not mine:
                raise IndexLocked(self.folder.uri)
            n = self.store.save(self.current, snapshot_seq)
            self.base = self.store.load()
            self.delta, self.dead = self._nothing()
            self.store.remove_old()
        self._changed_at, self._changes, self._current = time.time(), 0, None
        return n

    def close(self) -> None:
        """Removes the tables this session kept on the way; the index itself stays, and the next session starts warm."""
        drop_tables(self.spark)
        maintenance.ended(self.folder)

    def merge_if_due(self, least_postings: int = 1_000_000) -> bool:
        if maintenance.needs_merge(self.delta, least_postings) or maintenance.snapshot_due(self._changes, time.time() - self._changed_at):
            self.merge()
            return True
        return False

    def _appended(self, name: str, schema: str) -> DataFrame:
        if not self.folder.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.folder.at(name))

    def record_click(self, query: str, path: str) -> None:
        row = self.spark.createDataFrame([(query, path)], "query string, path string")
        row.select(F.current_timestamp().alias("ts"), "query", "path").coalesce(1).write.mode("append").parquet(self.folder.at("clicks"))

    @property
    def clicks(self) -> DataFrame:
        return self._appended("clicks", CLICK_SCHEMA)

    def top_queries(self, limit: int = 10) -> DataFrame:
        """``(query, clicks)`` of the queries whose results were opened most."""
        return maintenance.top_queries(self.clicks, limit)

    def search_many(self, queries: DataFrame, *, now_ns: int | None = None, **options) -> DataFrame:
        """``(query_id, rank, doc_id, path, score, exact)`` for ``(query_id, query)``."""
        counts = maintenance.click_counts(self.clicks)
        return search.search(self.current, queries, now_ns=now_ns or time.time_ns(), clicks=counts, **options)

    def search(self, query: str, *, providers: Sequence[Provider] = (), **options) -> DataFrame:
        """One query; its time and number of rows go to the log. Providers add rows from outside where the index has few."""
        began = time.time()
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        if providers and "extra_hits" not in options:
            options["extra_hits"] = client.provided(providers, asked)
        rows = self.search_many(asked, **options).drop("query_id")
        took = self.spark.createDataFrame([(int((time.time() - began) * 1000), rows.count())], "latency_ms long, result_count long")
        took.select(F.current_timestamp().alias("ts"), "latency_ms", "result_count").coalesce(1).write.mode("append").parquet(self.folder.at("query_log"))
        return rows

    def snippets(self, hits: DataFrame, query: str, shown: int = 20) -> DataFrame:
        """``(doc_id, snippet)`` for the first hits; contents are those the index was built from in this session, else they are read again from disk."""
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        contents = self.contents
        if contents is None:
            # at most ``shown`` rows
            first = hits.where(F.col("rank") <= shown).select("doc_id", "path").collect()
            there = sources.stat(self.spark, [r["path"] for r in first], Scope(roots=["/"], excludes=[], max_depth=64, index_hidden=True))
            texts = sources.extract(there.where("not is_dir")).select("path", "content")
            contents = local_rows(self.spark, [tuple(r) for r in first], "doc_id long, path string").join(texts, "path").select("doc_id", "content")
        return snippets.snippets(hits.withColumn("query_id", F.lit(0)), contents, asked, shown).drop("query_id")

    def stats(self) -> DataFrame:
        """One row of numbers on the index and its queries."""
        now = self.current
        terms = now.vocabulary.agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))
        log = self._appended("query_log", LOG_SCHEMA)
        latency = health.ranked_percentile(log.withColumn("one", F.lit(1)), "latency_ms", [50, 99])
        rate = health.zero_result_rate(log)
        return now.stats.join(F.broadcast(terms)).join(F.broadcast(latency)).join(F.broadcast(rate))

    def reconfigure(self, scope: Scope) -> DataFrame:
        """A new scope: files outside it leave the index, those of new roots come in; returns the actions taken."""
        self.scope = scope.normalised()
        self.folder.write_json("config.json", asdict(self.scope))
        out = self.current.files.where(sources.root_of(F.col("path"), self.scope).isNull()).select("doc_id")
        n = out.count()
        if n:
            self.apply(self._nothing()[0], out, n)
        return self.refresh()
