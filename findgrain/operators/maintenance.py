"""Keeping an index current: differences to the disk, stable ids, generations with delta and dead set."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findgrain.operators.index import Index, Lookups, lookups, vocabulary
from findgrain.sources.store import Folder


def reconcile(disk: DataFrame, indexed: DataFrame, readable_roots: list[str] | None = None) -> DataFrame:
    """``(path, action)`` that brings the index to the state of the disk: add, delete or update; unchanged files have no row.

    Unchanged is the same size and time. With ``readable_roots``, rows of other roots are kept: an unreadable root is no deletion.
    """
    d = disk.select("path", F.struct("size", "mtime_ns").alias("d"))
    i = indexed.select("path", "root", F.struct("size", "mtime_ns").alias("i"))
    both = d.join(i, "path", "full_outer")
    gone = F.col("d").isNull()
    if readable_roots is not None:
        gone = gone & F.col("root").isin(readable_roots)
    action = (
        F.when(F.col("i").isNull(), "add").when(gone, "delete").when(F.col("d").isNotNull() & ~F.col("d").eqNullSafe(F.col("i")), "update")
    )
    return both.withColumn("action", action).where("action is not null").select("path", "action")


def path_differences(disk: DataFrame, indexed: DataFrame) -> DataFrame:
    """Differences by path alone: ``(path, action)`` of add and delete."""
    d, i = disk.select("path").distinct(), indexed.select("path").distinct()
    return d.join(i, "path", "left_anti").withColumn("action", F.lit("add")).unionByName(i.join(d, "path", "left_anti").withColumn("action", F.lit("delete")))


def allocate_ids(known: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """``key`` columns with ``doc_id``: known ids stay, new keys get the next ones in order of the key.

    Ids are dense: range-sorted partitions number their own rows and start after the rows of those before.
    """
    same = [known[k].eqNullSafe(seen[k]) for k in key]
    on = same[0]
    for s in same[1:]:
        on = on & s
    new = seen.select(*key).distinct().join(known, on, "left_anti")
    top = known.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("top")).first()["top"]
    placed = new.repartitionByRange(*key).withColumn("part", F.spark_partition_id())
    # the sort decides the partition, so part and the order inside it are those of the keys
    from findgrain.session import through_table

    placed = through_table(placed, "new-ids")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*key))).join(F.broadcast(before), "part")
    ids = numbered.select(*key, (F.lit(top) + F.col("before") + F.col("k")).cast("long").alias("doc_id"))
    return known.select(*key, "doc_id").unionByName(ids)


def live_postings(base: DataFrame, delta: DataFrame, dead: DataFrame) -> DataFrame:
    """Postings of an immutable base without the dead, and of the delta."""
    return base.join(dead.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(delta)


def commit_batch(index: Index, delta: Index, dead: DataFrame, new: Index, removed: DataFrame) -> tuple[Index, DataFrame]:
    """Delta and dead set after a batch: rows of ``new`` replace those of their ids, ids in ``removed`` go; of files with one id the first path counts."""
    first = Window.partitionBy("doc_id").orderBy("path")
    files = new.files.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    gone = removed.select("doc_id").unionByName(files.select("doc_id")).distinct()
    postings = delta.postings.join(gone, "doc_id", "left_anti").unionByName(new.postings)
    kept = delta.files.join(gone, "doc_id", "left_anti").unionByName(files)
    return Index(kept, postings, index.stems), dead.select("doc_id").unionByName(gone).distinct()


def merged(base: Index, delta: Index, dead: DataFrame) -> Index:
    """The next generation: base without the dead, and delta."""
    d = dead.select("doc_id").distinct()
    files = base.files.join(d, "doc_id", "left_anti").unionByName(delta.files)
    return Index(files, live_postings(base.postings, delta.postings, dead), base.stems)


def needs_merge(delta: Index, least_postings: int) -> bool:
    return delta.postings.limit(least_postings).count() >= least_postings


def migration(index_version: int, code_version: int) -> str:
    """What an index of another version needs."""
    return "none" if index_version == code_version else "additive" if index_version > code_version else "rebuild"


def snapshot_due(changes: int, since_s: float, on_mains: bool = True) -> bool:
    return changes > 0 and (since_s >= 1800 or on_mains and since_s >= 300 or changes >= 5000)


def _checksum(table: DataFrame) -> str:
    """Number and hash of a table's rows, whatever their order; repeated rows count."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(table.columns)])
    row = table.select(h.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").bitwiseAND(F.lit(0x7FFFFFFF))).alias("s")).first()
    return f"{row['n']}-{row['x'] or 0}-{row['s'] or 0}"


class Generations:
    """Index generations in a folder all executors share: tables are written under a new number, then the manifest is swapped.

    A reader that holds an old generation keeps it until ``remove_old``; a crash before the swap leaves the old manifest.
    """

    VERSION = 3

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    @property
    def manifest(self) -> dict | None:
        """The manifest of an index that this code can read: of its own version, or of a later one, which has more."""
        found = self.folder.read_json("manifest.json")
        return found if found and migration(found["version"], self.VERSION) != "rebuild" else None

    def back_up(self) -> str | None:
        """Keeps the manifest of an index that must be built anew; its generation stays until ``remove_old`` after the next ``save``."""
        found = self.folder.read_json("manifest.json")
        if found is None or self.manifest is not None:
            return None
        name = f"backup-version={found['version']}.json"
        self.folder.write_json(name, found)
        return name

    def save(self, index: Index, snapshot_seq: int = 0) -> int:
        self.back_up()
        old = self.folder.read_json("manifest.json")
        n = (old["generation"] if old else 0) + 1
        at = self.folder.at(f"generation={n}")
        # sorted by term: a lookup reads the row groups of its terms only
        postings = index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
        postings.write.mode("overwrite").parquet(f"{at}/postings")
        files = index.files.repartitionByRange("path").sortWithinPartitions("path", "doc_id")
        files.write.mode("overwrite").parquet(f"{at}/files")
        written = self.spark.read.parquet(f"{at}/postings")
        vocabulary(written).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/vocabulary")
        kept, terms = self.spark.read.parquet(f"{at}/files"), self.spark.read.parquet(f"{at}/vocabulary")
        for name, table in lookups(kept, terms).named().items():
            first = table.columns[0]
            table.repartitionByRange(first).sortWithinPartitions(first).write.mode("overwrite").parquet(f"{at}/{name}")
        count = kept.count()
        sums = {"postings": _checksum(written), "files": _checksum(kept)}
        new = {"checksums": sums, "version": self.VERSION, "generation": n, "stems": index.stems, "snapshot_seq": snapshot_seq, "doc_count": count, "written_at": int(time.time())}
        self.folder.write_json("manifest.json", new)
        return n

    def load(self, verify: bool = False) -> Index | None:
        m = self.manifest
        if m is None:
            return None
        at = self.folder.at(f"generation={m['generation']}")
        files = self.spark.read.parquet(f"{at}/files")
        if verify:
            sound = files.count() == m["doc_count"] and all(_checksum(self.spark.read.parquet(f"{at}/{name}")) == s for name, s in m.get("checksums", {}).items())
            if not sound:
                return None
        table = lambda name: self.spark.read.parquet(f"{at}/{name}")
        found_by = Lookups({name: table(name) for name in Lookups.NAMES})
        return Index(files, table("postings"), m["stems"], table("vocabulary"), found_by)

    def remove_old(self) -> list[str]:
        m = self.manifest
        keep = f"generation={m['generation']}" if m else ""
        old = [d for d in self.folder.names() if d.startswith("generation=") and d != keep]
        for d in old:
            self.folder.delete(d)
        return old

    @contextmanager
    def writer(self, stale_s: int = 6 * 3600):
        """The one writer; yields False to a second one, which may only read. A lock older than ``stale_s`` was left by a crash."""
        held = self.folder.read_json("lock")
        if held and time.time() - held["at"] > stale_s:
            self.folder.delete("lock")
        mine = self.folder.create("lock")
        if mine:
            self.folder.write_json("lock", {"at": time.time()})
        try:
            yield mine
        finally:
            if mine:
                self.folder.delete("lock")


def startup(folder: Folder) -> str:
    """How the last session in a folder ended: ``first`` (there was none), ``warm`` (in order) or ``crash`` (its marker is still there). Sets the marker of this one."""
    known = folder.exists("manifest.json") or folder.exists("ended")
    how = "crash" if folder.exists("running") else "warm" if known else "first"
    folder.create("running")
    return how


def ended(folder: Folder) -> None:
    """An orderly end: takes the marker away."""
    folder.create("ended")
    folder.delete("running")


def recover(store: Generations) -> list[str]:
    """After a crash: removes what was half written (generations the manifest does not name, files not yet renamed); returns what went."""
    gone = store.remove_old()
    m = store.manifest
    for name in store.folder.names():
        half = name.startswith(("manifest.json.", "config.json.", "lock."))
        if half or (m is None and name.startswith("generation=")):
            store.folder.delete(name)
            gone.append(name)
    return gone


def cancelled(spark: SparkSession, tag: str) -> None:
    """Stops the running jobs of a search started under ``running(spark, tag)``."""
    spark.sparkContext.cancelJobsWithTag(tag)


@contextmanager
def running(spark: SparkSession, tag: str):
    """Jobs started inside carry a tag by which another thread can stop them: a newer query makes an older one stale."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def permission_changes(log: DataFrame) -> DataFrame:
    """``(path, seq, was, mode)``: the audit of permissions ``(path, seq, mode)``: every change of a path's mode, its first one with ``was`` null.

    Repeated deliveries and changes to the same mode are none; rows without path or mode say nothing.
    """
    once = log.where("path is not null and mode is not null").groupBy("path", "seq").agg(F.max("mode").alias("mode"))
    # neighbours inside blocks of numbers, then the ends of blocks: a path with any number of changes costs a row a block there
    once = once.withColumn("block", F.expr("(seq - pmod(seq, 65536)) div 65536"))
    ends = once.groupBy("path", "block").agg(F.max(F.struct("seq", "mode")).alias("e"))
    ends = ends.select("path", "block", F.lag("e.mode").over(Window.partitionBy("path").orderBy("block")).alias("before"))
    rows = once.join(ends, ["path", "block"])
    was = F.coalesce(F.lag("mode").over(Window.partitionBy("path", "block").orderBy("seq")), F.col("before"))
    return rows.withColumn("was", was).where("was is null or was <> mode").select("path", "seq", "was", "mode")


def permission_state(log: DataFrame, needed: int = 0o400) -> DataFrame:
    """``(path, mode, readable)``: the last mode of each path and whether it has the bits ``needed``."""
    last = log.where("path is not null and mode is not null").groupBy("path").agg(F.max(F.struct("seq", "mode")).alias("l"))
    return last.select("path", F.col("l.mode").alias("mode"), (F.col("l.mode").bitwiseAND(needed) == needed).alias("readable"))


def prefix_cache(files: DataFrame, k: int, longest: int = 4) -> DataFrame:
    """``(prefix, rank, doc_id)``: for every prefix of one to four letters of a path component the ``k`` greatest ids."""
    parts = F.explode(F.array_distinct(F.filter(F.split(F.lower("path"), "/"), lambda c: c != "")))
    rows = files.select("doc_id", parts.alias("c"))
    prefixes = rows.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("c"), F.lit(longest))), lambda n: F.substring(F.col("c"), F.lit(1), n))).alias("prefix")).distinct()
    top = Window.partitionBy("prefix").orderBy(F.desc("doc_id"))
    return prefixes.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("prefix", "rank", "doc_id")


def click_counts(clicks: DataFrame) -> DataFrame:
    """``(path, clicks)``: clicks of each path and of every folder above it."""
    from findgrain.functions.paths import ancestors

    once = clicks.where("path is not null").groupBy("path").agg(F.count("*").alias("n"))
    return once.select(F.explode(ancestors(F.col("path"))).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("clicks"))


def top_queries(clicks: DataFrame, limit: int) -> DataFrame:
    """``(query, clicks)``: the queries as typed whose results were opened most; ties go to the smaller text."""
    per = clicks.where("query is not null").groupBy("query").agg(F.count("*").alias("clicks"))
    return per.orderBy(F.desc("clicks"), "query").limit(limit)


def top_paths(clicks: DataFrame, limit: int) -> DataFrame:
    """``(path, clicks)``: the paths and folders above them that were opened most; ties go to the smaller path."""
    return click_counts(clicks).orderBy(F.desc("clicks"), "path").limit(limit)


def postings_bytes(postings: DataFrame) -> DataFrame:
    """One row ``(bytes)``: what postings take in memory at a rate of 48 bytes and its letters a term and 16 a posting."""
    per = postings.groupBy("term").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum(F.octet_length("term") + 48 + 16 * F.col("n")), F.lit(0)).alias("bytes"))


def hits_in_scope(hits: DataFrame, files: DataFrame, scope: str) -> DataFrame:
    """Hits of files at or below a folder."""
    from findgrain.functions.paths import under

    return hits.join(files.where(under(F.col("path"), scope)).select("doc_id"), "doc_id", "left_semi")


def recent_folders(clicks: DataFrame, n: int = 3) -> DataFrame:
    """Folders of the last ``n`` distinct clicked paths; of clicks at one time the later number, then the greater path counts."""
    last = clicks.groupBy("path").agg(F.max(F.struct("ts", "click_id")).alias("at"))
    return last.orderBy(F.desc("at"), F.desc("path")).limit(n).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
