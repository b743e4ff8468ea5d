"""Processing only new or changed input: a manifest of processed files, batches written idempotently, commits last."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from findgrain.session import local_rows
from findgrain.sources.files import arrow_reads, hash_bytes
from findgrain.sources.store import Folder

LISTING = ["file", "size", "checksum"]
#: Where Spark has to read files whole to hash them, a task holds no longer one. Their hash does not depend on it.
HELD_WHOLE = 256 << 20


@F.pandas_udf(StringType())
def _hash_of(file: pd.Series) -> pd.Series:
    return file.map(hash_bytes)


def list_files(spark: SparkSession, directory: str, pattern: str = "*.parquet", known: DataFrame | None = None) -> DataFrame:
    """The listing ``(file, size, modified, checksum)`` of real files below a folder: path, length in bytes, time of change, a hash of all bytes.

    The hash is the same function of the bytes for files of any length. Executors read them piece by piece through Arrow. Where
    Arrow cannot read the file system, Spark reads them whole, and those over ``HELD_WHOLE`` piece by piece through the driver.

    ``known`` may hold a manifest: files whose path, length and time it has keep the checksum noted there, so only others are
    read, and none where all are known. Names of unknown files pass through the driver, as all names do when Spark lists a folder.
    """
    load = lambda *at: spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(list(at))
    named = [F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    names = load(directory).select(*named)
    if known is None:
        kept, unseen = None, load(directory)
    else:
        # earlier manifests note the time of long files, which tells nothing of their bytes
        hashed_then = known.where(~F.startswith("checksum", F.lit("at ")))
        noted = hashed_then.select("file", "size", "modified", "checksum").dropDuplicates(["file", "size", "modified"])
        kept = names.join(noted, ["file", "size", "modified"])
        fresh = [r["file"] for r in names.join(noted, ["file", "size", "modified"], "left_anti").select("file").collect()]
        if not fresh:
            return kept.select("file", "size", "modified", "checksum")
        unseen = load(*fresh)
    if arrow_reads(Folder(spark, directory).uri):
        hashed = unseen.select(*named, _hash_of("path").alias("checksum"))
    else:
        whole = unseen.where(F.col("length") <= HELD_WHOLE).select(*named, F.hex(F.xxhash64("content")).alias("checksum"))
        longer = unseen.where(F.col("length") > HELD_WHOLE).select(*named)
        sums = [(r["file"], Folder(spark, r["file"]).hash_bytes()) for r in longer.select("file").collect()]
        hashed = whole.unionByName(longer.join(local_rows(spark, sums, "file string, checksum string"), "file"))
    return hashed if kept is None else kept.select(hashed.columns).unionByName(hashed)


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of the listing that the manifest does not have with the same size and checksum."""
    same = [listing[c].eqNullSafe(manifest[c]) for c in LISTING]
    return listing.join(manifest.select(*LISTING).distinct(), same[0] & same[1] & same[2], "left_anti")


class BatchStore:
    """Results, manifest and seen versions of an incremental job in a shared folder.

    Every attempt at batch N writes folders of its own below ``batch=N/``: ``rows``, ``manifest`` (the files it took in) and
    ``seen`` (key and version of what it processed). ``commits/N`` is created last, whole and only once, and names the
    attempt that counts: a batch without it never happened, and what other attempts wrote is never read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)
        self.root = self.folder.uri

    def committed(self) -> list[int]:
        return sorted(int(n) for n in self.folder.names("commits") if n.isdigit())

    def next_batch(self) -> int:
        done = self.committed()
        return done[-1] + 1 if done else 0

    def attempt(self) -> tuple[int, str]:
        """The number of the next batch and the folder of a new attempt at it."""
        batch = self.next_batch()
        return batch, f"{self.root}/batch={batch}/{uuid.uuid4().hex}"

    def commit(self, batch: int, at: str) -> None:
        if not self.folder.create_json(f"commits/{batch}", {"attempt": at.rpartition("/")[2]}):
            raise ValueError(f"batch {batch} was committed by another run")

    def _at(self, batch: int) -> str:
        made = self.folder.read_json(f"commits/{batch}")
        if made is None:
            raise ValueError(f"batch {batch} is not committed")
        return f"{self.root}/batch={batch}/{made['attempt']}"

    def _all(self, part: str) -> DataFrame | None:
        found = [f"batch={n}/{self._at(n).rpartition('/')[2]}/{part}" for n in self.committed()]
        found = [self.folder.at(f) for f in found if self.folder.exists(f)]
        return self.spark.read.parquet(*found) if found else None

    def manifest(self) -> DataFrame | None:
        """Every file taken in by a committed batch, as it was then."""
        return self._all("manifest")

    def seen(self) -> DataFrame | None:
        return self._all("seen")

    def rows(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self._at(batch)}/rows")

    def all_rows(self) -> DataFrame | None:
        return self._all("rows")


def _todo(store: BatchStore, listing: DataFrame) -> DataFrame:
    manifest = store.manifest()
    return listing if manifest is None else changed_files(listing, manifest)


def process_new_files(spark: SparkSession, store: BatchStore, listing: DataFrame, work: Callable[[DataFrame], DataFrame]) -> int | None:
    """One run over files: takes those the manifest lacks, writes ``work(listing of them)`` as the next batch, commits.

    Returns the batch number, or None where nothing is new. A failure anywhere before the commit leaves the store as it was.
    """
    todo = _todo(store, listing)
    batch, at = store.attempt()
    todo.write.parquet(f"{at}/manifest")
    todo = spark.read.parquet(f"{at}/manifest")
    if todo.isEmpty():
        return None
    work(todo).write.parquet(f"{at}/rows")
    store.commit(batch, at)
    return batch


def last_success(runs: DataFrame) -> DataFrame:
    """One row ``upto``: up to where the input was read by a run that succeeded and finished; null where none did."""
    done = (F.lower(F.trim("status")) == "succeeded") & F.col("finished_at").isNotNull()
    return runs.where(done).agg(F.max("read_upto").alias("upto"))


def _write_seen(pairs: DataFrame, at: str) -> None:
    # sorted by key: a later run reads the row groups of its own keys only
    pairs.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{at}/seen")


def _pairs(rows: DataFrame, key: str, version: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(version).alias("version")).distinct()


def adopt(store: BatchStore, rows: DataFrame, taken: DataFrame, *, key: str, version: str) -> int:
    """Takes over the work of runs before the store was there: ``rows`` they processed, and the listing of files they had read to the end.

    Commits a batch without rows of its own.
    """
    batch, at = store.attempt()
    _write_seen(_pairs(rows, key, version), at)
    taken.select("file", "size", "modified", "checksum").write.parquet(f"{at}/manifest")
    store.commit(batch, at)
    return batch


def new_entries(store: BatchStore, listing: DataFrame, read: Callable[[list[str]], DataFrame], *, key: str = "seq", version: str = "mtime_ns") -> int | None:
    """One run over a log kept in files: the number of its batch, whose rows are ``(key)`` once each, new or in a new version; None where no file is new.

    Files that the manifest has with their size and checksum are not looked at again. ``read(names)`` gives the rows of the others.
    A key and version that a committed batch has seen is not processed again, null being a version like others: so files
    that grow, or are delivered twice, bring their new entries only. Attempt, manifest and seen versions are written
    before the one commit that makes them count; after a failure anywhere the next run does the same work again.

    Rows without key are left out. Repeated rows and repeated deliveries change nothing. Versions seen before are read only
    in the range of the new keys. Names of changed files and the ends of that range come to the driver.
    """
    spark = store.spark
    todo = _todo(store, listing)
    batch, at = store.attempt()
    todo.select("file", "size", "modified", "checksum").write.parquet(f"{at}/manifest")
    names = [r["file"] for r in spark.read.parquet(f"{at}/manifest").select("file").collect()]
    if not names:
        return None
    seen = store.seen()
    fresh = _pairs(read(names), key, version)
    if seen is not None:
        fresh.write.parquet(f"{at}/candidates")
        fresh = spark.read.parquet(f"{at}/candidates")
        ends = fresh.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
        seen = seen.where(F.col("key").between(ends["low"], ends["high"])) if ends["low"] is not None else seen.limit(0)
        fresh = fresh.join(seen, fresh["key"].eqNullSafe(seen["key"]) & fresh["version"].eqNullSafe(seen["version"]), "left_anti")
    _write_seen(fresh, at)
    spark.read.parquet(f"{at}/seen").select(F.col("key").alias(key)).distinct().write.parquet(f"{at}/rows")
    store.commit(batch, at)
    return batch
