"""The change log: numbered records with checksums in segment files, checkpoints among them, replay up to the first bad record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findgrain.session import through_table
from findgrain.sources.store import Folder

#: A checkpoint record follows so many entries.
CHECKPOINT_EVERY = 256
FIELDS = ["seq", "ts", "event_type", "path", "size"]


def checksum(fields: list[str] = FIELDS) -> Column:
    """Hash of a record's fields, nulls included."""
    return F.xxhash64(*[F.coalesce(F.col(f).cast("string"), F.lit("\0")) for f in fields])


def numbered(entries: DataFrame, after: int, order: list[str]) -> DataFrame:
    """Entries ``(ts, event_type, path, size)`` with ``seq`` from ``after`` + 1 on in ``order``, and a Checkpoint record after every 256 of them.

    Range-sorted partitions number their own rows and start after those before; only their sizes meet in one place.
    """
    placed = through_table(entries.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "log-entries")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    k = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    rows = placed.join(F.broadcast(before), "part").withColumn("k", k)
    every = CHECKPOINT_EVERY
    own = F.struct((F.lit(after) + 1 + F.col("k") + F.expr(f"k div {every}")).alias("seq"), F.col("event_type"), F.col("path"), F.col("size"))
    mark = F.struct((F.lit(after) + 2 + F.col("k") + F.expr(f"k div {every}")).alias("seq"), F.lit("Checkpoint").alias("event_type"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("size"))
    both = F.when(F.pmod("k", F.lit(every)) == every - 1, F.array(own, mark)).otherwise(F.array(own))
    return rows.select("ts", F.explode(both).alias("r")).select("r.seq", "ts", "r.event_type", "r.path", "r.size")


class ChangeLog:
    """A log in a shared folder. ``segment=N`` holds the records of one append; ``log.json`` names the segments that count and the last seq."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    def _state(self) -> dict:
        return self.folder.read_json("log.json") or {"segments": [], "last": 0}

    @property
    def last_seq(self) -> int:
        return self._state()["last"]

    def append(self, entries: DataFrame, order: list[str] | None = None) -> int:
        """Writes a batch as the next segment; returns the last seq. A crash before the log names the segment leaves it out."""
        state = self._state()
        n = max([*state["segments"], *(int(d.partition("=")[2]) for d in self.folder.names() if d.startswith("segment="))], default=0) + 1
        rows = numbered(entries.select("ts", "event_type", "path", "size"), state["last"], order or ["ts", "path", "event_type"])
        rows.withColumn("checksum", checksum()).write.mode("overwrite").parquet(self.folder.at(f"segment={n}"))
        last = self.spark.read.parquet(self.folder.at(f"segment={n}")).agg(F.max("seq")).first()[0]
        if last is None:
            return state["last"]
        self.folder.write_json("log.json", {"segments": [*state["segments"], n], "last": last})
        return last

    def records(self) -> DataFrame:
        """All records, sound or not, with ``sound``."""
        at = [self.folder.at(f"segment={n}") for n in self._state()["segments"]]
        schema = "seq long, ts timestamp, event_type string, path string, size long, checksum long"
        rows = self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)
        return rows.withColumn("sound", F.col("checksum").eqNullSafe(checksum()))

    def first_bad(self) -> int | None:
        """The first seq that is unsound, missing or there twice; None for a sound log."""
        state = self._state()
        rows = self.records().where("seq is not null")
        # one row for the driver
        bad = rows.where("not sound").agg(F.min("seq")).first()[0]
        twice = rows.groupBy("seq").agg(F.count("*").alias("n")).where("n > 1").agg(F.min("seq")).first()[0]
        found = [b for b in (bad, twice) if b is not None]
        counted = rows.agg(F.countDistinct("seq").alias("n"), F.max("seq").alias("last")).first()
        if counted["n"] != state["last"]:
            # seqs are dense from 1: the first block that is short holds the first gap
            block = rows.select("seq").distinct().groupBy(F.expr("(seq - 1) div 65536").alias("b")).agg(F.count("*").alias("n"))
            have = {r["b"]: r["n"] for r in block.where("n < 65536").collect()}
            full = {r["b"] for r in block.where("n = 65536").select("b").collect()}
            b = next(i for i in range(state["last"] // 65536 + 1) if i not in full)
            inside = {r["seq"] for r in rows.where(F.expr(f"(seq - 1) div 65536 = {b}")).select("seq").distinct().collect()} if b in have else set()
            gap = next((q for q in range(b * 65536 + 1, min((b + 1) * 65536, state["last"]) + 1) if q not in inside), None)
            found += [] if gap is None else [gap]
        return min(found, default=None)

    def replay(self, after: int = 0) -> DataFrame:
        """Records after a snapshot's seq, up to the first bad one, without checkpoints."""
        bad = self.first_bad()
        rows = self.records().where((F.col("seq") > after) & ~F.col("event_type").eqNullSafe("Checkpoint"))
        return rows.where(F.col("seq") < bad).select(*FIELDS) if bad is not None else rows.select(*FIELDS)

    def recover(self) -> int:
        """Cuts the log off before its first bad record and removes what no append finished; returns the last seq that is left."""
        bad, state = self.first_bad(), self._state()
        if bad is not None:
            n = max(state["segments"], default=0) + 1
            kept = self.records().where(F.col("seq") < bad).drop("sound")
            kept.write.mode("overwrite").parquet(self.folder.at(f"segment={n}"))
            state = {"segments": [n], "last": bad - 1}
            self.folder.write_json("log.json", state)
        for d in self.folder.names():
            if d.startswith("segment=") and int(d.partition("=")[2]) not in state["segments"]:
                self.folder.delete(d)
        return state["last"]
