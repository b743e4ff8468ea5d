"""File changes as a stream: dedup per path, debounced batches, idempotent application."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE_SCHEMA = "seq long, ts timestamp, event_type string, path string, size long"
GAP_MS, CAP_MS = 300, 2_000
DEDUP_US = 100_000


def read_changes(spark: SparkSession, directory: str, schema: str = CHANGE_SCHEMA, max_files: int = 100) -> DataFrame:
    """Changes as they arrive as files in a folder; a replay reads the same folder again."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(directory)


def kept_times(us: list[int], last: int | None, width: int = DEDUP_US) -> tuple[list[bool], int | None]:
    """Which of sorted times are at least ``width`` after the last one kept."""
    keep = []
    for t in us:
        ok = last is None or t - last >= width
        keep.append(ok)
        if ok:
            last = t
    return keep, last


def dedup_stream(changes: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Drops a path's events less than 100 ms after its last kept one. State per path is one time and leaves it after the watermark."""

    def one(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        last = state.get[0] if state.exists else None
        keep, last = kept_times([t.value // 1000 for t in rows["ts"]], last)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    timed = changes.where("path is not null and ts is not null").withWatermark("ts", late)
    return timed.groupBy("path").applyInPandasWithState(one, "seq long, ts timestamp, event_type string, path string, size long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def bursts(changes: DataFrame, time_us: str, gap_us: int, block_us: int = 3_600_000_000) -> DataFrame:
    """``(path, us, seq, burst)``: events of a path cut where ``gap_us`` or more passes without one; burst is the time of its first event.

    Neighbours are looked for inside hours; ends of hours then meet per path. A path with any number of events costs one row an hour there.
    """
    rows = changes.select("path", F.col(time_us).alias("us"), "seq").where("path is not null and us is not null")
    rows = rows.withColumn("block", F.expr(f"us div {block_us}"))
    across = Window.partitionBy("path").orderBy("block")
    ends = rows.groupBy("path", "block").agg(F.max("us").alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(across)).drop("last")
    inside = Window.partitionBy("path", "block").orderBy("us", "seq")
    rows = rows.join(ends, ["path", "block"])
    rows = rows.withColumn("starts", F.coalesce(F.col("us") - F.coalesce(F.lag("us").over(inside), F.col("before")) >= gap_us, F.lit(True)))
    begun = F.when(F.col("starts"), F.col("us"))
    carried = rows.groupBy("path", "block").agg(F.max(begun).alias("b"))
    carried = carried.withColumn("carry", F.max("b").over(across.rowsBetween(Window.unboundedPreceding, -1))).drop("b")
    rows = rows.withColumn("own", F.max(begun).over(inside)).join(carried, ["path", "block"])
    return rows.select("path", "us", "seq", F.coalesce("own", "carry").alias("burst"))


def _walk_bursts(cut: DataFrame, width: int) -> DataFrame:
    """``(path, us, seq, burst, start)``: rows of ``bursts`` with the time of the row that began their part; a part begins ``width`` or more after the one before.

    The first event of a burst always begins one, so bursts stand alone; each is walked through once, in order, in partitions of
    many. A burst that never pauses is the work of one task, which holds a batch of it at a time.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, None
        for pdf in batches:
            starts = []
            for key, t in zip(zip(pdf["path"], pdf["burst"]), pdf["us"]):
                if key != at or t - last >= width:
                    at, last = key, t
                starts.append(last)
            yield pdf.assign(start=starts)[["path", "us", "seq", "burst", "start"]]

    placed = cut.repartition("path", "burst").sortWithinPartitions("path", "burst", "us", "seq")
    return placed.mapInPandas(walk, "path string, us long, seq long, burst long, start long")


def dedup_batch(changes: DataFrame, time_us: str = "us") -> DataFrame:
    """The same over a finished table: ``(path, us, seq)`` kept."""
    walked = _walk_bursts(bursts(changes, time_us, DEDUP_US), DEDUP_US)
    # of events at one time the first is kept
    first = F.row_number().over(Window.partitionBy("path", "burst", "start").orderBy("us", "seq"))
    return walked.where("us = start").withColumn("k", first).where("k = 1").select("path", "us", "seq")


def debounce(changes: DataFrame, gap_ms: int = GAP_MS, cap_ms: int = CAP_MS) -> DataFrame:
    """``(path, start, end, events)``: a path's events put together until ``gap_ms`` pass without one, or ``cap_ms`` since the first."""
    rows = changes.where("path is not null").select("path", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    walked = _walk_bursts(bursts(rows.withColumn("seq", F.col("us")), "us", gap_ms * 1000), cap_ms * 1000)
    per = walked.groupBy("path", "start").agg(F.max("us").alias("last"), F.count("*").alias("events"))
    end = F.least(F.col("last") + gap_ms * 1000, F.col("start") + cap_ms * 1000)
    return per.select("path", F.timestamp_micros("start").alias("start"), F.timestamp_micros(end).alias("end"), "events")


def debounce_stream(changes: DataFrame, gap_ms: int = GAP_MS, cap_ms: int = CAP_MS, late: str = "10 seconds") -> DataFrame:
    """``debounce`` over a stream: state per path is what is pending, and leaves when the watermark has passed its end."""

    def end_of(start: int, last: int) -> int:
        return min(last + gap_ms * 1000, start + cap_ms * 1000)

    def one(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, n = state.get if state.exists else (None, None, 0)
        done = []
        if not state.hasTimedOut:
            for t in sorted(t.value // 1000 for pdf in batches for t in pdf["ts"]):
                if start is not None and t >= end_of(start, last):
                    done.append((start, end_of(start, last), n))
                    start, n = None, 0
                if start is None:
                    start, last = t, t
                last, n = max(last, t), n + 1
        if start is not None and end_of(start, last) // 1000 < state.getCurrentWatermarkMs():
            done.append((start, end_of(start, last), n))
            start = None
        if start is None:
            if state.exists:
                state.remove()
        else:
            state.update((start, last, n))
            state.setTimeoutTimestamp(max(end_of(start, last) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame(done, columns=["start", "end", "events"])
        for c in ("start", "end"):
            out[c] = pd.to_datetime(out[c], unit="us")
        out.insert(0, "path", key[0])
        yield out

    timed = changes.where("path is not null and ts is not null").withWatermark("ts", late)
    return timed.groupBy("path").applyInPandasWithState(one, "path string, start timestamp, end timestamp, events long", "start long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def latest_per_path(changes: DataFrame) -> DataFrame:
    """The state each path is left in by its last change; earlier changes and repetitions do not matter."""
    last = changes.where("path is not null").groupBy("path").agg(F.max_by(F.struct("seq", "event_type", "size"), "seq").alias("l"))
    return last.select("path", "l.seq", "l.event_type", "l.size")


def replay_after(changes: DataFrame, seq: int, bad_seqs: DataFrame | None = None) -> DataFrame:
    """Changes after a snapshot, up to the first record that cannot be read."""
    out = changes.where(F.col("seq") > seq)
    if bad_seqs is not None:
        first = bad_seqs.where(F.col("seq") > seq).agg(F.min("seq").alias("bad"))
        out = out.join(F.broadcast(first), F.coalesce(F.col("seq") < F.col("bad"), F.lit(True))).drop("bad")
    return out


def subtree_deletes(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """Files at or below deleted paths, by an equi-join on their ancestors."""
    from findgrain.functions.paths import ancestors

    up = files.select("doc_id", "path", F.explode(ancestors(F.col("path"))).alias("gone"))
    return up.join(deleted.select(F.col("path").alias("gone")).distinct(), "gone", "left_semi").select("doc_id", "path").distinct()


def apply_stream(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs ``apply(latest state per path, batch number)`` per micro-batch; a repeated batch has its old number, so writing by number is idempotent."""

    def batch(df: DataFrame, n: int) -> None:
        apply(latest_per_path(df), n)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=f"{GAP_MS} milliseconds").start()
