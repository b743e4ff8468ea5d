"""Runs of repeated consecutive events, by associative run summaries over range-sorted chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findgrain.session import through_table

RUN_SCHEMA = (
    "k1 long, k2 long, code int, first_ts long, first_seq long, last_ts long, last_seq long, n long, "
    "chunk_first boolean, chunk_last boolean"
)
COLUMNS = [c.split()[0] for c in RUN_SCHEMA.split(", ")]


def _encode(max_gap: int, least: int):
    """Encodes one sorted chunk, batch by batch; the last run of a batch stays open for the next one."""

    def chunk(batches):
        open_run, is_first = None, True
        for pdf in batches:
            if pdf.empty:
                continue
            a = {c: pdf[c].to_numpy() for c in ("k1", "k2", "ts", "seq", "code")}
            size = len(pdf)
            start = np.ones(size, bool)
            start[1:] = (
                (a["k1"][1:] != a["k1"][:-1])
                | (a["k2"][1:] != a["k2"][:-1])
                | (a["code"][1:] != a["code"][:-1])
                | (a["ts"][1:] - a["ts"][:-1] > max_gap)
            )
            at = np.flatnonzero(start)
            end = np.append(at[1:], size) - 1
            runs = pd.DataFrame(
                {
                    "k1": a["k1"][at],
                    "k2": a["k2"][at],
                    "code": a["code"][at],
                    "first_ts": a["ts"][at],
                    "first_seq": a["seq"][at],
                    "last_ts": a["ts"][end],
                    "last_seq": a["seq"][end],
                    "n": end - at + 1,
                    "chunk_first": False,
                    "chunk_last": False,
                }
            )
            if open_run is not None:
                head = runs.iloc[0]
                if (
                    all(head[c] == open_run[c] for c in ("k1", "k2", "code"))
                    and head["first_ts"] - open_run["last_ts"] <= max_gap
                ):
                    for c in ("first_ts", "first_seq"):
                        runs.loc[0, c] = open_run[c]
                    runs.loc[0, "n"] += open_run["n"]
                    runs.loc[0, "chunk_first"] = open_run["chunk_first"]
                else:
                    runs = pd.concat([pd.DataFrame([open_run])[COLUMNS], runs], ignore_index=True)
            else:
                runs.loc[0, "chunk_first"] = is_first
            is_first = False
            open_run = runs.iloc[-1].to_dict()
            done = runs.iloc[:-1]
            yield done[(done["n"] >= least) | done["chunk_first"]]
        if open_run is not None:
            open_run["chunk_last"] = True
            yield pd.DataFrame([open_run])[COLUMNS]

    return chunk


def collapse_runs(
    events: DataFrame,
    key: Column,
    kind: Column,
    *,
    ts: str = "timestamp_us",
    seq: str = "seq",
    arrived: str | None = "received_at",
    max_gap: int = 2_000_000,
    least: int = 1,
) -> DataFrame:
    """One row per run ``(first_seq, last_seq, kind, n, first_ts, last_ts)``.

    A run is a longest stretch of entries of one key, ordered by (``ts``, ``seq``), of the same ``kind`` (an int code) and each at
    most ``max_gap`` after the one before. Runs shorter than ``least`` are left out.

    * One row per seq counts: of copies, amended or not, the one that arrived last, then the one greatest in key hash, time and kind.
      Without ``arrived`` (None) only the latter decides. Rows without seq are left out.
    * Rows whose key, kind or time is null then are left out before runs are formed.
    * Equal times are ordered by seq. No rows give no runs. Other columns are ignored.

    Copies meet in a shuffle by seq. Rows are then range-partitioned by (key, time, seq), so a key with a third of all rows
    spreads over many chunks. Each chunk is encoded on its own in one pass; the first and last run of each chunk then meet
    their neighbours: at most two rows a chunk. A key takes part as two 64-bit hashes, so that rows are five numbers wide.
    """
    hashed = [F.when(key.isNotNull(), F.xxhash64(key)).alias("k1"), F.when(key.isNotNull(), F.xxhash64(F.lit("second"), key)).alias("k2")]
    at = F.lit(None).cast("timestamp") if arrived is None else F.col(arrived)
    rows = events.select(*hashed, kind.cast("int").alias("code"), F.col(ts).cast("long").alias("ts"), F.col(seq).cast("long").alias("seq"), at.alias("arrived")).where("seq is not null")
    last = Window.partitionBy("seq").orderBy(F.desc_nulls_last("arrived"), *[F.desc_nulls_last(c) for c in ("k1", "k2", "ts", "code")])
    once = rows.repartition("seq").withColumn("copy", F.row_number().over(last)).where("copy = 1").drop("copy", "arrived")
    once = once.where("k1 is not null and code is not null and ts is not null")
    chunks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["k1", "k2", "ts", "seq"]
    coded = (
        once.repartitionByRange(chunks, *order)
        .sortWithinPartitions(*order)
        .mapInPandas(_encode(max_gap, least), RUN_SCHEMA)
    )
    # as a table: encoded once, and both readers below see the same chunks, whose bounds come from a sample
    return merge_edges(through_table(coded, "run-chunks"), max_gap, least)


def merge_edges(coded: DataFrame, max_gap: int, least: int) -> DataFrame:
    """The parallel prefix merge: last runs of chunks join compatible first runs of the chunks that follow."""
    is_edge = F.col("chunk_first") | F.col("chunk_last")
    inner = coded.where(~is_edge & (F.col("n") >= least))
    by_key = Window.partitionBy("k1", "k2").orderBy("first_ts", "first_seq")
    was = F.lag(F.struct("code", "last_ts", "chunk_last")).over(by_key)
    joins = (
        F.col("was").isNotNull()
        & F.col("was.chunk_last")
        & F.col("chunk_first")
        & (F.col("was.code") == F.col("code"))
        & (F.col("first_ts") - F.col("was.last_ts") <= max_gap)
    )
    edges = (
        coded.where(is_edge)
        .withColumn("was", was)
        .withColumn("run", F.sum(F.when(joins, 0).otherwise(1)).over(by_key))
        .groupBy("k1", "k2", "run")
        .agg(
            F.first("code").alias("code"),
            F.min(F.struct("first_ts", "first_seq")).alias("f"),
            F.max(F.struct("last_ts", "last_seq")).alias("l"),
            F.sum("n").alias("n"),
        )
        .where(F.col("n") >= least)
        .select("code", F.col("f.first_ts").alias("first_ts"), F.col("f.first_seq").alias("first_seq"), F.col("l.last_ts").alias("last_ts"), F.col("l.last_seq").alias("last_seq"), "n")
    )
    return (
        inner.select(edges.columns)
        .unionByName(edges)
        .select("first_seq", "last_seq", F.col("code").alias("kind"), "n", "first_ts", "last_ts")
    )
