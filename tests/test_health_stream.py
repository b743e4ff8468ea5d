import random

from pyspark.sql import functions as F

from findgrain.operators import health, maintenance
from findgrain.streaming import changes as stream


def test_percentile_matches_sorting(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.choice([None, *range(20)])) for _ in range(200)]
    got = {x["g"]: (x["p50"], x["p99"]) for x in health.ranked_percentile(spark.createDataFrame(rows, "g string, v int"), "v", [50, 99], ["g"]).collect()}
    for g in "ab":
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (v[len(v) * 50 // 100], v[len(v) * 99 // 100])


def test_rates(spark):
    log = spark.createDataFrame([(0,), (1,), (None,)], "result_count int")
    assert health.zero_result_rate(log).first()["zero_rate"] == 0.5
    assert health.zero_result_rate(log.limit(0)).first()["zero_rate"] == 0.0
    schema = "path string, mtime_ns long"
    row = health.integrity(spark.createDataFrame([("a", 1), ("b", 2)], schema), spark.createDataFrame([("b", 3)], schema)).first()
    assert (row["phantom_rate"], row["stale_rate"], row["reconcile"]) == (0.5, 0.5, True)
    files = spark.createDataFrame([(1,)], "x int")
    assert health.content_coverage(files, F.lit(False), F.lit(False)).first()["coverage"] == 1.0


def test_sequence_breaks(spark):
    seqs = [1, 2, 3, 7, 8, 8, 20]
    got = health.sequence_breaks(spark.createDataFrame([(s,) for s in seqs], "seq long"), block=4)
    assert sorted(map(tuple, got.collect())) == [(3, 7), (8, 20)]


def rbo(a, b, p=0.9):
    n, total, both = max(len(a), len(b)), 0.0, 0
    if not n:
        return 1.0
    for d in range(1, n + 1):
        both = len(set(a[:d]) & set(b[:d]))
        total += both / d * p ** (d - 1)
    return (1 - p) * total + both / n * p**n


def test_rbo(spark):
    lists = {1: ([1, 2, 3, 4], [1, 2, 3, 4]), 2: ([1, 2, 3], [3, 9, 1, 7]), 3: ([1], [2])}
    rank = lambda side: spark.createDataFrame([(k, i + 1, x) for k, v in lists.items() for i, x in enumerate(v[side])], "list_id int, rank int, doc_id int")
    scores = health.rank_biased_overlap(rank(0), rank(1))
    got = {r["list_id"]: r["rbo"] for r in scores.collect()}
    assert all(abs(got[k] - rbo(*v)) < 1e-12 for k, v in lists.items()) and abs(got[1] - 1) < 1e-12
    assert health.shadow_gate(scores).first()["passes"] is False


def test_ids(spark):
    known = spark.createDataFrame([(1, 5, 40), (None, 6, 41)], "vol long, ino long, doc_id long")
    seen = spark.createDataFrame([(1, 5), (None, 6), (2, 9), (1, 7), (1, 7)], "vol long, ino long")
    got = {(r["vol"], r["ino"]): r["doc_id"] for r in maintenance.allocate_ids(known, seen, ["vol", "ino"]).collect()}
    assert got == {(1, 5): 40, (None, 6): 41, (1, 7): 42, (2, 9): 43}


def test_batch_dedup_matches_walk(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randrange(0, 40) * 30_000, i) for i in range(120)] + [("a", 7_200_000_000, 900), ("a", 7_199_950_000, 901)]
    want = []
    for p in "ab":
        last = None
        for _, t, s in sorted((x for x in rows if x[0] == p), key=lambda x: x[1:]):
            if last is None or t - last >= 100_000:
                want.append((p, t, s))
                last = t
    got = stream.dedup_batch(spark.createDataFrame(rows, "path string, us long, seq long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert stream.dedup_batch(spark.createDataFrame([], "path string, us long, seq long")).count() == 0


def test_stream_applies_latest_state_once(spark, tmp_path):
    data, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    seen = []
    make = lambda rows: spark.createDataFrame(rows, "seq long, us long, event_type string, path string, size long").select("seq", F.timestamp_micros("us").alias("ts"), "event_type", "path", "size").coalesce(1).write.mode("append").parquet(data)
    apply = lambda df, n: seen.extend((n, r["path"], r["seq"]) for r in df.collect())
    make([(1, 1, "Created", "/a", 1), (2, 2, "Modified", "/a", 2), (3, 3, "Created", "/b", 1)])
    stream.apply_stream(stream.read_changes(spark, data), apply, ck).awaitTermination()
    make([(4, 4, "Deleted", "/b", 1)])
    stream.apply_stream(stream.read_changes(spark, data), apply, ck).awaitTermination()
    assert sorted(seen) == [(0, "/a", 2), (0, "/b", 3), (1, "/b", 4)]


def test_stream_dedup(spark, tmp_path):
    data = str(tmp_path / "in")
    day = 86_400_000_000
    rows = [(1, day, "M", "/a", 1), (2, day + 50_000, "M", "/a", 1), (3, day + 100_000, "M", "/a", 1), (4, day + 60_000, "M", "/b", 1)]
    spark.createDataFrame(rows, "seq long, us long, event_type string, path string, size long").select("seq", F.timestamp_micros("us").alias("ts"), "event_type", "path", "size").coalesce(1).write.parquet(data)
    q = stream.dedup_stream(stream.read_changes(spark, data)).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["seq"] for r in spark.table("kept").collect()) == [1, 3, 4]


def test_replay_and_subtree(spark):
    log = spark.createDataFrame([(i,) for i in range(10)], "seq long")
    bad = spark.createDataFrame([(2,), (7,)], "seq long")
    assert sorted(r["seq"] for r in stream.replay_after(log, 3, bad).collect()) == [4, 5, 6]
    assert stream.replay_after(log, 3, bad.limit(0)).count() == 6
    files = spark.createDataFrame([(1, "/u/project/a"), (2, "/u/project-notes/a"), (3, "/u/project")], "doc_id long, path string")
    gone = spark.createDataFrame([("/u/project",)], "path string")
    assert sorted(r["doc_id"] for r in stream.subtree_deletes(files, gone).collect()) == [1, 3]
