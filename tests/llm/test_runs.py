import datetime as dt
import random

from pyspark.sql import functions as F

from findgrain.llm.runs import collapse_runs

SCHEMA = "key string, kind int, timestamp_us long, seq long, received_at timestamp, n int, code string, k1 string"
DAY = dt.datetime(2025, 1, 1)


def brute(rows, gap, least):
    last, by_key = {}, {}
    for i, r in enumerate(rows):
        if r[3] is not None:
            last[r[3]] = r
    for key, kind, ts, seq in sorted((r for r in last.values() if None not in r), key=lambda r: (r[0], r[2], r[3])):
        by_key.setdefault(key, []).append((ts, seq, kind))
    out = []
    for events in by_key.values():
        run = [events[0]]
        for e in events[1:]:
            if e[2] == run[-1][2] and e[0] - run[-1][0] <= gap:
                run.append(e)
            else:
                out.append(run)
                run = [e]
        out.append(run)
    return sorted((r[0][1], r[-1][1], r[0][2], len(r), r[0][0], r[-1][0]) for r in out if len(r) >= least)


def got(spark, rows, gap=10, least=1):
    df = spark.createDataFrame([(*r, DAY + dt.timedelta(seconds=i), 1, "c", "k") for i, r in enumerate(rows)], SCHEMA)
    df = df.orderBy(F.rand(1))
    return sorted(map(tuple, collapse_runs(df, F.col("key"), F.col("kind"), max_gap=gap, least=least).collect()))


def test_random_events_match_brute_force(spark):
    for seed in range(4):
        r = random.Random(seed)
        rows = [(r.choice(["a", "a", "b", None]), r.choice([1, 1, 1, 2, None]), r.choice([None, *range(0, 300, 3)]), r.choice([None, *range(200)])) for _ in range(300)]
        for least in (1, 2):
            assert got(spark, rows, least=least) == brute(rows, 10, least)


def test_one_run_over_all_chunks(spark):
    rows = [("hot", 1, i, i) for i in range(500)]
    assert got(spark, rows) == [(0, 499, 1, 500, 0, 499)]
    # repeated deliveries and equal times
    rows = [("hot", 1, 5, i % 50) for i in range(500)] + [("hot", 2, 6, 99)]
    assert got(spark, rows) == [(0, 49, 1, 50, 5, 5), (99, 99, 2, 1, 6, 6)]


def test_gap_is_inclusive_and_empty(spark):
    assert got(spark, [("a", 1, 0, 1), ("a", 1, 10, 2), ("a", 1, 21, 3)]) == [(1, 2, 1, 2, 0, 10), (3, 3, 1, 1, 21, 21)]
    assert got(spark, []) == []


def test_amended_copies_count_once(spark):
    # the last to arrive: another time, another key, another kind, nothing readable
    rows = [("a", 1, 10, 1), ("a", 1, 20, 1), ("a", 1, 25, 2), ("b", 1, 0, 3), ("a", 1, 30, 3), ("a", 1, 40, 4), ("a", 2, 40, 4), ("a", 1, 50, 5), ("a", None, 50, 5)]
    assert got(spark, rows) == [(1, 3, 1, 3, 20, 30), (4, 4, 2, 1, 40, 40)]
    # without arrival times the greatest counts, whatever the order
    df = spark.createDataFrame([("a", 1, 10, 1, None, 1, "c", "k"), ("a", 1, 20, 1, None, 1, "c", "k"), ("a", 1, 20, 1, None, 1, "c", "k")], SCHEMA)
    for arrived in ("received_at", None):
        assert [tuple(r) for r in collapse_runs(df, F.col("key"), F.col("kind"), arrived=arrived).collect()] == [(1, 1, 1, 1, 20, 20)]
