import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findgrain.llm import quantiles as q


def test_quantize_keeps_order(spark):
    whole = {0, 1, 2047, 2048, 2049, 4095, 4096, 10**6, 10**12, 2**62, 2**63 - 1, *(3**k for k in range(39))}
    fractions = {0.2, 0.9, 1e-300, 1e300, 0.1 + 0.2, 1 / 3, 2.0**-1022, 1.7976931348623157e308, *(2.0**k for k in range(-60, 60)), *(np.nextafter(2.0**k, 0) for k in range(-60, 60))}
    values = sorted({float(s * v) for v in whole | fractions for s in (1, -1)})
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").transform(lambda d: q.quantize(d, "v", "l")).orderBy("v").collect()
    leaves = [r["l"] for r in rows]
    assert leaves == sorted(leaves) and 0 < min(leaves) and max(leaves) < 2**q.LEVELS
    back = q.leaf_value(np.array(leaves))
    assert all(abs(b - v) <= abs(v) / 1024 for b, v in zip(back, values)) and all(b == v for b, v in zip(back, values) if v == int(v) and abs(v) < 2048)
    odd = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),), (float("-inf"),), (5e-324,), (-0.0,)], "v double").transform(lambda d: q.quantize(d, "v", "l")).collect()
    assert [r["l"] for r in odd[:2]] == [None, None] and list(q.leaf_value(np.array([r["l"] for r in odd[2:]]))) == [np.inf, -np.inf, 0, 0]
    longs = spark.createDataFrame([(2**63 - 1,), (-(2**63),)], "v long").transform(lambda d: q.quantize(d, "v", "l")).collect()
    assert max(r["l"] for r in longs) < 2**q.LEVELS


def digest(values, k):
    node, n = np.unique(np.array(values, dtype=np.int64), return_counts=True)
    return q.compress(np.zeros(len(node), np.int64), node, n, k)


def rank_range(nodes, rank):
    """The values that the node answering a rank may stand for."""
    level, node, n = nodes
    right = ((node + 1) << level) - 1
    order = np.lexsort((level, right))
    return int(right[order][np.searchsorted(np.cumsum(n[order]), rank, side="right")])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=400), st.integers(0, 100), st.sampled_from([40, 160, 1600]))
def test_rank_error_is_bounded(values, pct, k):
    nodes = digest(values, k)
    assert int(nodes[2].sum()) == len(values)
    rank = min(len(values) * pct // 100, len(values) - 1)
    found = rank_range(nodes, rank)
    low, high = sum(v < found for v in values), sum(v <= found for v in values)
    error = q.LEVELS * (len(values) // k) + 0
    assert low - error <= rank < high + error + 1


def test_exact_when_small(spark):
    rows = [("d1", v) for v in range(100)] + [("d2", None), ("d2", -5), (None, 7)]
    df = spark.createDataFrame(rows, "g string, v long")
    digests = q.build_digests(df, ["g"], "v")
    got = {(r["g"], r["pct"]): r["value"] for r in q.percentiles(digests, ["g"], [0, 50, 99, 100]).collect()}
    same = {(g, p): v for g, v in ((None, 7), ("d2", -5)) for p in (0, 50, 99, 100)}
    assert got == {("d1", 0): 0, ("d1", 50): 50, ("d1", 99): 99, ("d1", 100): 99} | same


def test_negative_and_fractional_values(spark):
    df = spark.createDataFrame([("g", v) for v in (-5.0, -4.0, -3.0, 0.2, 0.9, float("nan"))], "g string, v double")
    got = q.percentiles(q.build_digests(df, ["g"], "v"), ["g"], [0, 50, 99]).collect()
    assert {r["size"] for r in got} == {5} and [r["value"] for r in got[:2]] == [-5, -3] and abs(got[2]["value"] - 0.9) < 0.001


def test_rank_errors(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(f"d{i % 2}", float(v)) for i, v in enumerate(rng.normal(0, 1e4, 20_000))], "g string, v double")
    digests = q.build_digests(df, ["g"], "v", eps=0.02)
    # nodes above the leaves: there is something to be wrong
    assert digests.where("level > 0").count() > 0
    errors = q.rank_errors(q.percentiles(digests, ["g"], [1, 50, 99]), df, ["g"], "v").collect()
    assert len(errors) == 6 and all(r["size"] == 10_000 and r["error"] <= 200 for r in errors)
    wrong = spark.createDataFrame([("d0", 50, -1e9, 10_000)], "g string, pct int, value double, size long")
    assert q.rank_errors(wrong, df, ["g"], "v").first()["error"] == 5_001


def test_merge_equals_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(f"d{i % 3}", int(v)) for i, v in enumerate(rng.integers(0, 1500, 3000))]
    df = spark.createDataFrame(rows, "g string, v long")
    parts = q.build_digests(df, ["g"], "v", eps=0.01)
    merged = q.merge_digests(parts.withColumn("g", F.lit("all")), ["g"], eps=0.01)
    values = sorted(v for _, v in rows)
    for r in q.percentiles(merged, ["g"], [1, 50, 90, 99]).collect():
        at = len(values) * r["pct"] // 100
        assert values[max(0, at - 61)] <= r["value"] <= values[min(len(values) - 1, at + 61)]
        assert r["size"] == 3000


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v long")
    digests = q.build_digests(df, ["g"], "v")
    assert digests.count() == 0 and q.percentiles(q.merge_digests(digests, ["g"]), ["g"], [50]).count() == 0


def test_queries_count_once(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1, 12)
    rows = [(1, t, 5, "x"), (1, t, 5, "x"), (2, t, None, "x"), (3, t, -1, "x"), (None, t, 4, "x"), (4, None, 4, "x"), (5, t, 0, "x")]
    out = q.counted_queries(spark.createDataFrame(rows, "query_id long, ts timestamp, latency_ms long, value string"), "latency_ms").collect()
    assert sorted(map(tuple, out)) == [("2025-01-01", 0), ("2025-01-01", 5)]
