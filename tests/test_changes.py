import random

from findgrain.operators.changes import apply_changes

SCHEMA = "doc_id long, seq long, path string, is_delete boolean, received_at long, k string, m int, block string"


def run(spark, rows, base=None, block=4):
    full = [(*r, "x", 7, "y") for r in rows]
    out = apply_changes(spark.createDataFrame(full, SCHEMA), base, block=block).collect()
    return sorted(((r["doc_id"], r["path"]) for r in out), key=repr)


def brute(rows, base=()):
    """State by plain replay of one copy per seq."""
    copies = {}
    for k, s, p, d, at in rows:
        if None in (k, s, d):
            continue
        rank = (at is not None, at or 0, p is not None, p or "", k, d)
        if s not in copies or rank > copies[s][0]:
            copies[s] = (rank, k, p, d)
    state = dict(base)
    for s in sorted(copies):
        _, k, p, d = copies[s]
        if d:
            state.pop(k, None)
        else:
            state[k] = p
    return sorted(state.items(), key=repr)


def test_random_feeds_match_replay(spark):
    for seed in range(4):
        r = random.Random(seed)
        rows = [(r.choice([1, 1, 1, 2, 3, None]), r.randrange(40), r.choice(["a", "b", None, ""]), r.random() < 0.3, r.randrange(3)) for _ in range(120)]
        assert run(spark, rows) == brute(rows)


def test_base_and_negative_seqs(spark):
    base = spark.createDataFrame([(1, "old"), (9, "kept"), (2, "gone")], "doc_id long, path string")
    rows = [(1, -5, "new", False, 1), (2, 3, None, True, 1), (7, 2, "fresh", False, 1), (1, -5, "new", False, 1)]
    assert run(spark, rows, base) == brute(rows, [(1, "old"), (9, "kept"), (2, "gone")])


def test_empty_feed(spark):
    assert run(spark, []) == []
    base = spark.createDataFrame([(1, "old")], "doc_id long, path string")
    assert run(spark, [], base) == [(1, "old")]


def test_batches_equal_one_run(spark):
    r = random.Random(5)
    rows = [(r.randrange(4), s, r.choice("abc"), r.random() < 0.3, 0) for s in range(60)]
    first = spark.createDataFrame(run(spark, rows[:30]), "doc_id long, path string")
    assert run(spark, rows[30:], first) == run(spark, rows)
