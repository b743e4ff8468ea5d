import random
from datetime import datetime, timedelta

from findgrain.operators.snapshots import list_sizes, reconciliation_lists, snapshot_changes

SCHEMA = "snapshot_id int, taken_at timestamp, path string, size long, mtime_ns long, content_hash long, walked_at long, root string, idx int, change string"


def table(spark, rows):
    return spark.createDataFrame([(s, None if s is None else datetime(2025, 1, 30) - timedelta(days=s), p, z, m, h, w, "r", 1, "x") for s, p, z, m, h, w in rows], SCHEMA)


def brute(rows):
    snaps, states = sorted({r[0] for r in rows if r[0] is not None}, reverse=True), {}
    for s, p, z, m, h, w in rows:
        if s is None or p is None:
            continue
        mm = None if m is None else int(m / 1000)
        # nulls count lowest; the greatest attributes win a tie
        key = tuple((x is not None, x or 0) for x in (w, z, h, mm))
        old = states.setdefault(s, {}).get(p)
        if old is None or key[0] > old[0][0]:
            states[s][p] = (key, z, h, mm)
    out = []
    for a, b in zip(snaps, snaps[1:]):
        x, y = states.get(a, {}), states.get(b, {})
        out += [(b, p, "added") for p in y if p not in x] + [(b, p, "removed") for p in x if p not in y]
        for p in x.keys() & y.keys():
            (_, z1, h1, m1), (_, z2, h2, m2) = x[p], y[p]
            if None not in (z1, z2) and z1 != z2 or None not in (h1, h2) and h1 != h2 or m1 != m2:
                out.append((b, p, "changed"))
    return sorted(out)


def got(spark, rows):
    return sorted((r["snapshot_id"], r["path"], r["change"]) for r in snapshot_changes(table(spark, rows)).collect())


def test_matches_brute_force(spark):
    for seed in range(3):
        r = random.Random(seed)
        rows = [
            (r.choice([None, 1, 2, 4, 7]), r.choice([None, "/a", "/b", "/c", "/d", "/e"]), r.choice([None, 1, 2]), r.choice([None, 1000, 1500, 3000]), r.choice([None, 5, 6]), i)
            for i in range(40)
        ]
        assert got(spark, rows) == brute(rows)


def test_spellings_repeats_and_gaps(spark):
    rows = [
        (3, "/a//b", 1, 1000, 1, 1), (3, "/a/b", 1, 1000, 1, 1), (3, "/x/../c", 1, 1000, 1, 1),
        (2, "/a/./b/", 1, 1999, None, 2), (2, "/é", 1, 1, 1, 1),
        (1, "/c", 1, 1000, 1, 1), (1, "/a/b", 2, 1000, 1, 1), (1, "/é", 1, 1, 1, 1),
    ]
    assert got(spark, rows) == [(1, "/a/b", "changed"), (1, "/c", "added"), (2, "/c", "removed"), (2, "/é", "added")]


def test_empty_and_single(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, "/a", 1, 1, 1, 1)]) == []


def test_carry_and_lists(spark):
    rows = [(2, "/a", 1, 1, 1, 1), (2, "/b", 1, 1, 1, 1), (1, "/b", 2, 1, 1, 1), (1, "/z", 1, 1, 1, 1)]
    found = snapshot_changes(table(spark, rows), carry=["root"])
    row = list_sizes(found).collect()
    assert [(r["root"], r["n_to_add"], r["n_to_delete"], r["n_to_update"], r["first_to_add"]) for r in row] == [("r", 1, 1, 1, "/z")]
    lists = {(r["list"], r["part"]): r["paths"] for r in reconciliation_lists(found).collect()}
    assert lists == {("to_add", 0): ["/z"], ("to_delete", 0): ["/a"], ("to_update", 0): ["/b"]}


def test_long_lists_come_in_parts(spark):
    found = spark.createDataFrame([(2, None, f"/f{i:03d}", "added") for i in range(100)], "snapshot_id int, root string, path string, change string")
    parts = reconciliation_lists(found, part=10).collect()
    assert len(parts) == 10 and max(len(r["paths"]) for r in parts) < 30 and all(r["paths"] == sorted(r["paths"]) for r in parts)
    assert sorted(p for r in parts for p in r["paths"]) == [f"/f{i:03d}" for i in range(100)]
    assert reconciliation_lists(found.limit(0)).count() == 0
