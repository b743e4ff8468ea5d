import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from findgrain.llm import terms

SCHEMA = "doc_id long, field int, token_pos int, term string, word string, record string, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "w", "r", 0) for r in rows], SCHEMA)


def counted(rows):
    places = {}
    for d, f, p, t in rows:
        t = (t or "").strip().lower()
        if d is not None and t:
            places[d, f, p] = min(t, places.get((d, f, p), t))
    return [(d, t) for (d, _, _), t in places.items()]


def sample(seed):
    r = random.Random(seed)
    return [(r.choice([None, -7, 0, 1, 64, 65, 2**40, *range(100, 112)]), r.choice([None, 1, 2]), r.randrange(12), r.choice(["hot", "Hot ", "a", "b", " c", "", "  ", None, "é"])) for _ in range(250)]


def test_frequencies(spark):
    for seed in range(2):
        occ = counted(sample(seed))
        docs = defaultdict(set)
        for d, t in occ:
            docs[t].add(d)
        n = len({d for d, _ in occ})
        want = {t: (k, len(docs[t]), "rare" if len(docs[t]) == 1 else "common" if len(docs[t]) > 0.1 * n else None) for t, k in Counter(t for _, t in occ).items()}
        got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in terms.term_frequencies(table(spark, sample(seed))).collect()}
        assert got == want


def test_empty_and_single(spark):
    assert terms.term_frequencies(table(spark, [])).count() == 0
    assert terms.distinctive_terms(table(spark, [])).count() == 0
    row = terms.term_frequencies(table(spark, [(1, 1, 1, "X" * 5000)])).first()
    assert (row["term"], row["mark"]) == ("x" * 5000, "rare")
    assert terms.distinctive_terms(table(spark, [(1, 1, 1, "a"), (1, 1, 2, "b")])).where("llr <> 0").count() == 0


def llr(a, b, c, d):
    n, out = a + b + c + d, 0.0
    for o, r, k in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        if o:
            out += o * math.log(o * n / (r * k))
    return 2 * out if a * (b + d) >= b * (a + c) else -2 * out


def test_distinctive(spark):
    occ = counted(sample(3))
    tf, df = Counter(occ), Counter(t for _, t in set(occ))
    dl, ct, docs = Counter(d for d, _ in occ), Counter(t for _, t in occ), len({d for d, _ in occ})
    rows = {(r["record"], r["term"]): r for r in terms.distinctive_terms(table(spark, sample(3))).collect()}
    assert set(rows) == set(tf)
    for (d, t), r in rows.items():
        n = tf[d, t]
        assert abs(r["weight"] - n * math.log(docs / df[t])) < 1e-6
        assert abs(r["llr"] - llr(n, ct[t] - n, dl[d] - n, len(occ) - dl[d] - ct[t] + n)) < 1e-6


def test_best_term_ties_go_to_the_smaller(spark):
    rows = [(1, "b", 3, 1.0, 2.0), (1, "a", 3, 1.0, 1.0), (1, "z", 1, 9.0, 9.0), (2, "q", 1, 5.0, 5.0), (3, "x", 2, 2.0, 1.0), (3, "y", 2, 3.0, -1.0), (4, "n", 2, 1.0, 0.0), (5, "c", 2, 1.0, 1.0), (5, "d", 2, 1.0, -1.0)]
    scored = spark.createDataFrame(rows, "record int, term string, records int, weight double, llr double")
    assert sorted(map(tuple, terms.best_terms(scored).collect())) == [(1, "a", True), (3, "y", False), (4, "n", False), (5, "c", True)]


def test_best_term_is_the_greatest_weight(spark):
    scored = terms.distinctive_terms(table(spark, sample(5)))
    want: dict = {}
    for r in scored.where("records >= 2").collect():
        want[r["record"]] = min(want.get(r["record"], (1.0, "")), (-r["weight"], r["term"])) if r["record"] in want else (-r["weight"], r["term"])
    assert {r["record"]: r["term"] for r in terms.best_terms(scored).collect()} == {k: v[1] for k, v in want.items()}


def test_bitmaps_of_wide_and_odd_identifiers(spark):
    rows = [(d, 1, 1, "a") for d in [*range(0, 200_000, 7), -1, -65_536, 2**40]] + [(d, 1, 2, "b") for d in range(64)]
    index = terms.vertical_index(terms.occurrences(table(spark, rows)))
    # a container a term and 65,536 identifiers, with its non-zero words only
    assert index.where("term = 'b'").select("chunk", F.size("words"), "n").collect() == [(0, 1, 64)]
    assert index.where("term = 'a'").count() == 4 + 2 and index.agg(F.max(F.size("words"))).first()[0] <= 1024
    assert {r["term"]: r["records"] for r in terms.union_bitmaps(index, "term").collect()} == {"a": 28572 + 3, "b": 64}
    assert terms.union_bitmaps(index).first()["records"] == 28572 + 3 + 64 - 10
    # identifiers that are no integers, or sparse
    tokens = table(spark, rows).select(F.concat(F.lit("r"), "doc_id").alias("doc_id"), "field", "token_pos", "term")
    got = {r["term"]: (r["records"], r["mark"]) for r in terms.term_frequencies(tokens, dense=False).collect()}
    assert got == {"a": (28575, "common"), "b": (64, None)}


def test_join_counts_splits_heavy_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(50)], "key string, i int")
    counts = rows.groupBy("key").agg(F.count("*").alias("w"))
    joined = terms.join_counts(rows, counts, "key", "w", 3050)
    assert joined.count() == 3050 and joined.where("key = 'hot' and w = 3000").count() == 3000
