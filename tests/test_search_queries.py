import pytest

from findgrain.functions.distance import osa
from findgrain.functions.phonetic import phonetic_code
from findgrain.plans import search_queries

PATHS = ["/u/Büro/inventory3724.txt", "/u/отчёт/summary1636.md", "/u/2024/inventory.txt", "/u/q/quarterly_v2.doc", "/u/inventary7/minutes12.txt", "/u/skech9/plan1.txt", "/u/plän/lög.txt", "/u/sumary1/tr4vl.txt", "/u/q/ab"]


def documents(spark, tmp_path, rows):
    """Writes a documents table of (doc_id, path, text); returns its folder."""
    made = spark.createDataFrame([(i, p, "/u", 1, 0, None, t) for i, p, t in rows], "doc_id long, path string, folder string, size long, mtime_ns long, tag string, text string")
    made.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.fixture(scope="module")
def named(spark, tmp_path_factory):
    return documents(spark, tmp_path_factory.mktemp("named"), [(i, p, "") for i, p in enumerate(PATHS)])


def test_names_are_the_whole_vocabulary(spark, named):
    got = {r["term"] for r in search_queries._names(spark, named).collect()}
    assert {"inventory3724", "summary1636", "büro", "отчёт", "2024", "inventory", "v2"} <= got


def test_name_queries_match_brute_force(spark, named):
    names = [r["term"] for r in search_queries.name_terms(spark, named).select("term").distinct().collect()]
    near = lambda words: {(w, n, osa(w, n)) for w in words for n in names if osa(w, n) <= (2 if len(w) >= 5 else 1)}
    want = near(("scna", "plna", "lgo", "note", "idea", "spce", "copi"))
    assert {tuple(r) for r in search_queries.fuzzy_terms_k1(spark, named).select("term", "name", "distance").collect()} == want
    want = near(("inventry", "sumary", "reprot", "skecth", "budgte", "trvl"))
    assert ("trvl", "tr4vl", 1) in want and ("sumary", "sumary1", 1) in want
    assert {tuple(r) for r in search_queries.fuzzy_terms_k2(spark, named).select("term", "name", "distance").collect()} == want
    want = {(w, n) for w in ("inventari", "minits", "resipe", "skech", "bujet") for n in names if phonetic_code(w) == phonetic_code(n)}
    assert {("inventari", "inventory3724"), ("skech", "skech9")} <= want
    assert {tuple(r) for r in search_queries.phonetic_terms(spark, named).select("term", "name").collect()} == want
    triples = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    alike = lambda a, b: len(triples(a) & triples(b)) / len(triples(a) | triples(b))
    want = {(w, n) for w in ("inventory", "summaries", "quarterly", "changelogs") for n in names if alike(w, n) >= 0.3}
    assert {("inventory", "inventory3724"), ("summaries", "summary1636")} <= want
    assert {(r["word"], r["term"]) for r in search_queries.trigram_jaccard(spark, named).collect()} == want


def test_copies_agree_in_the_whole_content(spark, tmp_path):
    long = "x" * 70_000
    rows = [(1, "/u/a", long + "a"), (2, "/u/b", long + "b"), (3, "/u/c", long + "b"), (4, "/u/d", ""), (5, "/u/e", ""), (6, "/u/f", None), (7, "/u/g", "s"), (8, "/u/h", "s")]
    got = search_queries.content_fingerprints(spark, documents(spark, tmp_path, rows)).collect()
    assert {(r["first_doc"], r["copies"]) for r in got} == {(2, 2), (7, 2)}
