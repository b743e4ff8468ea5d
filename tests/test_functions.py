import posixpath
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findgrain.functions import analyze, distance, events, paths, phonetic, scoring, stem, text


def test_plain_paths(spark):
    cases = ["/a//b/", "/a/./b", "/x/../a/b", "//a/b", "/..", "/../a", "/a/b/..", "/", "", "a/../b", "../a", "./a", "/a/b...c/.d", "/café", None, "/a/.../b", "/a/" + "b" * 5000 + "//"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, p string")
    got = [r["q"] for r in df.select("i", paths.plain_path(F.col("p")).alias("q")).orderBy("i").collect()]

    def plain(p):
        if not p:
            return p
        out = posixpath.normpath(p)
        out = out[1:] if out.startswith("//") else out
        return unicodedata.normalize("NFC", "" if out == "." else out)

    assert got == [plain(c) for c in cases]
    both = paths.with_plain_path(df, "p", "q").orderBy("i").collect()
    assert [r["q"] for r in both] == got


def test_path_parts(spark):
    df = spark.createDataFrame([("/u/a.tar.gz",), ("/u/.bashrc",), ("/u/Read Me",)], "p string")
    name = paths.file_name(F.col("p"))
    rows = df.select(name.alias("n"), paths.stem(name).alias("s"), paths.extension(name).alias("e"), paths.ancestors(F.col("p")).alias("a")).collect()
    assert [(r["n"], r["s"], r["e"]) for r in rows] == [("a.tar.gz", "a.tar", "gz"), (".bashrc", ".bashrc", ""), ("Read Me", "Read Me", "")]
    assert rows[0]["a"] == ["/u", "/u/a.tar.gz"]


def test_event_codes(spark):
    cases = {"Created": 1, " modified ": 2, "DELETED": 3, "EventType::Renamed": 4, "permission_changed": 5, "metadata-changed": 6, "255": 255, "2": 2, "99": None, "": None, "?": None, None: None, "checkpoint ": 255}
    rows = spark.createDataFrame([(k,) for k in cases], "e string").select("e", events.event_code(F.col("e")).alias("c"), events.event_name(events.event_code(F.col("e"))).alias("n")).collect()
    assert {r["e"]: r["c"] for r in rows} == cases
    assert {r["n"] for r in rows if r["c"] == 5} == {"PermissionChanged"}


def test_fold_term(spark):
    rows = spark.createDataFrame([(" Café ",), ("　X ",), ("  ",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(text.fold_term(F.col("t"))).collect()] == ["café", "x", None, None, None]


def test_terms(spark):
    df = spark.createDataFrame([("The fieldNotes_v2, of HTTPServer!",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(analyze.index_terms(F.col("t"))).collect()] == [["field", "notes", "v2", "httpserver"], [], []]
    assert df.select(analyze.query_words(F.col("t"))).first()[0] == ["the", "field", "notes", "v2", "of", "httpserver"]
    assert analyze.terms_of("The quarterlyReports, running") == ["quarter", "report", "run"]


def test_stems():
    known = dict(zip("consistency knightly hopping hoping agreed skies dying news relational generously communication triplicate cats flies bus gas".split(), "consist knight hop hope agre sky die news relat generous communic triplic cat fli bus gas".split()))
    assert {w: stem.stem(w) for w in known} == known
    assert stem.stem("be") == "be" and stem.stem("") == ""


def test_phonetic():
    assert phonetic.phonetic_code("smith") == phonetic.phonetic_code("smyth") == "SM0"
    assert phonetic.phonetic_code("knight") == phonetic.phonetic_code("night") == "NT"
    assert phonetic.phonetic_code("") == "" and phonetic.phonetic_code("meyer") == "MYR"


def osa_table(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_osa(a, b):
    assert distance.osa(a, b) == osa_table(a, b)


def test_osa_is_restricted():
    assert distance.osa("ca", "abc") == 3


def forms(s, k):
    out, level = {s}, {s}
    for _ in range(k):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7))
def test_near_words_share_a_deletion(a, b):
    for k in (1, 2):
        if osa_table(a, b) <= k:
            assert forms(a, k) & forms(b, k)


def test_deletions(spark):
    df = spark.createDataFrame([("abcd",), ("a",), ("",)], "s string")
    rows = df.select(distance.deletions(F.col("s"), 2)).collect()
    assert [set(r[0]) for r in rows] == [forms("abcd", 2), forms("a", 2), {""}]


def test_scores(spark):
    df = spark.createDataFrame([("finder", "Finder"), ("xyz", "finder"), ("finde", "finder"), ("ab", "abab")], "w string, n string")
    assert [round(r[0], 6) for r in df.select(scoring.trigram_similarity(F.col("w"), F.col("n"))).collect()] == [1.0, 0.0, 0.75, 0.0]
    one = spark.range(1)
    low, high = one.select(scoring.bm25(F.lit(1), F.lit(10), F.lit(10.0), F.lit(1.0)), scoring.bm25(F.lit(3), F.lit(10), F.lit(10.0), F.lit(1.0))).first()
    assert low < high
    boosts = one.select(*[scoring.recency_boost(F.lit(10**18 - d * scoring.DAY_NS), 10**18) for d in (-3, 0, 1, 2, 7, 8, 30, 31)]).first()
    assert list(boosts) == [8, 8, 8, 5, 5, 2, 2, 0]
    states = one.select(*[scoring.memory_state(F.lit(x)) for x in (0.5, 0.7, 0.9, 0.99)]).first()
    assert list(states) == ["Normal", "Reduced", "Minimal", "Critical"]
