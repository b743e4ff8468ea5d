import pytest

from findgrain.operators import index as ix
from findgrain.operators import maintenance, requests, search, snippets
from pyspark.sql import functions as F

NOW = 1_740_000_000_000_000_000
DAY = 86_400_000_000_000
FILES = [
    (1, "/u/docs/quarterly_report.pdf", "Q3 report about zebrafish"),
    (2, "/u/docs/budget.xlsx", None),
    (3, "/u/projects/MeetingNotes.txt", "notes on walruses and the report"),
    (4, "/u/projects/meyer_report.pdf", "otters"),
    (5, "/u/quotes/other.txt", ""),
    (6, "/u/Downloads/summary.md", "a summary of zebrafish, zebrafish and zebrafish"),
    (7, "/u/projects/app/main.py", "def report(): pass"),
]


@pytest.fixture(scope="module")
def built(spark):
    rows = [(i, p, "/u", 1000 * i, NOW - i * DAY * 20, "work,red" if i % 2 else None, c) for i, p, c in FILES]
    files = spark.createDataFrame(rows, "doc_id long, path string, root string, size long, mtime_ns long, tag string, content string")
    made = ix.build_index(files, stems=True)
    return ix.Index(made.files.cache(), made.postings.cache(), True)


def ask(spark, built, *texts, **options):
    q = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    rows = search.search(built, q, now_ns=NOW, **options).orderBy("query_id", "rank").collect()
    out = [[] for _ in texts]
    for r in rows:
        out[r["query_id"]].append(r["path"].rpartition("/")[2])
    return out if len(texts) > 1 else out[0]


def test_batch_equals_single_searches(spark, built):
    texts = ["report", "zebrafish", "reprot", "meeting notes", "", "the", "summary.md", "meetingNotes"]
    together = ask(spark, built, *texts)
    assert together == [ask(spark, built, t) for t in texts]
    assert together[0][0] == "quarterly_report.pdf" and "MeetingNotes.txt" in together[0]
    assert together[1][:2] == ["summary.md", "quarterly_report.pdf"]
    assert "quarterly_report.pdf" in together[2] and together[3][0] == "MeetingNotes.txt"
    assert together[4] == [] and together[6] == ["summary.md"]
    # inner capitals divide a typed word
    assert together[7][0] == "MeetingNotes.txt"


def test_blocks_and_tables_change_nothing(spark, built, monkeypatch):
    texts = ["report", "zebrafish", "reprot", "meeting notes", "budget", "", "summary kind:doc", "main.py", "me"]
    together = ask(spark, built, *texts)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    kept = search.few_or_table
    monkeypatch.setattr(search, "few_or_table", lambda rows, name: kept(rows, name, 0))
    assert ask(spark, built, *texts) == together


def test_a_search_leaves_no_tables(spark, built):
    from findgrain import session

    built.lookups.ready()
    before = list(session._made.get(spark.sparkContext.applicationId, []))
    rows = search.search(built, spark.createDataFrame([(1, "report")], "query_id int, query string"), now_ns=NOW)
    assert session._made.get(spark.sparkContext.applicationId, []) == before and rows.count() > 0


def test_short_words_and_queries_without_words(spark, built):
    # words of one or two letters are compared with all names, a query of marks alone with whole names
    assert ask(spark, built, "py")[0] == "main.py" and ask(spark, built, "._") == []
    assert sorted(ask(spark, built, "_")) == ["meyer_report.pdf", "quarterly_report.pdf"]


def test_filters(spark, built):
    assert ask(spark, built, "report kind:code") == ["main.py"]
    assert ask(spark, built, "report in:docs") == ["quarterly_report.pdf"]
    assert "meyer_report.pdf" not in ask(spark, built, "report -meyer")
    assert ask(spark, built, "report size:>5kb") == ["main.py"]
    assert ask(spark, built, "report tag:red tag:WORK after:1999")[0] == "quarterly_report.pdf"
    assert sorted(ask(spark, built, "report size:>5kb", filter_mode="post")) == ["main.py"]


def test_sound_and_clicks(spark, built):
    assert "meyer_report.pdf" in ask(spark, built, "mayer")
    clicks = maintenance.click_counts(spark.createDataFrame([("/u/projects/meyer_report.pdf",)] * 20, "path string"))
    assert ask(spark, built, "report", clicks=clicks)[0] == "meyer_report.pdf"
    assert {r["path"]: r["clicks"] for r in clicks.collect()}["/u/projects"] == 20


def test_requests():
    r = requests.parse_request("tax return kind:PDF in:~Documents -draft after:2024 before:2025-02 size:>4kb size:big tag:x")
    assert (r.text, r.kinds, r.folders, r.excluded, r.from_day, r.before_day, r.min_bytes, r.tags) == ("tax return", ["pdf"], ["documents"], ["draft"], "2024-01-01", "2025-02-01", 4000, ["x"])
    assert requests.parse_request("budget after:yesterday size:big").unrecognised == ["after:yesterday", "size:big"]
    assert requests.parse_request(None).text == "" and requests.parse_day("2024-13") is None


def test_snippets():
    make = snippets.make_snippet
    assert make("first\n  the\tquarterly   reports came", "report") == "the quarterly \x01reports\x02 came"
    assert make("nothing here", "report") is None and make(None, "x") is None and make("text", "kind:pdf -a") is None
    long = make("filler " * 40 + "target " + "filler " * 40, "target")
    assert long.startswith("…") and long.endswith("…") and "\x01target\x02" in long and len(long) <= 146
    assert make("x é🙂 Report y", "report") == "x é🙂 \x01Report\x02 y"


def test_generations_round_trip(spark, built, tmp_path):
    store = maintenance.Generations(spark, str(tmp_path / "index"))
    assert store.load() is None
    store.save(built)
    assert store.save(store.load(), snapshot_seq=7) == 2
    assert store.remove_old() == ["generation=1"] and store.manifest["snapshot_seq"] == 7
    again = store.load(verify=True)
    assert again.postings.exceptAll(built.postings.select(again.postings.columns)).isEmpty() and again.files.count() == 7
    # a table that was changed behind the manifest is noticed
    at = str(tmp_path / "index" / "generation=2" / "postings")
    rows = spark.read.parquet(at).collect()
    spark.createDataFrame([(*r[:-1], r[-1] + 1) for r in rows[:1]] + rows[1:], spark.read.parquet(at).schema).write.mode("overwrite").parquet(at)
    assert store.load() is not None and store.load(verify=True) is None
    # an index of a later version is read, an older one is kept aside and built anew
    m = store.folder.read_json("manifest.json")
    store.folder.write_json("manifest.json", m | {"version": m["version"] + 1})
    assert store.load() is not None and store.back_up() is None
    store.folder.write_json("manifest.json", m | {"version": 0})
    assert store.load() is None and store.save(built) == 3 and store.folder.exists("backup-version=0.json")
    with store.writer() as first, store.writer() as second:
        assert first and not second


def test_delta_equals_rebuild(spark):
    rows = lambda ids, c: spark.createDataFrame([(i, f"/u/f{i}.txt", "/u", 1, 1, None, c) for i in ids], "doc_id long, path string, root string, size long, mtime_ns long, tag string, content string")
    base, new = ix.build_index(rows(range(6), "old words")), ix.build_index(rows([1, 9], "new words"))
    none = ix.Index(base.files.limit(0), base.postings.limit(0))
    delta, dead = maintenance.commit_batch(base, none, base.files.select("doc_id").limit(0), new, rows([3], "").select("doc_id"))
    whole = maintenance.merged(base, delta, dead)
    again = ix.build_index(rows([0, 2, 4, 5], "old words").unionByName(rows([1, 9], "new words")))
    cols = ["term", "doc_id", "field", "tf"]
    assert sorted(map(tuple, whole.postings.select(cols).collect())) == sorted(map(tuple, again.postings.select(cols).collect()))
    assert sorted(map(tuple, whole.stats.collect())) == sorted(map(tuple, again.stats.collect()))


def test_empty_index(spark):
    empty = spark.createDataFrame([], "doc_id long, path string, root string, size long, mtime_ns long, tag string, content string")
    built = ix.build_index(empty)
    assert tuple(built.stats.first()) == (0, 1.0)
    assert ask(spark, built, "report") == []


def test_reconcile(spark):
    schema = "path string, root string, size long, mtime_ns long"
    disk = spark.createDataFrame([("/a/1", "/a", 1, 1), ("/a/2", "/a", 2, 2), ("/a/n", "/a", 1, 1)], schema)
    index = spark.createDataFrame([("/a/1", "/a", 1, 1), ("/a/2", "/a", 2, 9), ("/a/x", "/a", 1, 1), ("/b/x", "/b", 1, 1)], schema)
    got = lambda d: sorted(map(tuple, d.collect()))
    assert got(maintenance.reconcile(disk, index)) == [("/a/2", "update"), ("/a/n", "add"), ("/a/x", "delete"), ("/b/x", "delete")]
    assert ("/b/x", "delete") not in got(maintenance.reconcile(disk, index, ["/a"]))


def test_policies():
    assert maintenance.migration(1, 1) == "none" and maintenance.migration(2, 1) == "additive" and maintenance.migration(1, 2) == "rebuild"
    assert maintenance.snapshot_due(1, 300) and not maintenance.snapshot_due(1, 300, on_mains=False)
    assert maintenance.snapshot_due(1, 1800, on_mains=False) and maintenance.snapshot_due(5000, 1) and not maintenance.snapshot_due(0, 9999)


def test_engine_query(spark):
    df = spark.createDataFrame([("find in:/u draft ext:pdf",), ("x after:2024",), ("wild* card",)], "q string")
    p = requests.parse_engine_query(F.col("q"))
    rows = df.select(p["terms"].alias("t"), p["scope"].alias("s"), p["intent"].alias("i"), p["filter_keys"].alias("k")).collect()
    assert [(r["t"], r["s"], r["i"], r["k"]) for r in rows] == [(["find", "draft"], "/u", "Verification", ["ext"]), (["x"], None, "Recovery", ["after"]), (["wild", "card"], None, "Lookup", [])]
