import os
import shutil

from pyspark.sql import functions as F

from findgrain.api import SearchIndex
from findgrain.operators import client
from findgrain.sources.files import Scope
from findgrain.streaming import changes as stream


def names(rows):
    return [r["path"].rpartition("/")[2] for r in rows.orderBy("rank").collect()]


def test_life_of_an_index(spark, tmp_path):
    root = tmp_path / "home"
    (root / "docs").mkdir(parents=True)
    (root / "docs" / "report.txt").write_text("quarterly numbers about zebrafish")
    (root / "docs" / "budget.md").write_text("the annual budget")
    folder = str(tmp_path / "index")
    index = SearchIndex(spark, folder, Scope(roots=[str(root)]))
    assert names(index.search("report")) == []
    assert index.build(index.scan()) == 1
    assert names(index.search("zebrafish")) == ["report.txt"]
    text = index.snippets(index.search("zebrafish"), "zebrafish").first()["snippet"]
    assert text == "quarterly numbers about \x01zebrafish\x02"

    (root / "docs" / "budget.md").unlink()
    (root / "docs" / "plan.txt").write_text("zebrafish plan")
    actions = {r["path"].rpartition("/")[2]: r["action"] for r in index.refresh(index.scan()).collect()}
    assert actions == {"budget.md": "delete", "plan.txt": "add"}
    assert sorted(names(index.search("zebrafish"))) == ["plan.txt", "report.txt"] and names(index.search("budget")) == []
    assert index._changes == 2
    index.record_click("zebrafish", str(root / "docs" / "report.txt"))
    assert [tuple(r) for r in index.top_queries().collect()] == [("zebrafish", 1)]
    assert names(index.search("zebrafish"))[0] == "report.txt"
    assert index.merge() == 2

    again = SearchIndex(spark, folder)
    assert again.scope.roots == [str(root)] and sorted(names(again.search("zebrafish"))) == ["plan.txt", "report.txt"]
    # a folder is a document of its own kind, and excerpts are read again from disk
    assert names(again.search("docs kind:folder")) == ["docs"] and "docs" not in names(again.search("docs kind:document"))
    assert [r["snippet"] for r in again.snippets(again.search("zebrafish"), "zebrafish").collect() if "plan" in r["snippet"]] == ["\x01zebrafish\x02 plan"]
    row = again.stats().first()
    assert row["n_docs"] == 3 and row["queries"] == 10 and row["p99"] >= row["p50"]
    assert again.current is again.current
    again.reconfigure(Scope(roots=[str(tmp_path / "elsewhere")]))
    assert again.current.files.count() == 0
    again.close()
    assert sorted(names(SearchIndex(spark, folder).search("zebrafish"))) == ["plan.txt", "report.txt"]


def test_unreadable_root_keeps_its_files(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for root, name in ((a, "one.txt"), (b, "two.txt")):
        root.mkdir()
        (root / name).write_text("zebrafish")
    index = SearchIndex(spark, str(tmp_path / "index"), Scope(roots=[str(a), str(b)]))
    index.build(index.scan())
    (a / "one.txt").rename(tmp_path / "kept.txt")
    (a / "new.txt").write_text("walrus")
    b.rename(tmp_path / "unmounted")
    actions = {r["path"].rpartition("/")[2]: r["action"] for r in index.refresh().collect()}
    assert actions == {"one.txt": "delete", "new.txt": "add"} and names(index.search("zebrafish")) == ["two.txt"]
    assert not index.refresh_if_due() and index.refresh_if_due(0)


def test_changed_paths(spark, tmp_path):
    root = tmp_path / "home"
    (root / "docs").mkdir(parents=True)
    for i in range(3):
        (root / "docs" / f"f{i}.txt").write_text(f"zebrafish number{i}")
        os.utime(root / "docs" / f"f{i}.txt", (1000 + i, 1000 + i))
    index = SearchIndex(spark, str(tmp_path / "index"), Scope(roots=[str(root)]))
    index.build(index.scan())
    ids = {r["path"].rpartition("/")[2]: r["doc_id"] for r in index.current.files.collect()}
    # one renamed, one changed, a folder with something in it, and a path that never was
    (root / "docs" / "f0.txt").rename(root / "docs" / "g0.txt")
    (root / "docs" / "f1.txt").write_text("walrus")
    (root / "more").mkdir()
    (root / "more" / "h.md").write_text("otter")
    changed = [root / "docs" / "f0.txt", root / "docs" / "g0.txt", root / "docs" / "f1.txt", root / "more", root / "nothing"]
    rows = [(i, None, "Modified", str(p), None) for i, p in enumerate(changed)]
    spark.createDataFrame(rows, stream.CHANGE_SCHEMA).write.parquet(str(tmp_path / "changes"))
    run = index.follow(stream.read_changes(spark, str(tmp_path / "changes")), str(tmp_path / "checkpoint"))
    run.awaitTermination()
    now = {r["path"].rpartition("/")[2]: r["doc_id"] for r in index.current.files.collect()}
    assert set(now) == {"docs", "g0.txt", "f1.txt", "f2.txt", "more", "h.md"} and now["g0.txt"] == ids["f0.txt"] and now["f1.txt"] == ids["f1.txt"]
    assert sorted(names(index.search("zebrafish"))) == ["f2.txt", "g0.txt"] and names(index.search("otter")) == ["h.md"]
    # the same paths again change nothing; a folder that goes takes all below it along
    index.apply_paths([str(p) for p in changed])
    assert {r["path"].rpartition("/")[2]: r["doc_id"] for r in index.current.files.collect()} == now
    shutil.rmtree(root / "docs")
    index.apply_paths([str(root / "docs")])
    assert {r["path"].rpartition("/")[2] for r in index.current.files.collect()} == {"more", "h.md"}


def test_two_phases(spark, tmp_path):
    root = tmp_path / "home"
    root.mkdir()
    (root / "report.txt").write_text("zebrafish")
    index = SearchIndex(spark, str(tmp_path / "index"), Scope(roots=[str(root)]))
    phases = index.build_in_two_phases()
    assert next(phases) == 1 and names(index.search("report")) == ["report.txt"] and names(index.search("zebrafish")) == []
    assert next(phases) == 2 and names(index.search("zebrafish")) == ["report.txt"]

    class Outside:
        def provide(self, queries):
            return queries.select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit("/x/report.pdf").alias("path"))

    class Broken:
        def provide(self, queries):
            raise OSError("gone")

    assert names(index.search("report", providers=[Broken(), Outside()])) == ["report.txt", "report.pdf"]


def test_client(spark):
    df = spark.createDataFrame([('tax kind:pdf -draft size:>2KB content:"a b" after:2024-05',), ("plain",)], "q string")
    rows = df.select(*[c.alias(n) for n, c in client.chips(F.col("q")).items()]).collect()
    assert rows[0].asDict() == {"kind": "pdf", "in": None, "after": "2024-05", "before": None, "size": ">2KB", "tag": None, "content": "a b", "exclude": ["draft"], "text": "tax"}
    assert client.chip_bytes(">2KB") == 2048 and client.chip_bytes("<3") is None and client.chip_bytes("big") is None
    assert client.eta_minutes(2, 0.5) is None and client.eta_minutes(60, 0.5) == 1 and client.eta_minutes(600, 0.1) == 90
    one = spark.createDataFrame([("/u/a.app", 1500), ("/u/b", 10), ("/v\0x", None)], "path string, size long")
    assert [tuple(r) for r in one.select(client.readable_size(F.col("size")), client.display_path(F.col("path"), "/u"), client.window_scope(F.col("path"), "applications")).collect()][:2] == [("1.5 KB", "~/a.app", True), ("10 B", "~/b", False)]
    assert client.boundary_rows(one.withColumn("doc_id", F.lit(1)).withColumn("score", F.lit(1.0))).count() == 2
    log = spark.createDataFrame([("u", i, q) for i, q in enumerate(["a", "a", "b", " ", "a"])], "user string, ts int, query string")
    assert sorted((r["ts"], r["query"]) for r in client.history(log, 2).collect()) == [(2, "b"), (4, "a")]
    share = spark.range(10_000).where(client.sampled(F.col("id"), 0.1)).count()
    assert 850 < share < 1150
    assert spark.range(5).where(client.long_enough(F.lit(" a "))).count() == 0


def test_command_line_usage(capsys):
    from findgrain.__main__ import main

    assert main([]) == 2 and "index FOLDER" in capsys.readouterr().out
