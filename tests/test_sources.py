import os
from dataclasses import asdict

from pyspark.sql import functions as F

from findgrain.sources import files
from findgrain.sources.store import Folder


def test_scan_extract(spark, tmp_path):
    root = tmp_path / "home"
    for name, data in {"a.txt": b"hello", "sub/b.md": b"x\0y", "node_modules/c.txt": b"no", ".hidden": b"no", "X.app/in.txt": b"no", "d.pdf": b"pdf", "deep/1/2/3/e.txt": b"no"}.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    scope = files.Scope(roots=[str(root), str(root / "sub")], max_depth=3)
    rows = files.scan(spark, scope)
    names = {os.path.relpath(r["path"], root): r["is_dir"] for r in rows.collect()}
    assert {n for n, d in names.items() if not d} == {"a.txt", "sub/b.md", "d.pdf"}
    assert {"sub", "deep", "deep/1", "deep/1/2"} <= {n for n, d in names.items() if d}

    def broken(path, data):
        raise OSError(path)

    got = {os.path.basename(r["path"]): r["content"] for r in files.extract(rows.where("not is_dir"), {"pdf": broken}).collect()}
    assert got == {"a.txt": "hello", "b.md": "", "d.pdf": ""}
    got = {os.path.basename(r["path"]): r["content"] for r in files.extract(rows.where("not is_dir"), {"pdf": lambda p, d: d.decode() + "!"}).collect()}
    assert got["d.pdf"] == "pdf!"


def test_read_text():
    assert files.read_text(None) == ("", True) and files.read_text(b"") == ("", True)
    text, full = files.read_text("é".encode() * 40_000)
    assert not full and set(text) == {"é"} and len(text.encode()) <= files.CONTENT_BYTES
    text, _ = files.read_text(b"a" + "🙂".encode() * 20_000)
    assert set(text) == {"a", "🙂"}
    assert files.read_text(b"\xff\xfeabc")[0].endswith("abc")


def test_scope_config(spark, tmp_path):
    s = files.Scope(roots=["/a/b", "/a", "/a/", "/c"], max_depth=99, memory_budget_mb=1).normalised()
    assert (s.roots, s.max_depth, s.memory_budget_mb) == (["/a", "/c"], 64, 16)
    folder = Folder(spark, str(tmp_path / "store"))
    folder.write_json("c.json", {**asdict(s), "unknown": 1})
    folder.write_json("c.json", {**asdict(s), "unknown": 2})
    assert files.Scope.of(folder.read_json("c.json")) == s and folder.names() == ["c.json"]
    assert files.Scope.of(folder.read_json("none.json")) == files.Scope() and files.Scope.of({"max_depth": 3}).max_depth == 3
    assert folder.create("commits/1") and not folder.create("commits/1") and folder.names("commits") == ["1"]


def test_predicates(spark):
    df = spark.createDataFrame([("/u/.ssh/x",), ("/u/k.PEM",), ("/u/.env",), ("/u/ok.txt",), ("/Volumes/n/x",), ("/u/Documents/x",)], "p string")
    p = F.col("p")
    rows = df.select(files.never_indexed(p), files.queryable(p), files.in_access_scope(p, "limited", "/u"), files.content_kind(p)).collect()
    assert [r[0] for r in rows] == [True, True, True, False, False, False]
    assert [r[1] for r in rows] == [True, True, True, True, False, True]
    assert [r[2] for r in rows] == [False] * 5 + [True] and rows[3][3] == "text"


def test_extract_reads_whole_texts(spark, tmp_path):
    (tmp_path / "long.txt").write_bytes(b"word " * 20_000 + b"zebrafish")
    (tmp_path / "long.pdf").write_bytes(b"pdf")
    rows = files.scan(spark, files.Scope(roots=[str(tmp_path)])).where("not is_dir")
    own = {"pdf": lambda p, d: "word " * 20_000 + "walrus"}
    got = {os.path.basename(r["path"]): (r["content"][-9:].strip(), r["full"]) for r in files.extract(rows, own).collect()}
    assert got == {"long.txt": ("zebrafish", True), "long.pdf": ("rd walrus", True)}
    cut = files.extract(rows, own, limit=100).collect()
    assert all(len(r["content"]) == 100 and not r["full"] for r in cut)
