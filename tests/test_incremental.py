import os
import random
from datetime import datetime, timedelta

import pytest
from findgrain.operators import incremental
from pyspark.sql import functions as F

START = datetime(2025, 1, 1)
SCHEMA = "seq long, mtime_ns long, received_at timestamp, path string, file string"


def write_log(spark, at, rows):
    """One more file of the log."""
    made = spark.createDataFrame([(s, m, None if t is None else START + timedelta(minutes=t), "p", "f") for s, m, t in rows], SCHEMA)
    made.coalesce(1).write.mode("append").parquet(at)


class Log:
    """A log in a folder with its store; ``reads`` counts how often files of it were read."""

    def __init__(self, spark, tmp_path):
        self.spark, self.data, self.reads = spark, str(tmp_path / "log"), 0
        self.store = incremental.BatchStore(spark, str(tmp_path / "store"))

    def read(self, names):
        self.reads += 1
        return self.spark.read.schema(SCHEMA).parquet(*names)

    def run(self, known=None):
        listing = incremental.list_files(self.spark, self.data, known=known)
        batch = incremental.new_entries(self.store, listing, self.read)
        return None if batch is None else sorted(r["seq"] for r in self.store.rows(batch).collect())


def test_runs_match_brute_force(spark, tmp_path):
    r = random.Random(3)
    log, seen, new_keys = Log(spark, tmp_path), set(), []
    for _ in range(4):
        added = set()
        for _ in range(r.choice([1, 2])):
            rows = [(r.choice([None, *range(30)]), r.choice([None, 1, 2]), r.choice([None, 5])) for _ in range(40)]
            write_log(spark, log.data, rows)
            added |= {(s, m) for s, m, _ in rows if s is not None}
        new_keys.append(sorted({s for s, _ in added - seen}))
        assert log.run() == new_keys[-1]
        seen |= added
    assert sorted(r["seq"] for r in log.store.all_rows().collect()) == sorted(s for keys in new_keys for s in keys)


def test_unchanged_log_reads_no_data(spark, tmp_path):
    log = Log(spark, tmp_path)
    write_log(spark, log.data, [(1, 1, 0), (2, None, 0)])
    assert log.run() == [1, 2] and log.reads == 1
    # its bytes are gone, behind the same name, length and time: whoever reads them fails or sees another checksum
    known = log.store.manifest()
    at = next(str(p) for p in (tmp_path / "log").glob("*.parquet"))
    size, times = os.path.getsize(at), os.stat(at)
    with open(at, "r+b") as f:
        f.write(b"X" * size)
    os.utime(at, ns=(times.st_atime_ns, times.st_mtime_ns))
    assert log.run(known) is None and log.reads == 1 and log.store.committed() == [0]


def test_edges(spark, tmp_path):
    log = Log(spark, tmp_path)
    write_log(spark, log.data, [])
    assert log.run() == []
    write_log(spark, log.data, [(1, 1, 10), (1, 1, 90), (2, None, 10), (3, None, 10), (None, 7, 1)])
    assert log.run() == [1, 2, 3]
    # the same again, in a new file; then one new version, and null as a version
    write_log(spark, log.data, [(1, 1, 99), (2, None, 95)])
    assert log.run() == []
    write_log(spark, log.data, [(2, None, 95), (3, 5, 95), (1, None, 95)])
    assert log.run() == [1, 3]
    assert log.run() is None


def test_adopted_runs(spark, tmp_path):
    log = Log(spark, tmp_path)
    write_log(spark, log.data, [(1, 1, 10), (2, None, 10)])
    done = incremental.list_files(spark, log.data)
    write_log(spark, log.data, [(2, None, 50), (3, 1, 50), (1, 2, 50)])
    incremental.adopt(log.store, log.read([r["file"] for r in done.collect()]), done, key="seq", version="mtime_ns")
    assert log.run() == [1, 3] and log.run() is None


@pytest.mark.parametrize("step", ["read", "seen", "rows", "commit"])
def test_failure_at_each_step_repeats_the_batch(spark, tmp_path, monkeypatch, step):
    log = Log(spark, tmp_path)
    write_log(spark, log.data, [(1, 1, 0)])
    assert log.run() == [1]
    write_log(spark, log.data, [(1, 1, 0), (2, 1, 0)])

    def fails(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if step == "read":
            m.setattr(log, "read", fails)
        elif step == "seen":
            m.setattr(incremental, "_write_seen", fails)
        elif step == "rows":
            write = incremental._write_seen

            def half(pairs, at):
                write(pairs, at)
                fails()

            m.setattr(incremental, "_write_seen", half)
        else:
            m.setattr(log.store, "commit", fails)
        with pytest.raises(RuntimeError):
            log.run()
    assert log.store.committed() == [0]
    assert log.run() == [2] and log.store.committed() == [0, 1] and log.run() is None


def test_two_runs_at_once(spark, tmp_path):
    log = Log(spark, tmp_path)
    write_log(spark, log.data, [(1, 1, 0)])
    commit, once = log.store.commit, []

    def late(batch, at):
        # another run commits the same batch first
        if not once:
            once.append(1)
            log.store.commit = commit
            assert log.run() == [1]
        commit(batch, at)

    log.store.commit = late
    with pytest.raises(ValueError):
        log.run()
    # the rows of the one that committed are the ones that count
    assert log.store.committed() == [0] and [r["seq"] for r in log.store.rows(0).collect()] == [1]
    assert log.run() is None


def test_last_success(spark):
    t = lambda d: datetime(2025, 1, d)
    rows = [("succeeded", t(1), t(3)), (" SUCCEEDED", t(1), t(4)), ("succeeded", None, t(9)), ("failed", t(1), t(8)), (None, t(1), t(7))]
    runs = spark.createDataFrame(rows, "status string, finished_at timestamp, read_upto timestamp")
    assert incremental.last_success(runs).first()["upto"] == t(4)
    assert incremental.last_success(runs.limit(0)).first()["upto"] is None


def files_at(spark, folder):
    return incremental.list_files(spark, folder)


def test_files_are_taken_once(spark, tmp_path):
    data, root = str(tmp_path / "in"), "file://" + str(tmp_path / "out")
    store = incremental.BatchStore(spark, root)
    spark.range(5).coalesce(1).write.mode("append").parquet(data)
    read = lambda todo: spark.read.parquet(*[r["file"] for r in todo.select("file").collect()])
    assert incremental.process_new_files(spark, store, files_at(spark, data), read) == 0
    assert incremental.process_new_files(spark, store, files_at(spark, data), read) is None
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(data)
    assert incremental.process_new_files(spark, store, files_at(spark, data), read) == 1
    assert sorted(r["id"] for r in store.rows(1).collect()) == [5, 6, 7]
    assert sorted(r["id"] for r in store.all_rows().collect()) == list(range(8))


def test_failed_run_repeats_its_batch(spark, tmp_path):
    data, root = str(tmp_path / "in"), "file://" + str(tmp_path / "out")
    store = incremental.BatchStore(spark, root)
    spark.range(5).coalesce(1).write.parquet(data)

    def fails(todo):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        incremental.process_new_files(spark, store, files_at(spark, data), fails)
    assert store.committed() == []
    with pytest.raises(ValueError):
        store.rows(0)
    read = lambda todo: spark.read.parquet(*[r["file"] for r in todo.select("file").collect()])
    assert incremental.process_new_files(spark, store, files_at(spark, data), read) == 0
    assert store.rows(0).count() == 5
    with pytest.raises(ValueError):
        store.commit(0, f"{store.root}/batch=0/other")


def test_changed_file_is_seen_by_checksum(spark):
    a = spark.createDataFrame([("f", 3, "x"), ("g", 1, "y"), ("h", 1, None)], "file string, size long, checksum string")
    b = spark.createDataFrame([("f", 3, "z"), ("g", 1, "y"), ("h", 1, None)], "file string, size long, checksum string")
    assert [r["file"] for r in incremental.changed_files(b, a).collect()] == ["f"]


def test_known_files_keep_their_checksum(spark, tmp_path):
    data = str(tmp_path / "in")
    spark.range(3).coalesce(1).write.parquet(data)
    first = incremental.list_files(spark, data).persist()
    again = incremental.list_files(spark, data, known=first)
    assert sorted(map(tuple, again.select("file", "size", "checksum").collect())) == sorted(map(tuple, first.select("file", "size", "checksum").collect()))


LONG = (256 << 20) + 1


def _long_file(at, last):
    """A sparse file of ``LONG`` bytes that ends in ``last``, always with the same time."""
    with open(at, "wb") as f:
        f.seek(LONG - 1)
        f.write(last)
    os.utime(at, (1_700_000_000, 1_700_000_000))


def test_long_files_are_told_apart_by_their_bytes(spark, tmp_path):
    at = tmp_path / "in" / "long.bin"
    at.parent.mkdir()
    listed = lambda known=None: incremental.list_files(spark, str(at.parent), "*.bin", known)
    noted = lambda listing: spark.createDataFrame(listing.collect(), listing.schema)
    _long_file(at, b"a")
    first = noted(listed())
    # other bytes, same length and time
    _long_file(at, b"b")
    assert incremental.changed_files(listed(), first).count() == 1
    # same bytes, another time
    _long_file(at, b"a")
    os.utime(at, (1_800_000_000, 1_800_000_000))
    assert incremental.changed_files(listed(), first).count() == 0
    assert incremental.changed_files(listed(first), first).count() == 0
    # a manifest from when only the time of long files was noted says nothing of their bytes
    hashed = listed().first()
    earlier = noted(listed().withColumn("checksum", F.concat(F.lit("at "), F.col("modified").cast("string"))))
    assert listed(earlier).first()["checksum"] == hashed["checksum"]


def test_checksum_is_that_of_the_whole_content(spark, tmp_path, monkeypatch):
    r = random.Random(7)
    data = tmp_path / "in"
    data.mkdir()
    lengths = [1, 3, 4, 7, 8, 31, 32, 33, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, (3 << 20) + 5]
    for i, n in enumerate(lengths):
        (data / f"{i} é%20#.gz").write_bytes(r.randbytes(n))
    listed = lambda: sorted(map(tuple, incremental.list_files(spark, str(data), "*.gz").select("size", "checksum").collect()))
    whole = spark.read.format("binaryFile").load(str(data)).select("length", F.hex(F.xxhash64("content")))
    expected = sorted(map(tuple, whole.collect()))
    assert len(expected) == len(lengths) and listed() == expected
    # the same where Arrow cannot read the files, and wherever the longer ones begin
    monkeypatch.setattr(incremental, "arrow_reads", lambda name: False)
    for longest in (incremental.HELD_WHOLE, 1 << 20, 0):
        monkeypatch.setattr(incremental, "HELD_WHOLE", longest)
        assert listed() == expected
