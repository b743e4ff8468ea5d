import datetime as dt

from pyspark.sql import functions as F

from findgrain.operators import maintenance
from findgrain.sources.store import Folder
from findgrain.streaming import changes as stream
from findgrain.streaming.log import ChangeLog

T = dt.datetime(2025, 1, 1)
SCHEMA = "ts timestamp, event_type string, path string, size long"


def entries(spark, n, at=0):
    return spark.createDataFrame([(T + dt.timedelta(seconds=at + i), "Created" if i % 2 else None, f"/f{i}", i if i % 3 else None) for i in range(n)], SCHEMA)


def test_log_numbers_and_replays(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    assert log.last_seq == 0 and log.replay().count() == 0 and log.first_bad() is None
    assert log.append(entries(spark, 0)) == 0
    assert log.append(entries(spark, 600)) == 602 and log.append(entries(spark, 5, 1000)) == 607
    rows = log.records().orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, 608)) and all(r["sound"] for r in rows)
    assert [r["seq"] for r in rows if r["event_type"] == "Checkpoint"] == [257, 514]
    assert [r["path"] for r in rows if r["path"]][:2] == ["/f0", "/f1"] and [r["path"] for r in rows][-1] == "/f4"
    assert log.replay(600).count() == 7 and log.replay(500).count() == 106 and log.first_bad() is None and log.recover() == 607


def test_damaged_log_is_cut_before_the_first_bad_record(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    log.append(entries(spark, 20))
    log.append(entries(spark, 20, 100))
    segment = str(tmp_path / "log" / "segment=2")
    # one record amended without its checksum, and an append that was never finished
    rows = spark.read.parquet(segment).withColumn("size", F.when(F.col("seq") == 30, 999).otherwise(F.col("size")))
    spark.createDataFrame(rows.collect(), rows.schema).write.mode("overwrite").parquet(segment)
    spark.range(3).write.parquet(str(tmp_path / "log" / "segment=3"))
    assert log.first_bad() == 30 and log.replay().agg(F.max("seq")).first()[0] == 29
    assert log.recover() == 29 and log.first_bad() is None and log.records().count() == 29
    assert sorted(d for d in log.folder.names() if d.startswith("segment")) == ["segment=3"]
    assert log.append(entries(spark, 1, 500)) == 30
    # a record that is missing
    rows = log.records().where("seq <> 7").drop("sound")
    spark.createDataFrame(rows.collect(), rows.schema).write.parquet(str(tmp_path / "log" / "segment=9"))
    log.folder.write_json("log.json", {"segments": [9], "last": 30})
    assert log.first_bad() == 7 and log.recover() == 6


def test_startup(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "index"))
    assert maintenance.startup(folder) == "first"
    assert maintenance.startup(folder) == "crash"
    maintenance.ended(folder)
    assert maintenance.startup(folder) == "warm"
    store = maintenance.Generations(spark, str(tmp_path / "index"))
    for name in ("generation=7/postings/x", "manifest.json.12ab"):
        store.folder.create(name)
    assert sorted(maintenance.recover(store)) == ["generation=7", "manifest.json.12ab"] and maintenance.recover(store) == []


def test_tagged_jobs_can_be_stopped(spark):
    import threading
    import time

    with maintenance.running(spark, "search-1"):
        stop = threading.Timer(1.0, maintenance.cancelled, (spark, "search-1"))
        stop.start()
        began = time.time()
        try:
            spark.range(4, numPartitions=4).select(F.udf(lambda x: time.sleep(60) or x, "long")("id")).collect()
            failed = False
        except Exception:
            failed = True
        stop.join()
    assert failed and time.time() - began < 50
    assert spark.range(3).count() == 3


def at(ms):
    return T + dt.timedelta(milliseconds=ms)


def test_debounce_has_a_cap(spark, tmp_path):
    times = [0, 100, 399, 698, 2000, *range(5000, 8000, 200), 9000]
    rows = spark.createDataFrame([(i, at(t), "Modified", "/a", None) for i, t in enumerate(times)] + [(99, at(0), "x", None, None)], stream.CHANGE_SCHEMA)
    want = [(0, 998, 4), (2000, 2300, 1), (5000, 7000, 10), (7000, 8100, 5), (9000, 9300, 1)]
    table = stream.debounce(rows).orderBy("start").collect()
    assert [(r["start"], r["end"], r["events"]) for r in table] == [(at(a), at(b), n) for a, b, n in want]
    # the same over a stream in two batches, once the watermark has passed
    source = str(tmp_path / "in")
    rows.where("seq < 10").coalesce(1).write.parquet(source)
    more = rows.where("seq >= 10 and path is not null").unionByName(spark.createDataFrame([(500, at(60_000), "Modified", "/z", None)], stream.CHANGE_SCHEMA))
    more.coalesce(1).write.mode("append").parquet(source)
    late = spark.createDataFrame([(501, at(90_000), "Modified", "/z", None)], stream.CHANGE_SCHEMA)
    late.coalesce(1).write.mode("append").parquet(source)
    out = stream.debounce_stream(stream.read_changes(spark, source, max_files=10), late="1 second")
    run = out.writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.table("debounced").where("path = '/a'").orderBy("start").collect()
    assert [(r["start"], r["end"], r["events"]) for r in got] == [(at(a), at(b), n) for a, b, n in want]
