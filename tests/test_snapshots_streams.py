"""Snapshots by manifest, streaming state and listeners, SQLite files."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import SparkSession, functions as F

from marlstone import snapshots
from marlstone.sources import sqlite
from marlstone.streaming import progress


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_readers_see_whole_snapshots_only(spark, tmp_path):
    """A write that fails half-way, or one that has not committed, changes nothing for readers; earlier versions stay readable."""
    path = f"file://{tmp_path}/t"
    assert snapshots.versions(spark, path) == [] and snapshots.entries(spark, path).count() == 0
    with pytest.raises(ValueError):
        snapshots.read(spark, path)
    assert snapshots.write(spark.range(5), path, 7, 3) == 1
    broken = spark.range(100).withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        snapshots.write(broken, path, 7)
    assert _ids(snapshots.read(spark, path)) == list(range(5))
    assert snapshots.write(spark.range(10, 12), path, 7) == 2
    assert _ids(snapshots.read(spark, path)) == [10, 11] and _ids(snapshots.read(spark, path, version=1)) == list(range(5))
    first = snapshots.read(spark, path, version=1).first()
    assert (first.snapshot_id, first.version) == (7, 3)
    snapshots.write(spark.range(1), path, 10)
    assert snapshots.read(spark, path).first().snapshot_id == 10 and _ids(snapshots.read(spark, path, 7)) == [10, 11]
    snapshots.remove(spark, path, 10)
    assert snapshots.read(spark, path).first().snapshot_id == 7


def test_commits_of_two_writers_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    snapshots.write(spark.range(1), path, 1)
    true, calls = snapshots.manifest, []

    def stale(spark, path, version=None):
        found = true(spark, path, version)
        if not calls:
            calls.append(1)
            snapshots.write(spark.range(2), path, 2)  # another writer commits between reading and renaming
        return found

    monkeypatch.setattr(snapshots, "manifest", stale)
    assert snapshots.write(spark.range(3), path, 3) == 3
    monkeypatch.undo()
    assert {r.snapshot_id: r.rows for r in snapshots.entries(spark, path).collect()} == {1: 1, 2: 2, 3: 3}
    assert not [f for f in os.listdir(tmp_path / "t" / "_manifests") if f.endswith(".tmp")]


def test_completion_belongs_to_a_snapshot(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    snapshots.write(spark.range(4), path, 1, complete=False)
    folder = snapshots.manifest(spark, path)["snapshots"]["1"]["folder"]
    assert [(r.snapshot_id, r.rows) for r in snapshots.resumable(spark, path).collect()] == [(1, 4)]
    with pytest.raises(ValueError):
        snapshots.read(spark, path, complete_only=True)
    snapshots.write(spark.range(6), path, 1, complete=False)  # a new run takes its place
    with pytest.raises(snapshots.Conflict):
        snapshots.mark_complete(spark, path, 1, folder)
    with pytest.raises(snapshots.Conflict):
        snapshots.mark_complete(spark, path, 2)
    snapshots.mark_complete(spark, path, 1)
    assert snapshots.resumable(spark, path).count() == 0 and snapshots.read(spark, path, complete_only=True).count() == 6


def test_a_call_costs_what_is_new(spark, tmp_path):
    """Of 1,000 records read before and one new one, the stream reads one and updates one key; a replay reads none."""
    path, state, table = (f"file://{tmp_path}/{x}" for x in ("p", "s", "t"))
    folder = tmp_path / "p"
    folder.mkdir()
    rows = [{"k": None if i % 10 == 9 else i % 10, "n": i, "x": None if i % 3 else "a"} for i in range(1_000)]
    (folder / "1.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    last = {}
    for r in rows:
        last[r["k"]] = (r["n"], r["x"])

    def call():
        return {r.k: (r.n, r.x) for r in progress.replayed(spark, path, "k long, n long, x string", state, ("k",), "n").collect()}

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with progress.listening(spark, progress.ProgressTable(spark, table)):
        assert call() == last
        (folder / "2.jsonl").write_text('{"k": 3, "n": 5000, "x": "new"}\n')
        last[3] = (5_000, "new")
        assert call() == last == call()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    events = progress.progress_table(spark, table)
    assert sorted((r.batch, r.input_rows, r.updated_rows) for r in events.where("event = 'progress' and input_rows > 0").collect()) == [(0, 1_001, 10), (1, 1, 1)]
    assert events.where("event = 'started'").count() == 3 == events.where("event = 'terminated'").count()


def test_records_without_an_order_and_no_records(spark, tmp_path):
    (tmp_path / "p").mkdir()
    read = lambda: progress.replayed(spark, f"file://{tmp_path}/p", "k long, n long", f"file://{tmp_path}/s", ("k",), "n")
    assert read().count() == 0
    (tmp_path / "p" / "1.jsonl").write_text('{"k": 1, "n": null}\n{"k": 2, "n": null}\n{"k": 2, "n": 0}\n')
    assert sorted(map(tuple, read().collect())) == [(1, None), (2, 0)]


def test_a_listener_of_some_queries(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(3).write.mode("append").parquet(f"{tmp_path}/in")
    table = f"file://{tmp_path}/t"
    with progress.listening(spark, progress.ProgressTable(spark, table, "mine")):
        for name in ("mine", "other"):
            spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.format("noop").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert {r.name for r in progress.progress_table(spark, table).collect()} == {"mine"}


def test_a_watch_goes_on_after_a_stop(spark, tmp_path):
    path, state = f"{tmp_path}/in", f"file://{tmp_path}/state"
    for n in (3, 4):
        spark.range(n).selectExpr("id % 2 as k").write.mode("append").parquet(path)
        query = progress.counted(spark.readStream.schema("k long").parquet(path), state, "k", every="1 second")
        assert progress.wait(query, lambda: True)
    assert {r.k: r.n for r in progress.counts_so_far(spark, state).collect()} == {0: 4, 1: 3}


def test_a_run_stops_between_batches(spark, tmp_path):
    """The batch under way is finished, the next not begun; a later run goes on, and each item is worked off once, after a failure too."""
    path, state, out, flag = (f"file://{tmp_path}/{x}" for x in ("in", "state", "out", "stop"))
    for k in range(6):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(path)
    seen = []

    def run(work=lambda batch: batch):
        return progress.worked_off(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(path), state, out, flag, work)

    def asking(batch):
        seen.append(sorted(r.id for r in batch.collect()))
        if len(seen) == 2:
            progress.ask_to_stop(spark, flag)
            progress.ask_to_stop(spark, flag)
        return batch

    def failing(batch):
        if len(seen) == 2:
            seen.append([])
            return batch
        raise ValueError("work fails")

    assert progress.results(spark, out, "id long").count() == 0
    progress.ask_to_stop(spark, flag)
    assert not run(asking) and seen == [] and not os.path.exists(tmp_path / "stop")  # asked before the first batch
    assert not run(asking) and len(seen) == 2 and not os.path.exists(tmp_path / "stop")
    assert _ids(progress.results(spark, out, "id long")) == sorted(x for s in seen for x in s) and len(seen[0] + seen[1]) == 20
    with pytest.raises(Exception, match="work fails"):
        run(failing)
    assert progress.results(spark, out, "id long").count() == 30
    assert run() and _ids(progress.results(spark, out, "id long")) == list(range(60))
    progress.ask_to_stop(spark, flag)
    assert run() and not os.path.exists(tmp_path / "stop") and progress.results(spark, out, "id long").count() == 60  # nothing left, nothing to stop


def test_sqlite_there_and_back(spark, tmp_path):
    rows = [(i, i / 4 if i % 3 else None, None if i % 5 == 0 else f"t'{i}", bytes([i % 256]), i % 2 == 0) for i in range(997)]
    frame = spark.createDataFrame(rows, "a long, b double, `c d` string, e binary, f boolean").repartition(3)
    path = sqlite.write(frame, f"file://{tmp_path}/db", "t")
    assert len(os.listdir(tmp_path / "db")) == 3
    back = sqlite.read(spark, path, "t", 100)
    assert back.dtypes == [("a", "bigint"), ("b", "double"), ("c d", "string"), ("e", "binary"), ("f", "string")]
    assert sorted(map(tuple, back.collect())) == sorted((a, b, c, bytearray(e), str(f).lower()) for a, b, c, e, f in rows)
    assert back.rdd.getNumPartitions() >= 10
    kept = back.where((F.col("a") > 100) & F.col("a").isin(50, 150, 250) & F.col("c d").isNotNull() & (F.col("b") >= 0.5))
    assert sorted(r.a for r in kept.collect()) == [i for i in (50, 150, 250) if i > 100 and i % 5 and i % 3]
    assert sorted(r.a for r in back.where("`c d` = \"t'7\"").collect()) == [7] and back.where("a < 3 and e is null").count() == 0


def test_sqlite_filters_run_in_the_file():
    reader = sqlite.SqliteReader(sqlite.StructType([sqlite.StructField("a", sqlite.LongType())]), {"path": "/nowhere.db", "dbtable": "t"})
    left = list(reader.pushFilters([sqlite.GreaterThan(("a",), 3), sqlite.In(("a",), (1, 2)), sqlite.EqualTo(("a",), "x"), sqlite.IsNull(("a",)), sqlite.EqualTo(("a",), True)]))
    assert reader.where == ['"a" > ?', '"a" IN (?, ?)', '"a" IS NULL'] and reader.values == [3, 1, 2] and len(left) == 2


def test_sqlite_of_one_file_and_empty_tables(spark, tmp_path):
    with sqlite3.connect(tmp_path / "one.db") as c:
        c.execute("create table t (a integer, b varchar(3))")
        c.execute("create table gaps (a integer)")
        c.executemany("insert into gaps(rowid, a) values (?, ?)", [(-5, 1), (1_000_000, 2), (3, 3)])
    assert sqlite.read(spark, str(tmp_path / "one.db"), "t").count() == 0
    assert sorted(r.a for r in sqlite.read(spark, str(tmp_path / "one.db"), "gaps").collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        sqlite.local("hdfs://x/y")
