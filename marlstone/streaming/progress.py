"""Append-only progress as streams: each run reads what is new, and a replay changes nothing.

What a key's last record is, and how many records there are, is kept as streaming state and read from there: a call costs
what its new records cost, however long the history is.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: State is kept on disk, not in the executors' heaps.
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _started(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Starts a query with its state on disk; the session's setting is as before afterwards."""
    key, mine = _PROVIDER
    before = spark.conf.get(key, None)
    spark.conf.set(key, mine)
    try:
        return start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def last_records(stream: DataFrame, state: str, keys: tuple[str, ...], order: str) -> DataFrame:
    """The last record of each key that the stream has brought so far, by `order`, nulls first; equal ones by a hash of the record. Null keys are a key.

    Takes what is new since the last call with this state (a folder), and stops. Records that arrive twice count once.
    """
    spark = stream.sparkSession
    record = F.struct(*stream.columns)
    last = stream.groupBy(*keys).agg(F.max_by(record, F.struct(F.col(order), F.xxhash64(*stream.columns))).alias("record"))
    query = _started(spark, lambda: last.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    fs, commits = _path(spark, f"{state}/commits")
    if not fs.exists(commits) or not any(f.getPath().getName().isdigit() for f in fs.listStatus(commits)):  # nothing has come yet
        return spark.createDataFrame([], stream.schema)
    return spark.read.format("statestore").load(state).select("value.valueWithExtremumOrdering.*")


def replayed(spark: SparkSession, path: str, schema: str, state: str, keys: tuple[str, ...], order: str) -> DataFrame:
    """The last record of each key among the JSON lines below path; lines that are no record are dropped. See last_records."""
    lines = spark.readStream.schema("value string").text(path)
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "value").where(F.trim("value") != "").select("r.*").where("_corrupt is null").drop("_corrupt")
    return last_records(parsed, state, keys, order)


def open_items(grid: DataFrame, done: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of the grid that no record has, null keys compared as values."""
    d = done.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return grid.join(d, on, "left_anti")


def merged_series(source: DataFrame, state: str, key: str, order: str) -> DataFrame:
    """A history from a rolling source (a stream): the value with the greatest order a key. An upsert that meets a source twice changes nothing."""
    return last_records(source, state, (key,), order)


def counted(stream: DataFrame, state: str, *keys: str, every: str = "15 seconds") -> StreamingQuery:
    """Counts records a key while a table grows, looking at it every so often; runs until it is stopped. counts_so_far reads what it has counted."""
    counts = stream.groupBy(*keys).agg(F.count("*").alias("n"))
    return _started(stream.sparkSession, lambda: counts.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(processingTime=every).start())


def counts_so_far(spark: SparkSession, state: str) -> DataFrame:
    """keys and n of the last batch that is complete; also while the query runs."""
    return spark.read.format("statestore").load(state).select("key.*", F.col("value.count").alias("n"))


def wait(query: StreamingQuery, done: Callable[[], bool], seconds: float = 120.0) -> bool:
    """Lets the query work off what is there until done() holds, at most so long, and stops it; an error of the query is raised."""
    end = time.monotonic() + seconds
    ok = False
    try:
        while not ok and query.isActive and time.monotonic() < end:
            query.processAllAvailable()
            ok = done()
        return ok
    finally:
        query.stop()
        if query.exception():
            raise query.exception()


def ask_to_stop(spark: SparkSession, flag: str) -> None:
    """Asks the run that watches this flag, a file on the shared file system, to stop before its next batch. Asking again changes nothing."""
    fs, p = _path(spark, flag)
    fs.create(p, True).close()


def worked_off(stream: DataFrame, state: str, out: str, flag: str, work: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> bool:
    """Works off what a stream holds, batch by batch, and stores what work makes of each below out; True if nothing is left.

    Whoever sees the flag's folder may ask it to stop (ask_to_stop): the batch under way is finished and stored, the next one is not begun,
    and the result is False. A later run with the same state goes on with that batch. Each batch has a folder by its number, so that one that is
    repeated after a failure replaces itself; an error of work is raised. The request is taken back when the run ends, however it ends.
    """
    spark, halted = stream.sparkSession, []
    fs, asked = _path(spark, flag)

    def batch(rows: DataFrame, n: int) -> None:
        if fs.exists(asked):
            halted.append(n)
            raise InterruptedError(f"asked to stop before batch {n}")  # not committed: the next run begins here
        work(rows).write.mode("overwrite").parquet(f"{out}/{n:09d}")

    try:
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    except StreamingQueryException:
        if not halted:
            raise
    finally:
        fs.delete(asked, False)
    return not halted


def results(spark: SparkSession, out: str, schema) -> DataFrame:
    """What worked_off has stored so far; no rows before its first batch."""
    fs, p = _path(spark, out)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out) if fs.exists(p) else spark.createDataFrame([], schema)


#: Columns of a table of progress.
PROGRESS = "event string, name string, run string, batch long, input_rows long, updated_rows long, at string"


class ProgressTable(StreamingQueryListener):
    """Appends a row to a table for each start, batch and end of the queries whose name it is given (of all, without names)."""

    def __init__(self, spark: SparkSession, path: str, *names: str):
        self.spark, self.path, self.names, self.run_names = spark, path.rstrip("/"), names, {}

    def _append(self, **row) -> None:
        """One small file a row, complete or not there at all; its name is the same when an event is repeated."""
        if self.names and row["name"] not in self.names:
            return
        fs, target = _path(self.spark, f"{self.path}/{row['run']}-{row['event']}-{row['batch']}.json")
        _, part = _path(self.spark, f"{self.path}/_{row['run']}-{row['event']}-{row['batch']}.tmp")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()
        fs.rename(part, target)

    def onQueryStarted(self, event) -> None:
        self.run_names[str(event.runId)] = event.name
        self._append(event="started", name=event.name, run=str(event.runId), batch=None, input_rows=None, updated_rows=None, at=event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._append(event="progress", name=p.name, run=str(p.runId), batch=p.batchId, input_rows=p.numInputRows, updated_rows=sum(s.numRowsUpdated for s in p.stateOperators), at=p.timestamp)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        self._append(event="terminated", name=self.run_names.get(run), run=run, batch=None, input_rows=None, updated_rows=None, at=None)


def progress_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ProgressTable has written."""
    return spark.read.schema(PROGRESS).json(path)


class listening:
    """A block in which a listener is heard; when it ends, all events so far have been handled."""

    def __init__(self, spark: SparkSession, listener: StreamingQueryListener):
        self.spark, self.listener = spark, listener

    def __enter__(self) -> StreamingQueryListener:
        self.spark.streams.addListener(self.listener)
        return self.listener

    def __exit__(self, *_) -> None:
        self.spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        self.spark.streams.removeListener(self.listener)


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """day, event_type, n of a stream of events (ts, event_type), those later than the watermark left out. An extension."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")
