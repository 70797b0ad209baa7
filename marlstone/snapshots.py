"""Versioned snapshots of a table: data files that are never changed, and manifests that say which of them count.

A write puts its data into a folder of its own and then commits one manifest, which lists every live snapshot with its folder, its number of rows
and whether it is complete. Manifests are numbered; a commit is one rename to the next number, which fails if somebody else has taken it, and is then
tried again on top of theirs. Readers go by the last manifest, so they see the state before a write or the state after it, and never
a part; any earlier version can still be read.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Attempts of a commit before it gives up: each failure means that another writer has committed.
ATTEMPTS = 50


class Conflict(RuntimeError):
    """Too many other writers, or a snapshot that has changed meanwhile."""


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all manifests, in order."""
    fs, folder = _hadoop(spark, f"{path}/_manifests")
    if not fs.exists(folder):
        return []
    return sorted(int(m[1]) for f in fs.listStatus(folder) if (m := re.fullmatch(r"(\d{12})\.json", f.getPath().getName())))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version, or the last: {"version", "snapshots": {number: {"folder", "rows", "schema_version", "complete"}}}."""
    found = versions(spark, path)
    if version is None:
        version = found[-1] if found else 0
    elif version not in found:
        raise ValueError(f"no version {version} of {path}")
    if not version:
        return {"version": 0, "snapshots": {}}
    lines = spark.read.option("wholetext", True).text(f"{path}/_manifests/{version:012d}.json").collect()  # one small file
    return json.loads(lines[0].value)


def _commit(spark: SparkSession, path: str, change) -> int:
    """Applies change to the last manifest's snapshots and commits the result under the next number."""
    jvm = spark._jvm
    for _ in range(ATTEMPTS):
        last = manifest(spark, path)
        new = {"version": last["version"] + 1, "snapshots": change(dict(last["snapshots"]))}
        fs, part = _hadoop(spark, f"{path}/_manifests/.{uuid.uuid4().hex}.tmp")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        out.close()
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests/{new['version']:012d}.json")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        try:
            files.rename(part, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))  # never replaces a file
            return new["version"]
        except Exception as e:
            fs.delete(part, False)
            if "FileAlreadyExists" not in str(e):
                raise
    raise Conflict(f"no commit to {path} in {ATTEMPTS} attempts")


def write(df: DataFrame, path: str, snapshot_id: int, schema_version: int = 1, complete: bool = True) -> int:
    """Writes a snapshot, in place of an earlier one of that number, and returns the version from which it is seen. Until its commit nothing of it is."""
    spark = df.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    rows = spark.read.parquet(f"{path}/{folder}").count()  # from the files' footers
    entry = {"folder": folder, "rows": rows, "schema_version": schema_version, "complete": complete}
    return _commit(spark, path, lambda snapshots: snapshots | {str(int(snapshot_id)): entry})


def mark_complete(spark: SparkSession, path: str, snapshot_id: int, folder: str | None = None) -> int:
    """Marks a snapshot as complete; with a folder only if that is still its data, so that a mark never falls on what another run has written since."""

    def change(snapshots: dict) -> dict:
        entry = snapshots.get(str(int(snapshot_id)))
        if entry is None or folder not in (None, entry["folder"]):
            raise Conflict(f"snapshot {snapshot_id} of {path} is not the one to mark")
        return snapshots | {str(int(snapshot_id)): entry | {"complete": True}}

    return _commit(spark, path, change)


def remove(spark: SparkSession, path: str, snapshot_id: int) -> int:
    """Leaves a snapshot out from the next version on; its data stay for earlier ones."""
    return _commit(spark, path, lambda snapshots: {k: v for k, v in snapshots.items() if k != str(int(snapshot_id))})


def entries(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """snapshot_id, rows, schema_version, complete of a version's snapshots."""
    rows = [(int(k), v["rows"], v["schema_version"], v["complete"]) for k, v in manifest(spark, path, version)["snapshots"].items()]
    return spark.createDataFrame(rows, "snapshot_id long, rows long, schema_version int, complete boolean")


def read(spark: SparkSession, path: str, snapshot_id: int | None = None, version: int | None = None, complete_only: bool = False) -> DataFrame:
    """The records of a snapshot, by default of that with the greatest number, with snapshot_id and version (of its schema); from the last manifest or an earlier one."""
    found = {int(k): v for k, v in manifest(spark, path, version)["snapshots"].items() if v["complete"] or not complete_only}
    if not found or snapshot_id is not None and snapshot_id not in found:
        raise ValueError(f"no such snapshot in {path}")
    number = max(found) if snapshot_id is None else snapshot_id
    entry = found[number]
    return spark.read.parquet(f"{path}/{entry['folder']}").withColumn("snapshot_id", F.lit(number)).withColumn("version", F.lit(entry["schema_version"]))


def resumable(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots that were begun and not completed: snapshot_id, rows."""
    return entries(spark, path).where("not complete").select("snapshot_id", "rows")
