"""SQLite files as a Spark data source, in both directions.

A table is read by ranges of rowids, several tasks a file; filters on single columns go into the statement that each task runs. Files must lie on a
mounted folder: SQLite opens paths, not stores. Register with `register(spark)`, then `spark.read.format("sqlite")`.
"""

from __future__ import annotations

import os
import sqlite3
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

#: Spark's types of SQLite's affinities; columns without one of these are text.
_TYPES = {"INT": LongType(), "REAL": DoubleType(), "FLOA": DoubleType(), "DOUB": DoubleType(), "BLOB": BinaryType()}
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Rows that a task sends on at a time.
BATCH = 5_000
#: Ranges of one file, at most: rowids may be far apart.
MOST_RANGES = 10_000


def local(path: str) -> str:
    """The path of a file: URI or of a mounted folder."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"SQLite files must be on a mounted folder, not at {path}")
    return path


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.table = schema, options["dbtable"]
        root = local(options["path"])
        self.paths = sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".db")) if os.path.isdir(root) else [root]
        self.rows = int(options.get("rowspertask", 100_000))
        self.where, self.values = [], []

    def pushFilters(self, filters):
        """Comparisons with one value, membership and null tests of a column run in SQLite; Spark keeps the rest."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = {x.name: x.dataType for x in self.schema}.get(name)
            plain = lambda *v: all(isinstance(x, {LongType: int, DoubleType: (int, float), StringType: str}.get(type(kind), ())) and not isinstance(x, bool) for x in v)  # noqa: B023, E731
            if type(f) in _COMPARED and plain(f.value):
                self.where.append(f"{_quoted(name)} {_COMPARED[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, In) and f.value and plain(*f.value):
                self.where.append(f"{_quoted(name)} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif isinstance(f, (IsNull, IsNotNull)) and name:
                self.where.append(f"{_quoted(name)} IS {'NOT ' * isinstance(f, IsNotNull)}NULL")
            else:
                yield f

    def partitions(self):
        found = []
        for path in self.paths:
            with _open(path) as c:
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            c.close()
            if low is not None:
                step = max(self.rows, -(-(high - low + 1) // MOST_RANGES))
                found += [_Range(path, a, min(a + step, high + 1)) for a in range(low, high + 1, step)]
        return found or [_Range(self.paths[0], 0, 0)] if self.paths else [_Range("", 0, 0)]

    def read(self, partition):
        names = [f.name for f in self.schema]
        kinds = pa.schema([(f.name, {LongType: pa.int64(), DoubleType: pa.float64(), BinaryType: pa.binary()}.get(type(f.dataType), pa.string())) for f in self.schema])
        if partition.low >= partition.high:
            return
        conditions = " AND ".join(["rowid >= ? AND rowid < ?", *self.where])
        c = _open(partition.path)
        try:
            rows = c.execute(f"SELECT {', '.join(map(_quoted, names))} FROM {_quoted(self.table)} WHERE {conditions}", [partition.low, partition.high, *self.values])
            while some := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*some), kinds.types)], schema=kinds)
        finally:
            c.close()


class SqliteSource(DataSource):
    """Options: path (a file, or a folder of *.db files with the same table), dbtable, rowspertask."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        paths = SqliteReader(StructType(), self.options).paths
        if not paths:
            raise ValueError(f"no SQLite file below {self.options['path']}")
        c = _open(paths[0])
        try:
            columns = c.execute(f"PRAGMA table_info({_quoted(self.options['dbtable'])})").fetchall()
        finally:
            c.close()
        return StructType([StructField(n, next((t for k, t in _TYPES.items() if k in kind.upper()), StringType())) for _, n, kind, *_ in columns])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it push filters."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, table: str, rows_per_task: int = 100_000) -> DataFrame:
    register(spark)
    return spark.read.format("sqlite").option("path", path).option("dbtable", table).option("rowspertask", rows_per_task).load()


def write(df: DataFrame, path: str, table: str) -> str:
    """A folder of SQLite files, one a task that has rows, each complete or not there at all; columns of long, double, binary, and all others as text. A repeated task writes its file anew."""
    root = local(path)
    os.makedirs(root, exist_ok=True)
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    columns = ", ".join(f"{_quoted(c)} {kinds.get(k, 'TEXT')}" for c, k in df.dtypes)

    def run(batches):
        final = os.path.join(root, f"{table}-{TaskContext.get().partitionId():05d}.db")
        part = f"{final}.{uuid.uuid4().hex}"
        c, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            if c is None:
                c = sqlite3.connect(part)
                c.execute(f"CREATE TABLE {_quoted(table)} ({columns})")
            c.executemany(f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * b.num_columns)})", zip(*(x.to_pylist() for x in b.columns)))
            n += b.num_rows
        if c is not None:
            c.commit()
            c.close()
            os.replace(part, final)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    plain = df.selectExpr(*(f"`{c}`" if k in kinds else f"cast(`{c}` as string) as `{c}`" for c, k in df.dtypes))
    plain.mapInArrow(run, "n long").agg({"n": "sum"}).collect()  # one number
    return path
