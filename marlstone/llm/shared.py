"""Helpers shared by the training-data operators.

Intermediate results that several jobs read are written as Parquet below the
shared folder named by ``spark.checkpoint.dir``, so they survive the loss of
any executor.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Code points that end a word in the contracts: space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode, where nothing is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut in the lineage that is safe to lose executors over."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod: the contracts' folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def sampled(doc_id: Column, share: float) -> Column:
    """True for about this share of ids, the same ones on each run."""
    return F.pmod(F.xxhash64(doc_id, F.lit("sample")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))


#: Slots of a bit table: 8 MB whatever it holds. With more keys it lets more rows through, and still loses none.
SLOTS = 1 << 26
#: Rows of a table that may be broadcast, after they have been counted.
BROADCAST_ROWS = 200_000


def bit_table(hashes: DataFrame):
    """Broadcast bits of the remainders of 64-bit hashes, a table of one column."""
    words = hashes.toDF("h").select((F.col("h").bitwiseAND(SLOTS - 1)).alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("bits"))
    bits = np.zeros(SLOTS >> 6, np.uint64)
    for b in words.toArrow().to_batches():  # at most SLOTS / 64 rows
        bits[b.column(0).to_numpy()] = b.column(1).to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def in_bit_table(bits: np.ndarray, hashes: pa.Array) -> pa.Array:
    """Which hashes have their bit set."""
    s = hashes.to_numpy(zero_copy_only=False).astype(np.int64) & (SLOTS - 1)
    return pa.array((bits[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1)


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows; else joins shuffle, and skewed ones are split at run time. df is stored: it is counted."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Rows that a Python worker gets at a time, at most: texts are long, and a batch is held several times over on its way.
BATCH_ROWS = 1_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: What a worker process keeps from one task to the next, for one purpose at a time.
_KEPT: dict = {}


def kept(key, make):
    """What a worker process keeps under a key, made when it is not there; what it kept for another purpose goes."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def _forget() -> None:
    _KEPT.clear()


def mapped(df: DataFrame, run, schema, keeps: bool = False) -> DataFrame:
    """df.mapInArrow by batches of BATCH_ROWS rows at most (a setting of the session from then on); workers give memory back after each task, and what they kept before, unless run keeps something."""
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))

    def tidy(batches):
        if not keeps:
            _forget()
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(tidy, schema)
