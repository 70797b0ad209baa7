"""A positional inverted index of words, and phrases looked up in it.

The index is made in segments, one a task and without a shuffle: a row for each word of a document with the places at
which it stands, sorted by word, so that a look-up of few words reads few row groups of each segment. A phrase is
looked up by its rarest word: only there are candidates made, one a document. Its other words are joined to them by
word and document, and each leaves of the candidate's places those that have it at its distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .. import sinks

#: Rows of a table that may be broadcast, after they have been counted; and rows of texts that are turned into entries at a time.
BROADCAST_ROWS, ROWS = 200_000, 200


def words(text: Column) -> Column:
    """Maximal runs of letters and digits in lower case; null and empty texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _entries(part: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """Rows (key, row, words) as entries word, key, row, places: one for each different word of a row."""
    lists = part.column(2)
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    held = pc.list_flatten(lists).dictionary_encode()
    code = held.indices.to_numpy(zero_copy_only=False)
    place = (np.arange(len(row)) - np.searchsorted(row, row)).astype(np.int32)
    order = np.lexsort((place, row, code))
    code, row, place = code[order], row[order], place[order]
    starts = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(place))
    which = pa.array(row[starts])
    return pa.RecordBatch.from_arrays([held.dictionary.take(pa.array(code[starts])), part.column(0).take(which), part.column(1).take(which), places], names)


def index(texts: DataFrame, key: str) -> DataFrame:
    """word, key, row, places (from 0) of the words of texts (key, text), stored. Rows that repeat a key with another text are told apart by `row`; rows without a key take no part."""
    names = ["word", key, "row", "places"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                yield _entries(b.slice(at, ROWS), names)

    schema = StructType([StructField("word", StringType()), StructField(key, texts.schema[key].dataType), StructField("row", LongType()), StructField("places", ArrayType(IntegerType()))])
    rows = texts.where(F.col(key).isNotNull()).select(key, F.xxhash64("text").alias("row"), words(F.col("text")).alias("words"))
    return sinks.kept(rows.mapInArrow(run, schema).sortWithinPartitions("word"), "index")


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows; else its joins shuffle, and skewed ones are split at run time."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def found(index: DataFrame, phrases: DataFrame, key: str, phrase: str) -> DataFrame:
    """phrase, key and n, the places at which a document holds a phrase (phrase, text) as whole words in a row; phrases without words are in none.

    Phrases are told apart by the column `phrase`; rows that repeat it must have the same text. Equal rows of the indexed texts count once, and
    those that share no more than a key each for itself.
    """
    asked = sinks.kept(phrases.dropDuplicates([phrase]).select(F.col(phrase).alias("_phrase"), F.posexplode(words(F.col("text"))).alias("_at", "_word")), "asked")
    sought = _small(asked.select(F.col("_word").alias("word")).distinct())
    entries = index.select("word", F.col(key).alias("_key"), F.col("row").alias("_row"), "places").join(sought, "word", "left_semi")
    frequency = entries.groupBy("word").agg(F.sum(F.size("places")).alias("_n"))
    rated = asked.join(frequency, F.col("_word") == F.col("word"), "left").drop("word").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = rated.groupBy("_phrase").agg(F.min_by(F.struct("_word", "_at"), F.struct("_n", "_at")).alias("r"), F.count("*").alias("_size"), F.min("_n").alias("_least")).where("_least > 0")
    rarest = _small(sinks.kept(rarest.select("_phrase", "_size", F.col("r._word").alias("word"), F.col("r._at").alias("_off")), "rarest"))
    starts = F.filter(F.transform("places", lambda x: x - F.col("_off")), lambda x: x >= 0)
    candidates = sinks.kept(entries.join(rarest, "word").select("_phrase", "_size", "_off", "_key", "_row", starts.alias("_starts")).where(F.size("_starts") > 0).distinct(), "candidates")
    # the other words of each candidate; what of its places they leave
    others = _small(asked.select(F.col("_phrase").alias("_p"), "_at", F.col("_word").alias("word")))
    more = candidates.where("_size > 1").join(others, (F.col("_phrase") == F.col("_p")) & (F.col("_at") != F.col("_off"))).drop("_p")
    left = F.array_intersect("_starts", F.transform("places", lambda x: x - F.col("_at")))
    hits = more.join(entries, ["word", "_key", "_row"]).select("_phrase", "_size", "_key", "_row", "_at", left.alias("_left")).where(F.size("_left") > 0)
    hits = hits.groupBy("_phrase", "_size", "_key", "_row").agg(F.collect_set(F.struct("_at", "_left")).alias("_lefts")).where(F.size("_lefts") == F.col("_size") - 1)
    both = F.aggregate(F.slice("_lefts", 2, F.greatest(F.size("_lefts") - 1, F.lit(0))), F.get("_lefts", 0)["_left"], lambda a, x: F.array_intersect(a, x["_left"]))
    whole = hits.select("_phrase", "_key", F.size(both).alias("n")).unionAll(candidates.where("_size = 1").select("_phrase", "_key", F.size("_starts").alias("n")))
    return whole.groupBy(F.col("_phrase").alias(phrase), F.col("_key").alias(key)).agg(F.sum("n").cast("long").alias("n")).where("n > 0")
