"""Overlaps of intervals of any length, as equi-joins.

An interval of length l belongs to the scale of the least power of two that is not below l, and lies in at most two bins of that width.
Of two that overlap, the shorter one looks the longer one up at the longer one's scale, where it lies in at most two bins itself. So no
bin is narrower than what it holds, however lengths differ, and a group with many intervals is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _scale(length: Column) -> Column:
    """The exponent of the least power of two that is not below the length, exactly: from the bits of length - 1."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int")


def overlaps(rows: DataFrame, group: str, id_: str, start: str, end: str) -> DataFrame:
    """group, a_id, b_id of each pair of rows of a group with a_id < b_id, a.start < b.end and b.start < a.end.

    start and end are integers of 64 bits, such as seconds or microseconds. Rows with a null, and those that end before they start, meet
    nothing; an empty interval meets those that hold it inside. Rows that repeat an id do not meet each other.
    """
    own = rows.select(F.col(group).alias("g"), F.col(id_).alias("id"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("g is not null and id is not null and e >= s")
    own = own.withColumn("scale", _scale(F.col("e") - F.col("s")))
    scales = sorted(r.scale for r in own.select("scale").distinct().collect())  # at most 64
    bins = F.expr("sequence(shiftright(s, scale), shiftright(greatest(e - 1, s), scale))")
    held = own.select("g", "id", "s", "e", "scale", F.explode(bins).alias("bin"))
    every = F.array(*map(F.lit, scales)).cast("array<int>")
    asked = own.withColumnRenamed("scale", "own").withColumn("scale", F.explode(F.filter(every, lambda x: x >= F.col("own"))))
    asked = asked.select(F.col("g").alias("g2"), F.col("id").alias("id2"), F.col("s").alias("s2"), F.col("e").alias("e2"), "own", F.col("scale").alias("scale2"), F.explode(bins).alias("bin2"))
    both = held.join(asked, (F.col("g") == F.col("g2")) & (F.col("scale") == F.col("scale2")) & (F.col("bin") == F.col("bin2")))
    # once: in the first bin that both lie in, and of equal scales from one side
    first = F.col("bin") == F.expr("greatest(shiftright(s, scale), shiftright(s2, scale))")
    side = (F.col("own") < F.col("scale")) | (F.col("id") < F.col("id2"))
    met = both.where(first & side & (F.col("id") != F.col("id2")) & (F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")))
    return met.select(F.col("g").alias(group), F.least("id", "id2").alias("a_id"), F.greatest("id", "id2").alias("b_id"))
