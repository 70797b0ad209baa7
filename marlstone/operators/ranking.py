"""Positions in a global order without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import sinks


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with the position (from 1) of each row in an order that has no ties.

    Rows go to ranges of the order and are written with the number of their range; positions are those within a range plus the rows of the ranges before.
    """
    spark, path = df.sparkSession, sinks.landing(df.sparkSession, "ranges")
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))  # a row a range
    before = sizes.select("_r", (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_before"))
    rows = rows.join(F.broadcast(before), F.col("_range") == F.col("_r"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return rows.withColumn(name, at.cast("int")).drop("_range", "_r", "_before")
