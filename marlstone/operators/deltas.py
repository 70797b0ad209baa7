"""Snapshots against each other, and keys that stay the same over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def new_and_gone(before: DataFrame, after: DataFrame, *key: str) -> DataFrame:
    """category, key: keys of only one of two snapshots."""
    a, b = before.select(*key).distinct(), after.select(*key).distinct()
    lacks = lambda x, y, name: x.alias("x").join(y.alias("y"), [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in key], "left_anti").select(F.lit(name).alias("category"), *key)
    return lacks(b, a, "new").unionByName(lacks(a, b, "removed"))


def of_one_version(before: DataFrame, after: DataFrame, *key: str) -> DataFrame:
    """new_and_gone if both snapshots (with a column version) have one and the same version; else no rows."""
    versions = before.select("version").union(after.select("version")).agg(F.count_distinct("version").alias("_versions"))
    return new_and_gone(before, after, *key).crossJoin(F.broadcast(versions)).where("_versions = 1").drop("_versions")  # one row


def upserted(log: DataFrame, changes: DataFrame, key: str, rank: str, guarded: bool = True) -> DataFrame:
    """The log with the changes put in by key. guarded: a change only replaces a row of a lower or equal rank; else the last change always does."""
    rows = log.withColumn("_turn", F.lit(0)).unionByName(changes.withColumn("_turn", F.lit(1)))
    order = [F.desc(rank), F.desc("_turn")] if guarded else [F.desc("_turn"), F.desc(rank)]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n", "_turn")


def completeness(days: DataFrame, endpoints: tuple[str, ...], files: DataFrame) -> DataFrame:
    """day, endpoint, status of every expected pair: ok, corrupt (no JSON) or missing; files: day, endpoint, text."""
    expected = days.select("day", F.explode(F.array(*map(F.lit, endpoints))).alias("endpoint"))
    valid = files.groupBy(F.col("day").alias("_day"), F.col("endpoint").alias("_endpoint")).agg(F.bool_or(F.try_parse_json("text").isNotNull()).alias("_ok"))
    rows = expected.join(valid, (F.col("day") == F.col("_day")) & (F.col("endpoint") == F.col("_endpoint")), "left")
    return rows.select("day", "endpoint", F.when(F.col("_ok").isNull(), "missing").when(F.col("_ok"), "ok").otherwise("corrupt").alias("status"))


def finding_ids(known: DataFrame, found: DataFrame) -> DataFrame:
    """prefix, key, id, state of known (prefix, key, number) and found (prefix, key) findings.

    A finding that is still there keeps its number, one that is not is resolved and its number is not used again, new ones get the next free numbers of their prefix in order of key.
    """
    now = found.select("prefix", "key").distinct()
    same = (F.col("k.prefix") == F.col("f.prefix")) & (F.col("k.key") == F.col("f.key"))
    old = known.alias("k").join(now.alias("f"), same, "left").select(F.col("k.prefix").alias("prefix"), F.col("k.key").alias("key"), F.col("k.number").cast("long").alias("number"), F.when(F.col("f.key").isNull(), "resolved").otherwise("open").alias("state"))
    fresh = now.alias("f").join(known.alias("k"), same, "left_anti")
    last = known.groupBy(F.col("prefix").alias("_prefix")).agg(F.max("number").alias("_last"))
    fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("prefix").orderBy("key"))).join(last, F.col("prefix") == F.col("_prefix"), "left")
    fresh = fresh.select("prefix", "key", (F.col("_n") + F.coalesce("_last", F.lit(0))).cast("long").alias("number"), F.lit("new").alias("state"))
    return old.unionByName(fresh).select("prefix", "key", F.concat_ws("-", "prefix", F.col("number").cast("string")).alias("id"), "state")


def graded(rows: DataFrame, veto: str, *others: str, worst: int = 3, best: int = 1) -> DataFrame:
    """rows with grade: worst if the veto dimension, or two others, are worst; best if all are best; else middle."""
    n = sum((F.coalesce((F.col(c) == worst).cast("int"), F.lit(0)) for c in others), F.lit(0))
    fine = F.forall(F.array(veto, *others), lambda x: x == best)
    return rows.withColumn("grade", F.when((F.col(veto) == worst) | (n >= 2), "worst").when(fine, "best").otherwise("middle"))
