"""Findings of a package audit (JSON) against a list of packages and the functions of them that are in use."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import name_key

#: The audit's JSON, as far as it is read.
SCHEMA = "dependencies array<struct<name:string,version:string,vulns:array<struct<id:string,description:string,fix_versions:array<string>>>>>"


def vulnerabilities(audits: DataFrame) -> DataFrame:
    """path, package, version, id, description of every vulnerability in audits (path, text); texts that are no such JSON have none."""
    rows = audits.select("path", F.explode(F.from_json("text", SCHEMA)["dependencies"]).alias("d"))
    return rows.select("path", F.col("d.name").alias("package"), F.col("d.version").alias("version"), F.explode("d.vulns").alias("v")).select("path", "package", "version", F.col("v.id").alias("id"), F.coalesce("v.description", F.lit("")).alias("description"))


def in_use(found: DataFrame, used: DataFrame) -> DataFrame:
    """found with status and function: unlisted (no such package in used: package, function), affected, with the longest function that the description names, or clear.

    Names are compared in lower case without underscores, points and spaces. Functions of a package meet its own findings only.
    """
    listed = used.select(name_key(F.col("package")).alias("_package")).distinct()
    rows = found.withColumn("_key", name_key(F.col("package"))).withColumn("_text", name_key(F.col("description")))
    functions = used.where("function is not null").select(name_key(F.col("package")).alias("_package"), "function")
    hits = rows.select("path", "package", "id", "_key", "_text").distinct().join(functions, F.col("_key") == F.col("_package")).where(F.contains("_text", name_key(F.col("function"))))
    best = hits.groupBy(F.col("path").alias("_p"), F.col("package").alias("_n"), F.col("id").alias("_i")).agg(F.max_by("function", F.struct(F.length("function"), "function")).alias("function"))
    out = rows.join(listed, F.col("_key") == F.col("_package"), "left").join(best, (F.col("path") == F.col("_p")) & (F.col("package") == F.col("_n")) & (F.col("id") == F.col("_i")), "left")
    status = F.when(F.col("_package").isNull(), "unlisted").when(F.col("function").isNotNull(), "affected").otherwise("clear")
    return out.withColumn("status", status).select(*found.columns, "status", "function")
