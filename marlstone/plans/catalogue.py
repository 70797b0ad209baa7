"""All registered queries with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from . import code, landed, physical, relational
from .dialect import Duck, Spark

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def run(statement: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs a statement whose {table} marks stand for the tables in sf_dir; only those it names are opened."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in statement}
    return spark.sql(statement, **used)


QUERIES: dict = {name: partial(run, f(Spark)) for name, f in relational.PLANS.items()} | physical.QUERIES | code.QUERIES | landed.QUERIES
ORACLE_SQL: dict = {name: f(Duck) for name, f in relational.PLANS.items()} | code.ORACLE_SQL | landed.ORACLE_SQL
