"""Question catalogues and prompt variants that are found as files, and the runs they make together.

A catalogue is a file of JSON lines, or a folder of such files, whose name begins as agreed; a prompt variant is a text file or a
folder of one. Questions are read line by line in as many tasks as their files give; only variants and models are few, and are counted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import WHITE
from . import ranking

#: Pairs of a variant and a model, at most: they go to every task.
PAIRS = 10_000


def _found(spark: SparkSession, root: str, prefix: str) -> tuple[str, list[str]]:
    """A path pattern of what begins with prefix right below root, folders of a partitioned table included, and the names there are."""
    pattern = f"{root.rstrip('/')}/{{,*=}}{prefix}*"
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return pattern, sorted({re.sub(r"\.[^.]*$", "", x.getPath().getName().rpartition("=")[2]) for x in listed})


def _name(prefix: str) -> Column:
    """The name of the file or folder that begins with prefix, without an extension."""
    return F.regexp_replace(F.regexp_extract("_metadata.file_path", rf"[/=]({prefix}[^/]*)(?:/[^/]*)?$", 1), r"\.[^.]*$", "")


def questions(spark: SparkSession, root: str, schema: str, needs: str, prefix: str = "question_catalog") -> DataFrame:
    """catalogue and the columns of schema of all questions below root; no catalogue, no rows.

    Blank lines are passed over. A line that is no JSON object, or has no value under `needs`, is a fault of the catalogue and an error that names it. Names hold letters,
    digits, points, hyphens and underscores.
    """
    pattern, names = _found(spark, root, prefix)
    if not names:
        return spark.createDataFrame([], f"catalogue string, {schema}")
    lines = spark.read.text(pattern).select(_name(prefix).alias("catalogue"), "value").where(F.trim("value") != "")
    read = lines.select("catalogue", F.from_json("value", schema).alias("q"))
    right = F.when(F.col("q")[needs].isNull(), F.raise_error(F.concat(F.lit(f"a question without {needs} in "), "catalogue"))).otherwise(F.col("q"))
    return read.select("catalogue", right.alias("q")).select("catalogue", "q.*")


def prompts(spark: SparkSession, root: str, prefix: str = "system_prompt") -> DataFrame:
    """variant and prompt, the text without white space around it, of all prompt files below root, empty ones included; no file, no rows."""
    pattern, names = _found(spark, root, prefix)
    variants = spark.createDataFrame([(n,) for n in names], "variant string")
    if not names:
        return variants.withColumn("prompt", F.lit(""))
    # Spark's file sources pass over files of no length
    read = spark.read.text(pattern, wholetext=True).select(_name(prefix).alias("variant"), F.regexp_replace("value", rf"^[{WHITE}]+|[{WHITE}]+$", "").alias("prompt"))
    return variants.join(read, "variant", "left").withColumn("prompt", F.coalesce("prompt", F.lit("")))


def runs(asked: DataFrame, variants: DataFrame, models: list[str], *order: str) -> DataFrame:
    """Each question under each variant and model, with its position pos (from 1): by catalogue, variant, model in the given order, question by `order`, which has no ties.

    asked: see questions; variants: see prompts. Without questions, variants or models there are no runs; too many variants and models are an error.
    """
    pairs = [(r.variant, r.prompt, m, i) for r in variants.limit(PAIRS + 1).collect() for i, m in enumerate(models)]
    if len(pairs) > PAIRS:
        raise ValueError(f"more than {PAIRS} pairs of a variant and a model")
    if not pairs:
        return asked.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("variant", "string"), ("prompt", "string"), ("model", "string"), ("pos", "int")))).where("false")
    each = F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(p).alias("prompt"), F.lit(m).alias("model"), F.lit(i).alias("_m")) for v, p, m, i in pairs))
    grid = asked.select("*", F.explode(each).alias("_x")).select(*asked.columns, "_x.*")
    return ranking.numbered(grid, "pos", *map(F.col, ("catalogue", "variant", "_m", *order))).drop("_m")
