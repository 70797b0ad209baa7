"""Reports and snapshots as files.

Folders are written by Spark's committers, so that a lost executor leaves no half of one. Only reports that are one file by nature (a Markdown
table, a merged document) are put together on the driver, from rows whose number is checked.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows of a report that is one file, at most.
REPORT_ROWS = 100_000
#: Folders that a task writes to at a time, up to which rows that are stored by columns need not be sorted by them.
KEPT_FOLDERS, _WRITERS = 16, "spark.sql.maxConcurrentOutputFileWriters"


def landing(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared one (spark.checkpoint.dir); only local mode without that setting takes a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/marlstone/{uuid.uuid4().hex}/{name}"


def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df, written to the shared folder (partitioned by the named columns) and read from there: what several jobs read is made once. It goes when the driver ends."""
    spark, path = df.sparkSession, landing(df.sparkSession, name)
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, KEPT_FOLDERS if by else before)
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(_WRITERS, before)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def flat(df: DataFrame, *columns: str, sep: str = ", ") -> DataFrame:
    """The named columns only; lists of strings joined, so that they fit a CSV cell."""
    kinds = dict(df.dtypes)
    return df.select(*(F.array_join(c, sep).alias(c) if kinds[c] == "array<string>" else F.col(c) for c in columns or df.columns))


def write_csv(df: DataFrame, path: str, *columns: str, sep: str = ",") -> str:
    """CSV with a header; columns that are not named are dropped."""
    flat(df, *columns).write.mode("overwrite").option("header", True).option("escape", '"').option("quote", '"').option("sep", sep).csv(path)
    return path


def append_records(df: DataFrame, path: str) -> str:
    """JSON lines, added to what is there."""
    df.write.mode("append").json(path)
    return path


def bounded(df: DataFrame) -> list:
    """Rows of a report, which must be few."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows")
    return rows


def markdown_rows(df: DataFrame, right: tuple[str, ...] = ()) -> DataFrame:
    """line of a Markdown table: header, rule (columns in right are set to the right), then one line a row, in the order of the table. Bars in cells are escaped, null is empty."""
    head = "| " + " | ".join(df.columns) + " |"
    rule = "|" + "|".join("---:" if c in right else "---" for c in df.columns) + "|"
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |"))
    top = df.sparkSession.createDataFrame([(head,), (rule,)], "line string")
    return top.unionAll(df.select(line.alias("line")))


def write_whole(text: str, path: str) -> str:
    """One local file, complete or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=folder, delete=False, newline="") as f:
        f.write(text)
    os.replace(f.name, path)
    return path


def write_markdown(df: DataFrame, path: str, right: tuple[str, ...] = ()) -> str:
    """A Markdown table of a sorted, small DataFrame as one local file."""
    return write_whole("\n".join(r.line for r in bounded(markdown_rows(df, right))) + "\n", path)


def label_once(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with the group's label in the first row of each group only, in the given order within it."""
    first = F.row_number().over(Window.partitionBy(group).orderBy(*order)) == 1
    return df.withColumn("label", F.when(first, F.col(group).cast("string")).otherwise(""))


def write_entities(df: DataFrame, path: str, key: str, text: Column) -> str:
    """A folder of text files for each value of key."""
    df.select(key, text.alias("value")).write.mode("overwrite").partitionBy(key).text(path)
    return path


def merged_document(files: DataFrame, *group: str) -> DataFrame:
    """group, document: all files (path, text) of a group in order of path under one heading each; without a group all of them, which must be few."""
    section = F.concat(F.lit("## File: "), "path", F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    parts = F.sort_array(F.collect_list(F.struct("path", section.alias("s"))))
    return files.groupBy(*group).agg(F.array_join(F.transform(parts, lambda p: p["s"]), "\n").alias("document"))


def merged_chats(turns: DataFrame) -> DataFrame:
    """source_file, title, messages of chats (source_file, title, n, sender, text) that have any message with text."""
    kept = turns.where("text is not null and trim(text) != ''")
    return kept.groupBy("source_file", "title").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "sender", "text"))), lambda m: F.struct(m["sender"].alias("sender"), m["text"].alias("text"))).alias("messages"))
