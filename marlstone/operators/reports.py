"""Parsers of reports, logs and lists of findings: text columns become rows, without a shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Lines that the tools write.
FUNCTION_ROW = r"^\|\s*(\d+)\s*\|\s*(\w+)\s*\|\s*([^\|]*)\|\s*([^\|]+?)\s*\|\s*(\d+)\s*\|\s*$"
SUITE_ROW = r"^\s*(\S.*?)\s{2,}(\d+)\s+checks?\s+—\s+(\d+)\s+passed,\s+(\d+)\s+failed\s*$"
SUITE_HEADER, SUITE_UNKNOWN = "ZUSAMMENFASSUNG", "Ergebnis nicht erkannt"
FINDING = r"^(.+):(\d+): (unused \S+) '([^']+)' \((\d+)% confidence\)$"


def _lines(text: str | Column) -> Column:
    return F.split(text, "\r\n|\r|\n", -1)


def function_rows(reports: DataFrame) -> DataFrame:
    """path, file, lineno, kind, class_name, name, line_count of the table rows of reports (path, text); file is the last ### header before a row."""
    # sections: what stands before the first header belongs to no file
    sections = reports.select("path", F.posexplode(F.split(F.concat(F.lit("\n"), "text"), r"\n### (?=\S| +\S)")).alias("n", "s")).where("n > 0")
    rows = sections.select("path", F.trim(F.regexp_extract("s", r"^([^\n]*)", 1)).alias("file"), F.explode(F.filter(_lines("s"), lambda x: x.rlike(FUNCTION_ROW))).alias("row"))
    part = lambda n: F.trim(F.regexp_extract("row", FUNCTION_ROW, n))
    return rows.select("path", "file", part(1).cast("long").alias("lineno"), part(2).alias("kind"), part(3).alias("class_name"), part(4).alias("name"), part(5).cast("long").alias("line_count"))


def table_value(text: Column, label: str) -> Column:
    """The first cell that is a number in the first row with a label, without thousands commas; cells that end in % are passed over. Text: "12" and "12.5" tell whole from other numbers."""
    row = F.regexp_extract(text, rf"(?m)^\|\s*{re.escape(label)}\s*\|(.+)\|\s*$", 1)
    cells = F.transform(F.split(row, r"\|"), lambda c: F.replace(F.trim(c), F.lit(","), F.lit("")))
    return F.get(F.filter(cells, lambda c: c.rlike(r"^[+-]?(\d+|\d+\.\d*|\.\d+)$")), 0)


def suite_rows(logs: DataFrame) -> DataFrame:
    """path, n, label, total, passed, failed, unknown: the lines after the summary's header that name a suite, or (unknown) that were not recognised."""
    first = F.expr(f"substring(text, instr(text, '{SUITE_HEADER}'))")
    rows = logs.where(F.col("text").contains(SUITE_HEADER)).select("path", F.posexplode(F.slice(_lines(first), 2, 1_000_000_000)).alias("n", "row")).where(F.col("row").rlike(SUITE_ROW) | F.col("row").contains(SUITE_UNKNOWN))
    part = lambda n: F.regexp_extract("row", SUITE_ROW, n)
    return rows.select("path", "n", F.trim(part(1)).alias("label"), *(part(k).try_cast("long").alias(c) for k, c in ((2, "total"), (3, "passed"), (4, "failed"))), F.col("row").contains(SUITE_UNKNOWN).alias("unknown"))


def suite_gate(logs: DataFrame, exit_code: str | None = None) -> DataFrame:
    """path, status, total, passed: no_header, unrecognised, no_suite, red or ok, the first that holds; numbers only if ok. With exit_code a column that must be 0."""
    sums = suite_rows(logs).groupBy(F.col("path").alias("_path")).agg(F.bool_or("unknown").alias("unknown"), F.count_if(~F.col("unknown")).alias("suites"), F.sum("failed").alias("failed"), F.sum("total").alias("total"), F.sum("passed").alias("passed"))
    red = (F.col("failed") > 0) | (F.col(exit_code) != 0 if exit_code else F.lit(False))
    status = F.when(~F.col("text").contains(SUITE_HEADER), "no_header").when(F.col("unknown"), "unrecognised").when(F.coalesce("suites", F.lit(0)) == 0, "no_suite").when(red, "red").otherwise("ok")
    rows = logs.join(sums, F.col("path") == F.col("_path"), "left").withColumn("status", status)
    return rows.select("path", "status", *(F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in ("total", "passed")))


def passed_or_raise(gated: DataFrame) -> DataFrame:
    """The rows of suite_gate, or an error when any is not ok: nothing is written from a red run."""
    return gated.withColumn("status", F.when(F.col("status") == "ok", F.col("status")).otherwise(F.raise_error(F.concat(F.lit("red run: "), "path", F.lit(" "), "status"))))


def findings(reports: DataFrame) -> DataFrame:
    """path, file, line, kind, name, confidence of the finding lines of reports (path, text); backslashes in files become slashes."""
    rows = reports.select("path", F.explode(F.filter(F.transform(_lines("text"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.rlike(FINDING))).alias("row"))
    part = lambda n: F.regexp_extract("row", FINDING, n)
    return rows.select("path", F.replace(part(1), F.lit("\\"), F.lit("/")).alias("file"), part(2).cast("long").alias("line"), part(3).alias("kind"), part(4).alias("name"), part(5).cast("long").alias("confidence"))


def without_accepted(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings with `accepted`, true where (file, name) is in a list of accepted ones (file, name); slashes either way."""
    known = accepted.select(F.replace("file", F.lit("\\"), F.lit("/")).alias("_file"), F.col("name").alias("_name")).distinct()
    rows = found.join(known, (F.col("file") == F.col("_file")) & (F.col("name") == F.col("_name")), "left")
    return rows.withColumn("accepted", F.col("_file").isNotNull()).drop("_file", "_name")


def sections(documents: DataFrame) -> DataFrame:
    """path, pos, title, ts, raw: the ## sections of documents (path, text) in order of time, those without a time last in their old order, numbered anew."""
    text = F.concat(F.lit("\n"), "text")
    parts = F.slice(F.split(text, r"\n(?=## )", -1), 2, 1_000_000_000)
    rows = documents.select("path", F.posexplode(parts).alias("n", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))).where("raw != ''")
    ts = F.try_to_timestamp(F.regexp_extract("raw", r"\*(\d{2}\.\d{2}\.\d{4} \d{2}:\d{2})\*", 1), F.lit("dd.MM.yyyy HH:mm"))
    pos = F.row_number().over(Window.partitionBy("path").orderBy(F.asc_nulls_last("ts"), "n"))
    rows = rows.select("path", "n", F.trim(F.regexp_extract("raw", r"^## \d+ — ([^\n]+)", 1)).alias("title"), ts.alias("ts"), "raw").withColumn("pos", pos)
    return rows.select("path", "pos", "title", "ts", F.regexp_replace("raw", F.lit(r"^## \d+ — "), F.format_string("## %03d — ", "pos")).alias("raw"))


def csv_rows(files: DataFrame, *columns: str) -> DataFrame:
    """path, n and the named columns of small CSV texts (path, text): separator by the first line (; if it holds one, else ,), an optional sep= line, byte order mark, header in any case.

    Values are trimmed; a column that is not there is null, one that is there and blank is empty. Quoted values may hold the separator and doubled quotes, not line ends.
    """
    bare = F.regexp_replace("text", "^﻿", "")
    sep = F.when(F.split(bare, "\n")[0].contains(";"), ";").otherwise(",")
    lines = F.filter(_lines(bare), lambda x: x != "")
    rows = files.select("path", sep.alias("sep"), F.when(lines[0].startswith("sep="), F.slice(lines, 2, 1_000_000_000)).otherwise(lines).alias("lines"))
    outside = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    cells = lambda x: F.transform(F.when(F.col("sep") == ";", F.split(x, ";" + outside, -1)).otherwise(F.split(x, "," + outside, -1)), lambda c: F.trim(F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"'))))
    rows = rows.select("path", F.transform(cells(F.col("lines")[0]), lambda x: F.lower(x)).alias("head"), F.posexplode(F.transform(F.slice("lines", 2, 1_000_000_000), cells)).alias("n", "row"))
    at = lambda c: F.array_position("head", F.lit(c))
    return rows.select("path", "n", *(F.when(at(c) > 0, F.coalesce(F.get("row", (at(c) - 1).cast("int")), F.lit(""))).alias(c) for c in columns))


def timed_rows(logs: DataFrame, since: str, until: str) -> DataFrame:
    """path, n, line: log lines whose first 19 characters are a time in a closed range; the first line is a header."""
    rows = logs.select("path", F.posexplode(_lines("text")).alias("n", "line")).where("n > 0")
    ts = F.try_to_timestamp(F.substring("line", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return rows.where((F.length("line") > 19) & ts.between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp"))).select("path", "n", F.rtrim("line").alias("line"))


def code_and_prose(files: DataFrame) -> DataFrame:
    """path, code, prose: lines of Python sources that are code, and those that are comments or in docstrings; blank lines are neither. Null text has none."""
    state = "struct<d:string,code:bigint,prose:bigint>"

    def step(s, raw):
        x = F.regexp_replace(raw, r"^\s+|\s+$", "")
        mark = F.when(x.startswith('"""'), '"""').when(x.startswith("'''"), "'''")
        one = lambda d, code, prose: F.struct(d.cast("string").alias("d"), (s["code"] + code).alias("code"), (s["prose"] + prose).alias("prose"))
        none = F.lit(None)
        inside = one(F.when(~F.contains(x, s["d"]), s["d"]), 0, 1)
        opened = one(F.when(~F.contains(F.substring(x, F.lit(4), F.length(x)), mark), mark), 0, 1)
        return F.when(x == "", s).when(s["d"].isNotNull(), inside).when(x.startswith("#"), one(none, 0, 1)).when(mark.isNotNull(), opened).otherwise(one(none, 1, 0))

    start = F.struct(F.lit(None).cast("string").alias("d"), F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("prose")).cast(state)
    counted = F.aggregate(_lines(F.coalesce("text", F.lit(""))), start, step)
    return files.select("path", counted.alias("s")).select("path", F.col("s.code").alias("code"), F.col("s.prose").alias("prose"))
