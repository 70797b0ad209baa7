"""Patch deliveries: their parser, where their blocks stand in the files, and the files after them.

Blocks are compared with plain lines (see functions.text.plain_lines). The files themselves keep their line ends.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import plain_lines

#: What a delivery is written in. A file's part begins with a line FILE; in it, lines that begin with a head open a block of
#: that kind, whose text stands between its marks or else in a fence of three or more backticks.
FILE, OLD, NEW = "## FILE:", "### ALT", "### NEU"
MARKS = {OLD: ("<<<ALT>>>", "<<<ALT_END>>>"), NEW: ("<<<NEU>>>", "<<<NEU_END>>>")}
DELETE = "#DELETE"


class _Reader:
    """Reads a delivery line by line. It is between blocks, in one whose text has not begun, or inside marks or a fence, which end at a line of their own."""

    def __init__(self):
        self.files: list[tuple[str, list]] = []  # each with its blocks (kind, marked text, fenced text)
        self.ends: tuple[str, int] | None = None  # what ends the text that is being read: a mark, or a fence of so many backticks
        self.text: list[str] = []

    def _closes(self, line: str) -> bool:
        mark, ticks = self.ends
        return line.strip() == mark if mark else line.rstrip(" \t") == "`" * ticks

    def _keep(self) -> None:
        block = self.files[-1][1][-1]
        at = 1 if self.ends[0] else 2
        if block[at] is None:  # the first counts, marks before fences
            block[at] = "\n".join(self.text)

    def line(self, line: str) -> None:
        if self.ends:
            if self._closes(line):
                self._keep()
                self.ends = None
            else:
                self.text.append(line)
        elif line.startswith(FILE):
            self.files.append((line[len(FILE) :].strip(), []))
        elif self.files:
            self._within(line)

    def _within(self, line: str) -> None:
        blocks = self.files[-1][1]
        kind = OLD if line.startswith(OLD) else NEW if line.startswith(NEW) else None
        if kind:
            blocks.append([kind, None, None])
        elif blocks:
            opens, closes = MARKS[blocks[-1][0]]
            ticks = len(line) - len(line.lstrip("`"))
            if line.strip() == opens:
                self.ends, self.text = (closes, 0), []
            elif ticks >= 3:
                self.ends, self.text = ("", ticks), []


def anchors_of(text: str) -> list[tuple]:
    """(file, ix, old, new, error) of a delivery; ix counts from 1; an error row has no blocks, and a delivery with one is not applied.

    Old and new blocks of a file take turns. Text before the first file is a remark. Heads inside a block's text are part of it; a text that does not end is none.
    """
    reader = _Reader()
    for line in text.split("\n"):
        reader.line(line)
    out: list[tuple] = []
    for file, blocks in reader.files:
        kinds = [b[0] for b in blocks]
        if kinds != [OLD, NEW] * (len(kinds) // 2):
            out.append((file, len(out) + 1, None, None, "blocks do not pair"))
            continue
        for (_, *olds), (_, *news) in zip(blocks[::2], blocks[1::2]):
            old, new = (next((x for x in texts if x is not None), None) for texts in (olds, news))
            wrong = "no old block" if old is None else "no new block" if new is None else None if new.strip() else "empty new block"
            if wrong:
                old = new = None
            elif new.strip() == DELETE:
                new = DELETE
            out.append((file, len(out) + 1, old, new, wrong))
    return out


def deliveries(texts: DataFrame) -> DataFrame:
    """delivery, file, ix, old, new, error of delivery texts (delivery, text); a null text has no rows."""
    names = ["delivery", "file", "ix", "old", "new", "error"]

    def run(batches):
        for b in batches:
            rows = [(d, *a) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for a in anchors_of(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 2 else pa.string()) for i in range(6)], names)

    return texts.select(F.col("delivery").cast("string"), "text").mapInArrow(run, "delivery string, file string, ix int, old string, new string, error string")


def locate(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """anchors: file, ix, old, new; files: file, text. Adds hits, line (0-based, of the first place where whole lines are equal), n_lines and status.

    FILE_NOT_FOUND, ALREADY_APPLIED, NOT_FOUND, AMBIGUOUS, OVERLAP or OK: the first that applies. hits counts the old block as text, so that a
    block that is only part of a line has a hit and no line. A block without text is in no file.
    """
    rows = anchors.join(files.select(F.col("file").alias("_file"), plain_lines(F.col("text")).alias("_text"), F.regexp_replace("text", "\r\n?", "\n").alias("_raw")), F.col("file") == F.col("_file"), "left")
    rows = rows.withColumn("_old", plain_lines(F.col("old"))).withColumn("_new", plain_lines(F.col("new")))
    hits = lambda part: F.when(F.length(part) == 0, 0).otherwise((F.length("_text") - F.length(F.replace("_text", F.col(part), F.lit("")))) / F.greatest(F.length(part), F.lit(1))).cast("int")
    rows = rows.withColumn("hits", hits("_old"))
    there = (F.col("new") != DELETE) & (hits("_new") > 0) & (F.contains("_new", F.col("_old")) | (F.col("hits") == 0))
    status = F.when(F.col("_file").isNull(), "FILE_NOT_FOUND").when(there, "ALREADY_APPLIED").when(F.col("hits") == 0, "NOT_FOUND").when(F.col("hits") > 1, "AMBIGUOUS").otherwise("OK")
    lines, block = F.transform(F.split("_raw", "\n", -1), lambda x: F.rtrim(x, F.lit(" \t"))), F.split("_old", "\n", -1)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(lines) - F.size(block), F.lit(0))), lambda i: F.slice(lines, i + 1, F.size(block)) == block)
    rows = rows.withColumn("status", status).withColumn("line", F.when(F.col("status") == "OK", F.get(starts, 0))).withColumn("n_lines", F.when(F.col("line").isNotNull(), F.size(block)))
    # places of one file in order: one overlaps another if it starts before the furthest end so far, or ends after the next start
    by_file = Window.partitionBy("file", F.col("line").isNull()).orderBy("line", "ix")
    before = F.max(F.col("line") + F.col("n_lines")).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("line").over(by_file.rowsBetween(1, 1))
    overlaps = F.col("line").isNotNull() & (F.coalesce(before > F.col("line"), F.lit(False)) | F.coalesce(after < F.col("line") + F.col("n_lines"), F.lit(False)))
    rows = rows.withColumn("status", F.when(overlaps, "OVERLAP").otherwise(F.col("status")))
    return rows.select(*anchors.columns, "hits", "line", "n_lines", "status")


def applied(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """file, text, n_applied, ok of every file: with all its anchors applied, or as it was where any anchor of the delivery is in the way.

    All or nothing: an anchor whose status is neither OK nor ALREADY_APPLIED leaves all files as they are. New lines take the file's line ends; #DELETE removes the block.
    """
    placed = locate(anchors, files)
    bad = placed.agg(F.count_if(~F.col("status").isin("OK", "ALREADY_APPLIED")).alias("_bad"))
    listed = F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line", "n_lines", "new"))))
    edits = placed.groupBy(F.col("file").alias("_file")).agg(listed.alias("_edits"))  # as many as one file has anchors
    rows = files.join(edits, F.col("file") == F.col("_file"), "left").crossJoin(F.broadcast(bad))  # one row
    crlf = 2 * F.regexp_count("text", F.lit("\r\n")) >= F.regexp_count("text", F.lit("\n"))
    rows = rows.withColumn("_end", F.when(crlf, "\r\n").otherwise("\n")).withColumn("_lines", F.split("text", "(?<=\n)", -1))

    def step(s, e):
        new = F.regexp_replace(F.regexp_replace(e["new"], "\r\n?", "\n"), "\n$", "")
        put = F.when(e["new"] == DELETE, F.array().cast("array<string>")).otherwise(F.transform(F.split(new, "\n", -1), lambda x: F.concat(x, F.col("_end"))))
        return F.struct((e["line"] + e["n_lines"]).alias("at"), F.concat(s["out"], F.slice("_lines", s["at"] + 1, e["line"] - s["at"]), put).alias("out"))

    done = F.aggregate("_edits", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda s: F.concat(s["out"], F.slice("_lines", s["at"] + 1, F.greatest(F.size("_lines") - s["at"], F.lit(0)))))
    go = (F.col("_bad") == 0) & (F.size(F.coalesce("_edits", F.array().cast("array<struct<line:int,n_lines:int,new:string>>"))) > 0)
    return rows.select("file", F.when(go, F.array_join(done, "")).otherwise(F.col("text")).alias("text"), F.when(go, F.size("_edits")).otherwise(0).alias("n_applied"), (F.col("_bad") == 0).alias("ok"))
