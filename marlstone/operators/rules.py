"""Line scans by rules, their context, and verdicts by a function that the caller gives.

Rules are parameters of a scan, sent to the workers, where an automaton over the strings that the rules require picks those worth trying on a line.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import automaton

#: Rules of a scan, at most: they are broadcast.
MOST_RULES = 200_000


class _Index:
    """Rules, and which of them a line may satisfy."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.always, self.by_string = [], {}
        for n, (_, pattern) in enumerate(rules):
            strings = automaton.required(pattern)
            for x in strings or ():
                self.by_string.setdefault(x, []).append(n)
            if not strings:
                self.always.append(n)
        self.strings = automaton.built(self.by_string)
        self.compiled: dict[int, Callable] = {}

    def holds(self, n: int, line: str) -> bool:
        if n not in self.compiled:
            pattern = self.rules[n][1]
            try:
                self.compiled[n] = re.compile(pattern, re.A).search
            except (re.error, ValueError):
                self.compiled[n] = lambda x: pattern in x
        return bool(self.compiled[n](line))

    def of(self, text: str) -> tuple[list[str], list[tuple[int, int]]]:
        """The lines of a text, and (line from 0, rule) of the first rule a line and target."""
        lines = text.split("\n")
        low = text.lower()
        if len(low) != len(text):  # a few letters grow in lower case
            low = "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))
        starts, at = [], 0
        for line in lines:
            starts.append(at)
            at += len(line) + 1
        maybe: dict[int, set[int]] = {}
        if len(self.strings):
            for end, string in self.strings.iter(low):
                maybe.setdefault(bisect_right(starts, end) - 1, set()).update(self.by_string[string])
        out = []
        for i in range(len(lines)) if self.always else sorted(maybe):
            seen = set()
            for n in sorted({*self.always, *maybe.get(i, ())}):
                target = self.rules[n][0]
                if target not in seen and self.holds(n, lines[i]):
                    seen.add(target)
                    out.append((i, n))
        return lines, out


def hits(texts: DataFrame, rules: list[tuple[str, str]], key: str = "path", around: int = 3) -> DataFrame:
    """key, lineno, target, pattern, line, context: of each line and target the first rule (target, pattern) that holds.

    context holds the lines up to `around` before and after, the hit marked with "> ". One pass over a text: a line is tried only by rules of
    which it holds a required string, and by those that require none. Classes such as \\d and \\w are of ASCII. A pattern that is no
    regular expression counts as plain text. A null text counts as empty. At most MOST_RULES rules.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    held, name = texts.sparkSession.sparkContext.broadcast(rules), uuid.uuid4().hex
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        index = automaton.once(name, lambda: _Index(held.value))
        for b in batches:
            rows = []
            for at, text in enumerate(b.column(1).to_pylist()):
                lines, found = index.of(text or "")
                for i, n in found:
                    first = max(0, i - around)
                    near = "\n".join(("> " if first + j == i else "  ") + x for j, x in enumerate(lines[first : i + around + 1]))
                    rows.append((at, i + 1, *index.rules[n], lines[i], near))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:])], ["key", "lineno", "target", "pattern", "line", "context"])

    found = texts.select(key, "text").mapInArrow(run, f"key {kind}, lineno long, target string, pattern string, line string, context string")
    return found.withColumnRenamed("key", key)


def cache_key(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 16)


def stub(text: str) -> str:
    """A classifier that needs no model: by the length of the text."""
    return ("not_relevant", "relevant", "unsure")[len(text or "") % 3]


def judged(rows: DataFrame, cache: DataFrame, classify: Callable[[str], str] | None = stub, text: str = "line") -> DataFrame:
    """rows (with cache_key) plus verdict and origin: from the cache (cache_key, verdict), else computed; without a function unsure and offline.

    Only what the cache lacks is computed, equal keys once.
    """
    known = cache.groupBy(F.col("cache_key").alias("_key")).agg(F.max("verdict").alias("_cached"))
    found = rows.join(known, F.col("cache_key") == F.col("_key"), "left").drop("_key")
    if classify is None:
        return found.withColumn("verdict", F.coalesce("_cached", F.lit("unsure"))).withColumn("origin", F.when(F.col("_cached").isNull(), "offline").otherwise("cache")).drop("_cached")

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(classify)

    new = found.where("_cached is null").groupBy(F.col("cache_key").alias("_key")).agg(F.min(text).alias("_text")).select("_key", run("_text").alias("_new"))
    out = found.join(new, F.col("cache_key") == F.col("_key"), "left")
    return out.withColumn("verdict", F.coalesce("_cached", "_new", F.lit("unsure"))).withColumn("origin", F.when(F.col("_cached").isNull(), "computed").otherwise("cache")).drop("_cached", "_new", "_key")
