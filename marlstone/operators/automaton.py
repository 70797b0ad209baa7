"""Many patterns at once: one automaton over all of them passes over each text, and no text is ever in a join.

The patterns of one pass go to the workers by a broadcast whose size is bounded by PASS_CHARS and PASS_PATTERNS. More
patterns than that are dealt by a hash over as many passes as it takes, one after the other, each of which writes its pairs
to the shared folder and gives its broadcast back. A worker builds an automaton once for all its tasks.
"""

from __future__ import annotations

import re
import re._parser as _syntax  # the public name of this module is deprecated
import uuid
from collections.abc import Callable, Iterable
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import sinks

#: Characters and patterns of one automaton, at most: some hundred MB in a worker.
PASS_CHARS, PASS_PATTERNS = 4_000_000, 200_000
#: The automaton that a worker process holds, by a name of its patterns.
_BUILT: dict = {}


def once(key, make: Callable):
    """What this process has built for a key; only the last thing is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = make()
    return _BUILT[key]


def built(words: Iterable[str]) -> ahocorasick.Automaton:
    """An automaton whose matches give the word."""
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out


def _searched(held, name, batches):
    """Pairs of a key and a pattern's number for a batch of (key, text)."""

    def make():
        ids: dict[str, list] = {}
        for n, w in zip(*(c.to_pylist() for c in held.value)):
            ids.setdefault(w, []).append(n)
        return built(w for w in ids if w), ids

    automaton, ids = once(name, make)
    empty = ids.get("", [])  # the empty pattern is in every text
    for b in batches:
        at, found, size = [], [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            if text is None:
                continue
            words = {w for _, w in automaton.iter(text)} if len(automaton) else set()
            for w in words:
                at += [i] * len(ids[w])
                found += ids[w]
                size += [len(w)] * len(ids[w])
            at += [i] * len(empty)
            found += empty
            size += [0] * len(empty)
        kind = held.value[0].type
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, kind), pa.array(size, pa.int32())], ["key", "pattern", "size"])


def contained(texts: DataFrame, patterns: DataFrame, key: str, pattern: str, pass_chars: int = PASS_CHARS, pass_patterns: int = PASS_PATTERNS) -> DataFrame:
    """key, pattern and size (characters) for each text (key, text) and pattern (pattern, text) that it holds.

    Plain text, case and all. A null is held by nothing and holds nothing; an empty pattern is in every text. Patterns
    with equal texts have a row each, repeated texts too.
    """
    spark = texts.sparkSession
    rows = patterns.where("text is not null").select(F.col(pattern), "text")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    passes = max(1, -(-n // pass_patterns), -(-chars // pass_chars))
    kinds = {c: f.dataType.simpleString() for f in (*texts.schema, *patterns.schema) for c in (f.name,)}
    schema = f"key {texts.schema[key].dataType.simpleString()}, pattern {kinds[pattern]}, size int"

    def search(own: DataFrame):
        table = own.toArrow()  # about a pass's share
        held = spark.sparkContext.broadcast([table.column(i).combine_chunks() for i in range(2)])
        return held, texts.select(key, "text").mapInArrow(partial(_searched, held, uuid.uuid4().hex), schema)

    if passes == 1:
        found = search(rows)[1]
    else:
        root = sinks.landing(spark, "contained")
        for k in range(passes):
            held, pairs = search(rows.where(F.pmod(F.xxhash64(pattern), F.lit(passes)) == k))
            pairs.write.parquet(f"{root}/pass={k}")
            held.destroy()
        found = spark.read.schema(schema).parquet(*(f"{root}/pass={k}" for k in range(passes)))
    return found.select(F.col("key").alias(key), F.col("pattern").alias(pattern), "size")


def required(pattern: str) -> set[str] | None:
    """Strings in lower case of which each match of a regular expression holds one, whatever the case; None if no such set is known, as of a class of characters."""
    try:
        return _best(_syntax.parse(pattern))
    except re.error:
        return {pattern.lower()} if pattern else None  # such a rule counts as plain text


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set that lets fewer texts through: the one whose shortest string is longer."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _best(tree) -> set[str] | None:
    best, run = None, ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            low = chr(arg).lower()
            run += low if len(low) == 1 else ""
            if len(low) == 1:
                continue
        best, run = _better(best, {run} if run else None), ""
        if name == "SUBPATTERN":
            best = _better(best, _best(arg[-1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            best = _better(best, _best(arg[2]))
        elif name == "ATOMIC_GROUP":
            best = _better(best, _best(arg))
        elif name == "BRANCH":
            ways = [_best(way) for way in arg[1]]
            if all(ways):
                best = _better(best, set().union(*ways))
    return _better(best, {run} if run else None)
