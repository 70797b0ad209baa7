"""Overlapping chunks of long texts, and functions over them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def chunks(text: str = "text", size: int = 8000, overlap: int = 400) -> Column:
    """Array of (s, e): starts and ends of the chunks of a text column, by one fold over the row.

    A chunk ends behind the last line end of its second half, or after `size` characters if there is none; the next one
    starts `overlap` characters before that end.
    """
    if size // 2 <= overlap:
        raise ValueError("half a chunk must be longer than the overlap")
    half = size // 2
    n = f"length({text})"
    one = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    last = f"if(hi < {n}, instr(reverse(substring({text}, a.s + {half + 1}, hi - (a.s + {half}))), '\\n'), 0)"
    step = one("hi", f"least(a.s + {size}, {n})", one("at", last, one("e", "if(at > 0, hi - at + 1, hi)", f"named_struct('s', e - {overlap}, 'done', e >= {n}, 'out', concat(a.out, array(named_struct('s', a.s, 'e', e))))")))
    start = "named_struct('s', 0, 'done', false, 'out', cast(array() as array<struct<s:int,e:int>>))"
    return F.expr(f"aggregate(sequence(1, cast({n} div {half - overlap + 1} as int) + 1), {start}, (a, i) -> if(a.done, a, {step}), a -> a.out)")


def head(text: str) -> str:
    """A summary that needs no model: the first 80 characters."""
    return text[:80]


def summarised(docs: DataFrame, each: Callable[[str], str] = head, merge: Callable[[str], str] | None = None, key: str = "doc_id", size: int = 8000, overlap: int = 400) -> DataFrame:
    """key, n, merged: a function over each chunk of a document, the results in order by line ends, and if given a function over those."""

    @F.pandas_udf(T.StringType())
    def first(s: pd.Series) -> pd.Series:
        return s.map(each)

    parts = docs.select(key, "text", F.posexplode(chunks("text", size, overlap)).alias("idx", "c")).select(key, "idx", first(F.substring("text", F.col("c.s") + 1, F.col("c.e") - F.col("c.s"))).alias("part"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "part"))), lambda x: x["part"]), "\n")
    rows = parts.groupBy(key).agg(F.count("*").alias("n"), joined.alias("merged"))
    if merge is None:
        return rows

    @F.pandas_udf(T.StringType())
    def second(s: pd.Series) -> pd.Series:
        return s.map(merge)

    return rows.withColumn("merged", second("merged"))
