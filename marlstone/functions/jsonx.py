"""JSON functions: rewriting to a shape without values, shortening, comparing, strict recognition of tool calls."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _shape(x):
    if isinstance(x, dict):
        return {k: _shape(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_shape(x[0])] if x else []
    if isinstance(x, bool):
        return False
    return 0 if isinstance(x, (int, float)) else "..." if isinstance(x, str) else None


def _short(x, items: int = 3, depth: int = 0):
    if depth > 6:
        return x
    if isinstance(x, list):
        return [_short(v, items, depth + 1) for v in x[:items]]
    return {k: _short(v, items, depth + 1) for k, v in x.items()} if isinstance(x, dict) else x


def _rewritten(s: pd.Series, f) -> pd.Series:
    def one(t):
        try:
            return json.dumps(f(json.loads(t)), separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError, RecursionError):
            return None

    return s.map(one)


@F.pandas_udf(T.StringType())
def anonymized(s: pd.Series) -> pd.Series:
    """Values replaced by their kind, lists cut to the first; null where the text is no JSON."""
    return _rewritten(s, _shape)


@F.pandas_udf(T.StringType())
def trimmed(s: pd.Series) -> pd.Series:
    """Lists cut to three items, down to the sixth level; null where the text is no JSON."""
    return _rewritten(s, _short)


def has_key(c: Column, key: str) -> Column:
    """The text is an object with the key, whatever its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(c), key), F.lit(False))


def equal(a: Column, b: Column) -> Column:
    """Both texts are the same JSON, whatever the order of keys and the spaces; false where either is no JSON."""
    same = lambda c: F.to_json(F.try_parse_json(c))
    return F.coalesce(same(a) == same(b), F.lit(False))


def is_tool_call(c: Column) -> Column:
    """The whole string is an object with exactly a string `name` and an object `arguments`."""
    kind = F.schema_of_variant(F.try_parse_json(c))
    return F.coalesce(kind.rlike(r"^OBJECT<arguments: OBJECT<.*>, name: STRING>$") & (F.array_sort(F.json_object_keys(c)) == F.array(F.lit("arguments"), F.lit("name"))), F.lit(False))
