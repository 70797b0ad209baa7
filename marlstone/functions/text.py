"""Text functions as columns."""

from __future__ import annotations

import fnmatch
import hashlib
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: What counts as white space between words (Unicode, with the separators U+001C to U+001F).
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: What exported titles begin with, and where the site's name begins in exported file names.
TITLE_PREFIXES, SITE = ("Unterhaltung mit Gemini", "Chat with Gemini", "Gemini"), " -  ?Google Gemini.*$"
#: What a changed line holds when only its form or logging changed.
FORMAT_HINTS = ("indent", "ensure_ascii", "sort_keys", "log.", "logger.", "logging.", "print(")


_GAPS, _SIGNS = re.compile(r"[\s_-]+"), re.compile(r"[^\w ]")


def words(c: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


@F.pandas_udf(T.LongType())
def word_counts(texts: pd.Series) -> pd.Series:
    """As words, for long texts: white space is what Python splits at, and a batch of texts is split in a fraction of the time that a regular expression takes."""
    return pd.Series([len(t.split()) if t else 0 for t in texts], dtype="int64")


@F.pandas_udf(T.StringType())
def title_hashes(texts: pd.Series) -> pd.Series:
    """SHA-256 of title_key, for long texts; null for null."""
    return pd.Series([None if t is None else hashlib.sha256(_SIGNS.sub("", _GAPS.sub(" ", t.lower())).strip(" ").encode()).hexdigest() for t in texts], dtype="object")


def one_spaced(c: Column) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(c, f"[{WHITE}]+", " "))


def name_key(c: Column) -> Column:
    """Lower case without underscores, points and spaces."""
    return F.translate(F.lower(c), "_. ", "")


def title_key(c: Column) -> Column:
    """Lower case, runs of white space, underscores and hyphens as one space, without other signs."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), rf"[{WHITE}_-]+", " "), r"[^\p{L}\p{N}_ ]", ""))


def _without_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"^[._]+|[._]+$", "")


def _or_unknown(c: Column) -> Column:
    return F.when(c == "", F.lit("unknown")).otherwise(F.substring(c, 1, 80))


def file_name(c: Column) -> Column:
    """A title as a file name: signs that file systems reserve and white space become underscores; at most 80 characters, "unknown" if empty."""
    return _or_unknown(_without_ends(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|]', "_"), rf"[{WHITE}_]+", "_")))


def export_name(c: Column, prefixes: tuple[str, ...] = TITLE_PREFIXES) -> Column:
    """As file_name, after the first of the prefixes that fit in turn is cut off; underscores that were there stay."""
    t = F.regexp_replace(c, rf"^[{WHITE}]+|[{WHITE}]+$", "")
    for p in prefixes:
        t = F.when(t.startswith(p), F.regexp_replace(F.substring(t, F.lit(len(p) + 1), F.length(t)), r"^[ \-–—]+|[ \-–—]+$", "")).otherwise(t)
    return _or_unknown(_without_ends(F.regexp_replace(F.regexp_replace(t, r'[\\/:*?"<>|]', "_"), rf"[{WHITE}]+", "_")))


def plain_name(c: Column) -> Column:
    """Letters, digits, hyphens, underscores and points only, without points at the end."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_.\-]", ""), r"\.+$", "")


def export_title(c: Column) -> Column:
    """The title in the name of an exported file: underscores as spaces, up to the site's name."""
    t = F.regexp_replace(F.regexp_replace(c, r"\.[^./]+$", ""), "_", " ")
    return F.trim(F.regexp_replace(t, SITE, ""))


def stamp(c: Column) -> Column:
    """date_time digits in a file name; without them the sentinel that sorts last."""
    found = F.regexp_extract(c, r"(\d{4}-?\d{2}-?\d{2}_\d{6})", 1)
    return F.when(found == "", F.lit("99999999_999999")).otherwise(F.regexp_replace(found, "-", ""))


def shown_time(c: Column) -> Column:
    """An ISO time as dd.mm.yyyy hh:mm; what is no time stays as it is, null and empty are empty."""
    at = F.coalesce(*(F.try_to_timestamp(F.regexp_replace(c, r"(Z|[+-]\d{2}:\d{2})$", ""), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")))
    return F.coalesce(F.date_format(at, "dd.MM.yyyy HH:mm"), c, F.lit(""))


def snapshot_date(day: Column, snapshot: Column, fix_year: bool = True) -> Column:
    """mm/dd in the year of a snapshot's date; null where there is no such day. With fix_year a day after the snapshot is of the year before."""
    of = lambda y: F.try_to_timestamp(F.concat(y.cast("string"), F.lit("/"), day), F.lit("yyyy/MM/dd")).cast("date")
    found = of(F.year(snapshot))
    return F.when(found > snapshot, of(F.year(snapshot) - 1)).otherwise(found) if fix_year else found


def elapsed(seconds: Column) -> Column:
    """1h02m from an hour on, else 3m05s."""
    s = F.floor(seconds)
    return F.when(s >= 3600, F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))).otherwise(F.format_string("%dm%02ds", F.floor(s / 60), s % 60))


def clock(seconds: Column) -> Column:
    """mm:ss, with as many minutes as it takes."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def plain_lines(c: Column) -> Column:
    """Line ends as \\n, nothing at the ends of lines, no blank lines at either end."""
    t = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), rf"(?m)[{WHITE}&&[^\n]]+$", "")
    return F.regexp_replace(t, r"^\n+|\n+$", "")


def line_end(c: Column) -> Column:
    """\\r\\n if at least as many lines end so as with \\n alone, else \\n."""
    crlf = F.regexp_count(c, F.lit("\r\n"))
    return F.when(2 * crlf >= F.regexp_count(c, F.lit("\n")), "\r\n").otherwise("\n")


def answer(c: Column) -> Column:
    """A reply without what stands before the first </think>, if it holds both marks."""
    after = F.substring(c, F.instr(c, "</think>") + 8, F.length(c))
    return F.when(c.contains("<think>") & c.contains("</think>"), F.trim(after)).otherwise(c)


def verdict(c: Column) -> Column:
    """not_relevant, relevant or unsure: the first that a reply holds; unsure without any."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.when(t.contains("not_relevant"), "not_relevant").when(t.contains("relevant"), "relevant").otherwise("unsure")


def diff_side(c: Column, sign: str) -> Column:
    """The lines of a unified diff with a sign, without it, trimmed and joined by spaces."""
    kept = F.filter(F.split(c, "\n"), lambda x: x.startswith(sign) & ~x.startswith(sign * 3))
    return F.array_join(F.transform(kept, lambda x: F.trim(F.substring(x, F.lit(2), F.length(x)))), " ")


def diff_kind(c: Column, hints: tuple[str, ...] = FORMAT_HINTS) -> Column:
    """format/log if a changed line holds a hint, else behaviour."""
    changed = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)"))
    text = F.array_join(F.transform(changed, lambda x: F.substring(x, F.lit(2), F.length(x))), " ")
    return F.when(F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(text, h)), "format/log").otherwise("behaviour")


def any_keyword(c: Column, keywords: tuple[str, ...]) -> Column:
    """Whether the text holds any of the keywords, in whatever case."""
    return F.exists(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.contains(F.lower(c), k)) if keywords else F.lit(False)


def free_text(c: Column, query: str) -> Column:
    """Whether the text holds the query, in whatever case; an empty query holds everywhere."""
    return F.lit(True) if not query.strip() else F.lower(c).contains(query.strip().lower())


def glob_filter(path: Column, include: tuple[str, ...] = ("**/*.py",), exclude: tuple[str, ...] = ()) -> Column:
    """Paths that any include pattern matches (a * also crosses folders) and that start with no exclude prefix."""
    kept = F.lit(False)
    for p in include:
        kept = kept | path.rlike(f"^{fnmatch.translate(p).replace('(?>', '(?:').removesuffix(chr(92) + 'z').removesuffix(chr(92) + 'Z')}$")
    for p in exclude:
        kept = kept & ~path.startswith(p)
    return kept


def ignored(path: Column, patterns: tuple[str, ...]) -> Column:
    """Paths of which a part ends as a *suffix pattern says, or equals any other pattern."""
    parts, out = F.split(path, "/"), F.lit(False)
    for p in patterns:
        out = out | (_any_ends(parts, p[1:]) if p.startswith("*") else F.array_contains(parts, p))
    return out


def _any_ends(parts: Column, suffix: str) -> Column:
    return F.exists(parts, lambda x: x.endswith(suffix))


def folder(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """From the last point of the file name on; names that only begin with a point have none."""
    return F.regexp_extract(path, r"[^./]([.][^./]*)$", 1)


def stem(path: Column) -> Column:
    """The file name without its extension."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"([^.])[.][^.]*$", "$1")
