"""Runs of repeated words in a document: repeated k-gram masking, then Main and Lorentz on what survives.

A run is a maximal stretch of words with smallest period q, of at least `min_periods` periods and `min_words` words. A run
of length l repeats its first l - q words q words later, so each of its words lies in a k-gram that occurs twice in
the document, for the least such overlap k. Words outside of repeated k-grams join no run and cut the document into segments;
few words survive in ordinary prose. Main and Lorentz divide each surviving segment in halves and find the
runs that cross the middle from common extensions to both sides for each period. All segments of a chunk are divided level by
level at once; extensions are read from names of all stretches of 2^j words (equal names, equal stretches), so nothing rests on hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .branches import CRC_TABLE_SQL, crc32_sql
from .shared import mapped, table

MIN_WORDS, MIN_PERIODS = 24, 3
#: Words of documents that are looked at together; one longer document is a chunk of its own.
CHUNK_WORDS = 1_000_000


def least_overlap(min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> int:
    """The fewest words that a run shares with itself one period later: length - q, over all lengths and periods."""
    return min(max(min_words, min_periods * q) - q for q in range(1, min_words + 1))


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each position on; the last k - 1 positions have none."""
    h, width, done, out = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1, 0, None
    while True:
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        if k & width:
            part = h[done:]
            out = part if out is None else (out[: len(part)] * np.uint64(0x94D049BB133111EB) + part[: len(out)])
            done += width
        if width * 2 > k:
            return out[: len(ids) - k + 1]
        h, width = h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:], width * 2


def surviving(ids: np.ndarray, starts: np.ndarray, k: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments of min_words words and more that repeated k-grams of one document cover. starts: of the documents, and the end."""
    n = len(ids)
    none = np.zeros(0, np.int64)
    if n < k:
        return none, none
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    h = _grams(ids, k)[at] ^ (doc[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + k, -1)
    inside = np.cumsum(step[:-1]) > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | (doc[1:] != doc[:-1])
    lo, hi = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    keep = hi - lo >= min_words
    return lo[keep], hi[keep]


class Extensions:
    """Longest common extensions of two positions of a sequence, to the right and to the left."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.names = [np.unique(ids, return_inverse=True)[1].astype(np.int32)]  # fewer than 2^31 words in a chunk or a document
        while 2 << (len(self.names) - 1) <= longest:
            half, last = 1 << (len(self.names) - 1), self.names[-1]
            follow = np.full(len(ids), -1, np.int64)
            follow[:-half] = last[half:]
            self.names.append(np.unique(last.astype(np.int64) * (len(ids) + 1) + follow + 1, return_inverse=True)[1].astype(np.int32))

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words from a on that equal those from b on; a < b."""
        out, n = np.zeros(len(a), np.int64), len(self.names[0])
        for j in range(len(self.names) - 1, -1, -1):
            x, y = a + out, b + out
            fits = y + (1 << j) <= n
            same = fits & (self.names[j][np.where(fits, x, 0)] == self.names[j][np.where(fits, y, 0)])
            out[same] += 1 << j
        return out

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words before a that equal those before b; a < b."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            x, y = a - out - (1 << j), b - out - (1 << j)
            same = (x >= 0) & (self.names[j][np.maximum(x, 0)] == self.names[j][np.maximum(y, 0)])
            out[same] += 1 << j
        return out


def crossing(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Runs within segments of a sequence as rows (start, end, period), by start and end; no run reaches beyond its segment."""
    if not len(lo):
        return np.zeros((0, 3), np.int64)
    # segments end to end, each followed by a word of its own, so that no extension leaves one
    size = hi - lo
    base = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.arange(base[-1]) - np.repeat(base[:-1], size + 1)
    ends = base[1:] - 1
    words = np.asarray(ids, np.int64)[np.minimum(np.repeat(lo, size + 1) + flat, len(ids) - 1)]
    words[ends] = words.max() + 1 + np.arange(len(ends))
    reach = Extensions(words, int(size.max()))
    found = []
    a, z = base[:-1].copy(), ends.copy()
    while len(a):
        mid = (a + z) // 2
        periods = (z - a) // min_periods  # a longer one has no room for a whole run here
        node = np.repeat(np.arange(len(a)), periods)
        q = np.arange(len(node)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
        # a run across the middle has a whole period on its right or on its left
        for first in (mid[node], mid[node] - q):
            ok = (first >= a[node]) & (first + q < z[node])
            x, p = first[ok], q[ok]
            length = p + reach.right(x, x + p)
            back = reach.left(x, x + p)
            length += back
            run = length >= np.maximum(min_words, min_periods * p)
            found.append(np.stack([x[run] - back[run], x[run] - back[run] + length[run], p[run]], 1))
        a, z = np.concatenate([a, mid]), np.concatenate([mid, z])
        room = z - a >= min_words
        a, z = a[room], z[room]
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)  # a stretch has many periods; the smallest is its own
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    shift = (lo - base[:-1])[np.searchsorted(base, runs[:, 0], "right") - 1]
    runs[:, :2] += shift[:, None]
    return runs


def runs_of(texts: list[list[bytes]], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each run of each text, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    first = 0
    while first < len(texts):
        last, n = first + 1, len(texts[first])
        while last < len(texts) and n + len(texts[last]) <= CHUNK_WORDS:
            n += len(texts[last])
            last += 1
        if n:
            ids = pa.array([w for t in texts[first:last] for w in t], pa.binary()).dictionary_encode().indices.to_numpy()
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts[first:last]])])
            lo, hi = surviving(ids, starts, least_overlap(min_words, min_periods), min_words)
            for s, e, q in crossing(ids, lo, hi, min_words, min_periods).tolist():
                d = int(np.searchsorted(starts, s, "right")) - 1
                out[first + d].append((s - int(starts[d]), e - s, q))
        first = last
    for rows in out:
        rows.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Per row: doc_id, runs (start, length, period in words, by start, then period) and collapsed, the kept words joined by single spaces.

    Words are `[^\\x20\\x09-\\x0D]+`. A null text counts as empty and collapses to an empty one; repeated rows have a row each, null ids too; further columns play no part.
    """
    if not 2 <= min_periods <= min_words:
        raise ValueError("a run has two periods at least, and no fewer words than periods")
    kind = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def run(batches):
        for b in batches:
            texts = [(t or "").encode().split() for t in b.column(1).to_pylist()]  # bytes split at just these six code points
            found = runs_of(texts, min_words, min_periods)
            rows = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found]
            collapsed = [b" ".join(kept_words(t, rs)).decode() for t, rs in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, run_type), pa.array(collapsed, pa.string())], ["doc_id", "runs", "collapsed"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, about a tenth of the texts made periodic from some word on, as the contract has it. Rows without an id stay as they are."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for at, (i, text) in enumerate(zip(b.column(0).to_pylist(), texts)):
                h = zlib.crc32(str(i).encode())
                if i is None or h % 10 or not text or not (words := text.encode().split()):
                    continue
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                texts[at] = b" ".join(words[:a] + [words[a + (j - a) % p] for j in range(a, n)]).decode()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, text string")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from those of periodic_runs."""
    greater = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  exact: no division
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda acc, x: F.when(greater(x, acc), x).otherwise(acc))  # the first of equals has the smallest start, then period
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[x].cast("string") for x in ("start", "length", "period"))))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in all of `documents`, a tenth of which are made periodic."""
    return digest(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


ORACLE_SQL = f"""
WITH {CRC_TABLE_SQL}, original AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc
), planted AS (
  SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS edited, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM original
), words AS (
  SELECT doc_id, CASE WHEN edited THEN list_transform(range(n), lambda i: CASE WHEN i >= a THEN ws[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))] ELSE ws[1 + i] END) ELSE ws END AS ws FROM planted
), word AS MATERIALIZED (
  SELECT doc_id, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w FROM words
), spots AS (  -- words that come again q words later, for each q that leaves room for a run
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i JOIN words d ON d.doc_id = x.doc_id WHERE 3 * (y.i - x.i) <= len(d.ws)
), islands AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM spots) GROUP BY doc_id, q, island
), runs AS MATERIALIZED (
  SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), collapsed AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS text FROM word w ANTI JOIN dropped USING (doc_id, i) GROUP BY w.doc_id
), best AS (
  SELECT * FROM runs a WHERE NOT EXISTS (
    SELECT 1 FROM runs b WHERE a.doc_id = b.doc_id AND (b.length * a.period > a.length * b.period OR (b.length * a.period = a.length * b.period AND (b.start < a.start OR (b.start = a.start AND b.period < a.period)))))
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(l.text, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN collapsed c USING (doc_id)
"""
