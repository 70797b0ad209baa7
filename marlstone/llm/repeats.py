"""Long repeats of a corpus, byte for byte, by run-length indexes over aligned contexts.

Each string of WIDTH bytes names one of its GRAM-byte parts, the last of those with the smallest hash, as its anchor. Equal
strings have their anchors at the same place, so all places of a string meet under its anchor, and a corpus without
repeats sends nothing on: anchors are counted first, and only repeated ones send their context, the bytes around the
anchor that strings with this anchor need. A few bytes of shuffle a byte of repetitive text, none for the rest.

The contexts of an anchor are rows aligned at it, and of an alphabet of (column, byte) they have a Burrows-Wheeler transform
whose columns hold together: rows sorted by what follows a column, the byte before it, and the next column's order by a
stable sort of those bytes. In repetitive text the transform is few runs; each step to the left moves whole runs, and the
common prefix of a row with its predecessor is kept inside a run and looked up only between the end of one run and the head of
the next with its byte. The GRAM columns of the anchor itself are one run each and are passed over at once. Streaming
all columns gives each row its matching statistics: where its prefix of WIDTH bytes is shared, the rows that share it
are neighbours, and all but the one that starts first in the corpus are repeats.

An anchor with more than HOT places could fill a task. Such anchors, known from the count, send a row for each of their
strings instead, a hash of 128 bits, whose first place is found by an aggregation; equal strings of a batch are
settled there, so that a string sends a row a batch at most.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import bit_table, in_bit_table, mapped, stored, table

#: Bytes of a string that counts as a repeat, and of its anchor.
WIDTH, GRAM = 100, 48
#: Most columns on either side of an anchor.
SIDE = WIDTH - GRAM
#: An anchor with more places than this is not gathered in one task.
HOT = 50_000
#: Contexts that are indexed together, at least; a group of one anchor is never divided.
INDEX_ROWS = 50_000
#: Bytes of text that are hashed together.
CHUNK = 1 << 18
_LOW = np.uint64((1 << 24) - 1)
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column end to end, and where each text begins, with the end; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of stretches twice as long, from those of a width."""
    h = h[:-width] * _A + h[width:]
    h ^= h >> np.uint64(29)
    h *= _B
    return h


def gram_hashes(data: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the GRAM bytes and of the WIDTH bytes from each position on, as far as there are any."""
    h = (data.astype(np.uint64) + np.uint64(seed)) * _C
    h ^= h >> np.uint64(31)
    by = {}
    for j in range(6):
        by[1 << j] = h
        if len(h) <= 1 << j:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        h = _doubled(h, 1 << j) if j < 5 else h
    n = len(data) - GRAM + 1
    g = by[32][:n] * _D + by[16][32 : 32 + n] if n > 0 else np.zeros(0, np.uint64)
    g ^= g >> np.uint64(32)
    g *= _B
    m = max(0, len(data) - WIDTH + 1)
    w = g[:m] * _A + g[WIDTH - GRAM : WIDTH - GRAM + m] * _D + by[8][GRAM : GRAM + m] * _C  # the two grams and what lies between them
    w ^= w >> np.uint64(30)
    return g, w * _B


def anchors(data: np.ndarray, starts: np.ndarray):
    """For texts end to end: yields (hashes of grams, first byte of these, places of anchors, first and last string of each) by chunks; places count from the first text's first byte."""
    lo, hi = starts[:-1], starts[1:] - (WIDTH - 1)
    room = hi > lo
    step = np.zeros(len(data) + 1, np.int8)
    np.add.at(step, lo[room], 1)
    np.add.at(step, hi[room], -1)
    inside = np.cumsum(step, dtype=np.int8) > 0  # where a string of one text starts
    for first in range(0, len(data), CHUNK):
        here = inside[first : first + CHUNK]
        if not here.any():
            continue
        g, _ = gram_hashes(data[first : first + CHUNK + WIDTH - 1])
        # the smallest hash; of equal ones the last
        low = (g & ~_LOW) | (_LOW - np.arange(len(g), dtype=np.uint64))
        width = 1
        while width * 2 <= SIDE + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = SIDE + 1 - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        here = here[: len(low)]
        at = (_LOW - (low & _LOW)).astype(np.int64)
        head = here.copy()
        head[1:] &= ~here[:-1] | (at[1:] != at[:-1])
        tail = here.copy()
        tail[:-1] &= ~here[1:] | (at[1:] != at[:-1])
        begin, end = np.flatnonzero(head), np.flatnonzero(tail)
        yield g, first, at[begin] + first, begin + first, end + first


def _second(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Further 32 bits for the anchors at these places, by another rule than the first 64."""
    words = np.ascontiguousarray(data[at[:, None] + np.arange(GRAM)]).view(np.uint64)
    h = np.zeros(len(at), np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * _D
        h ^= h >> np.uint64(33)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _counted(batches):
    for b in batches:
        data, starts = _bytes_of(b.column(0))
        found = [g[at - first] for g, first, at, _, _ in anchors(data, starts)]
        h, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])


def _contexts(held, hot, batches):
    """Contexts of repeated anchors that are not hot: the text's key, the anchor and its place, the strings by their distance before the anchor (u), and the bytes that those need on both sides."""
    for b in batches:
        data, starts = _bytes_of(b.column(2))
        parts: list[list] = [[] for _ in range(6)]
        pieces, sizes = [], []
        for g, first, at, begin, end in anchors(data, starts):
            h = g[at - first].view(np.int64)
            keep = np.asarray(in_bit_table(held.value, pa.array(h)))
            if hot is not None:
                keep &= ~np.asarray(in_bit_table(hot.value, pa.array(h)))
            h, at, begin, end = h[keep], at[keep], begin[keep], end[keep]
            doc = np.searchsorted(starts, at, "right") - 1
            left, right = at - begin, SIDE - (at - end)
            size = left + right
            flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            pieces.append(data[np.repeat(begin, size) + flat + np.where(flat >= np.repeat(left, size), GRAM, 0)])
            sizes.append(size)
            for part, x in zip(parts, (doc, h, _second(data, at), at - starts[doc], (at - end).astype(np.int8), left.astype(np.int8))):
                part.append(x)
        if not pieces:
            continue
        doc, h, h2, at, lo, hi = (np.concatenate(p) for p in parts)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        context = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(pieces))])
        doc = pa.array(doc)
        yield pa.RecordBatch.from_arrays([b.column(0).take(doc), b.column(1).take(doc), *(pa.array(x) for x in (h, h2, at, lo, hi)), context], ["doc", "tie", "h", "h2", "at", "lo", "hi", "context"])


def _strings(hot, batches):
    """Strings of hot anchors: the text's key, where one starts, 128 bits of hash, and whether it is settled. Of a batch's equal strings the first goes on; the others are repeats, whatever else the corpus holds."""
    for b in batches:
        data, starts = _bytes_of(b.column(2))
        parts: list[list] = [[] for _ in range(4)]
        for g, first, at, begin, end in anchors(data, starts):
            keep = np.asarray(in_bit_table(hot.value, pa.array(g[at - first].view(np.int64))))
            begin, end = begin[keep], end[keep]
            if not len(begin):
                continue
            n = end - begin + 1
            place = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            chunk = data[first : first + CHUNK + WIDTH - 1]
            doc = np.searchsorted(starts, place, "right") - 1
            for part, x in zip(parts, (doc, place - starts[doc], *(gram_hashes(chunk, seed)[1][place - first].view(np.int64) for seed in (1, 0x5851F42D)))):
                part.append(x)
        if not parts[0]:
            continue
        doc, start, w1, w2 = (np.concatenate(p) for p in parts)
        key, tie = (np.asarray(b.column(i))[doc] for i in (0, 1))
        by = np.lexsort([start, tie, key, w2, w1])
        key, tie, start, w1, w2 = (x[by] for x in (key, tie, start, w1, w2))
        fresh = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
        head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        own = (key == key[head]) & (tie == tie[head]) & (start == start[head])  # rows that repeat as a whole have the same places
        use = fresh | ~own
        yield pa.RecordBatch.from_arrays([*(pa.array(x[use]) for x in (key, tie, start, w1, w2)), pa.array(~fresh[use])], ["doc", "tie", "start", "w1", "w2", "settled"])


def _between(least: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least value of each range lo to hi (exclusive, not empty)."""
    out = np.empty(len(lo), least.dtype)
    level = np.frexp(hi - lo)[1] - 1  # of the power of two that is in the range
    tables = [least]
    for j in range(int(level.max()) + 1 if len(level) else 0):
        now = level == j
        out[now] = np.minimum(tables[j][lo[now]], tables[j][hi[now] - (1 << j)])
        tables.append(np.minimum(tables[j][: -(1 << j)], tables[j][1 << j :]))
    return out


class RunIndex:
    """The transform of aligned rows from the anchor to the left, column by column; rows of different groups never mix.

    order: the rows, sorted by group and by what follows the current column. shared: bytes after the anchor that a row
    has in common with the one before it in this order, -1 where the group or a byte before the anchor differs.
    """

    def __init__(self, group: np.ndarray, left: np.ndarray, right: np.ndarray):
        """group: of each row, ascending; left and right: bytes of a row outwards from the anchor, padded with 255."""
        n = len(group)
        words = np.zeros((n, -(-right.shape[1] // 8) * 8), np.uint8)
        words[:, : right.shape[1]] = right
        keys = words.view(">u8").astype(np.uint64)
        self.order = np.lexsort([*keys.T[::-1], group])
        self.group = group
        self.left = np.ascontiguousarray(left.T)
        r = right[self.order]
        differ = r[1:] != r[:-1]
        same = np.where(differ.any(1), differ.argmax(1), right.shape[1])
        self.shared = np.concatenate([[-1], np.where(group[1:] == group[:-1], same, -1)]).astype(np.int8)

    def step(self, column: int) -> None:
        """The order one column further to the left."""
        n = len(self.order)
        key = self.group * 256 + self.left[column][self.order]  # the transform: the byte before each row
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(starts, append=n)
        moved = np.argsort(key[starts], kind="stable")  # runs, not rows, are sorted
        least = np.minimum.reduceat(self.shared, starts)
        place = np.cumsum(sizes[moved]) - sizes[moved]
        source = np.repeat(starts[moved] - place, sizes[moved]) + np.arange(n)
        shared = self.shared[source]
        heads = np.full(len(moved), -1, np.int8)
        follows = np.flatnonzero(key[starts][moved[1:]] == key[starts][moved[:-1]]) + 1
        if len(follows):
            run, before = moved[follows], moved[follows - 1]
            heads[follows] = np.minimum(_between(least, before + 1, run), self.shared[starts[run]])
        shared[place] = heads
        self.order, self.shared = self.order[source], shared


def repeated_strings(group: np.ndarray, rank: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the least and the greatest u in lo to hi for which u bytes before the anchor and SIDE - u after it are also those of a row of its group with a smaller rank; 127 and -1 if there is none."""
    index = RunIndex(group, left, right)
    least, most = np.full(len(group), 127, np.int16), np.full(len(group), -1, np.int16)
    for u in range(SIDE + 1):
        heads = np.flatnonzero(index.shared < SIDE - u)
        ranks = rank[index.order]
        first = np.minimum.reduceat(ranks, heads)
        rows = index.order[ranks > np.repeat(first, np.diff(heads, append=len(ranks)))]
        rows = rows[(lo[rows] <= u) & (u <= hi[rows])]
        least[rows] = np.minimum(least[rows], u)
        most[rows] = u
        if u < SIDE:
            index.step(u)
    return least, most


def _sides(context: pa.Array, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and after the anchors, outwards, as rows of SIDE bytes padded with 255, a byte that no text has."""
    offsets = np.frombuffer(context.buffers()[1], np.int32)[context.offset : context.offset + len(context)].astype(np.int64)
    data = context.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(1, np.uint8)
    column, out = np.arange(SIDE), []
    for at, there in ((offsets[:, None] + hi[:, None] - 1 - column, column < hi[:, None]), (offsets[:, None] + hi[:, None] + column, column < SIDE - lo[:, None])):
        out.append(np.where(there, flat[np.where(there, at, 0)], np.uint8(255)))
    return out[0], out[1]


def _indexed(batches):
    """Marks of contexts that come sorted by anchor: the text's key, and the first and last byte covered by repeats."""

    def marks(table: pa.Table):
        b = table.combine_chunks()
        column = lambda name: b.column(name).chunk(0).to_numpy(zero_copy_only=False)
        h, h2, doc, tie, at = (column(x) for x in ("h", "h2", "doc", "tie", "at"))
        lo, hi = column("lo").astype(np.int64), column("hi").astype(np.int64)
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
        group = np.cumsum(new) - 1
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(several):
            return
        left, right = _sides(b.column("context").chunk(0).take(pa.array(several)), lo[several], hi[several])
        doc, tie, at, lo, hi = (x[several] for x in (doc, tie, at, lo, hi))
        by = np.lexsort([at, tie, doc])
        fresh = np.concatenate([[False], (doc[by][1:] != doc[by][:-1]) | (tie[by][1:] != tie[by][:-1]) | (at[by][1:] != at[by][:-1])])
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(fresh)
        least, most = repeated_strings(np.unique(group[several], return_inverse=True)[1].astype(np.int64), rank, lo, hi, left, right)
        got = most >= 0
        yield pa.RecordBatch.from_arrays([pa.array(x[got]) for x in (doc, tie, at - most, at - least + WIDTH)], ["doc", "tie", "start", "end"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= INDEX_ROWS:
            whole = pa.Table.from_batches(held)
            h = whole.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last anchor's group may go on
            if cut:
                yield from marks(whole.slice(0, cut))
                held = whole.slice(cut).combine_chunks().to_batches()
                rows -= cut
    if held:
        yield from marks(pa.Table.from_batches(held))


def _spans(marks: list[dict]) -> list[tuple[int, int]]:
    """Maximal covered stretches."""
    out: list[list[int]] = []
    for s, e in sorted((m["start"], m["end"]) for m in marks):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut(batches):
    for b in batches:
        sizes, spans, kept = [], [], []
        for text, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            data = (text or "").encode()
            found = _spans(marks or [])
            ends = [0, *(e for _, e in found)]
            sizes.append(len(data))
            spans.append([{"start": s, "end": e} for s, e in found])
            kept.append(b"".join(data[x:y] for x, y in zip(ends, [*(s for s, _ in found), len(data)])))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), b.column(3), b.column(4)], ["doc_id", "n_bytes", "spans", "kept", "doc", "tie"])


def long_repeats(docs: DataFrame, hot_places: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (start, end in UTF-8 bytes) of all that WIDTH-byte strings cover which also start earlier, and kept, the other bytes.

    Earlier: in a document with a smaller id, or in the same one before. Null ids come before all others; rows that repeat an id
    are ordered by a hash of their texts; of rows that repeat as a whole one is the first, whichever. Null texts count as
    empty; texts shorter than WIDTH have no repeats. Further columns play no part. Ids are integers.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"))
    twice = not rows.groupBy("doc").count().where("count > 1").isEmpty()
    rows = rows.withColumn("tie", F.xxhash64("text") if twice else F.lit(0).cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    counts = mapped(docs.select("text"), _counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    counts = stored(counts, "anchors")
    held = bit_table(counts.select("h"))
    many = counts.where(F.col("n") > hot_places).select("h")
    hot = None if many.isEmpty() else bit_table(many)

    keyed = rows.select("doc", "tie", "text")
    found = mapped(keyed, partial(_contexts, held, hot), "doc long, tie long, h long, h2 int, at long, lo byte, hi byte, context binary")
    marks = mapped(found.repartition("h").sortWithinPartitions("h", "h2"), _indexed, "doc long, tie long, start long, end long")
    if hot is not None:
        strings = stored(mapped(keyed, partial(_strings, hot), "doc long, tie long, start long, w1 long, w2 long, settled boolean"), "strings")
        place = F.struct("doc", "tie", "start")
        open_ = strings.where("not settled")
        firsts = open_.groupBy("w1", "w2").agg(F.min(place).alias("first"))
        later = open_.join(firsts, ["w1", "w2"]).where(place != F.col("first")).select("doc", "tie", "start").unionAll(strings.where("settled").select("doc", "tie", "start"))
        marks = marks.unionByName(later.select("doc", "tie", "start", (F.col("start") + WIDTH).alias("end")))
    marks = marks.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("marks"))

    cut = rows.join(marks, ["doc", "tie"], "left").select("doc_id", "text", "marks", "doc", "tie")
    out = mapped(cut, _cut, f"doc_id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary, doc long, tie long")
    columns = ["doc_id", "n_bytes", "spans", "kept"]
    if not twice:
        return out.select(*columns)
    # of rows that repeat as a whole, all but one go
    copies = rows.groupBy("doc", "tie").count().where("count > 1")
    once = out.join(copies, ["doc", "tie"], "left_anti")
    again = out.join(copies, ["doc", "tie"]).dropDuplicates(["doc", "tie"]).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "count")))
    gone = (F.col("nth") > 1) & (F.col("n_bytes") >= WIDTH)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    again = again.withColumn("spans", F.when(gone, whole).otherwise(F.col("spans"))).withColumn("kept", F.when(gone, F.lit(b"")).otherwise(F.col("kept")))
    return once.select(*columns).unionByName(again.select(*columns))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long repeats in all of `documents`."""
    found = long_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), grams AS (
  SELECT doc_id, pos, substr(x, CAST(2 * pos + 1 AS BIGINT), 200) AS g FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 99)) AS pos FROM texts WHERE length(x) >= 200)
), later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) AS nth FROM grams) WHERE nth > 1
), islands AS (
  SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (
    SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100 THEN 0 ELSE 1 END AS fresh FROM later)
), spans AS (
  SELECT doc_id, min(pos) AS s, max(pos) + 100 AS e FROM islands GROUP BY doc_id, island
), bounds AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS lo, s AS hi FROM spans
  UNION ALL SELECT doc_id, coalesce(max(e), 0), NULL FROM texts LEFT JOIN spans USING (doc_id) GROUP BY doc_id
), kept AS (
  SELECT doc_id, coalesce(string_agg(CASE WHEN hi IS NULL THEN substr(x, CAST(2 * lo + 1 AS BIGINT)) ELSE substr(x, CAST(2 * lo + 1 AS BIGINT), CAST(2 * (hi - lo) AS BIGINT)) END, '' ORDER BY lo), '') AS k FROM bounds JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT t.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n.n, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM texts t JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(e - s) AS removed, count(*) AS n FROM spans GROUP BY doc_id) n USING (doc_id)
"""
