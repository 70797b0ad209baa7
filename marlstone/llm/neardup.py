"""Near-duplicates by SetSketch registers, banding, a joint likelihood estimate and exact verification.

1. Each distinct shingle set becomes a sketch of REGISTERS registers: every shingle draws exponentially
   spaced values into registers in an order of its own, a register keeps the smallest and stores its
   truncated logarithm. Sketches of parts merge by the larger register value.
2. Runs of ROWS registers, as levels to base FINE, form BANDS bands; sets that share a band are candidates.
   For the estimate a register is kept as its level to base BASE, which fits a byte.
3. A candidate pair's similarity is estimated from the counts of larger, smaller and equal
   registers by maximum likelihood; what is far below the threshold goes.
4. The rest is confirmed on the full shingle sets; confirmed links join documents to components.

Within a band, members are first compared with one hub each, so that a large group costs as many comparisons
as it has members. Members that are then still in different components meet in full: each member outside the
band's main component with all others, in blocks that compare full sets. No pair of one band is left out.

Texts are never shuffled. What a join needs of them or of the bands is chosen first by a bit table of fixed size over the
hashes of the keys that the join asks for: it may let others through, which the join then drops, and loses none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import bit_table, bounded_broadcast, in_bit_table, mapped, stored, table

BANDS, ROWS = 42, 6
REGISTERS, FINE, BASE, TOP = 256, 1.001, 1.09, 65535
#: Pairs whose estimate is this far below the threshold are not verified: over six standard errors of the estimate.
MARGIN = 0.17
#: Shingles, about, and texts that are sketched or sent at a time; a larger set is sketched in parts.
BATCH_HASHES, BATCH_TEXTS, PART_HASHES = 100_000, 400, 200_000
#: Shingles of the members that a block compares, and of the partners that a cell compares them with, about.
BLOCK_HASHES, CELL_HASHES = 100_000, 250_000
#: Bytes of the words whose hashes a task keeps, about, with what the table itself takes for each.
_KNOWN_BYTES, _ENTRY_BYTES = 40_000_000, 150
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text, ASCII letters in lower case."""

    def __init__(self, k: int):
        self.k, self.known, self.held = k, {}, 0

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if self.held > _KNOWN_BYTES:
            known.clear()
            self.held = 0
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
                    self.held += len(w) + _ENTRY_BYTES
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.k + 1)
        out = np.full(n, len(h) if len(h) < self.k else self.k, np.uint64)
        for j in range(min(self.k, len(h))):
            out = _mix(out * _MUL + h[j : j + n])
        return np.unique(out)


#: Interval ends of the j-th smallest of REGISTERS exponential values.
_ENDS = np.concatenate([[0.0], np.log1p(np.arange(1, REGISTERS) / (REGISTERS - np.arange(1, REGISTERS))), [60.0]])


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets, as levels to base FINE; those of parts of a large set merge by the larger value."""
    out = np.empty((len(sets), REGISTERS), np.uint16)
    small = [i for i, s in enumerate(sets) if len(s) <= PART_HASHES]
    out[small] = _sketches([sets[i] for i in small])
    for i in set(range(len(sets))).difference(small):
        out[i] = np.maximum.reduce([_sketches([sets[i][at : at + PART_HASHES]])[0] for at in range(0, len(sets[i]), PART_HASHES)])
    return out


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of sets, all together: round j gives each element of the sets that still need it its j-th value."""
    sizes = np.array([len(s) for s in sets])
    best = np.full((len(sets), REGISTERS), np.inf)
    if not len(sets):
        return np.empty((0, REGISTERS), np.uint16)
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    start, stride = (element & np.uint64(REGISTERS - 1)).astype(np.int64), ((element >> np.uint64(8)) & np.uint64(REGISTERS - 1)).astype(np.int64) | 1
    for j in range(REGISTERS):
        u = ((_mix(element + np.uint64((j + 1) * int(_MUL) & (2**64 - 1))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        low, high = _ENDS[j], _ENDS[j + 1]
        value = low - np.log1p(u * np.expm1(low - high))  # exponential, truncated to the interval
        np.minimum.at(best.ravel(), owner * REGISTERS + ((start + j * stride) & (REGISTERS - 1)), value)
        more = best.max(1) > high
        if not more.any():
            break
        keep = more[owner]
        if not keep.all():
            element, owner, start, stride = element[keep], owner[keep], start[keep], stride[keep]
    level = np.floor(1 - np.log(best / 20.0) / np.log(FINE))  # 20: above this value a register counts as never reached
    return np.clip(level, 0, TOP).astype(np.uint16)


def coarse(levels: np.ndarray) -> np.ndarray:
    """Levels to base BASE, one byte each, of levels to base FINE."""
    return np.clip(np.ceil(levels * (np.log(FINE) / np.log(BASE))), 0, 255).astype(np.uint8)


def bands(registers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ROWS registers."""
    out = np.empty((len(registers), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(registers), b + 1, np.uint64)
        for r in range(ROWS):
            h = _mix(h * _MUL + registers[:, b * ROWS + r].astype(np.uint64))
        out[:, b] = h
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs from register counts and the known set sizes, by golden-section search."""
    more, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = REGISTERS - more - less
    u, v = na / (na + nb), nb / (na + nb)
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def loss(j):
        p, q = chance(u - v * j), chance(v - u * j)
        return -(more * np.log(p + 1e-12) + less * np.log(q + 1e-12) + same * np.log(np.maximum(1 - p - q, 0) + 1e-12))

    low, high, ratio = np.zeros(len(a)), np.minimum(u / v, v / u), (np.sqrt(5) - 1) / 2
    for _ in range(30):
        c, d = high - ratio * (high - low), low + ratio * (high - low)
        left = loss(c) < loss(d)
        high, low = np.where(left, d, high), np.where(left, low, c)
    return (low + high) / 2


def _batched(texts: list[str | None], shingler: Shingler):
    """(first, sets) of runs of texts, each of bounded number and about bounded size."""
    first, sets, held = 0, [], 0
    for i, t in enumerate(texts):
        sets.append(shingler(t))
        held += len(sets[-1])
        if held >= BATCH_HASHES or len(sets) >= BATCH_TEXTS:
            yield first, sets
            first, sets, held = i + 1, [], 0
    if sets:
        yield first, sets


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n, same, bands, registers of each row; same, bands and registers are null for texts without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        shingler = Shingler(k)
        for b in batches:
            for at in range(0, len(b), BATCH_TEXTS):
                part = b.slice(at, BATCH_TEXTS)
                for first, sets in _batched(part.column(2).to_pylist(), shingler):
                    filled = [s for s in sets if len(s)]
                    levels = sketches(filled)
                    keys, regs = bands(levels).view(np.int64), coarse(levels)
                    row = np.cumsum([len(s) > 0 for s in sets]) - 1
                    columns = [
                        part.column(0).slice(first, len(sets)),
                        part.column(1).slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([keys[i] if len(s) else None for s, i in zip(sets, row, strict=True)], pa.list_(pa.int64())),
                        pa.array([regs[i].tobytes() if len(s) else None for s, i in zip(sets, row, strict=True)], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "same", "bands", "registers"])

    return mapped(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run, f"doc_id {kind}, text_hash long, n long, same binary, bands array<long>, registers binary")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id and full shingle set of the documents whose id is in ids (one column), and of a few others."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = bit_table(ids.toDF("id").select(F.xxhash64("id")))

    def run(batches):
        shingler = Shingler(k)
        for b in batches:
            b = b.filter(in_bit_table(wanted.value, b.column(1)))
            for at in range(0, len(b), BATCH_TEXTS):
                part = b.slice(at, BATCH_TEXTS)
                for first, sets in _batched(part.column(2).to_pylist(), shingler):
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(first, len(sets)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "hashes"])

    return mapped(docs.select("doc_id", F.xxhash64("doc_id"), "text"), run, f"doc_id {kind}, hashes array<long>")


def _banded(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(band, id, n) of each node's bands that are in wanted (one column), and a few others."""
    kind, held = nodes.schema["id"].dataType.simpleString(), bit_table(wanted)

    def run(batches):
        for b in batches:
            keys = b.column(2)
            flat, lengths = keys.flatten(), keys.value_lengths().to_numpy(zero_copy_only=False)
            hit = in_bit_table(held.value, flat)
            owner = np.repeat(np.arange(len(b)), lengths)[hit.to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([flat.filter(hit), b.column(0).take(pa.array(owner)), b.column(1).take(pa.array(owner))], ["band", "id", "n"])

    return mapped(nodes.select("id", "n", "bands"), run, f"band long, id {kind}, n long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of all ids that are not roots: root is the smallest id reachable. Alternates large-star and small-star steps until only stars are left; each step is stored."""
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(0).alias("below")), F.struct(F.col("b").alias("id"), F.lit(1).alias("below")))).alias("e"))
        chained = ends.groupBy("e.id").agg(F.sum("e.below").alias("below"), F.count("*").alias("n")).where("below > 0 and n > 1")
        if chained.isEmpty():  # every id is a root or has one edge, to a root
            return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_c"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("_c")).where("b > a").select(F.col("m").alias("a"), "b").where("a < b")  # at most a row an edge, repeats go below
        low = large.groupBy(F.col("b").alias("_c")).agg(F.min("a").alias("m"))
        joined = large.join(low, F.col("b") == F.col("_c"))
        small = joined.select(F.col("m").alias("a"), "b").union(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct()
        edges = stored(small, "edges")


def _joined(first: DataFrame, more: DataFrame) -> DataFrame:
    """Components (id, root) of the links behind first and of more (a, b) together: only links between roots are followed."""
    root = lambda x: first.select(F.col("id").alias(f"_{x}"), F.col("root").alias(f"r{x}"))
    links = more.join(root("a"), F.col("a") == F.col("_a"), "left").join(root("b"), F.col("b") == F.col("_b"), "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    last = components(links)
    moved = first.join(last.select(F.col("id").alias("_id"), F.col("root").alias("_root")), F.col("root") == F.col("_id"), "left").select("id", F.coalesce("_root", "root").alias("root"))
    return moved.unionByName(last)


def _labels(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes (id, ...) with the root of each."""
    return nodes.join(roots.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").withColumn("root", F.coalesce("root", "id")).drop("_id")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold; pairs: a, b and the size nb of b."""
    side = lambda x: nodes.select(F.col("id").alias(f"_{x}"), F.col("n").alias(f"n{x}_"), F.col("registers").alias(f"r{x}"))
    kinds = pairs.schema["a"].dataType.simpleString()

    def likely(batches):
        for t in batches:
            if len(t):
                regs = [np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in (4, 5)]
                got = estimate(*regs, t.column(2).to_numpy().astype(float), t.column(3).to_numpy().astype(float))
                yield pa.RecordBatch.from_arrays(t.columns[:4], ["a", "b", "na", "nb"]).filter(pa.array(got >= percent / 100 - MARGIN))

    # the hub's side first: sizes that rule a pair out are seen before a register of b is sent
    found = pairs.join(side("a"), F.col("a") == F.col("_a")).where(100 * F.least("na_", "nb") >= percent * F.greatest("na_", "nb"))
    found = found.select("a", "b", F.col("na_").alias("na"), "nb", "ra").join(side("b"), F.col("b") == F.col("_b"))
    found = stored(mapped(found.select("a", "b", "na", "nb", "ra", "rb"), likely, f"a {kinds}, b {kinds}, na long, nb long"), "likely")
    sets = _sets(texts, found.select(F.explode(F.array("a", "b"))), k)
    s = lambda x: sets.select(F.col("doc_id").alias(f"_{x}"), F.col("hashes").alias(f"h{x}"))
    exact = found.join(s("b"), F.col("b") == F.col("_b")).join(s("a"), F.col("a") == F.col("_a")).withColumn("both", F.size(F.array_intersect("ha", "hb")))
    return exact.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _forest(t: pa.Table, percent: int) -> pa.Table:
    """Exact links (a, b) between the minor members and all members of one cell, as many as join their components."""
    t = t.combine_chunks()
    ids, roots, minor = t["id"].to_pylist(), t["root"].to_pylist(), t["minor"].to_numpy(zero_copy_only=False)
    lists = t["hashes"].chunk(0)
    values, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    sizes, xs = np.diff(ends), np.flatnonzero(minor)
    pool, owner = np.concatenate([values[ends[i] : ends[i + 1]] for i in xs]), np.repeat(np.arange(len(xs)), sizes[xs])
    order = np.argsort(pool, kind="stable")
    pool, owner = pool[order], owner[order]
    up = {}

    def top(r):
        while (above := up.get(r, r)) != r:
            up[r] = r = up.get(above, above)
        return r

    links = []
    for y in range(len(ids)):
        own = values[ends[y] : ends[y + 1]]
        low, high = np.searchsorted(pool, own), np.searchsorted(pool, own, "right")
        runs = high - low
        total = int(runs.sum())
        if not total:
            continue
        at = np.arange(total) + np.repeat(low - np.cumsum(runs) + runs, runs)
        both = np.bincount(owner[at], minlength=len(xs))
        for i in xs[100 * both >= percent * (sizes[xs] + sizes[y] - both)].tolist():
            p, q = top(roots[i]), top(roots[y])
            if p != q:
                up[p] = q
                links.append((ids[i], ids[y]))
    return pa.table([pa.array([x[c] for x in links], t.schema.field("id").type) for c in (0, 1)], ["a", "b"])


def _across(rooted: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between members of a band whose components the hubs left apart.

    Each member outside a band's main component meets all members of other components that may reach the threshold by size.
    Those members form blocks of bounded size, a block's partners cells of bounded size; a cell is one group, compares full
    shingle sets through an index of the block and returns only a spanning forest. So no pair is ever a row.
    """
    kind = rooted.schema["id"].dataType.simpleString()
    per_root = rooted.groupBy("band", "root").agg(F.count("*").alias("c"))
    split = per_root.groupBy("band").agg(F.count("*").alias("roots"), F.sum("c").alias("size"), F.max_by("root", F.struct("c", "root")).alias("main")).where("roots > 1 and size > 2")
    split = stored(split.select(F.col("band").alias("_band"), "main"), "split")  # cut off, so that the join below may split hot bands
    open_ = stored(rooted.join(bounded_broadcast(split), F.col("band") == F.col("_band")).where("id != hub").drop("_band"), "open")
    minor = open_.where("root != main")
    blocks = stored(minor.select("main", "id", "n").distinct().groupBy(F.col("main").alias("_main")).agg(F.ceil(F.sum("n") / BLOCK_HASHES).alias("_blocks")), "block_counts")
    minor = minor.join(bounded_broadcast(blocks), F.col("main") == F.col("_main")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks"))).drop("_main", "_blocks")
    spans = minor.groupBy("band", "main", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("root").alias("r0"), F.max("root").alias("r1")).withColumnsRenamed({"band": "_band", "main": "_main"})
    fits = (100 * F.col("n") >= percent * F.col("n0")) & (percent * F.col("n") <= 100 * F.col("n1")) & ((F.col("root") != F.col("r0")) | (F.col("root") != F.col("r1")))
    partners = stored(open_.join(spans, (F.col("band") == F.col("_band")) & fits).select("main", "block", "id", "root", "n").distinct(), "partners")
    cells = stored(partners.groupBy(F.col("main").alias("_main"), F.col("block").alias("_block")).agg(F.ceil(F.sum("n") / CELL_HASHES).alias("_cells")), "cells")
    in_block = (F.col("main") == F.col("_main")) & (F.col("block") == F.col("_block"))
    xs = minor.select("main", "block", "id", "root").distinct().join(cells, in_block).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))).withColumn("minor", F.lit(True))
    ys = partners.join(cells, in_block).withColumn("cell", F.pmod(F.xxhash64("id", F.lit("cell")), F.col("_cells"))).withColumn("minor", F.lit(False))
    columns = ("main", "block", "cell", "id", "root", "minor")
    rows = stored(xs.select(*columns).unionByName(ys.select(*columns)), "rows")
    sets = _sets(texts, rows.select("id"), k)
    return rows.join(sets, F.col("id") == F.col("doc_id")).select(*columns, "hashes").groupBy("main", "block", "cell").applyInArrow(lambda t: _forest(t, percent), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, hashed: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept; with hashed also text_hash, the xxhash64 of the text.

    A document without words (null text included) has no shingles and is linked with nothing. Documents with equal
    shingle sets are one class, represented by its smallest id. Rows that repeat an id and a text have the same
    component and are kept or not together; if an id has several texts, each row has the component of its own text. Null
    ids stay alone, with a null component, kept. An empty table gives an empty result; other columns are not read.
    """
    texts = docs.select("doc_id", "text")
    sketch = stored(_sketched(texts, k), "sketch")
    # equal sets have equal sketches, so any row's will do; copies meet before the shuffle
    nodes = sketch.where("same is not null and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("registers").alias("registers"))
    nodes = stored(nodes, "nodes")
    shared = nodes.select("id", F.explode("bands").alias("band")).groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub != last").select(F.col("band").alias("_band"), "hub")
    shared = stored(shared, "shared")
    members = _banded(nodes, shared.select("_band")).join(shared, F.col("band") == F.col("_band")).select("band", "id", "n", "hub")
    members = stored(members, "members")
    pairs = members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b"), F.col("n").alias("nb")).distinct()
    edges = stored(_verified(pairs, nodes, texts, k, percent), "links")
    first = components(edges)
    more = stored(_across(stored(_labels(members, first), "rooted"), texts, k, percent), "links")
    ends = _joined(first, more) if not more.isEmpty() else first
    by_class = nodes.select("same", "id").join(ends.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select(F.col("same").alias("_same"), F.coalesce("root", "id").alias("_root"))
    out = sketch.select("doc_id", "text_hash", "n", "same").join(by_class, F.col("same") == F.col("_same"), "left")
    root = F.coalesce("_root", "doc_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), root).alias("component_id"), F.coalesce(root == F.col("doc_id"), F.lit(True)).alias("kept"), "text_hash")
    return out if hashed else out.drop("text_hash")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of the whole table `documents` by two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
