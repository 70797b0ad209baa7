"""Mixing sources to target weights by a splitting tree, in DataFrame functions alone.

Each source's documents are dealt to blocks of about equal numbers by a hash, which a permutation of the blocks' numbers puts in order. Full passes over a source are taken first;
the last, partial pass takes whole blocks in a permuted order up to the source's quota, and of the block that the quota
ends in it takes the documents that fit. The room that is left goes on to the blocks after it, in the same way among documents
no longer than the room, until none fits: what a walk over all documents in permuted order would take. The exact block counts of all sources are then split among output shards
by a tree: at each node the left half's blocks are a multivariate hypergeometric draw from the node's.
Shards take disjoint ranges of each source's permuted blocks and order their documents by a hash.

Only numbers per source reach the driver: the weights, targets and the tree are arithmetic on them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import WORD, stored, table

#: Documents in a block, about, words in an output shard, about, and the least number of shards.
BLOCK_DOCS, SHARD_WORDS, LEAST_SHARDS = 128, 50_000_000, 8
#: Blocks of all sources, at most: beyond 5e10 documents blocks are larger. The hypergeometric generator takes up to 1e9.
MAX_BLOCKS = 400_000_000
#: Ranges of a source's blocks whose sums are looked at first.
RANGES = 1_024
#: A bound on the number of sources, whose totals the driver reads.
MAX_SOURCES = 100_000
#: Stands for a round's end that no block is.
NO_BLOCK = 1 << 60


def sizes(text: Column) -> Column:
    """Words of the whole text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words to take per source: sources in code point order, null last, with weights repeating, share of all words.

    A target stops at most times its source's words; what is above is shared again by weight until none is.
    """
    order = sorted(totals, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    out: dict = {}
    left, open_ = share * sum(n for _, n in order), [s for s, _ in order]
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > cap[s]]
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = cap[s]
            left -= cap[s]
        open_ = [s for s in open_ if s not in set(over)]
    return out


def splitting_tree(quotas: list[int], shards: int, seed: int = 5) -> np.ndarray:
    """Exact numbers of each source's blocks per shard (shards x sources); columns sum to the quotas, rows are equal up to one."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    todo = [(0, shards, np.array(quotas, np.int64))]
    while todo:
        a, b, have = todo.pop()
        if b - a == 1:
            out[a] = have
            continue
        mid = (a + b) // 2
        left = rng.multivariate_hypergeometric(have, int(have.sum()) * (mid - a) // (b - a), method="marginals")
        todo += [(a, mid, left), (mid, b, have - left)]
    return out


def _fitted(ranked: DataFrame, cells: list[tuple[str | None, int, int]], seed: int) -> DataFrame:
    """source, _rank, _fh, _fits, _words: in each cell (source, block's rank, room) the documents that fit, in permuted order, by hash.

    Rows that repeat are one entry with their number, so that a cell is no longer than a block has different documents.
    """
    small = ranked.sparkSession.createDataFrame(cells, "_ps string, _pr long, _room long")
    kind = "array<struct<h:bigint,n:bigint,words:bigint>>"

    def step(s, x):
        n = F.when((x["size"] > 0) & (x["size"] <= s["room"]), F.least(x["n"], F.floor(s["room"] / x["size"]))).otherwise(F.lit(0).cast("long"))
        taken = F.struct((s["room"] - n * x["size"]).alias("room"), F.concat(s["got"], F.array(F.struct(x["_h"].alias("h"), n.alias("n"), (n * x["size"]).alias("words")))).alias("got"))
        return F.when(n > 0, taken).otherwise(s)

    there = ranked.join(F.broadcast(small) if len(cells) <= 10_000 else small, F.col("source").eqNullSafe(F.col("_ps")) & (F.col("_rank") == F.col("_pr")))
    there = there.groupBy("source", "_rank", "_room", "_h", "size").agg(F.count("*").alias("n"))
    listed = F.sort_array(F.collect_list(F.struct(F.xxhash64("_h", F.lit(seed + 2)).alias("o"), "_h", "size", "n")))
    fits = F.aggregate(listed, F.struct(F.first("_room").alias("room"), F.array().cast(kind).alias("got")), step, lambda s: s["got"])
    got = there.groupBy("source", "_rank").agg(fits.alias("_got")).select("source", "_rank", F.explode("_got").alias("g"))
    return got.groupBy("source", "_rank", F.col("g.h").alias("_fh")).agg(F.sum("g.n").alias("_fits"), F.sum("g.words").alias("_words"))


def _first_over(sums: DataFrame, unit: str) -> dict:
    """Per source of sums (source, unit, _words, _room, _done): (full, at): what is done before the first unit at which _done and all words up to it are over _room, and that unit, None if there is none."""
    sums = sums.withColumn("_end", F.col("_done") + F.sum("_words").over(Window.partitionBy("source").orderBy(unit).rowsBetween(Window.unboundedPreceding, 0)))
    found = sums.groupBy("source").agg(F.max(F.expr("if(_end <= _room, _end, _done)")).alias("full"), F.min(F.expr(f"if(_end > _room, {unit}, null)")).alias("at"))
    return {r.source: (int(r.full), r["at"]) for r in found.collect()}


def fill(ranked: DataFrame, quotas: dict[str | None, int], seed: int) -> dict[str | None, list[tuple[int, int, int, int]]]:
    """Per source its rounds (room, first, end, rest): of the blocks first to end - 1 all documents up to room words are taken, in block end those that fit into rest.

    A document longer than the room can no longer fit, so a round looks at the others alone. The next one starts behind block end with the room
    that is left; the last one has no such block. A block's documents that were left are longer than the room, so rounds are few.
    The end is found among RANGES ranges of a source's blocks, then among the blocks of one range.
    """
    out: dict = {}
    live = [(s, q, 0) for s, q in quotas.items() if q > 0]
    while live:
        now = ranked.sparkSession.createDataFrame(live, "_ls string, _room long, _first long")
        left = ranked.join(F.broadcast(now) if len(live) <= 10_000 else now, F.col("source").eqNullSafe(F.col("_ls"))).where("_rank >= _first and size > 0 and size <= _room")
        left = left.withColumn("_range", F.expr(f"_rank * {RANGES} div _blocks"))
        sums = left.groupBy("source", "_range").agg(F.sum("size").alias("_words"), F.first("_room").alias("_room"), F.lit(0).cast("long").alias("_done"))
        coarse = _first_over(sums, "_range")
        ends = [(s, int(at), full) for s, (full, at) in coarse.items() if at is not None]
        cut = {s: (full, None) for s, (full, at) in coarse.items() if at is None}
        if ends:
            within = ranked.sparkSession.createDataFrame(ends, "_es string, _er long, _done long")
            inside = left.join(F.broadcast(within) if len(ends) <= 10_000 else within, F.col("source").eqNullSafe(F.col("_es")) & (F.col("_range") == F.col("_er")))
            cut |= _first_over(inside.groupBy("source", "_rank").agg(F.sum("size").alias("_words"), F.first("_room").alias("_room"), F.first("_done").alias("_done")), "_rank")
        cells, firsts = {}, {}
        for s, room, first in live:
            if s in cut:
                full, at = cut[s]
                at = NO_BLOCK if at is None else int(at)
                out.setdefault(s, []).append((room, first, at, room - full))
                if at < NO_BLOCK and room > full:
                    cells[s], firsts[s] = room - full, at
        if not cells:
            break
        words = {r.source: int(r.n) for r in _fitted(ranked, [(s, firsts[s], n) for s, n in cells.items()], seed).groupBy("source").agg(F.sum("_words").alias("n")).collect()}
        live = [(s, n - words.get(s, 0), firsts[s] + 1) for s, n in cells.items() if n > words.get(s, 0)]
    return out


def _coprime(n: int, seed: int) -> int:
    """A multiplier that permutes the numbers below n."""
    a = max(1, int(n * 0.618) + seed)
    while math.gcd(a, n) != 1:
        a += 1
    return a


def row_hash() -> Column:
    """What tells the rows of documents apart: rows that repeat an id and a text have one hash."""
    return F.xxhash64("doc_id", "text")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), seed: int = 5, hashed: bool = False) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies, shards, orders; with hashed also row_hash.

    copies is how often the mix takes the whole document (0 to 2), shards the output shard of each copy, orders the seeded
    hash by which that copy is ordered within its shard. Null texts and
    texts without words have size 0 and are taken as often as their source's full passes. Rows that repeat an id are
    documents of their own. A null source is a source. An empty table gives an empty result; other columns are not read.
    """
    more = ["row_hash"] if hashed else []
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), sizes(F.col("text")).alias("size"), row_hash().alias("row_hash"))
    rows = stored(rows.withColumn("_h", F.xxhash64("row_hash", F.lit(seed))), "sizes")
    per = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = targets([(r.source, int(r.words)) for r in per], weights, share)
    block_docs = max(BLOCK_DOCS, -(-sum(r.n for r in per) // MAX_BLOCKS))
    plan = []
    for r in sorted(per, key=lambda r: (r.source is None, r.source or "")):
        words, blocks = int(r.words), max(1, -(-r.n // block_docs))
        passes = min(2, int(goal[r.source] // words)) if words else 1
        plan.append((r.source, words, float(goal[r.source]), passes, round(goal[r.source]) - passes * words if words else 0, blocks, _coprime(blocks, seed)))
    spark = docs.sparkSession
    facts = spark.createDataFrame(plan, "_s string, source_size long, target double, _passes int, _quota long, _blocks long, _step long")
    same = F.col("source").eqNullSafe(F.col("_s"))
    dealt = rows.join(F.broadcast(facts) if len(plan) <= 10_000 else facts, same)
    # a document's block, and the block's place in the source's permuted order
    ranked = stored(dealt.withColumn("_rank", F.expr(f"pmod(pmod(_h, _blocks) * _step + {seed}, _blocks)")).drop("_s", "_step", "_quota"), "blocks") if plan else None
    filled = fill(ranked, {p[0]: p[4] for p in plan}, seed) if plan else {}
    # what fills a quota's rest goes where the block that the quota ends in goes
    partial = {s: (min(r[0][2] + 1, n) if r else 0) for (s, n) in ((p[0], p[5]) for p in plan) for r in [filled.get(s)]}
    n_blocks = {p[0]: p[5] for p in plan}
    quotas = [p[3] * n_blocks[p[0]] + partial.get(p[0], 0) for p in plan]
    shards = max(LEAST_SHARDS, round(sum(p[2] for p in plan) / SHARD_WORDS))
    ends = np.cumsum(splitting_tree(quotas, shards, seed), axis=0) if plan else np.zeros((1, 0), np.int64)
    cuts = spark.createDataFrame([(p[0], [int(x) for x in ends[:, i]], [r[:3] for r in filled.get(p[0], [])], partial[p[0]]) for i, p in enumerate(plan)], "_c string, _cuts array<long>, _rounds array<struct<room:bigint,first:bigint,end:bigint>>, _drawn long")
    if not plan:
        return dealt.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).alias("copies"), F.array().cast("array<int>").alias("shards"), F.array().cast("array<bigint>").alias("orders"), *more)

    placed = ranked.join(F.broadcast(cuts) if len(plan) * shards <= 1_000_000 else cuts, F.col("source").eqNullSafe(F.col("_c")))
    placed = placed.withColumn("_in", F.exists("_rounds", lambda r: r["end"] == F.col("_rank")))
    cells = [(s, r[2], r[3]) for s, rounds in filled.items() for r in rounds if r[2] < NO_BLOCK]
    fitted = _fitted(ranked, cells, seed).select(F.col("source").alias("_fs"), F.col("_rank").alias("_fr"), "_fh", "_fits")
    partly = placed.where("_in").withColumn("_nth", F.row_number().over(Window.partitionBy("source", "_rank", "_h").orderBy("size")))
    partly = partly.join(fitted, F.col("source").eqNullSafe(F.col("_fs")) & (F.col("_rank") == F.col("_fr")) & (F.col("_h") == F.col("_fh")), "left").withColumn("_more", F.when(F.col("_nth") <= F.coalesce("_fits", F.lit(0)), 1).otherwise(0)).drop("_nth", "_fs", "_fr", "_fh", "_fits")
    whole = F.exists("_rounds", lambda r: (F.col("_rank") >= r["first"]) & (F.col("_rank") < r["end"]) & (F.col("size") <= r["room"])) & (F.col("size") > 0)
    done = placed.where("not _in").withColumn("_more", F.when(whole, 1).otherwise(0)).unionByName(partly).withColumn("copies", F.col("_passes") + F.col("_more"))
    nth = lambda c: c * F.col("_blocks") + F.when(c < F.col("_passes"), F.col("_rank")).otherwise(F.least(F.col("_rank"), F.col("_drawn") - 1))  # noqa: E731  of the source's drawn blocks, pass by pass
    shard = lambda c: F.size(F.filter("_cuts", lambda x: x <= nth(c)))
    each = lambda f, kind: F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), f)).otherwise(F.array().cast(f"array<{kind}>"))
    place = lambda c: F.xxhash64("_h", "source", c, F.lit(seed + 3))
    return done.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", each(shard, "int").alias("shards"), each(place, "bigint").alias("orders"), *more)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix of the whole table `documents`."""
    return mix(table(spark, sf_dir, "documents"))
