"""Exact top-k inner products by aggregation of sorted lists without random access.

The dimensions are cut into LISTS groups, and the candidates of a block into runs of similar vectors. In each group a
run has a middle and a radius, which bound the partial inner product of all its members from both sides. For a query
each group gives one list: the runs in descending order of their bound. The lists are read in step, some runs at a
time, and only what is read is multiplied. The score of a candidate lies between what was read of it plus the lower
bounds of its run in the lists where it was not met, and what was read plus the upper bounds there. A run none of
whose members reaches the k-th largest lower bound is passed over from then on, so that its entries in the remaining
lists are never multiplied; reading stops when every run is either passed over or complete. No entry is looked up out
of order, and the scores that remain are complete sums.

Rows are dealt to blocks of candidates and blocks of queries of bounded size; each pair of blocks is one group
of work, and the best k of every block meet in a final ranking.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import table

#: Lists, and rows of a block of candidates and of queries: large blocks of queries, so that candidates are seldom copied.
LISTS, CANDIDATES, QUERIES = 4, 8_192, 16_384
#: Rows of a run, on average; queries that read their lists together; runs that the first step reads of each list (each further step trebles what was read).
RUN, TOGETHER, FIRST = 64, 256, 16


def runs_of(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): the rows of c in runs of similar rows, by a few rounds of k-means; a run has at most 2 * RUN rows."""
    n = len(c)
    x = c.astype(np.float64)
    middles = x[np.linspace(0, n - 1, -(-n // RUN)).astype(np.int64)]
    for _ in range(4):
        nearest = np.argmin((middles**2).sum(1) - 2 * (x @ middles.T), axis=1)
        order = np.argsort(nearest, kind="stable")
        starts = np.flatnonzero(np.diff(nearest[order], prepend=-1))
        middles[nearest[order[starts]]] = np.add.reduceat(x[order], starts) / np.diff(starts, append=n)[:, None]
    cuts = [np.arange(lo, hi, 2 * RUN) for lo, hi in zip(starts, np.append(starts[1:], n))]
    return order, np.concatenate(cuts)


class Lists:
    """The lists of a block of candidates: for each group of dimensions, its runs with what bounds their partial inner products."""

    def __init__(self, c: np.ndarray, ids: np.ndarray):
        order, self.starts = runs_of(c)
        self.c, self.ids = c[order], ids[order]
        self.sizes = np.diff(self.starts, append=len(c))
        self.groups = [g for g in np.array_split(np.arange(c.shape[1]), LISTS) if len(g)] or [np.arange(0)]
        self.parts = [np.ascontiguousarray(self.c[:, g]) for g in self.groups]
        x = [p.astype(np.float64) for p in self.parts]
        self.middles = [np.add.reduceat(p, self.starts) / self.sizes[:, None] for p in x]
        away = [np.sqrt(((p - np.repeat(m, self.sizes, axis=0)) ** 2).sum(1)) for p, m in zip(x, self.middles)]
        self.radii = [np.maximum.reduceat(a, self.starts) for a in away]
        self.multiplied = 0  # entries read so far, for tests

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of partial inner products: lists x queries x runs, wider by more than rounding can err."""
        q = q.astype(np.float64)
        slack = 1e-9 * (1 + np.abs(q).max(initial=0) * float(np.abs(self.c).max(initial=0)) * q.shape[1])
        middle = np.stack([q[:, g] @ m.T for g, m in zip(self.groups, self.middles)])
        reach = np.stack([np.sqrt((q[:, g] ** 2).sum(1))[:, None] * r for g, r in zip(self.groups, self.radii)]) + slack
        return middle - reach, middle + reach

    def best(self, q: np.ndarray, q_ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the ids and scores of its k best candidates with another id, ties to the smaller id."""
        n, runs, k = len(self.c), len(self.starts), min(k, len(self.c))
        low, high = self.bounds(q)
        lists = np.argsort(-high, axis=2, kind="stable")
        met, passed = np.zeros(high.shape, bool), np.zeros(high.shape[1:], bool)
        read = np.zeros((len(q), n), self.c.dtype)
        own = self.ids == q_ids[:, None]
        depth, end = 0, FIRST
        while depth < runs and not (passed | met.all(0)).all():
            for g, dims in enumerate(self.groups):
                now = np.zeros(passed.shape, bool)
                np.put_along_axis(now, lists[g, :, depth:end], True, axis=1)
                now &= ~passed
                for r in np.flatnonzero(now.any(0)):
                    who, rows = np.flatnonzero(now[:, r]), slice(self.starts[r], self.starts[r] + self.sizes[r])
                    if len(who) == len(q):
                        read[:, rows] += q[:, dims] @ self.parts[g][rows].T
                    else:
                        read[who, rows] += q[np.ix_(who, dims)] @ self.parts[g][rows].T
                    self.multiplied += len(who) * int(self.sizes[r])
                met[g] |= now
            depth, end = end, 3 * end
            least = read + np.repeat(np.where(met, 0, low).sum(0), self.sizes, axis=1)
            least[own] = -np.inf
            kth = np.partition(least, n - k, axis=1)[:, n - k]
            most = np.maximum.reduceat(read, self.starts, axis=1) + np.where(met, 0, high).sum(0)
            passed |= (most < kth[:, None]) & ~met.all(0)
        known = np.repeat(met.all(0), self.sizes, axis=1) & ~own
        out = []
        for score, there in zip(read, known):
            at = np.flatnonzero(there)
            if len(at) > k:
                at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
            at = at[np.lexsort((self.ids[at], -score[at]))[:k]]
            out.append((self.ids[at], score[at]))
        return out


def clamped(score: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers, those beyond the range as its end."""
    if score.dtype != object:
        return score.astype(np.int64)
    return np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in score], np.int64)


def _cell(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q_ids, c_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        q, c = (matrix(t["v"].combine_chunks()) for t in (left, right))
        wide = max(q.shape[1], c.shape[1])
        q, c = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (q, c))
        top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(wide, 1)
        kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else object
        q, c = (np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) if kind is object else x.astype(kind) for x in (q, c))
        lists = Lists(c, c_ids)
        found: list[tuple] = []
        for at in range(0, len(q), TOGETHER):
            asking = q_ids[at : at + TOGETHER]
            found += [(np.full(len(ids), i), ids, clamped(score)) for i, (ids, score) in zip(asking, lists.best(q[at : at + TOGETHER], asking, k))]
        return pa.table({name: pa.array(np.concatenate([f[j] for f in found]).astype(np.int64)) for j, name in enumerate(("query_id", "vec_id", "score"))})

    return run


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of possibly different lengths, padded with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), int(sizes[0]))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def search(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all rows with another vec_id.

    vectors: vec_id, embedding. Vectors that are null or hold null or non-finite components take no part, nor do rows with a
    null id; shorter vectors count as padded with zeros. Rows with the same vec_id are candidates each, but not for
    each other; of those that repeat a query's id the one with the smallest vector asks. With fewer than k candidates all are returned; an empty table gives an empty result. A score that a long cannot hold
    is the nearest long; such scores tie. Other columns are not read.
    """
    e = F.col("embedding")
    ok = e.isNotNull() & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(ok)
    rows = rows.select("vec_id", F.transform(e, lambda x: F.floor(x.cast("double") * 64).cast("double")).alias("v"))
    n, nq = rows.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-(nq or 0) // QUERIES))
    place = F.monotonically_increasing_id()  # spreads rows evenly, whatever their ids; the same when a task over the input is repeated
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    left = asked.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("c", F.pmod(F.xxhash64(place), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all `embeddings` for each row whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
