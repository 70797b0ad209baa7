"""Quality classifier: positive-unlabelled learning with the non-negative risk.

Trusted positives (label 1) are set against unlabelled text: all documents of the learning fold, whatever their labels. With
the class prior p and the logistic loss l, the risk that is minimised is

    p * mean_P l(g) + max(0, mean_U l(-g) - p * mean_P l(-g))

g is linear in hinges over per-document text statistics, so that without the maximum the risk is convex: Newton steps
minimise it, and a step that takes the bracket below zero is shortened. Every pass reads all documents' statistics and
returns sums of fixed size. The prior is not read from labels: it is the smallest ratio, over thresholds of g, of the
unlabelled documents' share above to the positives' share above, with bounds of the sampling error; fits with the
old and the new prior alternate. Labels other than 1 are never used.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import mapped, remainder, stored, table

THRESHOLD = 0.3
#: Standardized statistics are cut at LIMIT; hinges rise from these values on.
LIMIT, HINGES = 6.0, (0.5, 1.5, 3.0)
RIDGE, PASSES, PRIORS = 0.03, 25, 3
#: Thresholds of the prior's estimate: bins of g, the least share of positives above one, and standard errors that are added.
BINS, RANGE, LEAST, ERRORS = 6_000, 30.0, 0.05, 1.65
_SYMBOLS = b"#$%&*@^~=<>{}[]\\/_+"


def features(text: str | None) -> list[float]:
    """Statistics of one whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    odd = lambda chars: (size - len(raw.translate(None, chars))) / size
    twice = sum(map(eq, words, words[1:]))
    tails = sum(map(eq, words, words[2:]))
    symbol = sum(not x[-1:].isalnum() and x[-1:] == x[-2:-1] for x in words if x[-1] < 128)
    return [
        np.log1p(len(words)), np.log1p(len(raw)), len(counts) / n, len(counts) / np.sqrt(n), top / n, twice / n, tails / n, symbol / n,
        odd(b"|"), raw.count(b" | ") / n, odd(_SYMBOLS), odd(b"0123456789"), odd(b".,;:!?"), odd(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        size / n, len(set(lines)) / max(len(lines), 1), len(lines) / n, np.sqrt(twice / n), np.sqrt(odd(b"|")), np.sqrt(symbol / n),
    ]


SIZE = len(features(""))
_TERMS = SIZE * (1 + len(HINGES)) + 1


def terms(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardized statistics, their hinges and a constant."""
    z = ((x - mean) / scale).clip(-LIMIT, LIMIT)
    return np.hstack([z, *(np.maximum(0, z - t) for t in HINGES), np.ones((len(z), 1))])


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z.clip(-30, 30)))


def sums(x: np.ndarray, positive: np.ndarray, model: dict) -> np.ndarray:
    """What a pass adds up over some rows: of all rows the number, losses, gradient and curvature, of the positives the number, both losses and terms."""
    phi = terms(x, model["mean"], model["scale"])
    g = phi @ model["w"]
    s, own = _sigmoid(g), positive
    return np.concatenate([[len(g), _softplus(g).sum()], s @ phi, ((phi * (s * (1 - s))[:, None]).T @ phi).ravel(), [own.sum(), _softplus(-g[own]).sum(), _softplus(g[own]).sum()], phi[own].sum(0)])


def _state(total: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """Risk, bracket and Newton step at w of the sums there."""
    n, loss, rest = total[0], total[1], total[2:]
    slope, curve = rest[:_TERMS] / n, rest[_TERMS : _TERMS + _TERMS**2].reshape(_TERMS, _TERMS) / n
    m, good, bad, phi = *rest[_TERMS + _TERMS**2 :][:3], rest[_TERMS + _TERMS**2 + 3 :]
    bracket = loss / n - prior * bad / m
    risk = prior * good / m + max(0.0, bracket) + RIDGE * float(w @ w) / 2
    return float(risk), float(bracket), np.linalg.solve(curve + RIDGE * np.eye(_TERMS), slope - prior * phi / m + RIDGE * w)


def descend(evaluate, w: np.ndarray, prior: float) -> np.ndarray:
    """Newton steps from w on the non-negative risk; evaluate(w) gives the sums of all rows at w."""
    risk, _, step = _state(evaluate(w), w, prior)
    size = 1.0
    for _ in range(PASSES):
        tried = w - size * step
        new, bracket, next_step = _state(evaluate(tried), tried, prior)
        if bracket >= 0 and new < risk:
            gain, w, risk, step, size = risk - new, tried, new, next_step, 1.0
            if gain < 1e-5:
                break
        elif size < 0.02:
            break
        else:
            size /= 4
    return w


def class_prior(positive: np.ndarray, every: np.ndarray) -> float:
    """The prior from counts of g by bins, in rising order, of positives and of all rows."""
    p, u = (np.cumsum(c[::-1]) / c.sum() for c in (positive, every))
    high = u + ERRORS * np.sqrt(u * (1 - u) / every.sum())
    low = p - ERRORS * np.sqrt(p * (1 - p) / positive.sum())
    fits = (p >= LEAST) & (low > 0)
    return float(np.clip((high[fits] / low[fits]).min(initial=1.0), 0.02, 0.98))


def bins_of(g: np.ndarray) -> np.ndarray:
    return ((g.clip(-RANGE, RANGE) + RANGE) * (BINS / (2 * RANGE))).astype(np.int64)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of the whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, x array<double>")


def _matrix(x: pa.ListArray) -> np.ndarray:
    return x.flatten().to_numpy().reshape(-1, SIZE)


def train(rows: DataFrame, labels: DataFrame) -> dict | None:
    """A model from all rows (see featured) of the learning fold and its labels (doc_id, quality); None without any labelled 1.

    A document with several labels is positive if any is 1. Labels of other documents and null labels count for nothing.
    """
    known = labels.where("doc_id is not null and quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    rows = stored(rows.join(known, F.col("doc_id") == F.col("_id"), "left").select("x", F.col("_id").isNotNull().alias("positive")), "learn")
    moments = [f(F.get("x", i)) for i in range(SIZE) for f in (F.avg, F.stddev_pop)]
    first = rows.agg(F.count_if("positive"), *moments).first()
    if not first[0]:
        return None
    model = {"mean": np.array(first[1::2], float), "scale": np.array(first[2::2], float) + 1e-6}

    def evaluate(w: np.ndarray) -> np.ndarray:
        held = rows.sparkSession.sparkContext.broadcast(model | {"w": w})

        def run(batches):
            total = np.zeros(2 + 2 * _TERMS + _TERMS**2 + 3)
            for b in batches:
                total += sums(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), held.value)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "v"])

        out = np.zeros(2 + 2 * _TERMS + _TERMS**2 + 3)
        for b in mapped(rows, run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow().to_batches():  # as many rows as sums
            out[b.column(0).to_numpy()] = b.column(1).to_numpy()
        return out

    def counted(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = rows.sparkSession.sparkContext.broadcast(model | {"w": w})

        def run(batches):
            every, own = np.zeros(BINS + 1, np.int64), np.zeros(BINS + 1, np.int64)
            for b in batches:
                at = bins_of(terms(_matrix(b.column(0)), held.value["mean"], held.value["scale"]) @ held.value["w"])
                every += np.bincount(at, minlength=BINS + 1)
                own += np.bincount(at[b.column(1).to_numpy(zero_copy_only=False)], minlength=BINS + 1)
            at = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at]), pa.array(own[at])], ["bin", "every", "own"])

        every, own = np.zeros(BINS + 1), np.zeros(BINS + 1)
        for b in mapped(rows, run, "bin long, every long, own long").groupBy("bin").agg(F.sum("every").alias("every"), F.sum("own").alias("own")).toArrow().to_batches():  # at most BINS rows
            every[b.column(0).to_numpy()], own[b.column(0).to_numpy()] = b.column(1).to_numpy(), b.column(2).to_numpy()
        return own, every

    return fit(evaluate, counted, model)


def fit(evaluate, counted, model: dict) -> dict:
    """Alternates fits and estimates of the prior, from one half on; evaluate(w) and counted(w) read all rows."""
    w, prior = np.zeros(_TERMS), 0.5
    for turn in range(PRIORS):
        w = descend(evaluate, w, prior)
        if turn < PRIORS - 1:
            prior = class_prior(*counted(w))
    return model | {"w": w, "prior": prior}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    return _sigmoid(terms(x, model["mean"], model["scale"]) @ model["w"])


def score(rows: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score (0 to 1) of rows (see featured); without a model each score is 0.5.

    Null and empty texts are scored like any other; repeated rows and null ids each get a row; an empty table gives an empty result.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(held.value, _matrix(b.column(1))) if held.value else np.full(len(b), 0.5))], ["doc_id", "score"])

    return mapped(rows, run, f"doc_id {kind}, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of rows with remainder 0 modulo 5 are never read by the fit."""
    rows = stored(featured(table(spark, sf_dir, "documents")), "features")
    learn = lambda df: df.where(remainder(F.col("doc_id"), 5) != 0)
    out = score(rows, train(learn(rows), learn(table(spark, sf_dir, "labels"))))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
