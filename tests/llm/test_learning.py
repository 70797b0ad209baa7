"""The two classifiers: held-out accuracy on the given tables, and awkward rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import quality, shared, toxicity

SF = "/root/testdata/sf0.01"


def _area(score, y):
    order = np.argsort(np.argsort(score)) + 1
    return (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def _held_out(spark, query, label):
    rows = query(spark, SF).where("held_out").join(shared.table(spark, SF, "labels").select("doc_id", label), "doc_id").toPandas()
    return rows.score.to_numpy(), (rows[label] == 1).to_numpy(), (rows.predicted == 1).to_numpy()


def test_quality_of_held_out_documents(spark):
    score, y, predicted = _held_out(spark, quality.op1_quality, "quality")
    assert _area(score, y) > 0.97 and (predicted == y).mean() > 0.95


def test_toxicity_of_held_out_documents(spark):
    score, y, predicted = _held_out(spark, toxicity.op2_toxicity, "toxic")
    assert _area(score, y) > 0.9 and (predicted == y).mean() > 0.95


def test_positive_unlabelled_fit_finds_the_prior():
    """Two clouds, labels for some of one: the share of that one among all is found, and the clouds are told apart."""
    rng, n = np.random.default_rng(0), 4_000
    good = rng.random(n) < 0.7
    x = rng.normal(0, 1, (n, quality.SIZE)) + np.where(good, 1.2, -1.2)[:, None]
    own = good & (rng.random(n) < 0.3)
    base = {"mean": x.mean(0), "scale": x.std(0)}
    counted = lambda w: tuple(np.bincount(quality.bins_of(quality.terms(x[k], **base) @ w), minlength=quality.BINS + 1) for k in (own, slice(None)))
    model = quality.fit(lambda w: quality.sums(x, own, base | {"w": w}), counted, base)
    assert abs(model["prior"] - 0.7) < 0.05
    assert ((quality.scores(model, x) > 0.5) == good).mean() > 0.99


def test_the_risk_stays_non_negative():
    rng = np.random.default_rng(1)
    x, own = rng.normal(0, 1, (60, quality.SIZE)), np.arange(60) < 30
    base = {"mean": x.mean(0), "scale": x.std(0)}
    w = quality.descend(lambda w: quality.sums(x, own, base | {"w": w}), np.zeros(quality._TERMS), 0.9)
    assert quality._state(quality.sums(x, own, base | {"w": w}), w, 0.9)[1] >= 0


def test_risk_gradient_and_curvature_by_a_plain_loop():
    """The sums of a pass, and the state they give, against the risk's formula row by row and its differences."""
    rng, n, prior = np.random.default_rng(3), 80, 0.4
    x, own = rng.normal(0, 2, (n, quality.SIZE)), rng.random(n) < 0.4
    base = {"mean": x.mean(0), "scale": x.std(0)}
    w = rng.normal(0, 0.3, quality._TERMS)

    def parts(w):
        good = bad = loss = 0.0
        for row, positive in zip(x, own):
            phi = []
            z = [min(quality.LIMIT, max(-quality.LIMIT, (v - m) / s)) for v, m, s in zip(row, base["mean"], base["scale"])]
            for f in (lambda v: v, *(lambda v, t=t: max(0.0, v - t) for t in quality.HINGES)):
                phi += [f(v) for v in z]
            g = sum(a * b for a, b in zip([*phi, 1.0], w))
            loss += math.log1p(math.exp(-abs(g))) + max(g, 0.0)  # log(1 + e^g): the loss of label -1
            if positive:
                good += math.log1p(math.exp(-abs(g))) + max(-g, 0.0)
                bad += math.log1p(math.exp(-abs(g))) + max(g, 0.0)
        return good / own.sum(), bad / own.sum(), loss / n

    def risk(w):
        good, bad, loss = parts(w)
        return prior * good + max(0.0, loss - prior * bad) + quality.RIDGE * sum(v * v for v in w) / 2

    good, bad, loss = parts(w)
    found, bracket, step = quality._state(quality.sums(x, own, base | {"w": w}), w, prior)
    assert found == pytest.approx(risk(w)) and bracket == pytest.approx(loss - prior * bad) and bracket > 0
    h, eye = 1e-4, np.eye(len(w))
    slope = np.array([(risk(w + h * e) - risk(w - h * e)) / (2 * h) for e in eye])
    along = (risk(w - h * step) - risk(w + h * step)) / (2 * h)
    assert along == pytest.approx(-slope @ step, rel=1e-3) and along < 0  # a step downhill
    curve = np.array([(slope_of(risk, w + h * e, e, h) - slope_of(risk, w - h * e, e, h)) / (2 * h) for e in eye[:6]])
    split = np.array_split(np.arange(n), 3)
    total = sum(quality.sums(x[i], own[i], base | {"w": w}) for i in split)
    assert np.allclose(total, quality.sums(x, own, base | {"w": w}))
    hess = total[2 + quality._TERMS : 2 + quality._TERMS + quality._TERMS**2].reshape(quality._TERMS, -1) / n + quality.RIDGE * eye
    assert np.allclose(curve, np.diag(hess)[:6], rtol=1e-2, atol=1e-4) and np.allclose(hess @ step, slope, atol=1e-4)


def slope_of(f, w, e, h):
    return (f(w + h * e) - f(w - h * e)) / (2 * h)


def test_class_prior_by_a_plain_loop():
    rng = np.random.default_rng(4)
    g, own = np.concatenate([rng.normal(2, 1, 600), rng.normal(-2, 1, 400)]), np.arange(1_000) < 300
    bins = quality.bins_of(g)
    best = 1.0
    for cut in range(quality.BINS + 1):
        p, u = (bins[own] >= cut).mean(), (bins >= cut).mean()
        low, high = p - quality.ERRORS * math.sqrt(p * (1 - p) / own.sum()), u + quality.ERRORS * math.sqrt(u * (1 - u) / len(g))
        if p >= quality.LEAST and low > 0:
            best = min(best, high / low)
    counts = [np.bincount(bins[k], minlength=quality.BINS + 1) for k in (own, slice(None))]
    assert quality.class_prior(*counts) == pytest.approx(best)


def test_features_of_any_text():
    assert all(len(quality.features(t)) == quality.SIZE and np.isfinite(quality.features(t)).all() for t in (None, " ", "\n", "a" * 100_000, "\ud800"))


def test_quality_of_awkward_tables(spark):
    docs = quality.featured(spark.createDataFrame([(1, "a"), (2, None), (2, None), (None, "")], "doc_id long, text string"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, quality.train(docs, none)).collect()] == [0.5] * 4
    every = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (None, 1), (9, 1), (1, None)], "doc_id long, quality int")
    rows = quality.score(docs, quality.train(docs, every)).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert quality.train(docs.limit(0), every) is None and quality.score(docs.limit(0), None).count() == 0


def test_fits_do_not_depend_on_partitions(spark):
    """The same rows in another order and number of partitions: the same labelled sample, lexicon and scores."""
    docs = shared.table(spark, SF, "documents").where("doc_id % 4 = 0").cache()
    labels = shared.table(spark, SF, "labels")
    moved = docs.repartition(7, F.rand(3))
    words = [toxicity.train(d, labels)["words"] for d in (docs, moved)]
    assert words[0].keys() == words[1].keys() and all(words[0][k] == pytest.approx(words[1][k]) for k in words[0])
    a, b = ({r.doc_id: r.score for r in quality.score(x, quality.train(x, labels)).collect()} for x in map(quality.featured, (docs, moved)))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-3


def test_viterbi_equals_brute_force():
    """Every reading of short tokens, scored by the same costs: the decoder's is the cheapest."""
    model = toxicity.smoothed(toxicity.gram_counts(["some toxic loser is a stupid idiot and so on, total fool " * 20]).astype(float))
    read, rng = toxicity.Decoder(model), np.random.default_rng(2)

    def best(token):
        text, found = toxicity.fold(token), {}

        def go(i, context, reading, total):
            if i == len(text):
                end = total + (model[context << 5] if context & 31 else 0)
                found[reading.strip()] = min(end, found.get(reading.strip(), np.inf))
                return
            c, arcs = text[i], []
            same = i and text[i - 1] == c
            if "a" <= c <= "z":
                arcs = [(c, 0.0), *([("", toxicity.COST_REPEAT if i < 2 or text[i - 2] != c else 0.05)] if same else [])]
            elif c in toxicity.LOOKALIKES:
                arcs = [(x, toxicity.COST_LOOK) for x in toxicity.LOOKALIKES[c]] + [("", toxicity.COST_LOOK + 1.5), (" ", 3.0), *([("", 0.3)] if same else [])]
            else:
                arcs = [("", toxicity.COST_DROP), (" ", 1.0)]
            for x, extra in arcs:
                code = 0 if x in ("", " ") else ord(x) - 96
                if x == "" or code == 0 and context & 31 == 0:
                    go(i + 1, context, reading, total + extra)
                else:
                    go(i + 1, ((context << 5) | code) & 32767, reading + x, total + extra + model[(context << 5) | code])

        go(0, 0, "", 0.0)
        return found

    for _ in range(150):
        token = "".join(rng.choice(list("ltsdoe01!$*.-"), rng.integers(1, 7)))
        found = best(token)
        assert found[read(token)] == pytest.approx(min(found.values()), abs=1e-4), token


def test_restored_words_raise_the_score(spark):
    """Disguises of lexicon words score like the words; switched off, the restoring misses them."""
    rows = [(i, f"the report of the meeting number {i} " + ("what a stupid pathetic loser you are" if i % 4 == 0 else "was read and agreed on by all")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int"))
    tried = ["what a stup1d pathet!c l0ser", "what a s t u p i d one", "you p.a.t.h.e.t.i.c one", "stuuupid and looooser", "$tupid", "the report was agreed on", "meeting 2024, 12:30 - 13:45", "", None]
    got = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(tried)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert min(got[:5]) >= toxicity.THRESHOLD > max(got[5:])


def test_lexicon_by_a_plain_loop(spark):
    """Counts, likelihood ratios and weights of words and beginnings, entry by entry."""
    rng = np.random.default_rng(7)
    words = ["meeting", "report", "agreed", "reader", "idiot", "idiotic", "moron", "loser", "losers", "fine", "table"]
    rows = []
    for i in range(300):
        y = int(i % 3 == 0)
        p = np.array([1.0] * 4 + ([2.0] * 5 if y else [0.02] * 5) + [1.0] * 2)
        rows.append((" ".join(rng.choice(words, rng.integers(3, 12), p=p / p.sum())), y))
    rows += [("", 0), (None, 1)]
    model = toxicity.smoothed(toxicity.gram_counts([t for t, _ in rows if t]).astype(float))
    read, counts = toxicity.Reader(model), {}
    for text, y in rows:
        for w in read(text):
            counts.setdefault(w, [0, 0])[y] += 1
    clean, toxic = (sum(c[k] for c in counts.values()) for k in (0, 1))
    entries: dict = {}
    for w, c in counts.items():
        for e in {f"^{w}$", *(f"^{w[:k]}" for k in (4, 5, 6) if len(w) > k)}:
            have = entries.setdefault(e, [0, 0])
            have[0], have[1] = have[0] + c[0], have[1] + c[1]
    want = {}
    for e, (a, b) in entries.items():
        ea, eb = (a + b) * clean / (clean + toxic), (a + b) * toxic / (clean + toxic)
        ratio = 2 * ((a * math.log(a / ea) if a else 0) + (b * math.log(b / eb) if b else 0))
        weight = math.log((b + 0.5) / (toxic + 1)) - math.log((a + 0.5) / (clean + 1))
        if b >= toxicity.MIN_COUNT and ratio >= toxicity.MIN_RATIO and weight > 2:
            want[e] = weight
    got = toxicity.lexicon(spark.createDataFrame(rows, "text string, y int").repartition(3), model)
    assert got.keys() == want.keys() and len(want) > 3 and all(got[k] == pytest.approx(want[k]) for k in want)
