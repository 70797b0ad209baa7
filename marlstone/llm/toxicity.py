"""Toxicity by a noisy channel: restore disguised words, then score the restored text.

1. A character 4-gram language model is counted over all documents (letters folded to a-z).
2. A token that holds look-alike symbols, inner separators or long letter runs, and a run
   of single characters set apart by one separator each, become character lattices: each
   position offers its letter, look-alikes at a cost, or deletion at a cost. Viterbi decoding
   under the language model picks the restored word.
3. A lexicon of words and word beginnings, with log-likelihood ratios from labelled rows,
   and a small logistic model over its hits score the restored text. Both are fitted on a bounded sample of
   labelled rows, chosen by a hash of their ids, so that their texts are never shuffled.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .shared import mapped, remainder, sampled, stored, table

THRESHOLD = 0.3
#: Entries need this log-likelihood ratio statistic, and this many toxic occurrences.
MIN_RATIO, MIN_COUNT = 18.0, 4
#: Look-alikes and the letters they may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
#: Channel costs in nats: a look-alike, a dropped repetition, a dropped separator.
COST_LOOK, COST_REPEAT, COST_DROP = 1.0, 0.7, 0.7
_SPACED = re.compile(r"(?:(?<=\s)|^)\S(?:[ ._*\-]{1,2}\S){2,}(?=[\s.,;:!?]|$)")
_EDGE = " \t\n\r\x0b\x0c.,;:?\"'()[]{}<>&%#~^`=/\\_-"
#: Decoration after a word: two or more of one sign.
_TAIL = re.compile(r"([^\w\s])\1+[.,;:]*$")
_ODD = re.compile(r"[0-9@$!|+€£¡*._\-]|(.)\1\1")
_FOLD = {ord("ß"): "ss", ord("æ"): "ae", ord("œ"): "oe", ord("ø"): "o"}
_BARE = {k: b for k in range(0xC0, 0x180) if (b := "".join(c for c in unicodedata.normalize("NFD", chr(k).lower()) if not unicodedata.combining(c))).isascii()} | _FOLD
_BOUND, _OTHER, _GRAMS = 0, 27, 1 << 20


def fold(word: str) -> str:
    """Lower case without accents."""
    word = word.lower()
    if word.isascii() or (word := word.translate(_BARE)).isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


_CODES = np.full(256, _OTHER, np.int64)
_CODES[list(b" \t\n\r\x0b\x0c.,;:!?\"'()-")] = _BOUND
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _CODES[ord(_c)] = _CODES[ord(_c.upper())] = _i + 1
#: Latin-1 letters by the letter under their accent.
for _base, _marked in {"a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõöø", "u": "ùúûü", "y": "ýÿ", "s": "ß"}.items():
    for _c in _marked + _marked.upper():
        if len(_c.encode("latin-1", "ignore")) == 1:
            _CODES[_c.encode("latin-1")[0]] = ord(_base) - 96


def gram_counts(texts) -> np.ndarray:
    """Counts of all 4-grams, 5 bits a letter; the table's size does not depend on the text."""
    total = np.zeros(_GRAMS, np.int64)
    for text in texts:
        if text:
            code = _CODES[np.frombuffer(f"   {text} ".encode("latin-1", "replace"), np.uint8)]
            total += np.bincount((code[:-3] << 15) | (code[1:-2] << 10) | (code[2:-1] << 5) | code[3:], minlength=_GRAMS)
    return total


def language_model(docs: DataFrame) -> np.ndarray:
    """Negative log probabilities of a letter after three, over every document, interpolated with shorter contexts."""

    def run(batches):
        total = np.zeros(_GRAMS, np.int64)
        for b in batches:
            texts = [x for x in b.column(0).to_pylist() if x]
            total += gram_counts(" ".join(texts[k : k + 500]) for k in range(0, len(texts), 500))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    counted = mapped(docs.select("text"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    total = np.zeros(_GRAMS)
    for batch in counted.toArrow().to_batches():  # at most 2 ** 20 rows
        total[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return smoothed(total)


def smoothed(counts: np.ndarray) -> np.ndarray:
    table4 = counts.reshape(32, 32, 32, 32)
    p = np.full(32, 1 / 32)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        n = table4.sum(axes) if axes else table4
        p = (n + 8 * p) / (n.sum(-1, keepdims=True) + 8)
    return -np.log(p).astype(np.float32).ravel()


class Decoder:
    """Viterbi over the character lattice of one token or spaced run."""

    def __init__(self, model: np.ndarray):
        self.cost = model

    def __call__(self, token: str) -> str:
        return self.decode(token)

    def decode(self, token: str) -> str:
        """The best reading, folded to a-z; other characters that no arc explains end a word (a space)."""
        text, cost = fold(token), self.cost
        states: dict[tuple[int, str], tuple[float, str]] = {(0, ""): (0.0, "")}  # (last three codes, last sign), cost and reading
        for i, c in enumerate(text):
            arcs: list[tuple[str, float]] = []
            if "a" <= c <= "z":
                arcs.append((c, 0.0))
                if i and text[i - 1] == c:
                    arcs.append(("", COST_REPEAT if i < 2 or text[i - 2] != c else 0.05))
            elif c in LOOKALIKES:
                arcs += [(x, COST_LOOK) for x in LOOKALIKES[c]] + [("", COST_LOOK + 1.5), (" ", 3.0)]
                if i and text[i - 1] == c:
                    arcs.append(("", 0.3))
            else:
                arcs += [("", COST_DROP), (" ", 1.0)]
            new: dict[tuple[int, str], tuple[float, str]] = {}
            for (context, last), (so_far, reading) in states.items():
                for x, extra in arcs:
                    if x == "":
                        key, total, out = (context, last), so_far + extra, reading
                    else:
                        code = 0 if x == " " else ord(x) - 96
                        if code == 0 and context & 31 == 0:
                            key, total, out = (context, last), so_far + extra, reading
                        else:
                            key, total, out = (((context << 5) | code) & 32767, x), so_far + extra + cost[(context << 5) | code], reading + x
                    old = new.get(key)
                    if old is None or total < old[0]:
                        new[key] = (total, out)
            states = new  # at most as many as the last three positions can be read
        return min(((t + (cost[k[0] << 5] if k[0] & 31 else 0), out) for k, (t, out) in states.items()), default=(0, ""))[1].strip()


#: Bytes of tokens whose readings a task keeps, about, with what the table itself takes for each.
KEPT_BYTES, ENTRY_BYTES = 40_000_000, 250


def _tells(run: str) -> bool:
    """Whether a spaced run holds two different letters or look-alikes: lines of one sign say nothing."""
    return len({c for c in run if c.isalpha() or c in LOOKALIKES and c not in "!|+*"}) > 1


class Reader:
    """Distinct folded words of a restored text. What a token reads as is kept, up to a bound, since tokens recur."""

    def __init__(self, model: np.ndarray):
        self.decoder = Decoder(model)
        self.kept: dict[str, tuple] = {}
        self.held = 0

    def token(self, token: str) -> tuple[str, ...]:
        word = (token if token[-1].isalnum() else _TAIL.sub("", token)).strip(_EDGE)
        if not word:
            return ()
        read = tuple(self.decoder(word).split()) if _ODD.search(word) else (word if word.isascii() else fold(word),)
        if "(" in token and ")" not in token and (open_ := token.strip(_EDGE.replace("(", ""))) != word:
            read += tuple(self.decoder(open_).split())  # a bracket that nothing closes may stand for a c
        return read

    def of(self, token: str) -> tuple:
        """What is kept for a token; subclasses keep something else for its words."""
        return self.token(token)

    def of_run(self, run: str) -> tuple:
        return tuple(self.decoder(run).split())

    def __call__(self, text: str | None) -> set:
        """Null and empty texts have no words."""
        out: set = set()
        if not text:
            return out
        low, kept = text.lower(), self.kept
        if self.held > KEPT_BYTES:
            kept.clear()
            self.held = 0
        for token in set(low.split()):
            got = kept.get(token)
            if got is None:
                got = kept[token] = self.of(token)
                self.held += 2 * len(token) + ENTRY_BYTES
            if got:
                out.update(got)
        for m in _SPACED.finditer(low):
            if _tells(m[0]):
                out.update(self.of_run(m[0].strip()))
        return out


def restored(text: str | None, decoder: Decoder) -> str:
    """The text in lower case with disguised tokens and spaced runs replaced by their readings."""
    low = _SPACED.sub(lambda m: decoder(m[0].strip()) if _tells(m[0]) else m[0], (text or "").lower())
    return re.sub(r"\S+", lambda m: decoder(w) if _ODD.search(w := m[0].strip(_EDGE)) and any(c.isalpha() for c in w) else m[0], low)


def _entries(word: str) -> list[str]:
    return ["^" + word + "$", *("^" + word[:k] for k in (4, 5, 6) if len(word) > k)]


def lexicon(rows: DataFrame, model: np.ndarray) -> dict[str, float]:
    """Words and beginnings that toxic rows hold far more often; rows: text and y of the sample."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        read, counts = Reader(held.value), ({}, {})
        def found():
            every = [(w, n, counts[1].get(w, 0)) for w, n in counts[0].items()] + [(w, 0, n) for w, n in counts[1].items() if w not in counts[0]]
            counts[0].clear(), counts[1].clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in every], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], ["word", "clean", "toxic"])
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                side = counts[1 if y == 1 else 0]
                for w in read(text):
                    side[w] = side.get(w, 0) + 1
                if len(counts[0]) + len(counts[1]) > 200_000:
                    yield found()
        yield found()

    words = stored(mapped(rows, run, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "words")
    w = F.col("word")
    parts = F.array_union(F.array(F.concat(F.lit("^"), w, F.lit("$"))), F.filter(F.transform(F.array(*map(F.lit, (4, 5, 6))), lambda k: F.when(F.length(w) > k, F.concat(F.lit("^"), F.substring(w, F.lit(1), k)))), lambda x: x.isNotNull()))
    n_clean, n_toxic = (int(x or 0) for x in words.agg(F.sum("clean"), F.sum("toxic")).first())
    if not n_toxic or not n_clean:
        return {}
    entries = words.select(F.explode(parts).alias("entry"), "clean", "toxic").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= MIN_COUNT)
    e0, e1 = (F.col("clean") + F.col("toxic")) * (n_clean / (n_clean + n_toxic)), (F.col("clean") + F.col("toxic")) * (n_toxic / (n_clean + n_toxic))
    term = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
    ratio = 2 * (term(F.col("clean"), e0) + term(F.col("toxic"), e1))
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    best = entries.select("entry", ratio.alias("ratio"), weight.alias("weight")).where((F.col("ratio") >= MIN_RATIO) & (F.col("weight") > 2.0))
    return {r.entry: float(r.weight) for r in best.collect()}  # words of a sample of bounded size, MIN_COUNT toxic texts each


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> tuple[DataFrame, float]:
    """(text, y) of about max_toxic and max_clean labelled documents, chosen by a hash of their ids, equal texts once; and the share of label 1.

    A document with several labels counts as toxic if any is 1. Only ids and hashes of texts are shuffled.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("y"))
    n, ones = known.agg(F.count("*"), F.sum("y")).first()
    ones = ones or 0
    keep = lambda bound, of: sampled(F.col("_id"), min(1.0, bound / of) if of else 0.0)
    ids = known.where(((F.col("y") == 1) & keep(max_toxic, ones)) | ((F.col("y") == 0) & keep(max_clean, n - ones)))
    texts = docs.select("doc_id", "text")
    hashes = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "y", F.xxhash64("text").alias("h"))
    picked = stored(hashes.groupBy("h").agg(F.min("doc_id").alias("_id"), F.max("y").alias("y")), "picked").select("_id", "y")
    return texts.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", "y"), ones / n if n else 0.0


class Scorer(Reader):
    """Lexicon hits of a text, as four numbers."""

    def __init__(self, model: np.ndarray, words: dict[str, float]):
        super().__init__(model)
        self.words, self.heads = words, {e[1:5].removesuffix("$") for e in words}

    def _hits(self, words) -> tuple:
        found = ((w, max((self.words.get(e, 0.0) for e in _entries(w)), default=0.0)) for w in words if w[:4] in self.heads)
        return tuple(x for x in found if x[1])

    def of(self, token: str) -> tuple:
        return self._hits(self.token(token))

    def of_run(self, run: str) -> tuple:
        return self._hits(self.decoder(run).split())

    def features(self, text: str | None) -> list[float]:
        hits = sorted((weight for _, weight in self(text)), reverse=True)
        return [hits[0] if hits else 0.0, hits[1] if len(hits) > 1 else 0.0, float(np.log1p(sum(hits))), float(np.log1p(len(hits)))]


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, share: float, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights and intercept on rows that count n times; both classes are weighted to the share of label 1 among all labels."""
    ones = (n * y).sum() / n.sum()
    if 0 < ones < 1 and 0 < share < 1:
        n = n * np.where(y == 1, share / ones, (1 - share) / (1 - ones))
    design, theta = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(design @ theta).clip(-30, 30)))
        step = np.linalg.solve((design * (n * p * (1 - p) + 1e-6)[:, None]).T @ design + ridge * np.eye(len(theta)), design.T @ (n * (p - y)) + ridge * theta)
        theta = theta - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return theta


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, max_toxic: int = 20_000, max_clean: int = 40_000) -> dict:
    """Language model over all of corpus (default: docs); lexicon and logistic model on about max_toxic and max_clean labelled rows.

    Without labels of both classes, or without words that tell them apart, the lexicon is empty and every score is 0.0: nothing speaks against any text.
    """
    model = language_model(docs if corpus is None else corpus)
    rows, share = sample(docs, labels, max_toxic, max_clean)
    words = lexicon(rows, model)
    out = {"lm": model, "words": words, "theta": None}
    if words:
        held = docs.sparkSession.sparkContext.broadcast((model, words))

        def run(batches):
            scorer = Scorer(*held.value)
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([scorer.features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], ["x", "y"])

        # rows with the same features count together: few numbers, whatever the sample
        got = mapped(rows, run, "x array<double>, y int").groupBy("x", "y").agg(F.count("*").alias("n")).collect()
        if got:
            out["theta"] = _logistic(np.array([r.x for r in got]), np.array([float(r.y) for r in got]), np.array([float(r.n) for r in got]), share)
    return out


def judged(docs: DataFrame, model: dict, name: str = "toxicity_score") -> DataFrame:
    """docs with all its columns and, last, the score (0 to 1) of the whole text under a name that no column may have; null and empty texts have no hits; repeated rows each get a row."""
    if name in docs.columns:
        raise ValueError(f"a column {name} is there already")
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        m = held.value
        scorer = Scorer(m["lm"], m["words"])
        for b in batches:
            x = np.array([scorer.features(t) for t in b.column(at).to_pylist()], dtype=float).reshape(-1, 4)
            p = np.zeros(len(x)) if m["theta"] is None else 1 / (1 + np.exp(-(x @ m["theta"][:-1] + m["theta"][-1]).clip(-30, 30)))
            yield b.append_column(name, pa.array(p))

    return mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every whole text.

    Texts that are null or empty have no hits and score the least; other columns are not read; an empty table gives an empty result.
    """
    return judged(docs.select("doc_id", "text"), model, "score").drop("text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of rows with remainder 2 modulo 4 are never read by the fit."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = lambda df: df.where(remainder(F.col("doc_id"), 4) != 2)
    out = score(docs, train(learn(docs), learn(labels), docs))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
