"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two second-order character models, of random strings and of ordinary identifiers, are each an even mixture of a model of a
labelled sample that a generator makes and of one of the corpus itself: the values of all secrets that the fixed patterns find, and
all distinct words of letters. So what the corpus tells never weighs more than half, however large it is. A token whose mean
log-likelihood ratio per character favours the random model by more than a threshold is a secret, whatever its prefix; the threshold
is where no more than MOST_WRONG of a further sample of ordinary identifiers would be taken for one.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import mapped, table

#: Kinds in the order of the contract; "random" spans are those that only the models find.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as of [0-9a-f]+ with 24 or more
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
#: What the generated sample counts in the corpus's model: after two characters that the corpus seldom holds, its shares stand.
UNSEEN = 50.0
_CODE = {c: i + 1 for i, c in enumerate(_ALPHABET)}
_SIZE = len(_ALPHABET) + 2
#: Least threshold on the mean ratio in nats a character, threshold on the total, and share of ordinary identifiers that may pass both.
MIN_MEAN, MIN_TOTAL, MOST_WRONG = 0.3, 16.0, 0.001
#: Ordinary words that identifiers are made of, for the labelled sample.
_WORDS = """access account action active add address alias all any api app apply array async auth back base batch begin block body bool buffer build
byte cache call cancel cell change char check child class clean clear client clock close cluster code collect color column command commit config
connect content context copy core count create current cursor data date day debug decode default define delete depth device dir disk document
domain done draw drop edit element empty enable encode end entry error event exec exit export factory fetch field file filter find first flag
float flush folder format frame from function get global graph group handle hash header height hidden host http id image import index info init
input insert int item iterator job join key kind label last layer layout left length level library limit line link list load local lock log loop
main make manager map mask master match max memory merge message meta method min mode model module name network next node null number object
offset open option order output package page pair param parent parse part path pattern pool port position prefix print process project
property proxy query queue random range rank rate read ready record region remote remove report request reset result return right root row
run sample scale scan schema score search section select send server service session set shape shared size sort source space span start state
status stop store stream string style sum sync system table tag target task test text thread time title total trace transform tree type
unit update upload url user util value vector version view visit wait width window word work write""".split()


def labelled_samples(n: int = 6_000, seed: int = 11) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers) by a seeded generator; the same on each run."""
    rng = random.Random(seed)
    sets = ["abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", _ALPHABET[:62], _ALPHABET[:62] + "+/", _ALPHABET[:62] + "-_"]
    secret = ["".join(rng.choices(rng.choice(sets), k=rng.randint(20, 64))) for _ in range(n)]
    joiners = [lambda w: "_".join(w), lambda w: "-".join(w), lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "".join(x.title() for x in w), lambda w: "".join(w), lambda w: "/".join(w), lambda w: "_".join(w).upper()]
    plain = []
    for _ in range(n):
        w = rng.choices(_WORDS, k=rng.randint(2, 7))
        plain.append(rng.choice(joiners)(w) + (str(rng.randint(0, 9999)) if rng.random() < 0.15 else ""))
    return secret, plain


def trigrams(samples) -> np.ndarray:
    """Counts of a character after two, by their codes; 0 stands before each sample."""
    counts = np.zeros((_SIZE,) * 3)
    for s in samples:
        c = [0, 0, *(_CODE.get(x, _SIZE - 1) for x in s)]
        np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    return counts


def _shares(counts: np.ndarray, strength: float = 4.0) -> np.ndarray:
    """Second-order character model of trigram counts, interpolated with lower orders."""
    p = np.full(_SIZE, 1 / _SIZE)
    for n in (counts.sum((0, 1)), counts.sum(0), counts):
        p = (n + strength * p) / (n.sum(-1, keepdims=True) + strength)
    return p


class Model:
    """ratios: log-likelihood ratios of a character after two, random over ordinary. threshold: of the mean ratio. recall: share of a further sample of random strings that pass."""

    def __init__(self, random_counts: np.ndarray | None = None, ordinary_counts: np.ndarray | None = None):
        sides = []
        for sample, corpus in zip(labelled_samples(), (random_counts, ordinary_counts)):
            own = _shares(trigrams(sample))
            if corpus is not None:
                own = (own + (corpus + UNSEEN * own) / (corpus.sum(-1, keepdims=True) + UNSEEN)) / 2
            sides.append(own)
        self.ratios = np.log(sides[0]) - np.log(sides[1])
        secret, plain = ([(t, ratio(t, self.ratios)) for t in side if len(t) >= 20] for side in labelled_samples(2_000, 12))
        means = np.array([r / len(t) for t, r in plain if r >= MIN_TOTAL] + [MIN_MEAN] * sum(r < MIN_TOTAL for _, r in plain))
        self.threshold = max(MIN_MEAN, float(np.nextafter(np.quantile(means, 1 - MOST_WRONG, method="higher"), np.inf)))
        self.recall = sum(self.random(t) for t, _ in secret) / len(secret)

    def random(self, token: str) -> bool:
        got = ratio(token, self.ratios)
        return got >= MIN_TOTAL and got / len(token) >= self.threshold


def ratio(token: str, table: np.ndarray) -> float:
    """Sum of the log-likelihood ratios of a token's characters."""
    c = np.array([0, 0, *(_CODE.get(x, _SIZE - 1) for x in token)])
    return float(table[c[:-2], c[1:-1], c[2:]].sum())


def _counted(words: DataFrame) -> np.ndarray:
    """Trigram counts of a column of words of ASCII characters."""

    def run(batches):
        total = np.zeros(_SIZE**3)
        for b in batches:
            codes = np.full(256, _SIZE - 1, np.int64)
            codes[[ord(c) for c in _ALPHABET]] = [_CODE[c] for c in _ALPHABET]
            codes[0] = 0
            code = codes[np.frombuffer("".join(f"\0\0{w}" for w in b.column(0).to_pylist()).encode("ascii"), np.uint8)]
            code = (code[:-2] * _SIZE + code[1:-1]) * _SIZE + code[2:]
            total += np.bincount(code[code % _SIZE > 0], minlength=_SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["gram", "n"])

    total = np.zeros(_SIZE**3)
    for batch in mapped(words, run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow().to_batches():  # at most 70 ** 3 rows
        total[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return total.reshape((_SIZE,) * 3)


def ordinary(docs: DataFrame) -> np.ndarray:
    """Trigram counts of the distinct words of letters only, of 4 or more, of all documents."""
    words = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+")).alias("w")).where("w rlike '^[A-Za-z]{4,}$'").distinct()
    return _counted(words)


def known(docs: DataFrame) -> np.ndarray:
    """Trigram counts of the distinct values of secrets that the fixed patterns find in all documents."""

    def run(batches):
        for b in batches:
            found = {v for text in b.column(0).to_pylist() if text for v in _values(text)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["w"])

    return _counted(mapped(docs.select("text"), run, "w string").distinct())


def _values(text: str):
    """What base spans hold: of an assignment the value alone, if it is as long as a token and not a word."""
    for kind, s, e in base_spans(text):
        value = _ASSIGN.match(text, s, e)[1] if kind == "assign" else text[s:e]
        if len(value) >= 16 and not value.isalpha():
            yield value


def model(docs: DataFrame) -> Model:
    return Model(known(docs), ordinary(docs))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three fixed kinds; matches that fail their condition go without another try."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low or not text.isascii():
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def added_spans(text: str, base: list[tuple[str, int, int]], found: Model) -> list[tuple[str, int, int]]:
    """Tokens that the models call random and that overlap no base span."""
    out = []
    taken = sorted((s, e) for _, s, e in base)
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        core = m[0].strip("-_=/+")
        if len(core) < 20 or core.isalpha() and (core.islower() or core.istitle()) or core.isdigit():
            continue
        at = bisect.bisect_left(taken, (e, 0))
        if any(x < e and s < y for x, y in taken[max(0, at - 3) : at]):
            continue
        if found.random(m[0]):
            out.append(("random", s, e))
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def scan(docs: DataFrame, trained: Model | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are in code points, end exclusive. Null text counts as empty; a text without findings has the
    hash of the empty string and empty spans. Repeated rows each get a row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(trained or model(docs))

    def run(batches):
        extra = held.value
        for b in batches:
            rows: list[tuple] = []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                spans = base + added_spans(text or "", base, extra)
                n = [sum(k == x for k, _, _ in base) for x in KINDS[:3]]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the same columns, secrets in text replaced by [SECRET]."""
    schema, at = docs.schema, docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model(docs))

    def run(batches):
        for b in batches:
            texts = []
            for text in b.column(at).to_pylist():
                base = base_spans(text or "")
                clean, end = [], 0
                for _, s, e in sorted(base + added_spans(text or "", base, held.value), key=lambda x: x[1:]):
                    if s >= end:
                        clean += [text[end:s], "[SECRET]"]
                    end = max(end, e)
                texts.append(text if not clean else "".join([*clean, text[end:]]))
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return mapped(docs, run, schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all of `documents`."""
    return scan(table(spark, sf_dir, "documents"))
