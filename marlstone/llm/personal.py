"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Fixed patterns give the base spans, which always stay. High-recall generators propose further, possibly overlapping spans
(spelled-out addresses, national telephone numbers, social security and bank account numbers). Boosted
trees over format and context features score each; a threshold calibrated on held-out samples selects
what is redacted. The trees are fitted on the driver from two labelled samples, and run as SQL expressions: candidates of a
bounded sample of the corpus, labelled by checksums and formats, and generated ones for the kinds that a corpus may lack.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import table

#: The contract's patterns. Where nothing follows a repetition it is possessive, which finds the same and needs no
#: stack; a match of a run starts at the run's first character, or where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap condition that holds wherever the pattern matches.
_NEEDS = {"email": "contains({t}, '@')", "ip": "contains({t}, '.')", "card": "true", "phone": "contains({t}, '+')"}
#: High-recall generators of further spans.
MORE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,40}\x20?[\[({<]?\x20?(?:at|@)\x20?[\])}>]?\x20?[a-z0-9-]{2,40}\x20?(?:[\[({<]\x20?dot\x20?[\])}>]|\x20dot\x20|\.)\x20?(?:com|org|net|edu|gov|io|de|fr|es|uk|info)(?![a-z0-9])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
_MORE_NEEDS = {"email": "{t} rlike '(?i)(@|[^a-z]at[^a-z]).{{1,60}}(dot|[.])'", "phone": "{t} rlike '[0-9]{{3}}[-. )]'", "ssn": "{t} rlike '[0-9]{{3}}-[0-9]{{2}}-'", "iban": "{t} rlike '[A-Z]{{2}}[0-9]{{2}}'"}
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
WINDOW = 24
#: Words near a span that speak for and against personal data.
_FOR = "(?i)(mail|contact|write|reach|address|call|phone|tel|mobile|fax|cell|ssn|social|security|iban|account|bank|name|dial|whatsapp|sms)"
_AGAINST = "(?i)(version|build|order|invoice|isbn|issue|page|chapter|total|price|code|serial|part|sku|ratio|score|line|section|figure)"


#: Elements of an array that a fold goes through at a time.
BLOCK = 128


def fold_sql(values: str, start: str, step: str, out: str, kind: str = "int") -> str:
    """SQL: an array with out for each element of an array, from the state t before it and the element y; step is the state after it, start the first.

    A fold that appends to its result copies it each time. Here blocks of elements append to results of their own, so that long arrays take
    time in proportion to their length, but for one copy of block references a block.
    """
    inner = f"aggregate(b, named_struct('t', a.t, 'o', cast(array() as array<{kind}>)), (c, y) -> transform(array(c.t), t -> named_struct('t', {step}, 'o', concat(c.o, array({out}))))[0])"
    whole = f"aggregate(bs, named_struct('t', {start}, 'o', cast(array() as array<array<{kind}>>)), (a, b) -> transform(array({inner}), r -> named_struct('t', r.t, 'o', concat(a.o, array(r.o))))[0], a -> flatten(a.o))"
    blocks = f"transform(sequence(0, (size(v) - 1) div {BLOCK}), i -> slice(v, cast(i * {BLOCK} + 1 as int), {BLOCK}))"
    return f"transform(array({values}), v -> transform(array({blocks}), bs -> {whole})[0])[0]"


def spans_sql(text: str, pattern: str, needs: str, kind: str) -> str:
    """Array of structs (k, s, e, m, l, r) of a pattern's matches in order: kind, code point span, match, text at either side."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    gaps, hits = f"split({text}, '{p}', -1)", f"regexp_extract_all({text}, '{p}', 0)"
    none = "cast(array() as array<struct<k:string,s:int,e:int,m:string,l:string,r:string>>)"
    ends = fold_sql("transform(m, (x, i) -> length(g[i]) + length(x))", "0", "t + y", "t + y")
    found = f"transform(m, (x, i) -> named_struct('k', '{kind}', 's', ends[i] - length(x), 'e', ends[i], 'm', x, 'l', right(g[i], {WINDOW}), 'r', left(g[i + 1], {WINDOW})))"
    walk = f"if(size(m) = 0, {none}, transform(array({ends}), ends -> {found})[0])"
    return f"if({needs.format(t=text)}, transform(array({hits}), m -> transform(array({gaps}), g -> {walk})[0])[0], {none})"


def free_sql(base: str, more: str) -> str:
    """SQL: the spans of more that overlap no span of base and, in the order of their starts, none that was taken before; arrays of structs with s and e, and k in more.

    One sort and three folds: the furthest end of a base span before each span, the start of the next one after it, and the end of the last span taken.
    """
    events = f"array_sort(concat(transform({base}, x -> named_struct('s', x.s, 'more', 0, 'e', x.e, 'k', x.k)), transform({more}, x -> named_struct('s', x.s, 'more', 1, 'e', x.e, 'k', x.k))))"
    before = fold_sql("ev", "0", "if(y.more = 0, greatest(t, y.e), t)", "t")
    after = f"reverse({fold_sql('reverse(ev)', '2147483647', 'if(y.more = 0, y.s, t)', 't')})"
    open_ = "filter(ev, (x, i) -> x.more = 1 and fwd[i] <= x.s and bwd[i] >= x.e)"
    taken = fold_sql("op", "0", "if(y.s >= t, y.e, t)", "if(y.s >= t, 1, 0)")
    bound = f"transform(array({events}), ev -> transform(array({before}), fwd -> transform(array({after}), bwd -> transform(array({open_}), op -> transform(array({taken}), tk -> filter(op, (x, i) -> tk[i] = 1))[0])[0])[0])[0])[0]"
    return f"if(size({more}) = 0, cast(array() as array<struct<s:int,more:int,e:int,k:string>>), {bound})"


def _luhn(digits: str) -> str:
    """SQL: the digits of the string expression pass Luhn's test."""
    value = f"cast(substring({digits}, i, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (n, i) -> n + if((length({digits}) - i) % 2 = 0, {value}, if({value} > 4, 2 * {value} - 9, 2 * {value}))) % 10 = 0"


_PASSES = {
    "email": "true",
    "ip": r"forall(split(x.m, '\\.'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255)",
    "card": f"(transform(array(regexp_replace(x.m, '[^0-9]', '')), d -> length(d) between 13 and 19 and {_luhn('d')})[0])",
    "phone": "(length(regexp_replace(x.m, '[^0-9]', '')) between 9 and 15)",
}

#: Digits of an account number's checksum, in the order of their values.
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: SQL: x.m is a bank account number whose remainder by 97 is 1.
_CHECKED = f"(x.k = 'iban' and transform(array(replace(x.m, ' ', '')), c -> aggregate(sequence(1, length(c)), 0, (n, i) -> transform(array(locate(substring(concat(substring(c, 5), left(c, 4)), i, 1), '{_ALNUM}') - 1), v -> (if(v < 10, 10, 100) * n + v) % 97)[0]))[0] = 1)"
#: A digit right before or after: the span may be a part of a longer number.
_DIGIT_BEFORE, _DIGIT_AFTER = "[0-9][ ./]?$", "^[ ./]?[0-9]"
#: Social security numbers that are never given.
_NEVER = "^(000|666|9)|-00-|-0000$"


def remainder_97(account: str) -> int:
    c = account.replace(" ", "")
    return functools.reduce(lambda n, ch: (n * (10 if ch.isdigit() else 100) + _ALNUM.index(ch)) % 97, c[4:] + c[:4], 0)


#: Features of a candidate span x: SQL, and the same in Python for fitting.
_FEATURES: list[tuple[str, object]] = [
    ("cast(length(x.m) as double)", lambda k, m, l, r: len(m)),
    ("cast(length(regexp_replace(x.m, '[^0-9]', '')) as double)", lambda k, m, l, r: len(re.sub("[^0-9]", "", m))),
    ("cast(length(regexp_replace(x.m, '[^A-Za-z]', '')) as double)", lambda k, m, l, r: len(re.sub("[^A-Za-z]", "", m))),
    ("cast(length(regexp_replace(x.m, '[^ ]', '')) as double)", lambda k, m, l, r: m.count(" ")),
    ("if(x.m rlike '[\\\\[({<]', 1.0D, 0.0D)", lambda k, m, l, r: float(bool(re.search(r"[\[({<]", m)))),
    (f"if(x.l rlike '{_FOR}', 1.0D, 0.0D)", lambda k, m, l, r: float(bool(re.search(_FOR, l)))),
    (f"if(x.l rlike '{_AGAINST}', 1.0D, 0.0D)", lambda k, m, l, r: float(bool(re.search(_AGAINST, l)))),
    ("if(x.l rlike '[:=] ?$', 1.0D, 0.0D)", lambda k, m, l, r: float(bool(re.search("[:=] ?$", l)))),
    ("if(x.m rlike '(?i)(dot|@)', 1.0D, 0.0D)", lambda k, m, l, r: float(bool(re.search("(?i)(dot|@)", m)))),
    (f"if(x.m rlike '{_NEVER}', 1.0D, 0.0D)", lambda k, m, l, r: float(bool(re.search(_NEVER, m)))),
    (f"if({_CHECKED}, 1.0D, 0.0D)", lambda k, m, l, r: float(k == "iban" and remainder_97(m) == 1)),
    (f"if(x.l rlike '{_DIGIT_BEFORE}' or x.r rlike '{_DIGIT_AFTER}', 1.0D, 0.0D)", lambda k, m, l, r: float(bool(re.search(_DIGIT_BEFORE, l) or re.search(_DIGIT_AFTER, r)))),
    *((f"if(x.k = '{kind}', 1.0D, 0.0D)", lambda k, m, l, r, kind=kind: float(k == kind)) for kind in MORE),
]


def labelled_samples(n: int = 6_000, seed: int = 3) -> list[tuple[str, str, str, str, int]]:
    """(kind, match, left, right, label) by a seeded generator: spans as the generators propose them, personal or not."""
    rng, out = random.Random(seed), []
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
    good = ["contact me: ", "mail ", "write to ", "phone: ", "call ", "tel ", "SSN ", "social security ", "IBAN: ", "bank account ", "my name is ", ""]
    bad = ["version ", "order ", "see page ", "we met ", "look ", "build ", "invoice ", "part ", "stay ", "he was ", ""]
    tld = ["com", "org", "net", "de", "fr", "io"]
    for _ in range(n):
        y, kind = int(rng.random() < 0.5), rng.choice(list(MORE))
        left = "".join(word() + " " for _ in range(2)) + rng.choice(good if rng.random() < (0.75 if y else 0.15) else bad)
        sep = rng.choice("-. ")
        if kind == "email":
            dot, at = (rng.choice([" dot ", "[dot]", "(dot)", " [dot] "]), rng.choice([" at ", "[at]", "(at)", " [at] ", " (at) "])) if y else (".", " at ")
            m = f"{word()}{at}{word()}{dot}{rng.choice(tld)}"
        elif kind == "phone":
            m = f"({digits(3)}) {digits(3)}-{digits(4)}" if rng.random() < 0.4 else sep.join([digits(3), digits(3), digits(4)])
            left = left if y else "".join(word() + " " for _ in range(2)) + rng.choice([x for x in bad if x])
        elif kind == "ssn":
            m = f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}" if y else rng.choice([f"000-{digits(2)}-{digits(4)}", f"9{digits(2)}-{digits(2)}-{digits(4)}", f"{digits(3)}-00-{digits(4)}"])
        else:
            body = digits(rng.randint(12, 20)) if y else "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123", k=rng.randint(12, 20)))
            land = rng.choice(["DE", "FR", "ES", "GB"])
            m = land + (f"{98 - remainder_97(f'{land}00{body}'):02d}" if y and rng.random() < 0.9 else digits(2)) + body
        out.append((kind, m, left[-WINDOW:], " " + word(), y))
    return out


def corpus_samples(docs: DataFrame, max_docs: int = 20_000, max_spans: int = 500) -> list[tuple[str, str, str, str, int]]:
    """(kind, match, left, right, label) of candidates in about max_docs documents, at most max_spans different ones of a kind and label.

    Labels come from what a span itself proves. Accounts: the remainder by 97. Social security numbers: ranges that are never given.
    Telephone numbers: the national part of an international one is one, a stretch of a longer number is none. Addresses: one that
    the base pattern finds is one, and stands here spelled out; plain prose around "at" is none. Candidates that prove nothing are left out.
    """
    n = docs.count()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    if n > max_docs:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "t"), F.lit(1_000_000)) < int(1_000_000 * max_docs / n))
    base = lambda k: f"filter({spans_sql('t', BASE[k], _NEEDS[k], k)}, x -> {_PASSES[k]})"
    more = lambda k: spans_sql("t", MORE[k], _MORE_NEEDS[k], k)
    row = lambda k, m, y: f"named_struct('k', '{k}', 'm', {m}, 'l', x.l, 'r', x.r, 'y', {y})"
    form = "abs(xxhash64(x.m)) % 3"
    at, dot = f"element_at(array(' at ', '[at]', ' (at) '), cast({form} as int) + 1)", f"element_at(array(' dot ', '[dot]', '(dot)'), cast({form} as int) + 1)"
    host = r"regexp_extract(x.m, '@(?:.*[.])?([^.]+)[.]([^.]+)$', {})"
    national = r"regexp_replace(x.m, '^[+][0-9]{1,3}[ .-]?', '')"
    apart = f"(x.l rlike '{_DIGIT_BEFORE}' and not x.l rlike '[+][0-9]{{1,3}}[ .-]?$' or x.r rlike '{_DIGIT_AFTER}')"
    whole = lambda k: f"y -> y.m rlike '^(?:{MORE[k]})$'".replace("\\", "\\\\")
    spelled = f"concat(substring_index(x.m, '@', 1), {at}, {host.format(1)}, {dot}, {host.format(2)})"
    parts = [
        f"filter(transform({base('email')}, x -> {row('email', spelled, 1)}), {whole('email')})",
        f"transform(filter({more('email')}, x -> not x.m rlike '(?i)[@(<{{\\\\[]|[^a-z]dot[^a-z]'), x -> {row('email', 'x.m', 0)})",
        f"filter(transform({base('phone')}, x -> {row('phone', national, 1)}), {whole('phone')})",
        f"transform(filter({more('phone')}, x -> {apart}), x -> {row('phone', 'x.m', 0)})",
        f"transform({more('ssn')}, x -> {row('ssn', 'x.m', f"if(x.m rlike '{_NEVER}', 0, 1)")})",
        f"transform({more('iban')}, x -> {row('iban', 'x.m', f'if({_CHECKED}, 1, 0)')})",
    ]
    found = rows.select(F.explode(F.expr(f"concat({', '.join(parts)})")).alias("x")).select("x.*").distinct()
    order = Window.partitionBy("k", "y").orderBy(F.xxhash64("m", "l", "r"), "m", "l", "r")
    found = found.withColumn("i", F.row_number().over(order)).where(F.col("i") <= max_spans)
    return sorted((r.k, r.m, r.l, r.r, r.y) for r in found.collect())  # at most 2 * max_spans a kind


#: The last word before a span, and the words whose weight is kept at most, each seen a few times at least.
_WORD_BEFORE, MAX_WORDS, SEEN = "([A-Za-z]+)[^A-Za-z]*$", 256, 4


def word_before(left: str) -> str:
    found = re.search(_WORD_BEFORE, left)
    return found[1].lower() if found else ""


def word_weights(rows: list) -> dict[str, float]:
    """How much likelier than in all rows a span is personal after each word, as a logarithm."""
    counts = {y: Counter(word_before(r[2]) for r in rows if r[4] == y) for y in (0, 1)}
    total = {y: sum(counts[y].values()) + 1 for y in (0, 1)}
    seen = Counter(counts[0]) + counts[1]
    words = sorted((w for w in seen if w and seen[w] >= SEEN), key=lambda w: (-seen[w], w))[:MAX_WORDS]
    return {w: float(np.log((counts[1][w] + 1) / (counts[0][w] + 1) * total[0] / total[1])) for w in words}


@functools.lru_cache(maxsize=8)
def trees(corpus: tuple = (), n_trees: int = 30, depth: int = 3, rate: float = 0.3) -> tuple[list, float, float, dict[str, float]]:
    """(trees, start, threshold, weights of words): gradient boosting of the logistic loss on generated and corpus samples.

    The threshold keeps precision at 0.95 or more on samples held out, which neither trees nor weights have seen.
    """
    rows = labelled_samples() + list(corpus)
    held = np.arange(len(rows)) % 4 == 0
    weights = word_weights([r for r, h in zip(rows, held) if not h])
    x = np.array([[*(float(f(*r[:4])) for _, f in _FEATURES), weights.get(word_before(r[2]), 0.0)] for r in rows])
    y = np.array([r[4] for r in rows], float)
    xt, yt = x[~held], y[~held]
    start = float(np.log(yt.mean() / (1 - yt.mean())))

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, d: int):
        leaf = float(-g[at].sum() / (h[at].sum() + 1.0)) * rate
        best = (1e-3, None, None)
        if d:
            for j in range(x.shape[1]):
                for cut in np.unique(np.quantile(xt[at, j], np.linspace(0.05, 0.95, 12))):
                    low = xt[at, j] <= cut
                    if 10 <= low.sum() <= len(at) - 10:
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (at[low], at[~low])) - g[at].sum() ** 2 / (h[at].sum() + 1)
                        if gain > best[0]:
                            best = (gain, j, float(cut))
        if best[1] is None:
            return leaf
        low = xt[at, best[1]] <= best[2]
        return best[1], best[2], grow(at[low], g, h, d - 1), grow(at[~low], g, h, d - 1)

    def values(tree, m: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(m), tree)
        low, out = m[:, tree[0]] <= tree[1], np.empty(len(m))
        out[low], out[~low] = values(tree[2], m[low]), values(tree[3], m[~low])
        return out

    out, score = [], np.full(len(xt), start)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        out.append(grow(np.arange(len(xt)), p - yt, p * (1 - p), depth))
        score += values(out[-1], xt)
    got = start + sum(values(t, x[held]) for t in out)
    order = np.argsort(-got)
    precision = np.cumsum(y[held][order]) / np.arange(1, held.sum() + 1)
    fine = np.flatnonzero(precision >= 0.95)
    return out, start, float(got[order][fine[-1]]) if len(fine) else float("inf"), weights


def _tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    return f"if(f[{tree[0]}] <= {tree[1]!r}D, {_tree_sql(tree[2])}, {_tree_sql(tree[3])})"


def _selected(text: str, corpus: tuple) -> str:
    """SQL: array of structs (k, s, e, ...) of the generators' spans that the trees accept."""
    grown, start, threshold, weights = trees(corpus)
    found = "flatten(array(" + ", ".join(spans_sql(text, p, _MORE_NEEDS[k], k) for k, p in MORE.items()) + "))"
    known = "map(" + ", ".join(f"'{w}', {v!r}D" for w, v in weights.items()) + ")"
    before = f"coalesce(element_at({known}, lower(regexp_extract(x.l, '{_WORD_BEFORE}', 1))), 0.0D)" if weights else "0.0D"
    features = "array(" + ", ".join([*(sql for sql, _ in _FEATURES), before]) + ")"
    score = f"transform(array({features}), f -> {start!r}D + " + " + ".join(_tree_sql(t) for t in grown) + ")[0]"
    return f"filter({found}, x -> {score} >= {threshold!r}D)"


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    Spans are in code points, end exclusive, by kind, then start. Added spans that overlap a base span, or
    an added one that starts before them and is kept, go; the time is in proportion to the number of spans. Null text counts as empty; a text without findings has the hash of the empty string
    and empty spans. Repeated rows each get a row. The trees learn from the corpus too (corpus_samples, bounded): which spans are added depends on it, base spans do not.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    for k, p in BASE.items():
        rows = rows.withColumn(f"b_{k}", F.expr(f"filter({spans_sql('t', p, _NEEDS[k], k)}, x -> {_PASSES[k]})"))
    rows = rows.withColumn("more", F.expr(_selected("t", tuple(corpus_samples(docs))))).drop("t")
    base = "concat(" + ", ".join(f"b_{k}" for k in BASE) + ")"
    text = lambda a: f"array_join(transform({a}, x -> concat(x.k, ':', x.s, ':', x.e)), ',')"
    rank = "array_position(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), x.k)"
    extra = free_sql("base", "more")
    every = f"transform(array_sort(transform(concat(transform(base, x -> struct(x.s as s, x.e as e, x.k as k)), transform({extra}, x -> struct(x.s as s, x.e as e, x.k as k))), x -> struct({rank} as o, x.s as s, x.e as e, x.k as k))), x -> struct(x.k as k, x.s as s, x.e as e))"
    rows = rows.withColumn("base", F.expr(base))
    return rows.select(
        "doc_id", *(F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.expr(text("base")).cast("binary"), 256).alias("base_sha256"), F.expr(text(every)).alias("spans"),
    )


def op7_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all of `documents`."""
    return find(table(spark, sf_dir, "documents"))
