"""Branch merge, periodic runs and long repeats against plain brute force, on awkward and on random tables."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from marlstone.llm import branches, periodic, repeats

SCHEMA = "doc_id long, text string, lang string, source string, id string, row_key long, unit string, h long, tie long, runs int"
LONG = " ".join(str(i * i % 977) for i in range(20_000))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, "x", 1, "y", 2, 3, 4) for i, t, lang, src in rows], SCHEMA)


AWKWARD = [
    (1, "a\nb\n\nc", "en", "s"), (2, None, None, None), (3, "", "", ""), (4, "x", "en", "t"), (4, "y\nz", "de", "t"), (5, LONG, "en", "s"), (5, LONG, "en", "s"), (None, "no id\nat all", "fr", "s"), (None, None, None, None), (6, "\n" * 3_000, "en", None),
]


# --- merge


def code(branch, i, name):
    return zlib.crc32(f"{branch}:{'' if i is None else i}:{name}".encode()) % 17


def merged(rows):
    """The contract, document by document."""
    out = []
    added = {"L": {}, "R": {}}
    for i, text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        ops = {}
        for b, first in (("L", -1), ("R", -5)):
            o = ops[b] = {}
            row = code(b, i, "row")
            if row in (3, 4) and i is not None:
                new = ("!?"[row - 3], lang, source)
                added[b][first - i] = min(new, added[b].get(first - i, new))
            o["row"] = row == 0
            for name, v in (("lang", lang), ("source", source)):
                new = {0: "", 1: v + "!", 2: v + "?"}.get(code(b, i, name), v)
                if new != v:
                    o[name] = new
            for n, _ in enumerate(text.split("\n")):
                c = code(b, i, n)
                if c <= 2:
                    o["line", n] = c
                elif c <= 4:
                    o["gap", n] = c
        left, right = ops["L"], ops["R"]
        ld, rd = left.pop("row"), right.pop("row")
        n = Counter()
        state = {**right, **left}
        if ld or rd:
            fought = (ld and not rd and right) or (rd and not ld and left)
            n["n_edit_delete" if fought else "n_clean"] += 1
            state = left
            if ld or not left:
                out.append((i, None, None, None, n["n_clean"], 0, n["n_edit_delete"], 0))
                continue
        else:
            for u in state:
                if u not in left or u not in right or left[u] == right[u]:
                    n["n_clean"] += 1
                elif u[0] == "gap":
                    n["n_insert_insert"] += 1
                elif u[0] == "line" and 0 in (left[u], right[u]):
                    n["n_edit_delete"] += 1
                else:
                    n["n_edit_edit"] += 1
        lines = []
        for k, old in enumerate(text.split("\n")):
            op = state.get(("line", k))
            if op != 0:
                lines.append(old + {None: "", 1: "!", 2: "?"}[op])
            if ("gap", k) in state:
                lines.append("!?"[state["gap", k] - 3])
        out.append((i, state.get("lang", lang), state.get("source", source), "\n".join(lines), n["n_clean"], n["n_edit_edit"], n["n_edit_delete"], n["n_insert_insert"]))
    for i in {*added["L"], *added["R"]}:
        a, b = added["L"].get(i), added["R"].get(i)
        text, lang, source = a or b
        fight = a is not None and b is not None and a != b
        out.append((i, lang, source, text, int(not fight), 0, 0, int(fight)))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "lang", "source", "text", "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert").collect())


def test_merge_of_awkward_rows(spark):
    assert got(branches.merge(frame(spark, AWKWARD))) == merged(AWKWARD)
    assert got(branches.merge(frame(spark, []))) == Counter()


def test_merge_of_many_small_documents(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "\n".join(rng.choice(["a", "", "b c"]) for _ in range(rng.randint(1, 40)))]), rng.choice(["en", None, ""]), rng.choice("st")) for i in range(-20, 900)]
    want = merged(rows)
    assert got(branches.merge(frame(spark, rows))) == want
    kinds = [sum(r[k] * n for r, n in want.items()) for k in (4, 5, 6, 7)]
    assert min(kinds) > 0 and any(r[3] is None for r in want)  # every class of pair occurs, and absent rows


def test_logs_hold_changes_only(spark):
    base = branches.prepared(frame(spark, AWKWARD))
    log = branches.edit_log(base, "L").collect()
    assert {r.action for r in log} <= {"drop", "edit", "insert"} and all(code("L", r.id or None, r.pos if r.pos >= 0 else r.unit) <= 4 for r in log)
    assert len(log) == len({(r.id, r.row_key, r.unit, r.pos) for r in log})


# --- runs


def brute_runs(words, least=24, periods=3):
    """Every maximal stretch of every period, with the smallest period of each."""
    n, best = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, periods * q):
                best.setdefault((i, length), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in best.items()), key=lambda r: (r[0], r[2]))


def periodic_text(rng):
    """Words with nested, touching and overlapping runs."""
    words = []
    for _ in range(rng.randint(1, 5)):
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        words += (unit * 12)[: rng.randint(1, len(unit) * 7)]
        words += [rng.choice("abcdefgh") for _ in range(rng.choice([0, 0, 1, 9]))]
    return words


def test_runs_are_all_found():
    rng = random.Random(3)
    texts = [periodic_text(rng) for _ in range(400)] + [[], ["a"], ["a"] * 23, ["a"] * 24, ["a", "b"] * 12, ["a"] * 5_000, list("abaab" * 100), [str(i) for i in range(500)] * 3]
    found = periodic.runs_of([[w.encode() for w in t] for t in texts])
    assert [[tuple(r) for r in rs] for rs in found] == [brute_runs(t) for t in texts]
    assert sum(map(len, found)) > 300


@pytest.mark.parametrize("least,periods", [(6, 2), (4, 4), (12, 3)])
def test_runs_of_other_sizes(least, periods):
    rng = random.Random(least)
    texts = [periodic_text(rng) for _ in range(150)]
    found = periodic.runs_of([[w.encode() for w in t] for t in texts], least, periods)
    assert [[tuple(r) for r in rs] for rs in found] == [brute_runs(t, least, periods) for t in texts]


def test_chunks_do_not_change_runs(monkeypatch):
    rng = random.Random(8)
    texts = [[w.encode() for w in periodic_text(rng)] for _ in range(60)]
    want = periodic.runs_of(texts)
    monkeypatch.setattr(periodic, "CHUNK_WORDS", 50)
    assert periodic.runs_of(texts) == want


def test_least_overlap_masks_no_run():
    """Each word of a run lies in a repeated k-gram: masked documents have the runs of whole ones."""
    assert periodic.least_overlap() == 16 and periodic.least_overlap(6, 2) == 3
    words = np.array([0] * 24 + list(range(1, 60)))
    lo, hi = periodic.surviving(words, np.array([0, len(words)]), 16, 24)
    assert lo.tolist() == [0] and hi.tolist() == [24]


def test_digest_of_runs(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(periodic_text(rng)), "en", "s") for i in range(300)] + [(7, None, None, None), (7, "", "en", "s"), (None, "a " * 40, "en", "s"), (8, "one\x0btwo three four  ", "en", "s"), (9, LONG, "en", "s"), (9, LONG, "en", "s")]
    want = []
    for i, text, _, _ in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
        runs = brute_runs(words)
        gone = {j for s, length, q in runs for j in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        want.append((i, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    out = periodic.digest(periodic.periodic_runs(periodic.with_planted_runs(frame(spark, rows))))
    assert Counter(tuple(r) for r in out.collect()) == Counter(want)
    assert periodic.digest(periodic.periodic_runs(frame(spark, []))).count() == 0


# --- repeats


def covered(texts):
    """Per text, in this order: bytes that a string of 100 covers which starts earlier."""
    seen, out = set(), []
    for data in texts:
        hit = bytearray(len(data))
        for i in range(len(data) - 99):
            g = data[i : i + 100]
            if g in seen:
                hit[i : i + 100] = b"\1" * 100
            seen.add(g)
        out.append(bytes(hit))
    return out


def wanted(rows, hashes):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    texts = [(t or "").encode() for _, t, *_ in order]
    out = []
    for (i, *_), data, hit in zip(order, texts, covered(texts)):
        kept = bytes(b for b, h in zip(data, hit) if not h)
        spans = tuple((m[0], m[1]) for m in _stretches(hit))
        out.append((i, len(data), spans, kept))
    return Counter(out)


def _stretches(hit):
    at = 0
    while (at := hit.find(1, at)) >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        yield at, end
        at = end


def found(df):
    return Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in df.collect())


def hashes_of(spark, rows):
    return {r.text: r.h for r in spark.createDataFrame([(t,) for _, t, *_ in rows], "text string").selectExpr("text", "xxhash64(text) as h").collect()}


def pasted(rng, n, size=6):
    """Texts that share passages of all lengths about 100 bytes, some over many bytes a letter, some periodic."""
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(60, 260))) for _ in range(size)] + ["ab" * 150, "z" * 400, "ש" * 130]
    out = []
    for i in range(n):
        parts = [rng.choice([lambda: (p := rng.choice(passages))[rng.randint(0, 30) :][: rng.randint(90, 240)], lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 120)))])() for _ in range(rng.randint(0, 6))]
        out.append((i // 2 if i % 10 == 0 else i, "".join(parts), "en", "s"))
    return out


def test_repeats_of_awkward_rows(spark):
    rows = [*AWKWARD, (7, "q" * 99, "en", "s"), (8, "q" * 100, "en", "s"), (9, "q" * 100, "en", "s"), (10, "q" * 101, "en", "s"), (-3, "q" * 100, "en", "s")]
    assert found(repeats.long_repeats(frame(spark, rows))) == wanted(rows, hashes_of(spark, rows))
    assert found(repeats.long_repeats(frame(spark, []))) == Counter()


@pytest.mark.parametrize("hot", [repeats.HOT, 5])
def test_repeats_of_pasted_texts(spark, hot):
    """With a small limit most anchors are hot and go by their strings; the result is the same."""
    rng = random.Random(2)
    rows = pasted(rng, 160)
    out = found(repeats.long_repeats(frame(spark, rows).repartition(5), hot))
    assert out == wanted(rows, hashes_of(spark, rows))
    assert sum(len(r[2]) for r in out) > 50


def test_repeats_across_chunks_and_index_parts(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, t, "en", "s") for i, (_, t, *_) in enumerate(pasted(rng, 120))]
    texts = [t.encode() for _, t, *_ in rows]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def strings(chunk):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        return {(int(s), int(a)) for _, _, at, b, e in repeats.anchors(data, starts) for a, x, y in zip(at, b, e) for s in range(x, y + 1)}

    whole = strings(1 << 18)
    assert strings(37) == strings(1000) == whole
    assert {s for s, _ in whole} == {s for i, t in enumerate(texts) for s in range(starts[i], starts[i] + len(t) - 99)}
    assert all(s <= a <= s + repeats.SIDE for s, a in whole)


def test_run_index_orders_columns():
    """Each step's order and shared bytes are those of sorting the rows by all that follows the column."""
    rng = np.random.default_rng(1)
    group = np.sort(rng.integers(0, 6, 200))
    left, right = (rng.integers(0, 2, (200, repeats.SIDE)).astype(np.uint8) for _ in range(2))
    left[:, 3:] = right[:, 2:] = 0
    index = repeats.RunIndex(group, left, right)
    for u in range(8):
        key = [(int(group[i]), bytes(left[i, :u][::-1]), bytes(right[i])) for i in index.order]
        assert key == sorted(key)
        for i in range(1, 200):
            same = next((j for j in range(repeats.SIDE) if key[i][2][j] != key[i - 1][2][j]), repeats.SIDE)
            assert index.shared[i] == (same if key[i][:2] == key[i - 1][:2] else -1)
        index.step(u)
