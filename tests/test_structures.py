"""Automata, rule indexes, hash trees, interval bins, word indexes and stored facts against plain brute force."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import SparkSession, functions as F

from marlstone import sinks
from marlstone.operators import automaton, catalogues, code_graph, intervals, merkle, phrases, pyast, rules
from marlstone.plans import catalogue, code
from marlstone.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


TEXTS = [(1, "abcab"), (1, "abcab"), (2, ""), (3, None), (None, "xabc"), (4, "ß Éa\nİabc" * 50)]
PATTERNS = [(1, "abc"), (2, "abc"), (3, ""), (4, None), (5, "b"), (6, "nowhere"), (7, "Éa\nİ"), (8, "abcab")]


@pytest.mark.parametrize("limit", [(4_000_000, 200_000), (6, 200_000), (4_000_000, 2)])
def test_contained_in_one_pass_and_in_several(spark, limit):
    texts, patterns = spark.createDataFrame(TEXTS, "k long, text string"), spark.createDataFrame(PATTERNS, "p int, text string")
    got = sorted(map(tuple, automaton.contained(texts, patterns, "k", "p", *limit).collect()), key=str)
    assert got == sorted(((k, p, len(x)) for k, t in TEXTS for p, x in PATTERNS if t is not None and x is not None and x in t), key=str)
    assert automaton.contained(texts, patterns.limit(0), "k", "p").count() == 0 == automaton.contained(texts.limit(0), patterns, "k", "p").count()


def test_required_strings():
    want = {
        "error": {"error"}, "(foo|barbar)x?": {"foo", "barbar"}, "[a-z]+": None, "a?bcd": {"bcd"}, "(?i)PassWord\\s*=": {"password"}, "x{2,3}longer": {"longer"}, "(a|b*)": None, "ab((": {"ab(("},
        "(?:http|ftp)://[^ ]+": {"://"}, "(?=abc)d": {"d"}, "": None, "a(?!longword)b": {"a"}, "^\\d{3}-tel$": {"-tel"},
    }
    for pattern, strings in want.items():
        got = automaton.required(pattern)
        assert got == strings or (got and strings and min(map(len, got)) == min(map(len, strings))), pattern


def _first_hits(texts, listed):
    """What the first rule of each line and target is, by trying all."""
    out = []
    for k, text in texts:
        for n, line in enumerate((text or "").split("\n"), 1):
            seen = set()
            for target, p in listed:
                try:
                    hit = re.search(p, line, re.A)
                except re.error:
                    hit = p in line
                if hit and target not in seen:
                    seen.add(target)
                    out.append((k, n, target, p))
    return sorted(out, key=str)


def test_five_thousand_rules(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(400)]
    listed = []
    for i in range(5_000):
        a, b = rng.choice(words), rng.choice(words)
        listed.append((f"t{i % 7}", rng.choice([f"{a} {b}", f"(?i){a.upper()}[ -]+{b}", f"{a}({b}|{b}s)", f"{a}+\\d", f"{a} {b}(("])))
    listed.insert(17, ("t9", "[0-9]{3}"))
    texts = [(i, "\n".join(" ".join(rng.choice([rng.choice(words), str(rng.randint(0, 2_000))]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 12)))) for i in range(25)] + [(98, None), (99, "İ" * 3 + words[0] + "7 123\r\n" + words[1])]
    got = rules.hits(spark.createDataFrame(texts, "path long, text string"), listed)
    assert sorted(((r.path, r.lineno, r.target, r.pattern) for r in got.collect()), key=str) == _first_hits(texts, listed)


def test_few_rules_and_their_context(spark):
    listed = [("a", "fox"), ("a", "f.x"), ("b", "(("), ("b", "[0-9]+"), ("c", "^$")]
    texts = [("p", "a fox\nfix 12 ((\n\nlast"), ("q", ""), ("r", None)]
    got = rules.hits(spark.createDataFrame(texts, "path string, text string"), listed, around=1).collect()
    assert sorted((r.path, r.lineno, r.target, r.pattern) for r in got) == _first_hits(texts, listed)
    assert {r.context for r in got if r.lineno == 2} == {"  a fox\n> fix 12 ((\n  "}
    with pytest.raises(ValueError):
        rules.hits(spark.createDataFrame(texts, "path string, text string"), [("a", "b")] * (rules.MOST_RULES + 1))


def _root(rows):
    """The root of one group's rows (key, hash), level by level."""
    level = {k: hashlib.sha256(f"{k}:{h or 'missing'}".encode()).hexdigest() for k, h in rows}
    for _ in range(12):
        nodes: dict = {}
        for k in sorted(level):
            nodes.setdefault(k >> 6, []).append(level[k])
        level = {k: v[0] if len(v) == 1 else hashlib.sha256("|".join(v).encode()).hexdigest() for k, v in nodes.items()}
    assert len(level) == 1
    return next(iter(level.values()))


def test_hash_trees(spark):
    rng = random.Random(2)
    one = {(g, k): rng.choice(["x", "y", None]) for g in ("a", "b", None) for k in rng.sample(range(300_000), 200)} | {("c", 5): None, ("c", 70): None, ("d", 0): "z"}
    two = {x: h for x, h in one.items() if rng.random() > 0.01} | {("b", 299_999): "new", ("e", 3): "e"}
    for x in rng.sample(sorted(two, key=str), 5):
        two[x] = "changed"
    del two["d", 0]
    frame = lambda rows: spark.createDataFrame([(g, k, h) for (g, k), h in rows.items()], "g string, k long, h string")
    a, b = frame(one), frame(two)
    got = {r.group: r.hash for r in merkle.roots(merkle.tree(a, "g", "k", "h")).collect()}
    assert got == {g: None if all(h is None for (x, _), h in one.items() if x == g) else _root([(k, h) for (x, k), h in one.items() if x == g]) for g in {x for x, _ in one}}
    changes = {(r.g, r.k): r.status for r in merkle.changed_members(a, b, "g", "k", "h").collect()}
    want = {x: "new" if x not in one else "gone" if x not in two else "changed" for x in one.keys() | two.keys() if x not in one or x not in two or one[x] != two[x]}
    assert changes == want
    levels = merkle.depth("k", a, b)
    states = {r.group: r.status for r in merkle.status(merkle.tree(a, "g", "k", "h", levels), merkle.tree(b, "g", "k", "h", levels)).collect()}
    assert states == {g: "new" if g == "e" else "unreadable" if g == "d" else "changed" if any(x[0] == g for x in want) else "unchanged" for g in {x for x, _ in one} | {"e"}}
    assert merkle.changed_members(a, a, "g", "k", "h").count() == 0 == merkle.roots(merkle.tree(a.limit(0), "g", "k", "h")).count()


def test_negative_keys_and_uneven_versions(spark):
    one, two = [("a", k, "x") for k in (-5_000, -1, 0, 3)], [("a", k, "x") for k in (-1, 0, 3)]
    a, b = (spark.createDataFrame(rows, "g string, k long, h string") for rows in (one, two))
    assert [(r.k, r.status) for r in merkle.changed_members(a, b, "g", "k", "h").collect()] == [(-5_000, "gone")]


def test_overlaps_of_all_lengths(spark):
    """Seconds to weeks, empty and broken intervals, and a user with a third of all rows."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        s = rng.randint(0, 3_000_000)
        rows.append((0 if i % 3 == 0 else rng.choice([1, 2, None]), i, s, s + rng.choice([-1, 0, 1, 2, 5, 64, 65, 3_600, 86_400, 604_800, 1_500_000])))
    rows += [(7, 1_000, -100, -20), (7, 1_001, -21, 5), (7, 1_002, 5, 9), (7, 1_003, None, 9), (7, 1_000, -90, -80)]
    frame = spark.createDataFrame(rows, "u int, id int, s long, e long")
    got = sorted(map(tuple, intervals.overlaps(frame, "u", "id", "s", "e").collect()))
    good = [r for r in rows if None not in r and r[3] >= r[2]]
    assert got == sorted((a[0], a[1], b[1]) for a in good for b in good if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3])
    assert intervals.overlaps(frame.limit(0), "u", "id", "s", "e").count() == 0


def test_phrases(spark):
    texts = [(1, "The quick, brown fox. The quick fox"), (2, "brown"), (3, None), (4, "fox the QUICK brown"), (5, "a a a b")]
    asked = [("p1", "the quick"), ("p2", "Brown"), ("p3", "quick brown fox"), ("p4", "!!"), ("p5", None), ("p6", "a a"), ("p7", "fox quick"), ("p8", "no such"), ("p9", "a a a b")]
    index = phrases.index(spark.createDataFrame(texts, "d long, text string"), "d")
    got = {(r.p, r.d): r.n for r in phrases.found(index, spark.createDataFrame(asked, "p string, text string"), "d", "p").collect()}
    assert got == {("p1", 1): 2, ("p1", 4): 1, ("p2", 1): 1, ("p2", 2): 1, ("p2", 4): 1, ("p3", 1): 1, ("p6", 5): 2, ("p9", 5): 1}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_phrases_against_a_plain_search(spark, monkeypatch, limit):
    """Broadcast or shuffled; repeated rows count once, rows that share a key add up, rows without a key take no part."""
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", limit)
    texts = [(i % 60, " ".join("abcde"[(i * j * j + j // 3) % 5] for j in range(i % 40))) for i in range(90)] + [(None, "a b c"), (7, None), (8, ""), (61, "a b " * 3000)]
    asked = [(p, p) for p in ("a", "a b", "b a b", "a a a", "e d c b a", "c a", "zz a", "A B a")]
    index = phrases.index(spark.createDataFrame(texts + texts[:5], "d int, text string").repartition(3), "d")
    got = {(r.p, r.d): r.n for r in phrases.found(index, spark.createDataFrame(asked, "p string, text string"), "d", "p").collect()}
    want = {}
    for d, t in set(texts):
        has = (t or "").split()
        for p, _ in asked:
            x = p.lower().split()
            n = sum(has[i : i + len(x)] == x for i in range(len(has)))
            if n and d is not None:
                want[p, d] = want.get((p, d), 0) + n
    assert got == want
    empty = phrases.index(spark.createDataFrame([], "d int, text string"), "d")
    assert phrases.found(empty, spark.createDataFrame(asked, "p string, text string"), "d", "p").count() == 0


def test_relations_share_one_parse(spark):
    files = code.modules(spark, SF)
    facts = code_graph.fact_table(files)
    for relation in (code_graph.import_relations, code_graph.call_edges):
        plan = relation(facts, files)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "PartitionFilters: [isnotnull(kind" in plan
    assert facts.where(F.col("kind") == "import").count() > 0


def test_catalogues_found_as_files(spark, tmp_path):
    """Files and folders that begin as agreed, in the order of the plan; faults are errors that name the catalogue; nothing found, nothing to run."""
    root = f"file://{tmp_path}"
    schema = "id long, question string"
    none = catalogues.questions(spark, root, schema, "question")
    assert none.count() == 0 and catalogues.prompts(spark, root).count() == 0
    for name, lines in {"question_catalog_b.jsonl": ['{"id": 2, "question": "B2"}', "", '{"id": 1, "question": "B1", "more": 3}'], "question_catalog.v2.jsonl": ['{"id": 1, "question": ""}'], "my_question_catalog.jsonl": ["nonsense"], "system_prompt_x.md": ["", "  be", "brief \u00a0", ""], "system_prompt_y.md": [""], "notes.md": ["no"]}.items():
        (tmp_path / name).write_text("\n".join(lines))
    (tmp_path / "question_catalog_a").mkdir()
    for i in (0, 1):
        (tmp_path / "question_catalog_a" / f"part-{i}").write_text(f'{{"id": {9 - i}, "question": "A{9 - i}"}}\n')
    asked, variants = catalogues.questions(spark, root, schema, "question"), catalogues.prompts(spark, root)
    assert {(r.variant, r.prompt) for r in variants.collect()} == {("system_prompt_x", "be\nbrief"), ("system_prompt_y", "")}
    got = [(r.pos, r.catalogue, r.variant, r.model, r.id) for r in catalogues.runs(asked, variants, ["m2", "m1"], "id").orderBy("pos").collect()]
    held = [("question_catalog.v2", [1]), ("question_catalog_a", [8, 9]), ("question_catalog_b", [1, 2])]
    want = [(c, v, m, i) for c, ids in held for v in ("system_prompt_x", "system_prompt_y") for m in ("m2", "m1") for i in ids]
    assert got == [(n + 1, *w) for n, w in enumerate(want)]
    assert catalogues.runs(asked, variants, [], "id").count() == 0 and catalogues.runs(none, variants, ["m"], "id").count() == 0
    for bad in ('{"id": 3}', "no json"):
        (tmp_path / "question_catalog_b.jsonl").write_text(bad)
        with pytest.raises(Exception, match="a question without question in question_catalog_b"):
            catalogues.questions(spark, root, schema, "question").collect()


@pytest.fixture(scope="module")
def moments(spark, tmp_path_factory):
    """Events at fractions of seconds; times and ids below 0 too. Returns a folder and its rows in DuckDB."""
    folder = str(tmp_path_factory.mktemp("moments"))
    at = ["00:00:00.500000", "00:00:01.500000", "00:00:05.499999", "00:00:05.700000", "00:00:06.500000", "00:59:59.600000", "01:00:00.400000", "01:00:00.600000", "01:00:01.600000", "01:00:02.500000"]
    rows = [(i - 14, f"{day} {t}", 1, kind) for i, (day, kind, t) in enumerate((d, k, t) for d in ("2024-01-01", "1969-12-31") for k in ("view", "click") for t in at)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{folder}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    return folder, duck


@pytest.mark.parametrize("name", ["interval_any", "interval_overlap"])
def test_overlaps_at_fractions_of_seconds(spark, moments, name):
    folder, duck = moments
    got, want = catalogue.QUERIES[name](spark, folder), duck.sql(catalogue.ORACLE_SQL[name]).fetchall()
    assert want and sorted(map(tuple, got.select("user_id", "a_id", "b_id").collect())) == sorted(want)


def test_facts_of_named_kinds(spark):
    """Facts of some kinds are those of all kinds, of these; what a kind does not need is not read."""
    text = "import os, a.b as c\nfrom .m import f as g, h\nclass A(B):\n    x = [1, 'y']\n    def m(self, q: int = g(1), *r):\n        'Doc.'\n        try:\n            open(q)\n        except (E, a.F):\n            log.error(h)\n            raise\nX = lambda: load(g, 'z')\nb.c.connect(g)\n__import__('k')\n"
    every = pyast.facts("p", text)
    assert {r["kind"] for r in every} == set(pyast.KINDS) - {"error"}
    assert [r["flags"] for r in every if r["kind"] == "call" and r["mode"] == "direct"] == [["imported"] if r["name"] in ("g", "h") else [] for r in every if r["kind"] == "call" and r["mode"] == "direct"]
    files = spark.createDataFrame([("p", text), ("q", "def ("), ("r", None)], "path string, text string")
    for kinds in [(k,) for k in pyast.KINDS] + [("call", "alias"), ("function", "error", "assign")]:
        assert pyast.facts("p", text, frozenset(kinds)) == [r for r in every if r["kind"] in kinds]
        assert pyast.python_facts(files, *kinds).count() == sum(r["kind"] in kinds for r in every) + ("error" in kinds)
    with pytest.raises(ValueError):
        pyast.python_facts(files, "imports")


@pytest.mark.parametrize("limit", [100_000, 0])
def test_names_looked_up_broadcast_or_shuffled(spark, monkeypatch, limit):
    monkeypatch.setattr(code_graph, "BROADCAST_KEYS", limit)
    files = spark.createDataFrame([("a/x.py", "import y, y.z, os, b.x\nfrom x import f as g, h\ng(1); k()\ny.run()"), ("b/x.py", "import q"), ("b/y.py", None)], "path string, text string")
    facts = code_graph.fact_table(files, "import", "call", "alias")
    got = code_graph.resolved_imports(facts, files)
    assert limit == 0 or "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.path, r.full): r.resolved for r in got.collect()} == {("a/x.py", "y"): "b/y.py", ("a/x.py", "y.z"): "b/y.py", ("a/x.py", "os"): None, ("a/x.py", "b.x"): "b/x.py", ("a/x.py", "x"): "b/x.py", ("b/x.py", "q"): None}
    assert sorted((r.caller, r.func, r.via, r.callee) for r in code_graph.call_edges(facts, files).collect()) == [("a/x.py", "f", "from-import", "b/x.py"), ("a/x.py", "run", "attribute", "b/y.py")]


#: Queries over sources, and the kinds of facts that each asks for.
ASKED = {
    "call_usages": "call alias",
    "import_resolution": "import",
    "ast_interfaces": "interface",
    "import_relations": "alias assign function",
    "ast_risk_histogram": "handler",
    "ast_io_totals": "io",
    "ast_depth": "function",
    "ast_file_io": "io",
    "ast_name_sets": "function class",
    "ast_symbols": "function class assign",
    "ast_depth_by_file": "function",
    "import_degrees": "import",
    "ast_errors": "error",
    "ast_dynamic_totals": "dynamic",
    "ast_handlers": "handler",
    "ast_symbol_totals": "function class assign",
    "ast_calls": "call",
    "ast_bindings": "binding",
    "call_edges": "call alias",
    "ast_dynamic_imports": "dynamic",
}


@pytest.mark.parametrize("name", ASKED)
def test_queries_ask_for_the_kinds_they_use(spark, monkeypatch, name):
    asked, plain = [], pyast.python_facts
    monkeypatch.setattr(pyast, "python_facts", lambda files, *kinds: (asked.append(" ".join(kinds)), plain(files, *kinds))[1])
    assert catalogue.QUERIES[name](spark, SF).columns and asked == [ASKED[name]]


def test_signatures_without_broadcasts(spark):
    """Texts go to no driver; names and texts of odd files, repeated and null wishes."""
    files = spark.createDataFrame([("a.py", "class A:\n    def f(self): pass\nX = 1"), ("b.py", "def ("), ("c.py", None)], "path string, text string")
    want = {("a.py", "def f"): "ok", ("a.py", " class A(B):"): "ok", ("a.py", "def A"): "missing", ("a.py", "X = 1 "): "ok", ("a.py", ""): "ok", ("a.py", None): "missing", ("b.py", "def ("): "missing", ("b.py", "ef ("): "missing", ("c.py", ""): "missing", ("d.py", "x"): "file_missing", (None, "x"): "file_missing"}
    wanted = spark.createDataFrame([(*w, n) for w in want for n in (1, 2)], "path string, signature string, n int")
    got = code_graph.signatures(wanted, files, code_graph.fact_table(files, "function", "class", "error"))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r.path, r.signature, r.n, r.status) for r in got.collect()), key=str) == sorted(((*w, n, s) for w, s in want.items() for n in (1, 2)), key=str)
    assert "Broadcast" not in catalogue.QUERIES["signature_check"](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("relation", [code_graph.import_relations, lambda facts, files: code_graph.degrees(facts.selectExpr("path", "name as resolved"), files)])
def test_tables_of_files_are_not_broadcast(spark, relation):
    files = code.modules(spark, SF)
    assert "Broadcast" not in relation(code_graph.fact_table(files), files)._jdf.queryExecution().executedPlan().toString()


def test_sources_land_in_bundles(spark, tmp_path, monkeypatch):
    """Files of any text, in fewer files than they are; the query lands no file a source."""
    rows = [("a", f"m{i}.py", t) for i, t in enumerate(["x\n\ty = '\u2028\0\r\n'", "", None, "\\ \"q\" \U0001f600", " lead "])] + [("b", "m0.py", "z")]
    files.land_bundles(spark.createDataFrame(rows, "package string, path string, text string").coalesce(1), f"file://{tmp_path}/t", "package", 3)
    assert sorted((r.path, r.text) for r in files.bundled_files(spark, f"file://{tmp_path}/t", "package").collect()) == sorted((f"{p}/{n}", t) for p, n, t in rows)
    assert len(list((tmp_path / "t").rglob("*.json"))) == 3
    (tmp_path / "t" / "package=b" / "x.json").write_text("no json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.bundled_files(spark, f"file://{tmp_path}/t", "package").collect()
    monkeypatch.setattr(sinks, "landing", lambda s, name: f"file://{tmp_path}/q/{name}{len(list((tmp_path / 'q').glob('*')))}")
    (tmp_path / "q").mkdir()
    assert catalogue.QUERIES["folder_imports"](spark, SF).count() > 0
    assert 0 < len([f for f in (tmp_path / "q" / "sources0").rglob("part-*") if f.is_file()]) <= 5 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("text", [
    "@load('x')\n@g(open)\ndef f() -> load(1):\n    load(2)\n",
    "x = f'''\n{open(\n 'a')}\n'''\r\nload(y)\rdump(1)\r\n\r\nopen(z)\n",
    "\uff4fpen('a')\nb.\uff4copen(2)\n",
    "x\\\n.open(\n'a',\n'w'); \x0cdump(1)\n\x0bload(2)",
    "class A:\n    _load = 1\nopen(open(x, 'r').read(), 'w')\nmatch y:\n    case 1 if stat(y):\n        pass\n",
    "_open(1); opens(2); 'open'\na.connect(lambda: find_spec('q'))\n",
])
def test_calls_are_looked_for_where_their_names_stand(text, monkeypatch):
    """Only lines that hold a name are gone into, and texts without any are not parsed; the facts are those of a whole walk."""
    every = pyast.facts("p", text)
    for kinds in (("io",), ("dynamic",), ("binding",), ("io", "dynamic", "binding")):
        assert pyast.facts("p", text, frozenset(kinds)) == [r for r in every if r["kind"] in kinds]
    monkeypatch.setattr(pyast.ast, "parse", None)
    assert pyast.facts("p", "x = _open(1)\nreopen(load_2)\ndef (", frozenset(["io"])) == []


def test_sources_are_parsed_in_several_parts_a_core(spark):
    """A part a core leaves the rest waiting for the slowest."""
    from marlstone.plans import code

    assert code.modules(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_lists_of_plain_values_are_shown_at_once(monkeypatch):
    text = "NAMES = ['a1', \"b\", 3, [None, x.y], []]\nclass A:\n    def __init__(self):\n        with self.b:\n            self.c = [1]\n"
    rows = {r["name"]: r for r in pyast.facts("p", text + "U = [u'a']\nV = [*a, -1]\n") if r["kind"] in ("assign", "class")}
    assert (rows["U"]["detail"], rows["V"]["detail"], rows["A"]["names"]) == ("[u'a']", "[*a, -1]", ["self.c"])
    monkeypatch.setattr(pyast.ast, "unparse", None)
    assert pyast.facts("p", text, frozenset(["assign"]))[0]["detail"] == "['a1', 'b', 3, [None, x.y], []]"


def test_receivers_and_modules_are_looked_up_together(spark, monkeypatch):
    """The index of modules is made and looked through once, whatever asks for it; facts are stored by kind without a sort."""
    files = spark.createDataFrame([("a/x.py", "from y import f as g\ng(1)\ny.run()\nz.w.run()"), ("b/y.py", "y.run()"), ("b/w.py", None)], "path string, text string")
    stored, plain = [], code_graph.sinks.kept
    monkeypatch.setattr(code_graph.sinks, "kept", lambda df, name, *by: (stored.append(name), plain(df, name, *by))[1])
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    got = code_graph.call_edges(code_graph.fact_table(files, "call", "alias"), files)
    assert stored == ["facts", "asked", "held"] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert sorted((r.lineno, r.func, r.via, r.callee) for r in got.collect()) == [(2, "f", "from-import", "b/y.py"), (3, "run", "attribute", "b/y.py"), (4, "run", "attribute", "b/w.py")]
