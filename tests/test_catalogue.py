"""Every relational query against its SQL in DuckDB, and the operators on small inputs."""

import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import SparkSession, functions as F

from marlstone import sinks
from marlstone.functions import jsonx, text
from marlstone.operators import patch, pyast, reports, rules
from marlstone.plans import catalogue
from marlstone.sources import files
from marlstone.streaming import progress

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = lambda found: sorted(map(str, found))
    at = [want.columns.index(c) for c in got.columns]
    assert rows(tuple(map(cell, r)) for r in got.collect()) == rows(tuple(cell(r[i]) for i in at) for r in want.fetchall())


def test_handlers_by_risk(spark):
    """Logging excuses neither pass nor an empty return; names of modules do not hide a broad type; a bare print is no log."""
    want = {
        "except: pass": "critical", "except Exception as e: log.error(e)": "silent", "except Exception: x=1": "broad", "except KeyError: log.error('k')": "silent", "except KeyError: raise": "ok", "except KeyError: x=1": "ok",
        "except ValueError:\n    log.error(1)\n    pass": "critical", "except builtins.Exception: x=1": "broad", "except KeyError: print(1)": "ok", "except Exception: raise X()": "ok", "except (A, BaseException): x": "broad", "except f(): x=1": "ok",
    }
    text = "\n".join(f"try:\n    a()\n{x}" for x in want)
    rows = pyast.handlers(pyast.python_facts(spark.createDataFrame([("a", text)], "path string, text string"))).orderBy("lineno").collect()
    assert [r.risk for r in rows] == list(want.values())
    assert [r.exc_type for r in rows][-2:] == ["(A, BaseException)", "unknown"] and rows[0].function == "<module>"


def test_depth_and_kinds():
    rows = {r["name"]: r for r in pyast.facts("a", "class C:\n    def m(self):\n        def g(): pass\ndef h():\n    if a: pass\n    elif b: pass\n    elif c: pass\n    else: pass\n") if r["kind"] == "function"}
    assert (rows["m"]["mode"], rows["g"]["mode"], rows["h"]["mode"], rows["h"]["value"]) == ("method", "local", "module", 3)
    assert pyast.facts("a", "def (")[0]["kind"] == "error" and pyast.facts("a", None) == [] and pyast.facts("a", "\0")[0]["kind"] == "error"


def test_deep_sources_do_not_stop_a_task():
    for n in (6_000, 60_000):
        kinds = {r["kind"] for r in pyast.facts("a", "x = " + " + ".join(["1"] * n))}
        assert kinds <= {"error", "assign"} and kinds


def test_blocks_are_found_as_whole_lines(spark):
    files = spark.createDataFrame([("f", "max = 10\nx = 2\n"), ("g", "")], "file string, text string")
    anchors = spark.createDataFrame([("f", 1, "x = 1", "y"), ("f", 2, "", "y"), ("f", 3, "x = 2", "y"), ("g", 4, "a", "b"), ("h", 5, "a", "b")], "file string, ix int, old string, new string")
    got = {r.ix: (r.hits, r.line, r.status) for r in patch.locate(anchors, files).collect()}
    assert got == {1: (1, None, "OK"), 2: (0, None, "NOT_FOUND"), 3: (1, 1, "OK"), 4: (0, None, "NOT_FOUND"), 5: (None, None, "FILE_NOT_FOUND")}


def test_delivery_errors():
    assert [a[1:] for a in patch.anchors_of("intro\n## FILE: a.py\n### ALT\nno block\n### NEU\n```\nx\n```\n")][-1][-1] == "no old block"
    assert patch.anchors_of("## FILE: a\n### ALT\n```\nx\n```\n### NEU\n```\n \n```\n")[0][-1] == "empty new block"


def test_delivery_blocks():
    """Marks count before fences, fences end with as many backticks, heads inside a block are text, files without blocks have no rows."""
    text = "\n".join([
        "remark", "## FILE: a.py ", "### ALT 1", "```py", "fenced", "```", "<<<ALT>>>", "x = 1", "### NEU inside", "  <<<ALT_END>>>", "### NEU 1", "````", "a", "```", "b", "```` ", "```", "late", "```",
        "## FILE: b.py", "nothing", "## FILE: c.py", "### ALT", "```", "y", "```", "### NEU", "```", " #DELETE", "```", "## FILE: d.py", "### NEU", "```", "z", "```", "### ALT", "```", "z", "```",
        "## FILE: e.py", "### ALT", "```", "open", "### NEU", "```", "x",
    ])
    assert patch.anchors_of(text) == [("a.py", 1, "x = 1\n### NEU inside", "a\n```\nb", None), ("c.py", 2, "y", patch.DELETE, None), ("d.py", 3, None, None, "blocks do not pair"), ("e.py", 4, None, None, "blocks do not pair")]
    assert patch.anchors_of("") == [] == patch.anchors_of("no file\n### ALT\n")


def test_tool_calls_and_json(spark):
    assert jsonx._shape({"a": [1, 2], "b": True, "c": None, "d": "x"}) == {"a": [0], "b": False, "c": None, "d": "..."}
    assert jsonx._short({"a": [1, 2, 3, 4], "b": [[1, 2, 3, 4]]}) == {"a": [1, 2, 3], "b": [[1, 2, 3]]}
    rows = spark.createDataFrame([("{bad",), (None,), ("[1]",)], "j string")
    assert [tuple(r) for r in rows.select(jsonx.anonymized("j"), jsonx.is_tool_call(rows.j), jsonx.has_key(rows.j, "a")).collect()] == [(None, False, False), (None, False, False), ("[0]", False, False)]


def test_text_functions_of_awkward_values(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a\u00a0b\x1cc\u3000d",)], "t string")
    assert [r[0] for r in rows.select(text.words(rows.t)).collect()] == [0, 0, 4]
    assert [r[0] for r in rows.select(text.file_name(rows.t)).collect()] == [None, "unknown", "a_b_c_d"]
    assert [r[0] for r in rows.select(text.verdict(rows.t)).collect()] == ["unsure"] * 3
    day = spark.createDataFrame([("12/30", "2026-01-02"), ("02/30", "2026-01-02")], "d string, s string").withColumn("s", F.col("s").cast("date"))
    assert [str(r[0]) for r in day.select(text.snapshot_date(F.col("d"), F.col("s"))).collect()] == ["2025-12-30", "None"]
    assert [str(r[0]) for r in day.select(text.snapshot_date(F.col("d"), F.col("s"), False)).collect()] == ["2026-12-30", "None"]


def test_code_and_prose(spark):
    source = '"""Doc."""\n\n# note\nx = 1  # inline\ndef f():\n    \'\'\'Open\n    more\n    close\'\'\'\n    return """text"""\n'
    rows = reports.code_and_prose(spark.createDataFrame([("a", source), ("b", None), ("c", "")], "path string, text string"))
    assert {r.path: (r.code, r.prose) for r in rows.collect()} == {"a": (3, 5), "b": (0, 0), "c": (0, 0)}


def test_gates_stop_a_red_run(spark):
    logs = spark.createDataFrame([("a", "ZUSAMMENFASSUNG\nx   1 check — 0 passed, 1 failed")], "path string, text string")
    assert reports.suite_gate(logs).first().status == "red"
    with pytest.raises(Exception, match="red run"):
        reports.passed_or_raise(reports.suite_gate(logs)).collect()
    assert reports.suite_gate(logs.limit(0)).count() == 0


def test_reports_as_files(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string").orderBy("n")
    path = sinks.write_markdown(frame, str(tmp_path / "r" / "t.md"), ("n",))
    assert open(path).read() == "| n | s |\n|---:|---|\n| 1 | a\\|b |\n| 2 |  |\n"


def test_rules_and_verdicts(spark):
    texts = spark.createDataFrame([("a", "x\nhit (("), ("b", None)], "path string, text string")
    got = rules.hits(texts, [("t", "(("), ("t", "hit")]).collect()
    assert [(r.path, r.lineno, r.pattern, r.context) for r in got] == [("a", 2, "((", "  x\n> hit ((")]
    rows = spark.createDataFrame([("k1", "abc"), ("k2", "abcd"), ("k2", "abcd")], "cache_key string, line string")
    known = spark.createDataFrame([("k1", "relevant")], "cache_key string, verdict string")
    assert Counter((r.verdict, r.origin) for r in rules.judged(rows, known).collect()) == {("relevant", "cache"): 1, ("relevant", "computed"): 2}
    assert Counter((r.verdict, r.origin) for r in rules.judged(rows, known, None).collect()) == {("relevant", "cache"): 1, ("unsure", "offline"): 2}


def test_progress_is_read_once(spark, tmp_path):
    path, state = f"file://{tmp_path}/p", f"file://{tmp_path}/s"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.jsonl").write_text('{"k": 1, "n": 1}\nbroken\n\n{"k": null, "n": 2}\n')
    read = lambda: sorted((r.k or 0, r.n) for r in progress.replayed(spark, path, "k long, n long", state, ("k",), "n").collect())
    assert read() == [(0, 2), (1, 1)]
    (tmp_path / "p" / "2.jsonl").write_text('{"k": 1, "n": 3}\n{"k": 1, "n": 3}\n')
    assert read() == [(0, 2), (1, 3)] == read()
    grid = spark.createDataFrame([(1,), (None,), (4,)], "k long")
    assert [r.k for r in progress.open_items(grid, progress.replayed(spark, path, "k long, n long", state, ("k",), "n"), ("k",)).collect()] == [4]


def test_files_and_json_lines(spark, tmp_path):
    (tmp_path / "skip").mkdir()
    (tmp_path / "a.py").write_bytes(b"x\xff")
    (tmp_path / "skip" / "b.py").write_text("y")
    assert [(r.path, r.text) for r in files.text_files(spark, str(tmp_path), "*.py", ("skip",)).collect()] == [("a.py", "x\ufffd")]
    r = files.text_files(spark, str(tmp_path), extensions=(".PY",)).orderBy("path").first()
    assert (r.path, r.length, r.sha1) == ("a.py", 2, hashlib.sha1(b"blob 2\x00x\xff").hexdigest())
    assert files.newest(files.text_files(spark, str(tmp_path)), r"\.py$").count() == 1 and files.newest(files.text_files(spark, str(tmp_path)), "nope").count() == 0
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": \n\n{"a": 2}\n')
    good, bad = files.tolerant_json_lines(spark, str(tmp_path / "l.jsonl"), "a long")
    assert (good.count(), bad.count()) == (2, 1)


def test_daily_counts_of_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id, 0, 0) as ts, if(id % 3 = 0, 'a', 'b') as event_type from range(60)")
    rows.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/events")
    progress.daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(str(r.day)[:10], r.event_type): r.n for r in spark.table("daily").collect()}
    assert got == {(f"2024-01-0{d + 1}", t): sum(1 for i in range(60) if i // 24 == d and (i % 3 == 0) == (t == "a")) for d in range(3) for t in "ab"}
