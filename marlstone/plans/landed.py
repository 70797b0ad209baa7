"""Queries over landed texts: exports, logs, reports, configurations, patches and snapshots.

The texts are put together from the tables, parsed back by the operators, and held against SQL over the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import sinks, snapshots
from ..functions import jsonx, text
from ..operators import audit, catalogues, chat, deltas, patch, reports, rules
from ..sources import files, sqlite
from ..streaming import progress

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Scalar functions


@query("""SELECT p_partkey, replace(replace(replace(lower('Ab_c.' || p_name || ' X'), '_', ''), '.', ''), ' ', '') AS name_key, replace(p_name, ' ', '_') || '_a_b_' || p_partkey AS file_name, replace(p_name, ' ', '_') || '__' || p_partkey AS export_name,
  replace(p_name, ' ', '') || p_partkey AS plain_name, 'A ' || p_name AS export_title, CASE WHEN p_partkey % 3 = 0 THEN '99999999_999999' ELSE '202605' || lpad(CAST(1 + p_partkey % 28 AS VARCHAR), 2, '0') || '_140428' END AS stamp,
  'a b ' || p_name AS one_spaced, CAST(2 + len(string_split(p_name, ' ')) AS BIGINT) AS n_words, lower(replace(p_name, ' ', ' ')) || ' v2' AS title_key FROM part""")
def text_names(spark, sf_dir):
    p, at = _table(spark, sf_dir, "part"), F.col("p_name")
    k = F.col("p_partkey").cast("string")
    stamped = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("chat_"), k, F.lit(".md"))).otherwise(F.concat(F.lit("chat_2026-05-"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0"), F.lit("_140428.md")))
    spaced = F.concat(F.lit("\x1c a b   "), at, F.lit("\n"))
    return p.select(
        "p_partkey", text.name_key(F.concat(F.lit("Ab_c."), at, F.lit(" X"))).alias("name_key"), text.file_name(F.concat(F.lit(".."), at, F.lit(": a/b_"), k, F.lit("?_"))).alias("file_name"),
        text.export_name(F.concat(F.lit("Chat with Gemini – "), at, F.lit(" <"), k, F.lit(">"))).alias("export_name"), text.plain_name(F.concat(at, F.lit(" ("), k, F.lit(").."))).alias("plain_name"),
        text.export_title(F.concat(F.lit("A_"), F.replace(at, F.lit(" "), F.lit("_")), F.lit("_-_Google_Gemini_2026.md"))).alias("export_title"), text.stamp(stamped).alias("stamp"),
        text.one_spaced(spaced).alias("one_spaced"), text.words(spaced).alias("n_words"), text.title_key(F.concat(F.lit(" "), F.upper(at), F.lit(" --_v2!?"))).alias("title_key"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y %H:%M') WHEN 1 THEN 'soon' ELSE '' END AS shown, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
  CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' ELSE (s // 60) || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' END AS elapsed, lpad(CAST(s // 60 AS VARCHAR), CAST(greatest(2, len(CAST(s // 60 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock,
  format('{:,}', s) AS thousands FROM (SELECT *, o_orderkey * 37 AS s FROM orders)""")
def time_names(spark, sf_dir):
    o, k = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    iso = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 3 == 1, "soon")
    day = F.when(k % 11 == 0, "13/45").otherwise(F.date_format("o_orderdate", "MM/dd"))
    s = k * 37
    return o.select("o_orderkey", text.shown_time(iso).alias("shown"), F.date_format(text.snapshot_date(day, F.date_add(F.col("o_orderdate").cast("date"), 10)), "yyyy-MM-dd").alias("day"), text.elapsed(s).alias("elapsed"), text.clock(s).alias("clock"), F.format_number(s, 0).alias("thousands"))


@query("""SELECT conv_id, turn, array_to_string([rtrim(x, ' ') for x in string_split(text, chr(10))], chr(10)) AS plain, CASE WHEN turn % 2 = 0 THEN 'crlf' ELSE 'lf' END AS line_end FROM (SELECT conv_id, turn, trim(text, chr(10)) AS text FROM conversations WHERE text IS NOT NULL AND trim(text, chr(10) || ' ') <> '')""")
def line_shapes(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").where("text is not null and trim(both '\\n ' from text) != ''")
    crlf = F.when(F.col("turn") % 2 == 0, "\r\n").otherwise("\n")
    raw = F.concat(crlf, F.replace("text", F.lit("\n"), F.concat(F.lit(" \t"), crlf)), crlf, F.lit("  "), crlf)
    return c.select("conv_id", "turn", text.plain_lines(raw).alias("plain"), F.when(text.line_end(raw) == "\r\n", "crlf").otherwise("lf").alias("line_end"))


@query("""SELECT page_id, contains(lower(url), 'example.net') OR contains(lower(url), '/fr/') AS keyword, contains(lower(url), 'page=') AS searched, regexp_matches(path, '^.*/.*html$') AND NOT starts_with(path, 'www') AS included, len([x for x in string_split(path, '/') if x = 'en' OR ends_with(x, '.net')]) > 0 AS ignored
  FROM (SELECT page_id, url, regexp_replace(split_part(url, '?', 1), '^[a-z]+://', '') AS path FROM pages)""")
def path_filters(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").withColumn("path", F.regexp_replace(F.split("url", r"\?")[0], "^[a-z]+://", ""))
    return p.select(
        "page_id", text.any_keyword(F.col("url"), ("Example.NET", "/fr/")).alias("keyword"), text.free_text(F.col("url"), " PAGE= ").alias("searched"),
        text.glob_filter(F.col("path"), ("*/*html",), ("www",)).alias("included"), text.ignored(F.col("path"), ("en", "*.net")).alias("ignored"),
    )


_REPLIES = "['Not_Relevant.', 'so RELEVANT!', 'irrelevant', 'unsure', '', NULL]"


@query(f"SELECT doc_id, ['not_relevant', 'relevant', 'relevant', 'unsure', 'unsure', 'unsure'][CAST(doc_id % 6 AS INTEGER) + 1] AS verdict FROM labels")
def verdict_parse(spark, sf_dir):
    replies = F.array(*map(F.lit, ("Not_Relevant.", "so RELEVANT!", "irrelevant", "unsure", "", None)))
    return _table(spark, sf_dir, "labels").select("doc_id", text.verdict(F.get(replies, (F.col("doc_id") % 6).cast("int"))).alias("verdict"))


@query("SELECT v.verdict, CAST(count(l.doc_id) AS BIGINT) AS n, v.pos FROM (VALUES ('relevant', 1), ('unsure', 2), ('not_relevant', 3)) v(verdict, pos) LEFT JOIN (SELECT doc_id, ['not_relevant', 'relevant', 'relevant', 'unsure', 'unsure', 'unsure'][CAST(doc_id % 6 AS INTEGER) + 1] AS verdict FROM labels) l ON l.verdict = v.verdict GROUP BY ALL")
def findings_by_verdict(spark, sf_dir):
    order = spark.createDataFrame([("relevant", 1), ("unsure", 2), ("not_relevant", 3)], "verdict string, pos int")
    return order.join(verdict_parse(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n")), "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"), "pos")


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN trim(text, ' ') WHEN 1 THEN text ELSE '<think>' || text END AS answer FROM conversations WHERE text IS NOT NULL")
def think_strip(spark, sf_dir):
    t = F.col("text")
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>a</think> "), t)).when(F.col("turn") % 3 == 1, t).otherwise(F.concat(F.lit("<think>"), t))
    return _table(spark, sf_dir, "conversations").where(t.isNotNull()).select("conv_id", "turn", text.answer(raw).alias("answer"))


# Conversations


def _exports(spark, sf_dir):
    """One Markdown export a conversation, by turns in one of two dialects."""
    c = _table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    claude = F.col("conv_id") % 2 == 0
    head = F.when(claude, F.when(F.col("role") == "user", "### 👤 Du").otherwise("### 🤖 Assistant")).otherwise(F.when(F.col("role") == "user", "## 👤 You").otherwise("## 🤖 Gemini"))
    turns = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat(head, F.lit(" (1)\n> 2026 ---\n"), F.coalesce("text", F.lit("")), F.lit("\n---\n")).alias("s")))), lambda x: x["s"]), "")
    return c.groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.concat(F.lit("# Chat Export\n*from here*\nlost\n"), turns).alias("text"))


_TURNS = "SELECT conv_id, role, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM conversations WHERE role IN ('user', 'assistant')"
_SIDES = ", ".join(f"CAST(coalesce(sum(CASE WHEN role = '{r}' THEN {x} END), 0) AS BIGINT) AS {s}_{n}" for r, s in (("user", "user"), ("assistant", "ai")) for n, x in (("turns", "1"), ("words", "len(string_split(t, ' '))"), ("chars", "length(t)")))


@query(f"SELECT CAST(conv_id AS VARCHAR) AS path, CASE WHEN conv_id % 2 = 0 THEN 'Claude MD' ELSE 'Gemini MD' END AS format, {_SIDES} FROM ({_TURNS}) WHERE t <> '' GROUP BY conv_id")
def chat_markdown(spark, sf_dir):
    return chat.turn_stats(chat.markdown_turns(_exports(spark, sf_dir)), "path", "format")


@query(f"SELECT CASE WHEN conv_id % 2 = 0 THEN 'Claude MD' ELSE 'Gemini MD' END AS format, {_SIDES} FROM ({_TURNS}) WHERE t <> '' GROUP BY ROLLUP (format)")
def chat_markdown_totals(spark, sf_dir):
    turns = chat.markdown_turns(_exports(spark, sf_dir))
    of = lambda side, x: F.coalesce(F.sum(F.when(F.col("side") == side, x)), F.lit(0)).cast("long")
    counts = {"turns": F.lit(1), "words": text.words(F.col("text")), "chars": F.length("text")}
    return turns.rollup("format").agg(*(of(s, x).alias(f"{s}_{n}") for s in ("user", "ai") for n, x in counts.items()))


def _json_exports(spark, sf_dir):
    """One JSON export a conversation: a chat or a list of one, fields under any of their names, text in blocks or plain."""
    c = _table(spark, sf_dir, "conversations")
    sender = F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    q = lambda x: F.to_json(F.struct(x.alias("x")), {"ignoreNullFields": "false"})
    quoted = lambda x: F.regexp_extract(q(x), r"(?s)^\{\"x\":(.*)\}$", 1)
    blocks = F.concat(F.lit('{"role":'), quoted(sender), F.lit(',"content":[{"type":"image","text":"no"},{"type":"text","text":'), quoted(F.col("text")), F.lit("}]}"))
    plain = F.concat(F.lit('{"sender":'), quoted(sender), F.lit(',"content":[],"text":'), quoted(F.col("text")), F.lit("}"))
    message = F.when(F.col("turn") % 2 == 0, blocks).otherwise(plain)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]), ",")
    rows = c.groupBy("conv_id").agg(joined.alias("ms"))
    k = F.col("conv_id")
    title = F.when(k % 2 == 0, F.concat(F.lit('"name":"","title":"T'), k, F.lit('"'))).otherwise(F.concat(F.lit('"chat_title":"T'), k, F.lit('"')))
    named = F.when(k % 3 == 0, '"chat_messages"').when(k % 3 == 1, '"messages":[],"conversation"').otherwise('"chat_messages":"none","messages"')
    body = F.concat(F.lit("{"), title, F.lit(","), F.when(k % 3 == 1, F.lit('"messages":[],"conversation":[')).otherwise(F.concat(named, F.lit(":["))), "ms", F.lit("]}"))
    return rows.select(k.cast("string").alias("path"), F.when(k % 7 == 0, "{broken").when(k % 5 == 0, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body).alias("text"))


@query("SELECT CAST(conv_id AS VARCHAR) AS path, 'T' || conv_id AS title, CASE role WHEN 'user' THEN 'user' ELSE 'ai' END AS side, CAST(count(*) AS BIGINT) AS turns, CAST(sum(length(trim(text, ' '))) AS BIGINT) AS chars FROM conversations WHERE conv_id % 7 <> 0 AND role IN ('user', 'human', 'assistant') AND trim(text, ' ') <> '' GROUP BY ALL")
def chat_json(spark, sf_dir):
    return chat.json_turns(_json_exports(spark, sf_dir)).groupBy("path", "title", "side").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


# Reports, logs, findings


def _listed(df: DataFrame, key: str, order: str, line) -> DataFrame:
    """path, lines: the lines of a key's rows in order."""
    return df.groupBy(F.col(key).cast("string").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("s")))), lambda x: x["s"]), "\n").alias("lines"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS path, 'src/' || l_returnflag || '.py' AS file, CAST(l_quantity AS BIGINT) AS lineno, CASE WHEN l_linenumber % 2 = 0 THEN 'method' ELSE 'module' END AS kind, CASE WHEN l_linenumber % 2 = 0 THEN 'C' || l_suppkey ELSE '' END AS class_name, 'f_' || l_partkey AS name, CAST(l_linenumber * 20 AS BIGINT) AS line_count FROM lineitem")
def report_rows(spark, sf_dir):
    line = F.concat(F.lit("### src/"), "l_returnflag", F.lit(".py \n| Line | Kind | Class | Name | Lines |\n|---:|---|---|---|---:|\n| "), F.col("l_quantity").cast("long"), F.lit(" | "), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("method | C"), "l_suppkey")).otherwise(F.lit("module | ")), F.lit(" | f_"), "l_partkey", F.lit(" | "), F.col("l_linenumber") * 20, F.lit(" |\ntext"))
    made = _listed(_table(spark, sf_dir, "lineitem").withColumn("_id", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")), "l_orderkey", "_id", line)
    return reports.function_rows(made.select("path", F.concat(F.lit("# Map\n| 1 | method | | lost | 3 |\n"), "lines").alias("text")))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, CASE WHEN p_size >= 10 THEN CAST(p_size * 1000 + 7 AS VARCHAR) || '.5' ELSE NULL END AS price, NULL::VARCHAR AS absent FROM part")
def report_value(spark, sf_dir):
    size = F.col("p_size").cast("string")
    cell = F.when(F.col("p_size") >= 10, F.concat(size, F.lit(",007.5"))).otherwise(F.lit("n/a"))
    report = F.concat(F.lit("# P\n| Name | Value |\n|---|---|\n| Size | 12% | x | "), size, F.lit(" | 7 |\n|  Price (net)  | 3 % | "), cell, F.lit(" |\n"))
    p = _table(spark, sf_dir, "part").select("p_partkey", report.alias("t"))
    return p.select("p_partkey", reports.table_value(F.col("t"), "Size").alias("size"), reports.table_value(F.col("t"), "Price (net)").alias("price"), reports.table_value(F.col("t"), "Size (").alias("absent"))


def _logs(spark, sf_dir):
    k = F.col("s_suppkey")
    row = lambda label, n, bad: F.concat(F.lit(f"  {label}   "), n, F.lit(" checks — "), n - bad, F.lit(" passed, "), bad, F.lit(" failed\n"))
    red = F.when(k % 5 == 1, 1).otherwise(0)
    body = F.concat(row("unit tests", k + 2, F.lit(0)), F.when(k % 5 == 2, F.lit("  lint  Ergebnis nicht erkannt\n")).otherwise(F.lit("")), row("end to end", k + 5, red))
    text_ = F.when(k % 5 == 3, F.concat(F.lit("running\n"), row("early", k, F.lit(0)))).when(k % 5 == 4, F.lit("x\n== ZUSAMMENFASSUNG ==\nnothing here\n")).otherwise(F.concat(F.lit("a\n"), row("early", k, F.lit(0)), F.lit("== ZUSAMMENFASSUNG ==\n\n"), body, F.lit("done")))
    return _table(spark, sf_dir, "supplier").select(k.cast("string").alias("path"), text_.alias("text"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS path, label, CAST(s_suppkey + extra AS BIGINT) AS total, CAST(s_suppkey + extra - CASE WHEN s_suppkey % 5 = 1 AND extra = 5 THEN 1 ELSE 0 END AS BIGINT) AS passed, CAST(CASE WHEN s_suppkey % 5 = 1 AND extra = 5 THEN 1 ELSE 0 END AS BIGINT) AS failed
  FROM supplier, (VALUES ('unit tests', 2), ('end to end', 5)) v(label, extra) WHERE s_suppkey % 5 < 3""")
def suite_rows(spark, sf_dir):
    return reports.suite_rows(_logs(spark, sf_dir)).where("not unknown").select("path", "label", "total", "passed", "failed")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS path, ['ok', 'red', 'unrecognised', 'no_header', 'no_suite'][CAST(s_suppkey % 5 AS INTEGER) + 1] AS status, CASE WHEN s_suppkey % 5 = 0 THEN 2 * s_suppkey + 7 END AS total, CASE WHEN s_suppkey % 5 = 0 THEN 2 * s_suppkey + 7 END AS passed FROM supplier""")
def suite_gate(spark, sf_dir):
    return reports.suite_gate(_logs(spark, sf_dir))


@query("SELECT label, CAST(sum(s_suppkey + extra) AS BIGINT) AS total FROM supplier, (VALUES ('unit tests', 2), ('end to end', 5)) v(label, extra) WHERE s_suppkey % 5 < 3 GROUP BY ROLLUP (label)")
def suite_totals(spark, sf_dir):
    return suite_rows(spark, sf_dir).rollup("label").agg(F.sum("total").alias("total"))


def _found(spark, sf_dir):
    line = F.concat(F.lit("  pkg\\m"), F.col("l_suppkey") % 7, F.lit(".py:"), "l_orderkey", F.lit(": unused "), F.when(F.col("l_linenumber") % 2 == 0, "function").otherwise("import"), F.lit(" 'n"), F.col("l_partkey") % 50, F.lit("' ("), F.when(F.col("l_returnflag") == "R", 60).otherwise(90), F.lit("% confidence)\nnoise: 1"))
    return reports.findings(_listed(_table(spark, sf_dir, "lineitem").withColumn("_id", F.struct("l_linenumber", "l_partkey", "l_suppkey")), "l_orderkey", "_id", line).select("path", F.col("lines").alias("text")))


_FOUND = "SELECT 'pkg/m' || (l_suppkey % 7) || '.py' AS file, l_orderkey AS line, CASE WHEN l_linenumber % 2 = 0 THEN 'unused function' ELSE 'unused import' END AS kind, 'n' || (l_partkey % 50) AS name, CAST(CASE WHEN l_returnflag = 'R' THEN 60 ELSE 90 END AS BIGINT) AS confidence FROM lineitem"


@query(f"SELECT file, kind, confidence, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT name) AS BIGINT) AS n_names, CAST(max(line) AS BIGINT) AS last FROM ({_FOUND}) GROUP BY ALL")
def finding_rows(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("file", "kind", "confidence").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"), F.max("line").alias("last"))


@query(f"SELECT accepted, CAST(count(*) AS BIGINT) AS n FROM (SELECT (file IN ('pkg/m0.py', 'pkg/m1.py') AND name IN ('n1', 'n2')) AS accepted FROM ({_FOUND})) GROUP BY ALL")
def findings_accepted(spark, sf_dir):
    accepted = spark.createDataFrame([("pkg\\m0.py", "n1"), ("pkg/m0.py", "n2"), ("pkg/m1.py", "n1"), ("pkg\\m1.py", "n2"), ("pkg\\m1.py", "n2")], "file string, name string")
    return reports.without_accepted(_found(spark, sf_dir), accepted).groupBy("accepted").agg(F.count("*").alias("n"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY ts NULLS LAST, n) AS INTEGER) AS pos, 'Order ' || o_orderkey AS title, strftime(ts, '%Y-%m-%d %H:%M') AS ts FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS ts FROM orders)""")
def summary_sections(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    time = F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "dd.MM.yyyy HH:mm")).otherwise("undated")
    made = _listed(o, "o_custkey", "o_orderkey", F.concat(F.lit("## 7 — Order "), "o_orderkey", F.lit("\n*"), time, F.lit("*\nbody ## no\n")))
    found = reports.sections(made.select("path", F.concat(F.lit("# Head\n*Made today*\n"), "lines").alias("text")))
    return found.where(F.col("raw").startswith(F.format_string("## %03d — ", "pos"))).select("path", "pos", "title", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"))


def _configs(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    sep = F.when(k % 2 == 0, ";").otherwise(",")
    row = lambda *cells: F.concat(F.array_join(F.array(*cells), "\x01"), F.lit("\n"))
    name = F.when(k % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit("doc"), k % 9))
    body = F.concat(row(F.lit("Quelle"), F.lit("S1"), F.lit("TARGET")), row(name, F.concat(F.lit('"m'), sep, F.lit('""1"""')), F.lit(" FR ")), F.lit("\n"), row(F.lit("doc1"), F.lit(""), F.lit("")))
    return c.select(k.cast("string").alias("path"), F.concat(F.when(k % 3 == 0, F.concat(F.lit("﻿sep="), sep, F.lit("\n"))).otherwise(F.when(k % 3 == 1, F.lit("﻿")).otherwise(F.lit(""))), F.replace(body, F.lit("\x01"), sep)).alias("text"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS path, 'doc' || (c_custkey % 9) AS quelle, 'm' || CASE WHEN c_custkey % 2 = 0 THEN ';' ELSE ',' END || '"1"' AS s1, 'fr' AS target, 'general' AS mindset FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 9 < 7""")
def config_rows(spark, sf_dir):
    rows = reports.csv_rows(_configs(spark, sf_dir), "quelle", "s1", "target", "mindset")
    known = spark.range(7).select(F.concat(F.lit("doc"), "id").alias("source"))
    given = rows.where("coalesce(quelle, '') != '' and coalesce(s1, '') != ''").join(known, F.col("quelle") == F.col("source"), "left_semi")
    return given.select("path", "quelle", "s1", F.lower(F.coalesce("target", F.lit("en"))).alias("target"), F.lower(F.coalesce("mindset", F.lit("general"))).alias("mindset"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00' AND event_id % 10 <> 3 GROUP BY event_type")
def perf_rows(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    stamp = F.when(F.col("event_id") % 10 == 3, F.lit("????-??-??T??:??:??")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    line = F.concat(stamp, F.when(F.col("user_id") % 2 == 0, ";").otherwise(","), "event_type", F.lit(";"), "event_id")
    made = _listed(e.withColumn("user", F.col("user_id") % 1000), "user", "event_id", line).select("path", F.concat(F.lit("time;type;id\n"), "lines", F.lit("\n\n")).alias("text"))
    found = reports.timed_rows(made, "2024-01-02 00:00:00", "2024-01-09 12:00:00")
    cells = F.split(F.substring("line", 21, 1000), ";")
    return found.groupBy(cells[0].alias("event_type")).agg(F.count("*").alias("n"), F.sum(cells[1].cast("long")).alias("ids"))


# JSON


@query("""SELECT event_id, '{"a":[0],"b":false,"c":null,"d":"...","e":{"k":0},"f":[]}' AS shape, (event_id % 2 = 0) AS has_steps, true AS same, event_id % 3 = 0 AS equal FROM events""")
def json_shapes(spark, sf_dir):
    e, k = _table(spark, sf_dir, "events"), F.col("event_id")
    doc = F.concat(F.lit('{"a":['), k, F.lit(',"x"],"b":true,"c":null,"d":"'), "event_type", F.lit('","e":'), "props", F.lit(',"f":[]}'))
    flagged = F.concat(F.lit('{"p":'), "props", F.when(k % 2 == 0, F.lit(',"steps":null}')).otherwise(F.lit("}")))
    other = F.concat(F.lit('{ "y": [1, {"b": 2, "a": '), F.when(k % 3 == 0, 1).otherwise(2), F.lit('}], "x": 1.0 }'))
    return e.select("event_id", jsonx.anonymized(doc).alias("shape"), jsonx.has_key(flagged, "steps").alias("has_steps"), jsonx.equal(doc, F.concat(F.lit(" "), doc)).alias("same"), jsonx.equal(F.lit('{"x":1.0,"y":[1,{"a":1,"b":2}]}'), other).alias("equal"))


@query("""SELECT conv_id, '{"m":[' || array_to_string(['[' || t || ',1,2]' for t in list_sort(list(turn))[1:3]], ',') || '],"n":' || count(*) || '}' AS trimmed FROM conversations GROUP BY conv_id""")
def json_trimmed(spark, sf_dir):
    turns = F.array_join(F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.concat(F.lit("["), t, F.lit(",1,2,3,4]"))), ",")
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit('{"m":['), turns, F.lit('],"n":'), F.count("*"), F.lit("}")).alias("j"))
    return rows.select("conv_id", jsonx.trimmed("j").alias("trimmed"))


@query("SELECT conv_id, turn, turn % 9 = 0 OR turn % 9 = 8 AS accepted FROM conversations")
def tool_calls(spark, sf_dir):
    replies = ('{"name":"t","arguments":{"a":1}}', '{"name":"t","arguments":{},"x":1}', 'see {"name":"t","arguments":{}}', '{"name":1,"arguments":{"name":"x"}}', '{"name":"t","arguments":"{x"}', '{"name":"t","arguments":[]}', '{"name":"t"}', None, ' {"arguments":{},"name":""}\n')
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", jsonx.is_tool_call(F.get(F.array(*map(F.lit, replies)), (F.col("turn") % 9).cast("int"))).alias("accepted"))


@query("SELECT event_id, regexp_replace(props, ': *-?[0-9]+', ':0') AS props FROM events")
def json_anonymize(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", jsonx.anonymized("props").alias("props"))


# Mutation results


def _specs(spark, sf_dir):
    """Specifications and their results: an outcome and a unified diff for most."""
    s = _table(spark, sf_dir, "orders").selectExpr("o_orderkey as job", "o_custkey % 10 as module", "o_custkey", "o_orderstatus")
    diff = F.concat(F.lit("--- a.py\n+++ b.py\n@@ -1 +1 @@\n ctx print(\n-x = "), "o_custkey", F.when(F.col("o_custkey") % 4 == 0, F.lit("\n+log.info(x)\n")).otherwise(F.lit("\n+  x = 0 \n")))
    outcome = F.when(F.col("o_orderstatus") == "F", "KILLED").when(F.col("o_orderstatus") == "O", "SURVIVED").when(F.col("job") % 2 == 0, "TIMEOUT").otherwise("INCOMPETENT")
    return s.select("job", "module"), s.where("job % 7 != 0").select("job", outcome.alias("outcome"), diff.alias("diff"))


_OUTCOME = "CASE WHEN o_orderkey % 7 = 0 THEN 'PENDING' WHEN o_orderstatus = 'F' THEN 'KILLED' WHEN o_orderstatus = 'O' THEN 'SURVIVED' WHEN o_orderkey % 2 = 0 THEN 'TIMEOUT' ELSE 'INCOMPETENT' END"
_COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE o = '{x.upper()}') AS BIGINT) AS {x}" for x in ("killed", "survived", "timeout", "incompetent", "pending"))


@query(f"""SELECT *, CASE WHEN killed + survived + timeout > 0 THEN floor(1000.0 * CAST(killed + timeout AS DOUBLE) / CAST(killed + survived + timeout AS DOUBLE) + 0.5) / 10 END AS rate FROM (
  SELECT module, CAST(count(*) AS BIGINT) AS mutants, {_COUNTS} FROM (SELECT o_custkey % 10 AS module, {_OUTCOME} AS o FROM orders) GROUP BY ROLLUP (module))""")
def mutation_outcomes(spark, sf_dir):
    specs, results = _specs(spark, sf_dir)
    rows = specs.join(results.select("job", "outcome").withColumnRenamed("job", "_job"), F.col("job") == F.col("_job"), "left").withColumn("o", F.coalesce("outcome", F.lit("PENDING")))
    counts = rows.rollup("module").agg(F.count("*").alias("mutants"), *(F.count_if(F.col("o") == x.upper()).alias(x) for x in ("killed", "survived", "timeout", "incompetent", "pending")))
    judged = F.col("killed") + F.col("survived") + F.col("timeout")
    return counts.withColumn("rate", F.when(judged > 0, F.floor(1000.0 * (F.col("killed") + F.col("timeout")).cast("double") / judged.cast("double") + 0.5) / 10))


def _sqlite_specs(spark, sf_dir):
    """The same tables through SQLite files."""
    root = sinks.landing(spark, "sqlite")
    return (sqlite.read(spark, sqlite.write(df, f"{root}/{t}", t), t, 5_000) for df, t in zip(_specs(spark, sf_dir), ("specs", "results")))


@query(f"SELECT module, CAST(count(*) AS BIGINT) AS mutants, {_COUNTS} FROM (SELECT o_custkey % 10 AS module, {_OUTCOME} AS o FROM orders) GROUP BY module")
def sqlite_outcomes(spark, sf_dir):
    """Outcomes by module from SQLite files: specifications with and without a result."""
    specs, results = _sqlite_specs(spark, sf_dir)
    rows = specs.join(results.select(F.col("job").alias("_job"), "outcome"), F.col("job") == F.col("_job"), "left").withColumn("o", F.coalesce("outcome", F.lit("PENDING")))
    return rows.groupBy("module").agg(F.count("*").alias("mutants"), *(F.count_if(F.col("o") == x.upper()).alias(x) for x in ("killed", "survived", "timeout", "incompetent", "pending")))


@query("SELECT o_orderkey AS job, o_custkey % 10 AS module, CAST(row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) AS INTEGER) AS pos FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderstatus = 'O' AND o_orderkey > 500")
def sqlite_survivors(spark, sf_dir):
    """Survivors with their specifications, in order within a module; both conditions run in SQLite."""
    specs, results = _sqlite_specs(spark, sf_dir)
    kept = results.where("outcome = 'SURVIVED' and job > 500").select(F.col("job").alias("_job"))
    rows = specs.join(kept, F.col("job") == F.col("_job"))
    return rows.select("job", "module", F.row_number().over(Window.partitionBy("module").orderBy("job")).alias("pos"))


@query(f"""SELECT o_orderkey AS job, 'x = ' || o_custkey AS removed, CASE WHEN o_custkey % 4 = 0 THEN 'log.info(x)' ELSE 'x = 0' END AS added, CASE WHEN o_custkey % 4 = 0 THEN 'format/log' ELSE 'behaviour' END AS kind FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderstatus = 'O'""")
def mutation_survivors(spark, sf_dir):
    _, results = _specs(spark, sf_dir)
    d = F.col("diff")
    return results.where("outcome = 'SURVIVED'").select("job", text.diff_side(d, "-").alias("removed"), text.diff_side(d, "+").alias("added"), text.diff_kind(d).alias("kind"))


@query("SELECT DISTINCT state, module FROM (SELECT 'unmapped' AS state, p_brand AS module FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') UNION ALL SELECT 'stale', 'Gone#1')")
def mapping_gaps(spark, sf_dir):
    modules = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("module"))
    mapping = spark.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#3",), ("Gone#1",)], "module string")
    found = deltas.new_and_gone(mapping, modules, "module")
    return found.select(F.when(F.col("category") == "new", "unmapped").otherwise("stale").alias("state"), "module")


# Resuming, coverage, selections


@query("SELECT doc_id FROM documents WHERE NOT (doc_id % 3 = 0) OR doc_id % 2 = 1 AND doc_id % 3 <> 0")
def resume_by_name(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id")
    log = d.where("doc_id % 3 = 0 or doc_id % 4 = 1 and doc_id % 3 != 0").select(F.concat(F.lit("**File:** `chat_"), "doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(".json`")).otherwise(F.lit(".json__IN_PROGRESS__`"))).alias("line"))
    done = log.select(F.regexp_extract("line", r"^\*\*File:\*\* `chat_(\d+)\.json`$", 1).alias("done")).where("done != ''").select(F.col("done").cast("long").alias("done"))
    return d.join(done, F.col("doc_id") == F.col("done"), "left_anti")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 4 = 1 OR p_partkey % 4 = 2 THEN 'ok' ELSE 'missing' END AS status FROM part WHERE p_partkey % 10 <> 0")
def coverage_by_keys(spark, sf_dir):
    """A module is covered if its path, its file name or its stem is mentioned."""
    p, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    modules = p.select("p_partkey", F.when(k % 10 == 0, F.concat(F.lit("pkg"), k, F.lit("/__init__.py"))).otherwise(F.concat(F.lit("pkg/mod"), k, F.lit(".py"))).alias("path")).where("path not like '%/__init__.py'")
    stem = F.regexp_extract("path", r"([^/]+)\.py$", 1)
    line = F.concat(F.lit("see ` "), F.when(k % 4 == 0, F.concat(F.lit("pkg/mod"), k, F.lit(".py"))).when(k % 4 == 1, F.concat(F.lit("mod"), k, F.lit(".py"))).when(k % 4 == 2, F.concat(F.lit("mod"), k)).otherwise(F.concat(F.lit("mod"), k, F.lit("()"))), F.lit("` and `x`"))
    mentions = p.select(F.explode(F.regexp_extract_all(line, F.lit("`([^`]+)`"), F.lit(1))).alias("m")).select(F.trim("m").alias("m")).distinct()
    keys = modules.select("p_partkey", F.explode(F.array_distinct(F.array("path", F.regexp_extract("path", "([^/]+)$", 1), stem))).alias("key"))
    hit = keys.join(mentions, F.col("key") == F.col("m"), "left").groupBy("p_partkey").agg(F.bool_or(F.col("m").isNotNull()).alias("hit"))
    return hit.select("p_partkey", F.when(F.col("hit"), "ok").otherwise("missing").alias("status"))


@query("SELECT n_name, contains((SELECT string_agg(n_name, ' ' ORDER BY n_nationkey) FROM nation WHERE n_nationkey % 3 = 0), n_name) AS mentioned FROM nation")
def coverage_by_text(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    document = n.where("n_nationkey % 3 = 0").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), " ").alias("_document"))
    return n.crossJoin(F.broadcast(document)).select("n_name", F.contains("_document", F.col("n_name")).alias("mentioned"))  # one document


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def selection_restore(spark, sf_dir):
    saved = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("VANISHED",), (None,)], "saved string")
    return _table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct().join(F.broadcast(saved), F.col("c_mktsegment") == F.col("saved"), "left_semi")


@query("SELECT strftime(d.day, '%Y-%m-%d') AS day, (SELECT arg_min(e.event_id, e.event_id) FROM events e WHERE CAST(e.ts AS DATE) = d.day AND e.event_type = 'error') AS first_error, (SELECT count(*) > 0 FROM events e WHERE CAST(e.ts AS DATE) = d.day AND e.event_type = 'error' AND e.value > 50) AS any_large, CAST((SELECT count(*) FROM events e WHERE CAST(e.ts AS DATE) = d.day) AS BIGINT) AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d")
def day_outcomes(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    error = F.col("event_type") == "error"
    return e.groupBy("day").agg(F.min(F.when(error, F.col("event_id"))).alias("first_error"), F.bool_or(error & (F.col("value") > 50)).alias("any_large"), F.count("*").alias("n"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, CAST(max(o_orderkey) AS BIGINT) AS last_number FROM orders GROUP BY o_custkey")
def latest_file(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.max("o_orderkey").alias("last_number"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CASE WHEN row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) = 1 THEN CAST(l_suppkey AS VARCHAR) ELSE '' END AS label FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem)")
def group_label(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").distinct()
    return sinks.label_once(rows, "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT conv_id, turn, coalesce(lag(right(text, 300)) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context FROM conversations")
def part_context(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.lag(F.expr("right(text, 300)")).over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")).alias("context"))


@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_shipdate DESC NULLS FIRST, l_partkey, l_suppkey, l_quantity) AS INTEGER) AS pos, l_returnflag, l_partkey FROM lineitem")
def ranked_findings(spark, sf_dir):
    rank = F.array_position(F.array(F.lit("R"), F.lit("A"), F.lit("N")), F.col("l_returnflag"))
    w = Window.partitionBy("l_orderkey").orderBy(rank, F.desc_nulls_first("l_shipdate"), "l_partkey", "l_suppkey", "l_quantity")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("pos"), "l_returnflag", "l_partkey")


@query("SELECT l_orderkey AS release, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS downloads, CAST(count(*) AS BIGINT) AS assets, floor(CAST(sum(CAST(floor(l_extendedprice) AS BIGINT) * 100) AS DOUBLE) / 1048576 * 100 + 0.5) / 100 AS mb FROM lineitem GROUP BY l_orderkey")
def asset_downloads(spark, sf_dir):
    """Releases with an array of assets each, as they come from an interface; assets are exploded and summed."""
    asset = F.struct(F.col("l_quantity").cast("long").alias("download_count"), (F.floor("l_extendedprice") * 100).alias("size"))
    releases = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("release")).agg(F.to_json(F.struct(F.collect_list(asset).alias("assets"))).alias("body"))
    rows = releases.select("release", F.explode(F.from_json("body", "assets array<struct<download_count:bigint,size:bigint>>")["assets"]).alias("a"))
    return rows.groupBy("release").agg(F.sum("a.download_count").alias("downloads"), F.count("*").alias("assets"), (F.floor(F.sum("a.size").cast("double") / 1048576 * 100 + 0.5) / 100).alias("mb"))


# Rules


_RULES = [("contact", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), ("contact", r"\+[0-9][0-9 ().-]+"), ("note", "((unclosed"), ("number", "[0-9][0-9][0-9]+")]


@query(r"""SELECT doc_id, CAST(i AS BIGINT) AS lineno, target, pattern, array_to_string([CASE WHEN j = i THEN '> ' ELSE '  ' END || ls[j] for j in range(greatest(i - 3, 1), least(i + 3, len(ls)) + 1)], chr(10)) AS context FROM (
  SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) l,
  LATERAL (SELECT 'contact' AS target, CASE WHEN regexp_matches(ls[i], '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+') THEN '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+' WHEN regexp_matches(ls[i], '\+[0-9][0-9 ().-]+') THEN '\+[0-9][0-9 ().-]+' END AS pattern
    UNION ALL SELECT 'note', CASE WHEN contains(ls[i], '((unclosed') THEN '((unclosed' END UNION ALL SELECT 'number', CASE WHEN regexp_matches(ls[i], '[0-9][0-9][0-9]+') THEN '[0-9][0-9][0-9]+' END) r WHERE pattern IS NOT NULL""")
def scan_rules(spark, sf_dir):
    return rules.hits(_table(spark, sf_dir, "documents"), _RULES, key="doc_id").select("doc_id", "lineno", "target", "pattern", "context")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'cached' ELSE ['not_relevant', 'relevant', 'unsure'][CAST(length(text) % 3 AS INTEGER) + 1] END AS verdict, CASE WHEN doc_id % 2 = 0 THEN 'cache' ELSE 'computed' END AS origin FROM documents WHERE text IS NOT NULL""")
def cached_verdicts(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", rules.cache_key(F.lit("t"), F.col("doc_id").cast("string"), F.col("text")).alias("cache_key"))
    cache = d.where("doc_id % 2 = 0").select("cache_key", F.lit("cached").alias("verdict"))
    return rules.judged(d, cache, rules.stub, "text").select("doc_id", "verdict", "origin")


# Patches


def _deliveries(spark, sf_dir):
    """A file of four lines a part, and one delivery of some blocks for each: found, twice there, gone, applied before, deleting, overlapping."""
    k = F.col("p_partkey")
    p = _table(spark, sf_dir, "part").select(k, F.concat(F.lit("m"), k, F.lit(".py")).alias("file"), F.when(k % 2 == 0, "\r\n").otherwise("\n").alias("e"))
    files = p.where("p_partkey % 17 != 0").select("file", F.concat(F.lit("a = "), "p_partkey", F.col("e"), F.lit("b = 2  "), F.col("e"), F.lit("c = 3"), F.col("e"), F.lit("b = 2"), F.col("e"), F.lit("d = 4")).alias("text"))
    block = lambda old, new: F.concat(F.lit("### ALT\n<<<ALT>>>\n"), old, F.lit("\n<<<ALT_END>>>\n### NEU\n````py\n"), new, F.lit("\n````\n"))
    a, kind = F.concat(F.lit("a = "), "p_partkey"), k % 7
    one = F.when(kind == 0, block(F.concat(a, F.lit("\nb = 2")), F.lit("```\nx\n```"))).when(kind == 1, block(F.lit("b = 2"), F.lit("y"))).when(kind == 2, block(F.lit("zz = 1"), F.lit("y"))).when(kind == 3, block(F.lit("z"), a)).when(kind == 4, block(F.lit("c = 3"), F.lit(" #DELETE "))).when(kind == 5, F.concat(block(F.concat(a, F.lit("\nb = 2")), F.lit("y")), block(F.lit("b = 2\nc = 3"), F.lit("y")))).otherwise(F.concat(F.lit("### ALT\n"), block(a, F.lit("y"))))
    texts = p.select(k.cast("string").alias("delivery"), F.concat(F.lit("## FILE: "), "file", F.lit("\ntext\n"), one).alias("text"))
    return texts, files


@query("""SELECT 'm' || p_partkey || '.py' AS file, ix, CASE WHEN p_partkey % 7 = 6 THEN 'blocks do not pair' END AS error, CASE WHEN p_partkey % 7 = 6 THEN NULL WHEN p_partkey % 17 = 0 THEN 'FILE_NOT_FOUND' ELSE ['OK', 'AMBIGUOUS', 'NOT_FOUND', 'ALREADY_APPLIED', 'OK', 'OVERLAP'][CAST(p_partkey % 7 AS INTEGER) + 1] END AS status,
  CASE WHEN p_partkey % 17 <> 0 THEN CASE p_partkey % 7 WHEN 0 THEN 0 WHEN 4 THEN 2 WHEN 5 THEN ix - 1 END END AS line FROM part, (VALUES (CAST(1 AS INTEGER)), (CAST(2 AS INTEGER))) i(ix) WHERE ix = 1 OR p_partkey % 7 = 5""")
def patch_locate(spark, sf_dir):
    texts, sources = _deliveries(spark, sf_dir)
    anchors = patch.deliveries(texts).select("file", "ix", "old", "new", "error")
    good = patch.locate(anchors.where("error is null"), sources).select("file", "ix", "error", "status", "line")
    return good.unionByName(anchors.where("error is not null").select("file", "ix", "error", F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("line")))


@query("""SELECT 'm' || p_partkey || '.py' AS file, CASE p_partkey % 7 WHEN 0 THEN replace('```|x|```|c = 3|b = 2|d = 4', '|', e) WHEN 4 THEN replace('a = ' || p_partkey || '|b = 2  |b = 2|d = 4', '|', e) ELSE replace('a = ' || p_partkey || '|b = 2  |c = 3|b = 2|d = 4', '|', e) END AS text, CAST(CASE WHEN p_partkey % 7 IN (0, 4) THEN 1 ELSE 0 END AS INTEGER) AS n_applied, true AS ok
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN chr(13) || chr(10) ELSE chr(10) END AS e FROM part WHERE p_partkey % 17 <> 0)""")
def patch_apply(spark, sf_dir):
    texts, sources = _deliveries(spark, sf_dir)
    wanted = texts.where("cast(delivery as bigint) % 17 != 0 and cast(delivery as bigint) % 7 in (0, 3, 4)")
    return patch.applied(patch.deliveries(wanted).select("file", "ix", "old", "new"), sources)


@query("SELECT 'm' || p_partkey || '.py' AS file, CAST(0 AS INTEGER) AS n_applied, false AS ok FROM part WHERE p_partkey % 17 <> 0")
def patch_refused(spark, sf_dir):
    texts, sources = _deliveries(spark, sf_dir)
    return patch.applied(patch.deliveries(texts).where("error is null").select("file", "ix", "old", "new"), sources).select("file", "n_applied", "ok")


# Snapshots


def _io(spark, sf_dir, year):
    return _table(spark, sf_dir, "lineitem").where(F.year("l_shipdate") == year).select(F.col("l_suppkey").alias("module"), F.col("l_linestatus").alias("function"), F.col("l_returnflag").alias("mode"), F.col("l_linenumber").alias("op"))


_IO = "SELECT DISTINCT l_suppkey AS module, l_linestatus AS \"function\", l_returnflag AS mode, l_linenumber AS op FROM lineitem WHERE year(l_shipdate) = "


@query(f"SELECT 'new' AS category, * FROM (({_IO} 1997) EXCEPT ({_IO} 1996)) UNION ALL SELECT 'removed', * FROM (({_IO} 1996) EXCEPT ({_IO} 1997))")
def delta_io(spark, sf_dir):
    return deltas.new_and_gone(_io(spark, sf_dir, 1996), _io(spark, sf_dir, 1997), "module", "function", "mode", "op")


@query(f"SELECT 'same' AS gate, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM (({_IO} 1997) EXCEPT ({_IO} 1996)) UNION ALL SELECT * FROM (({_IO} 1996) EXCEPT ({_IO} 1997))) UNION ALL SELECT 'other', CAST(0 AS BIGINT)")
def delta_version_gate(spark, sf_dir):
    a, b = (_io(spark, sf_dir, y) for y in (1996, 1997))
    n = lambda name, v: deltas.of_one_version(a.withColumn("version", F.lit(2)), b.withColumn("version", F.lit(v)), "module", "function", "mode", "op").agg(F.lit(name).alias("gate"), F.count("*").alias("n"))
    return n("same", 2).unionByName(n("other", 3))


@query("""SELECT mode, CAST(count(*) AS BIGINT) AS n, CAST(sum(rank) AS BIGINT) AS ranks FROM (SELECT 'guarded' AS mode, greatest(c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey * 7) % 25 ELSE -1 END) AS rank FROM customer UNION ALL SELECT 'last', CASE WHEN c_custkey % 2 = 0 THEN (c_custkey * 7) % 25 ELSE c_nationkey END FROM customer) GROUP BY mode""")
def quality_upsert(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    log = c.selectExpr("c_custkey as day", "cast(c_nationkey as bigint) as rank")
    changes = c.where("c_custkey % 2 = 0").selectExpr("c_custkey as day", "(c_custkey * 7) % 25 as rank")
    of = lambda name, guarded: deltas.upserted(log, changes, "day", "rank", guarded).agg(F.lit(name).alias("mode"), F.count("*").alias("n"), F.sum("rank").alias("ranks"))
    return of("guarded", True).unionByName(of("last", False))


@query("SELECT CAST(o_orderkey AS BIGINT) AS day, endpoint, CASE WHEN endpoint = 'uds' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'corrupt' ELSE 'ok' END ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'missing' ELSE 'ok' END END AS status FROM orders, (VALUES ('uds'), ('sleep')) e(endpoint)")
def import_completeness(spark, sf_dir):
    days = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("day"))
    uds = days.select("day", F.lit("uds").alias("endpoint"), F.when(F.col("day") % 5 == 0, "{ this is not valid json ]").otherwise('[{"a": 1}]').alias("text"))
    sleep = days.where("day % 3 != 0").select("day", F.lit("sleep").alias("endpoint"), F.lit("{}").alias("text"))
    return deltas.completeness(days, ("uds", "sleep"), uds.unionByName(sleep))


@query("""SELECT p_brand AS prefix, p_partkey AS key, p_brand || '-' || CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 1 ELSE (SELECT coalesce(max(q.p_partkey + 1), 0) FROM part q WHERE q.p_brand = p.p_brand AND q.p_partkey % 3 = 0) + (SELECT count(*) FROM part q WHERE q.p_brand = p.p_brand AND q.p_partkey % 3 <> 0 AND q.p_partkey % 5 <> 0 AND q.p_partkey <= p.p_partkey) END AS id,
  CASE WHEN p_partkey % 3 <> 0 THEN 'new' WHEN p_partkey % 5 = 0 THEN 'resolved' ELSE 'open' END AS state FROM part p WHERE p_partkey % 3 = 0 OR p_partkey % 5 <> 0""")
def stable_ids(spark, sf_dir):
    p = _table(spark, sf_dir, "part").selectExpr("p_brand as prefix", "p_partkey as key")
    return deltas.finding_ids(p.where("key % 3 = 0").withColumn("number", F.col("key") + 1), p.where("key % 5 != 0"))


@query("""SELECT grade, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN a = 3 OR (b = 3 AND c = 3) THEN 'worst' WHEN a = 1 AND b = 1 AND c = 1 THEN 'best' ELSE 'middle' END AS grade FROM (SELECT 1 + p_partkey % 3 AS a, 1 + p_size % 3 AS b, 1 + (p_partkey + p_size) % 3 AS c FROM part)) GROUP BY grade""")
def score_grid(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").selectExpr("1 + p_partkey % 3 as a", "1 + p_size % 3 as b", "1 + (p_partkey + p_size) % 3 as c")
    return deltas.graded(rows, "a", "b", "c").groupBy("grade").agg(F.count("*").alias("n"))


# Sinks, read back


@query("SELECT CAST(p_partkey AS BIGINT) AS id, 'a|b, \"' || p_name || '\"' AS name, p_brand || ', ' || p_type AS symbols FROM part")
def sink_csv(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit('a|b, "'), "p_name", F.lit('"')).alias("name"), F.array("p_brand", "p_type").alias("symbols"), F.lit(1).alias("extra"))
    path = sinks.write_csv(p, sinks.landing(spark, "csv"), "id", "name", "symbols", sep=";")
    return spark.read.option("header", True).option("sep", ";").option("escape", '"').schema("id long, name string, symbols string").csv(path)


@query("SELECT o_orderkey, CAST(11 AS INTEGER) AS snapshot_id, CAST(2 AS INTEGER) AS version FROM orders WHERE o_orderkey % 2 = 1")
def sink_snapshots(spark, sf_dir):
    path, o = sinks.landing(spark, "snapshots"), _table(spark, sf_dir, "orders").select("o_orderkey")
    for n in (9, 11, 10):
        snapshots.write(o.where(F.col("o_orderkey") % 2 == n % 2), path, n, 2)
    return snapshots.read(spark, path).select("o_orderkey", F.col("snapshot_id").cast("int").alias("snapshot_id"), "version")


@query("""SELECT CAST(v AS INTEGER) AS as_of, snapshot_id, CAST(n AS BIGINT) AS n, complete FROM (
  SELECT 1 AS v, 1 AS snapshot_id, count(*) AS n, true AS complete FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, 1, count(*), true FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, 2, count(*), false FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 3, 1, count(*), true FROM orders UNION ALL SELECT 3, 2, count(*), false FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 4, 1, count(*), true FROM orders UNION ALL SELECT 4, 2, count(*), true FROM orders WHERE o_orderstatus = 'O')""")
def snapshot_versions(spark, sf_dir):
    """Each version of a table of snapshots as it was: written, added to, replaced, marked as complete."""
    path, o = sinks.landing(spark, "versions"), _table(spark, sf_dir, "orders")
    snapshots.write(o.where("o_orderstatus = 'F'"), path, 1)
    snapshots.write(o.where("o_orderstatus = 'O'"), path, 2, complete=False)
    snapshots.write(o, path, 1)
    snapshots.mark_complete(spark, path, 2)
    out = None
    for v in snapshots.versions(spark, path):
        listed = snapshots.entries(spark, path, v)
        for n in (1, 2) if v > 1 else (1,):
            counted = snapshots.read(spark, path, n, v).groupBy().agg(F.count("*").alias("n"))
            rows = listed.where(F.col("snapshot_id") == n).crossJoin(F.broadcast(counted)).select(F.lit(v).alias("as_of"), F.col("snapshot_id").cast("int").alias("snapshot_id"), "n", "complete")  # one row each
            out = rows if out is None else out.unionAll(rows)
    return out


@query("SELECT model, question, CAST(max(n) AS BIGINT) AS n FROM (SELECT event_type AS model, user_id % 20 AS question, event_id AS n FROM events) GROUP BY ALL")
def stream_progress(spark, sf_dir):
    """Progress records appended in two parts, each read by a stream that stops and goes on where it was."""
    e = _table(spark, sf_dir, "events").selectExpr("event_type as model", "user_id % 20 as question", "event_id as n")
    path, state = sinks.landing(spark, "progress"), sinks.landing(spark, "state")
    for part in (e.where("n % 2 = 0"), e.where("n % 2 = 1")):
        sinks.append_records(part, path)
        out = progress.replayed(spark, path, "model string, question long, n long", state, ("model", "question"), "n")
    return out


@query("SELECT DISTINCT event_type AS model, user_id % 20 AS question FROM events WHERE event_type <> 'view' AND user_id % 20 > 4")
def stream_resume(spark, sf_dir):
    grid = _table(spark, sf_dir, "events").selectExpr("event_type as model", "user_id % 20 as question").distinct()
    path, state = sinks.landing(spark, "progress"), sinks.landing(spark, "state")
    sinks.append_records(grid.where("model = 'view' or question <= 4"), path)
    return progress.open_items(grid, progress.replayed(spark, path, "model string, question long", state, ("model", "question"), "question"), ("model", "question"))


@query("SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CAST(max(event_id) AS BIGINT) AS n FROM events GROUP BY 1")
def stream_merge(spark, sf_dir):
    """A rolling source of daily values in two files, merged into a history by day."""
    e = _table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id")
    path, state = (sinks.landing(spark, x) for x in ("rolling", "state"))
    for part in (e.where("event_id % 2 = 0"), e):
        part.groupBy("day").agg(F.max("event_id").alias("n")).write.mode("append").parquet(path)
        out = progress.merged_series(spark.readStream.schema("day string, n long").parquet(path), state, "day", "n")
    return out


@query("SELECT CAST(event_id % 3 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS input_rows, CAST(count(DISTINCT event_type || user_id) AS BIGINT) AS updated_rows FROM events GROUP BY 1")
def stream_listener(spark, sf_dir):
    """What a listener has recorded of a stream over a table that grows twice: each batch works on the new rows only."""
    e = _table(spark, sf_dir, "events").selectExpr("event_type as model", "user_id as question", "event_id as n")
    path, state, table = (sinks.landing(spark, x) for x in ("growing", "state", "progress"))
    with progress.listening(spark, progress.ProgressTable(spark, table)):
        for k in range(3):
            e.where(F.col("n") % 3 == k).write.mode("append").parquet(path)
            progress.last_records(spark.readStream.schema(e.schema).parquet(path), state, ("model", "question"), "n")
    return progress.progress_table(spark, table).where("event = 'progress' and input_rows > 0").select("batch", "input_rows", "updated_rows")


@query("SELECT event_type AS model, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def stream_watch(spark, sf_dir):
    """Finished results counted while their table grows, as often as the trigger says."""
    e = _table(spark, sf_dir, "events").selectExpr("event_type as model", "event_id as n")
    path, state = sinks.landing(spark, "results"), sinks.landing(spark, "state")
    e.where("n % 2 = 0").write.mode("append").parquet(path)
    query = progress.counted(spark.readStream.schema(e.schema).parquet(path), state, "model", every="1 second")
    e.where("n % 2 = 1").write.mode("append").parquet(path)
    progress.wait(query, lambda: query.lastProgress is not None and query.lastProgress["numInputRows"] == 0)
    return progress.counts_so_far(spark, state)


@query("SELECT event_type AS model, CAST(count(*) AS BIGINT) AS n, true AS stopped FROM events GROUP BY 1")
def stream_stop(spark, sf_dir):
    """Items worked off by a run that is asked to stop during its first batch, and by one that goes on from there: each item once."""
    e = _table(spark, sf_dir, "events").selectExpr("event_type as model", "event_id as n")
    path, state, out, flag = (sinks.landing(spark, x) for x in ("items", "state", "done", "stop"))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    e.repartition(parts, "n").write.parquet(path)

    def asking(batch: DataFrame) -> DataFrame:
        progress.ask_to_stop(spark, flag)
        return batch

    runs = [progress.worked_off(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", parts // 4).parquet(path), state, out, flag, work) for work in (asking, lambda batch: batch)]
    return progress.results(spark, out, e.schema).groupBy("model").agg(F.count("*").alias("n")).withColumn("stopped", F.lit(runs == [False, True]))


@query("SELECT '| p_size | n |' AS line UNION ALL SELECT '|---|---:|' UNION ALL SELECT '| ' || p_size || ' | ' || count(*) || ' |' FROM part GROUP BY p_size")
def sink_markdown(spark, sf_dir):
    return sinks.markdown_rows(_table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n")).orderBy("p_size"), ("n",))


@query("SELECT conv_id, string_agg('## File: ' || conv_id || '/' || lpad(CAST(turn AS VARCHAR), 4, '0') || '.txt' || chr(10) || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY turn) AS document FROM conversations GROUP BY conv_id")
def sink_merged_document(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select("conv_id", F.concat("conv_id", F.lit("/"), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit(".txt")).alias("path"), "text")
    return sinks.merged_document(c, "conv_id")


@query("SELECT 'c' || conv_id AS source_file, CAST(count(*) AS BIGINT) AS messages, string_agg(role, ',' ORDER BY turn) AS senders FROM conversations WHERE trim(text, ' ') <> '' GROUP BY conv_id")
def sink_merged_chats(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("source_file"), F.lit("t").alias("title"), F.col("turn").alias("n"), F.col("role").alias("sender"), "text")
    path = sinks.landing(spark, "chats")
    sinks.merged_chats(turns).write.json(path)
    back = spark.read.schema("source_file string, title string, messages array<struct<sender:string,text:string>>").json(path)
    return back.select("source_file", F.size("messages").cast("long").alias("messages"), F.array_join("messages.sender", ",").alias("senders"))


@query("SELECT c_nationkey, c_name || ' in ' || c_nationkey AS value FROM customer")
def sink_entities(spark, sf_dir):
    path = sinks.write_entities(_table(spark, sf_dir, "customer"), sinks.landing(spark, "entities"), "c_nationkey", F.concat("c_name", F.lit(" in "), "c_nationkey"))
    return spark.read.schema("value string, c_nationkey int").text(path)


@query("SELECT 'lauf_' || (max(s_suppkey) + 1) || '_20260101_next' AS name, CAST(max(s_suppkey) + 1 AS INTEGER) AS number FROM supplier")
def run_folder(spark, sf_dir):
    names = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("lauf_"), "s_suppkey", F.lit("_20251231_old_run")).alias("name"))
    last = names.agg((F.coalesce(F.max(F.regexp_extract("name", r"^lauf_(\d+)_(\d{8})_(.*)$", 1).try_cast("int")), F.lit(0)) + 1).alias("number"))
    return last.select(F.concat_ws("_", F.lit("lauf"), F.col("number").cast("string"), F.lit("20260101"), F.lit(None).cast("string"), F.lit("next")).alias("name"), "number")


# Files and audits


@query("SELECT 'n_regionkey=' || n_regionkey AS folder, CAST(sum(len(n_name) + 1) AS BIGINT) AS bytes, string_agg(n_name, ',' ORDER BY n_name) AS names, 40 AS sha_length FROM nation WHERE n_regionkey <> 3 GROUP BY n_regionkey")
def source_tree(spark, sf_dir):
    """A folder of text files, read back with one folder left out."""
    root = sinks.landing(spark, "tree")
    _table(spark, sf_dir, "nation").repartition("n_regionkey").select("n_regionkey", F.col("n_name").alias("value")).write.partitionBy("n_regionkey").text(root)
    found = files.text_files(spark, root, "*.txt", skip_dirs=("n_regionkey=3",), skip_names=("_SUCCESS",))
    names = F.array_join(F.array_sort(F.filter(F.split("text", "\n"), lambda x: x != "")), ",")
    return found.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), F.col("length").alias("bytes"), names.alias("names"), F.length("sha1").alias("sha_length"))


@query("""SELECT p_partkey AS id, CASE WHEN p_brand NOT IN ('Brand#1', 'Brand#2') THEN 'unlisted' WHEN f IS NULL THEN 'clear' ELSE 'affected' END AS status, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN f END AS "function"
  FROM (SELECT *, CASE WHEN p_brand = 'Brand#1' AND p_name = 'small ring' THEN 'Small_ring' WHEN contains(p_name, 'ring') THEN 'ring' WHEN p_brand = 'Brand#2' AND contains(p_name, 'widget') THEN 'widget' END AS f FROM part)""")
def audit_findings(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    vuln = F.struct(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("Bug in "), "p_name", F.lit("()")).alias("description"))
    audits = p.groupBy(F.col("p_size").cast("string").alias("path"), F.col("p_brand").alias("name")).agg(F.collect_list(vuln).alias("vulns"))
    audits = audits.groupBy("path").agg(F.to_json(F.struct(F.collect_list(F.struct("name", F.lit("1.0").alias("version"), "vulns")).alias("dependencies"))).alias("text"))
    used = spark.createDataFrame([("brand#1", "Small_ring"), ("Brand#1", "ring"), ("Brand#2", "ring"), ("Brand#2", "widget"), ("Brand#2", None)], "package string, function string")
    return audit.in_use(audit.vulnerabilities(audits), used).select(F.col("id").cast("long").alias("id"), "status", "function")


@query("SELECT u.id, u.score, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type AS id, event_id % 5 AS score FROM events WHERE event_id % 9 <> 4) u GROUP BY ALL")
def tolerant_lines(spark, sf_dir):
    """JSON lines, some of them broken or blank; those that are records count."""
    e = _table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 9 == 4, F.when(F.col("event_id") % 2 == 0, '{"id": "x", "sco').otherwise("  ")).otherwise(F.to_json(F.struct(F.col("event_type").alias("id"), (F.col("event_id") % 5).alias("score"))))
    path = sinks.landing(spark, "lines")
    e.select(line.alias("value")).write.text(path)
    good, _ = files.tolerant_json_lines(spark, path, "id string, score long")
    return good.groupBy("id", "score").agg(F.count("*").alias("n"))


# Series, orders, dimensions


@query("SELECT strftime(coalesce(v.d, c.d, p.d), '%Y-%m-%d') AS day, CAST(coalesce(v.n, 0) AS INTEGER) AS views, CAST(coalesce(c.n, 0) AS INTEGER) AS clicks, CAST(coalesce(p.n, 0) AS INTEGER) AS commits FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) v FULL JOIN (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'click' AND event_id % 3 = 0 GROUP BY 1) c ON v.d = c.d FULL JOIN (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1) p ON p.d = coalesce(v.d, c.d)")
def series_joined(spark, sf_dir):
    """Series of different days, outer-joined by day one after the other, gaps as 0."""
    e = _table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "event_id")
    views = e.where("event_type = 'view'").groupBy("day").agg(F.count("*").alias("views"))
    clicks = e.where("event_type = 'click' and event_id % 3 = 0").groupBy("day").agg(F.count("*").alias("clicks"))
    commits = _table(spark, sf_dir, "orders").where("year(o_orderdate) = 1998").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("commits"))
    rows = views.join(clicks, "day", "full_outer").join(commits, "day", "full_outer").na.fill(0)
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), *(F.col(c).cast("int").alias(c) for c in ("views", "clicks", "commits")))


@query("""SELECT strftime(day, '%Y-%m-%d') AS day, CAST(max_by(n, snap) AS BIGINT) AS n, CAST(max(snap) AS INTEGER) AS snap FROM (SELECT d AS day, snap, c + snap AS n FROM (SELECT CAST(ts AS DATE) AS d, s.snap AS snap, count(*) AS c FROM events, (VALUES (1), (2), (3)) s(snap) WHERE day(ts) % 3 <> s.snap % 3 GROUP BY 1, 2)) GROUP BY day""")
def traffic_history(spark, sf_dir):
    """Snapshots of a rolling series, days as mm/dd in the year of the snapshot's folder; the last snapshot of a day counts."""
    days = _table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    snapshots = days.select("d", "n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("snap")).where("day(d) % 3 != snap % 3")
    files_ = snapshots.select(F.format_string("2024-03-%02d_%d", F.lit(28), "snap").alias("folder"), F.concat(F.date_format("d", "MM/dd"), F.lit(';"'), F.col("n") + F.col("snap"), F.lit('"')).alias("line"))
    cells = F.from_csv("line", F.lit("day string, n long"), {"sep": ";"})
    rows = files_.select("folder", cells.alias("c")).select(text.snapshot_date(F.col("c.day"), F.to_date(F.substring("folder", 1, 10))).alias("day"), "c.n", "folder").where("day is not null")
    last = rows.groupBy("day").agg(F.max(F.struct("folder", "n")).alias("x"))
    return last.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "x.n", F.substring_index("x.folder", "_", -1).cast("int").alias("snap"))


@query(r"SELECT page_id, href, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first) AS INTEGER) AS pos FROM (SELECT page_id, href, min(i) AS first FROM (SELECT page_id, unnest(l) AS href, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href=.([^ >]+).>', 1) AS l FROM pages)) GROUP BY ALL)")
def ordered_distinct(spark, sf_dir):
    links = F.array_distinct(F.regexp_extract_all("html", F.lit("href=.([^ >]+).>"), F.lit(1)))
    return _table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("i", "href")).select("page_id", "href", (F.col("i") + 1).alias("pos"))


@query("""SELECT page_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder, regexp_replace(name, '([^.])[.][^.]*$', '\\1') AS stem, regexp_extract(name, '[^.]([.][^.]*)$', 1) AS extension FROM (SELECT page_id, path, regexp_extract(path, '[^/]*$') AS name FROM (SELECT page_id, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^[a-z]+://', '') AS path FROM pages))""".replace("\\\\", "\\"))
def path_parts(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.split("url", "[?#]")[0], "^[a-z]+://", "").alias("path"))
    return p.select("page_id", text.folder(F.col("path")).alias("folder"), text.stem(F.col("path")).alias("stem"), text.extension(F.col("path")).alias("extension"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'candidate' WHEN p_size > 20 THEN 'clear' ELSE 'fine' END AS rating, p_size >= 30 AS slow, p_retailprice > 950 AND p_size > 20 AS listed FROM part")
def threshold_ratings(spark, sf_dir):
    size = F.col("p_size")
    return _table(spark, sf_dir, "part").select("p_partkey", F.when(size > 40, "candidate").when(size > 20, "clear").otherwise("fine").alias("rating"), (size >= 30).alias("slow"), ((F.col("p_retailprice") > 950) & (size > 20)).alias("listed"))


@query("SELECT l_suppkey, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS best, bool_or(l_returnflag = 'R' AND l_linestatus NOT IN ('F')) AS drift, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS allowed, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_suppkey")
def status_by_module(spark, sf_dir):
    """Best rank, drift outside an allow-list, and counters per module."""
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    allowed = F.col("l_linestatus").isin("F")
    return _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min(rank).alias("best"), F.bool_or((F.col("l_returnflag") == "R") & ~allowed).alias("drift"), F.count_if(allowed).alias("allowed"), F.count("*").alias("n"))


@query("SELECT 'cat' || n_regionkey AS catalogue, m.model, n_name AS question, CAST(row_number() OVER (ORDER BY n_regionkey, m.ix, n_nationkey) AS INTEGER) AS pos FROM nation, (VALUES ('m1', 1), ('m2', 2)) m(model, ix) WHERE n_regionkey <> 4")
def catalogue_grid(spark, sf_dir):
    """Question catalogues found as files, each crossed with the models, in the order of catalogue, model and question."""
    root = sinks.landing(spark, "catalogues")
    n = _table(spark, sf_dir, "nation")
    body = F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("questions")))
    n.groupBy(F.when(F.col("n_regionkey") == 4, F.lit("other")).otherwise(F.concat(F.lit("cat"), "n_regionkey")).alias("catalogue")).agg(body.alias("value")).write.partitionBy("catalogue").text(root)
    found = files.text_files(spark, root, "*.txt").select(F.regexp_extract("path", "catalogue=([^/]+)/", 1).alias("catalogue"), F.posexplode(F.from_json("text", "questions array<string>")["questions"]).alias("ix", "question")).where("catalogue like 'cat%'")
    models = spark.createDataFrame([("m1", 1), ("m2", 2)], "model string, m int")
    pos = F.row_number().over(Window.orderBy("catalogue", "m", "ix"))  # a grid of a few dimensions
    return found.crossJoin(F.broadcast(models)).select("catalogue", "model", "question", pos.alias("pos"))


@query("""SELECT catalogue, variant, n_prompt, model, conv_id, turn, pos FROM (
  SELECT 'question_catalog_' || (conv_id % 7) AS catalogue, 'system_prompt_' || r_regionkey AS variant, CAST(length(trim(r_name)) AS INTEGER) AS n_prompt, m.model, conv_id, turn,
    CAST(row_number() OVER (ORDER BY conv_id % 7, r_regionkey, m.ix, conv_id, turn) AS INTEGER) AS pos
  FROM conversations, region, (VALUES ('small', 1), ('large', 2)) m(model, ix) WHERE role = 'user' AND conv_id % 7 <> 6 AND r_regionkey <> 4
) WHERE NOT (model = 'small' AND turn = 0)""")
def catalogue_runs(spark, sf_dir):
    """Questions of all catalogues that are found, under each prompt variant and model, in the order of the whole plan; what has a record is not asked again."""
    root = sinks.landing(spark, "catalogues")
    named = lambda name, key, other: F.concat(F.when(other, F.lit("draft_")).otherwise(F.lit("")), F.lit(name), key.cast("string"))
    asked = _table(spark, sf_dir, "conversations").where("role = 'user'")
    asked.select(named("question_catalog_", F.col("conv_id") % 7, F.col("conv_id") % 7 == 6).alias("catalogue"), F.to_json(F.struct("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"))).alias("value")).write.partitionBy("catalogue").text(root)
    regions = _table(spark, sf_dir, "region").withColumn("name", named("system_prompt_", F.col("r_regionkey"), F.col("r_regionkey") == 4))
    sinks.write_entities(regions, f"{root}_prompts", "name", F.concat(F.lit("  "), "r_name", F.lit("\n\n")))
    found = catalogues.questions(spark, root, "conv_id long, turn long, question string", "question")
    plan = catalogues.runs(found, catalogues.prompts(spark, f"{root}_prompts"), ["small", "large"], "conv_id", "turn")
    done = asked.where("turn = 0").selectExpr("conv_id", "turn", "'small' as model")
    left = progress.open_items(plan, done, ("conv_id", "turn", "model"))
    return left.select("catalogue", "variant", F.length("prompt").alias("n_prompt"), "model", "conv_id", "turn", "pos")


@query("SELECT DISTINCT p_brand AS module FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')")
def resume_by_file(spark, sf_dir):
    """Modules without a result file of their own; an empty file is no result."""
    modules = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("module")).distinct()
    root = sinks.landing(spark, "results")
    done = modules.where("module in ('Brand#1', 'Brand#2', 'Brand#3')").select(F.replace("module", F.lit("#"), F.lit("_")).alias("name"), F.lit('{"killed": 1}').alias("value"))
    done.write.partitionBy("name").text(root)
    present = files.text_files(spark, root, "*.txt").where("length > 0").select(F.replace(F.regexp_extract("path", "name=([^/]+)/", 1), F.lit("_"), F.lit("#")).alias("done")).distinct()
    return modules.join(present, F.col("module") == F.col("done"), "left_anti")
