"""Spark's own form of queries whose one-statement form would not hold at scale: no recursion, nested loops, single partitions or null-aware anti joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import sinks
from ..functions import text
from ..operators import automaton, chunks, intervals, merkle, phrases, ranking, rules
from . import dialect

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def doc_chunks(spark, sf_dir):
    long = _table(spark, sf_dir, "documents").where("length(text) > 8000")
    rows = long.select("doc_id", F.posexplode(chunks.chunks()).alias("pos", "c"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("idx"), F.col("c.s").alias("start_at"), F.col("c.e").alias("end_at"), (F.col("c.e") - F.col("c.s")).alias("len"))


@query
def doc_chunk_merge(spark, sf_dir):
    return chunks.summarised(_table(spark, sf_dir, "documents").where("length(text) > 8000"))


def _stats(spark, sf_dir):
    """Of each document: its language and source, and its lines, words and characters."""
    t = F.coalesce("text", F.lit(""))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"))) + F.when((t != "") & (F.right(t, F.lit(1)) != "\n"), 1).otherwise(0)
    return _table(spark, sf_dir, "documents").select("lang", "source", lines.cast("long").alias("n_lines"), text.word_counts("text").alias("n_words"), F.length(t).cast("long").alias("n_chars"))


@query
def text_stats_by_lang(spark, sf_dir):
    sums = [F.count("*").alias("n_files"), *(F.sum(c).alias(c) for c in ("n_lines", "n_words", "n_chars"))]
    return _stats(spark, sf_dir).rollup("lang").agg(*sums).select(F.coalesce("lang", F.lit("TOTAL")).alias("label"), "n_files", "n_lines", "n_words", "n_chars")


@query
def text_stats_by_source_top(spark, sf_dir):
    sums = [F.count("*").alias("n_files"), *(F.sum(c).alias(c) for c in ("n_lines", "n_words", "n_chars"))]
    return _stats(spark, sf_dir).groupBy("source").agg(*sums).orderBy(F.desc("n_chars"), "source")


def _titles(spark, sf_dir):
    """doc_id and a hash of the normalized text, so that texts are not shuffled."""
    return _table(spark, sf_dir, "documents").select("doc_id", text.title_hashes("text").alias("k"))


@query
def doc_dedup_latest(spark, sf_dir):
    return _titles(spark, sf_dir).groupBy("k").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


@query
def doc_dup_skipped(spark, sf_dir):
    rows = _titles(spark, sf_dir)
    kept = rows.groupBy(F.col("k").alias("_k")).agg(F.max("doc_id").alias("kept_id"), F.count("*").alias("n")).where("n > 1")
    return rows.join(kept, F.col("k").eqNullSafe(F.col("_k"))).where("doc_id != kept_id").select("doc_id", "kept_id")


_RULES = [("contact", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "email"), ("contact", "[+][0-9][0-9 ().-]+", "phone"), ("legal", "[Ll]icen[sc]e", "license"), ("number", "[0-9][0-9][0-9]+", "digits")]


def _hits(spark, sf_dir):
    found = rules.hits(_table(spark, sf_dir, "documents"), [r[:2] for r in _RULES], key="doc_id")
    label = F.create_map(*(F.lit(x) for _, p, name in _RULES for x in (p, name)))
    return found.withColumn("rule", F.element_at(label, F.col("pattern")))


@query
def rule_hits(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", "lineno", "target", "rule")


@query
def rule_hits_by_target(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), "quality")
    rows = _hits(spark, sf_dir).select("doc_id", "target").join(labels, F.col("doc_id") == F.col("_id"), "left")
    verdict = F.when(F.col("quality") == 1, "relevant").when(F.col("quality") == 0, "not_relevant").otherwise("unsure")
    return rows.groupBy("target").agg(*(F.count_if(verdict == v).alias(v) for v in ("relevant", "not_relevant", "unsure")), F.count("*").alias("total"))


@query
def hit_context(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", "lineno", "target", (F.regexp_count("context", F.lit("\n")) + 1).cast("long").alias("n"), "context")


def _versions(spark, sf_dir):
    """Two versions of the documents of each source: source, doc_id, hash."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("e"), F.lit("a"))).otherwise(F.col("text"))
    hashed = lambda rows: rows.select("source", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return hashed(d.where("doc_id % 10 != 1")), hashed(d.where("doc_id % 10 != 2").withColumn("text", edited))


@query
def hash_status(spark, sf_dir):
    """Roots of two versions of each source's hash tree."""
    one, two = _versions(spark, sf_dir)
    return merkle.status(merkle.tree(one, "source", "doc_id", "hash"), merkle.tree(two, "source", "doc_id", "hash")).withColumnRenamed("group", "source")


@query
def hash_changed(spark, sf_dir):
    """The members that differ between two versions, found from the roots of their trees."""
    return merkle.changed_members(*_versions(spark, sf_dir), "source", "doc_id", "hash")


@query
def composite_hash(spark, sf_dir):
    """One hash over all members of a nation in order, with a placeholder for a member that is missing; null if all are."""
    c = _table(spark, sf_dir, "customer").where("c_nationkey != 3 or c_custkey % 4 = 0")
    members = c.select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.sha2(F.col("c_name").cast("binary"), 256)).alias("hash"))
    return merkle.roots(merkle.tree(members, "c_nationkey", "c_custkey", "hash")).select(F.col("group").alias("c_nationkey"), F.col("hash").alias("composite"))


@query
def silo_gaps(spark, sf_dir):
    """Users of a day with one kind of event and without another, both ways."""
    e = _table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    seen = e.where("user_id is not null").groupBy("user_id", "day").agg(*(F.bool_or(F.col("event_type") == t).alias(t) for t in ("view", "click", "purchase")))
    pairs = F.array(*(F.when(F.col(a) & ~F.col(b), F.lit(f"{a}_without_{b}")) for a, b in (("view", "click"), ("click", "view"), ("purchase", "click"), ("click", "purchase"))))
    return seen.select(F.explode(F.array_compact(pairs)).alias("gap"), "user_id", "day")


@query
def backfill_candidates(spark, sf_dir):
    """Days with a view that no processed day covers, beyond the first three; a row a day."""
    e = _table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    done = e.where("event_type = 'purchase' and user_id % 50 = 0").select(F.col("day").alias("_day")).distinct()
    left = e.where("event_type = 'view'").select("day").distinct()
    return ranking.numbered(left.join(done, F.col("day") == F.col("_day"), "left_anti"), "pos", F.col("day")).where("pos > 3")


@query
def nulls_last_sort(spark, sf_dir):
    c, o = _table(spark, sf_dir, "customer").select("c_custkey"), _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("t"))
    rows = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "t")
    return ranking.numbered(rows, "pos", F.asc_nulls_last("t"), F.asc("c_custkey")).select("c_custkey", "pos")


@query
def interval_overlap(spark, sf_dir):
    """Pairs of a user's views of which one begins within the hour of the other."""
    at = F.expr(dialect.Spark.seconds("ts"))
    v = _table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", "event_id", at.alias("s"), (at + 3600).alias("e"))
    return intervals.overlaps(v, "user_id", "event_id", "s", "e")


@query
def interval_any(spark, sf_dir):
    """Overlaps of intervals from five seconds to a week."""
    at = F.expr(dialect.Spark.seconds("ts"))
    length = F.coalesce(F.get(F.array(*map(F.lit, (5, 60, 900, 7_200, 86_400, 604_800))), (F.col("event_id") % 6).cast("int")), F.lit(604_800))  # ids below 0 too
    v = _table(spark, sf_dir, "events").where("event_type in ('click', 'purchase')").select("user_id", "event_id", at.alias("s"), (at + length).alias("e"))
    return intervals.overlaps(v, "user_id", "event_id", "s", "e")


@query
def phrase_coverage(spark, sf_dir):
    """Names of all parts, and the first words of all benchmark items, and in how many documents and places they stand as phrases."""
    index = phrases.index(_table(spark, sf_dir, "documents"), "doc_id")
    asked = _table(spark, sf_dir, "part").select(F.col("p_name").alias("text")).unionAll(_table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.split("text", "[^A-Za-z]+"), 1, 3), " ").alias("text"))).distinct().withColumn("phrase", F.col("text"))
    hits = phrases.found(index, asked, "doc_id", "phrase").groupBy(F.col("phrase").alias("_phrase")).agg(F.count("*").alias("documents"), F.sum("n").alias("places"))
    rows = asked.join(hits, F.col("phrase") == F.col("_phrase"), "left")
    return rows.select("phrase", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "places")))


@query
def series_retention(spark, sf_dir):
    """One fold over the distinct days: the first, each that is 13 or more days after the last kept, and the last."""
    days = _table(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).distinct().agg(F.sort_array(F.collect_list("d")).alias("ds"))
    kept = F.aggregate("ds", F.array().cast("array<date>"), lambda k, d: F.when((F.size(k) == 0) | (F.date_diff(d, F.try_element_at(k, F.lit(-1))) >= 13), F.concat(k, F.array(d))).otherwise(k))
    return days.select(F.explode(F.array_union(kept, F.slice("ds", -1, 1))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))


@query
def contains_longest(spark, sf_dir):
    """The longest item that a document holds, and how many it holds; all items are looked for in one pass over a text."""
    found = automaton.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return found.groupBy("doc_id").agg(F.max_by("item_id", F.struct("size", -F.col("item_id"))).alias("item_id"), F.count("*").alias("n"))


@query
def rule_index(spark, sf_dir):
    """Rules made of each benchmark item: its first three words as text, its last two with any blanks between them, and text that is no regular expression; the first rule of a line and target counts."""
    items = sinks.bounded(_table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.regexp_extract("text", "^([^ \n]+ [^ \n]+ [^ \n]+)", 1).alias("head"), F.regexp_extract("text", "([a-z]+)[ ]+([a-z]+)[.]?$", 1).alias("last"), F.regexp_extract("text", "([a-z]+)[ ]+([a-z]+)[.]?$", 2).alias("end")).orderBy("item_id"))
    listed = [(f"t{r.item_id % 3}", p) for r in items for p in (re.sub(r"([.+*?()\[\]{}|^$\\])", r"\\\1", r.head) if r.head else None, f"{r.last}[ ]+{r.end}" if r.last else None, f"({r.item_id}(") if p]
    return rules.hits(_table(spark, sf_dir, "documents"), listed, key="doc_id").select("doc_id", "lineno", "target", "pattern")


@query
def superset_label(spark, sf_dir):
    """Short texts, and whether they are the last of their kind; texts are compared by their hashes."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("k"), F.length("text").alias("n"))
    last = d.groupBy("k").agg(F.max("doc_id").alias("last")).select("last")
    rows = d.where("n < 500").join(last, F.col("doc_id") == F.col("last"), "left")
    return rows.select("doc_id", F.when(F.col("last").isNull(), "test_only").otherwise("everywhere").alias("status"))
