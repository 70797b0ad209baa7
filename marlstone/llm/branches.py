"""Three-way merge of two branches of a corpus from sparse edit logs.

A branch is not stored as a second copy of the corpus but as a log of what it changes: one row for each unit that it
touches, and none for the rest. The logs of two branches meet in a full outer join on document and unit; each pair of
operations is classified there, and only the resolved operations of a document travel on to its text.

Units: `row` (the whole document), `lang`, `source`, `line` and `gap` (what is inserted after a line, even after one that
is dropped), the last two with the line's number from 0. Actions: `drop`; `edit` (value: the column's new value, for a
line what is appended to it); `insert` (value: the new line). Whole rows that a branch adds are logged apart: see `added`.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import mapped, table

#: Codes are crc32 of `branch:doc_id:name` modulo this; 0 drops, 1 and 2 edit, 3 and 4 insert or add, the rest do nothing.
CODES = 17
#: A row that a branch adds has this number less its document's id.
ADDED_FROM = {"L": -1, "R": -5}
_KEYS = ["id", "row_key", "unit", "pos"]
_SUMS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and source with nulls as empty strings, and the key of the row's log: id as text and a hash of the rest, so that rows that repeat an id keep apart."""
    text, lang, source = (F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source"))
    rows = docs.select("doc_id", text, lang, source)
    return rows.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("row_key", F.xxhash64("doc_id", "text", "lang", "source"))


def _code(branch: str, name) -> F.Column:
    return (F.crc32(F.concat(F.lit(f"{branch}:"), "id", F.lit(":"), name).cast("binary")) % CODES).cast("int")


def edit_log(base: DataFrame, branch: str) -> DataFrame:
    """The branch's operations on prepared rows: id, row_key, unit, pos, action, value. Only units whose code stands for a change have a row; a column that its edit leaves as it is has none. No text is carried."""
    sign = lambda code, one, two: F.when(code == one, F.lit("!")).when(code == two, F.lit("?"))
    entry = lambda unit, pos, action, value: F.struct(F.lit(unit).alias("unit"), pos.cast("long").alias("pos"), action.alias("action"), value.alias("value"))
    drop, edit, none, head = F.lit("drop"), F.lit("edit"), F.lit(None).cast("string"), F.lit(-1)

    def column(name):
        code = _code(branch, F.lit(name))
        value = F.when(code == 0, F.lit("")).when(code <= 2, F.concat(name, sign(code, 1, 2)))
        return F.when(value != F.col(name), entry(name, head, edit, value))

    def line(at):
        code = _code(branch, at.cast("string"))
        kept = F.when(code <= 2, entry("line", at, F.when(code == 0, drop).otherwise(edit), sign(code, 1, 2)))
        return F.coalesce(kept, F.when(code <= 4, entry("gap", at, F.lit("insert"), sign(code, 3, 4))))

    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n")))
    row = F.when(_code(branch, F.lit("row")) == 0, entry("row", head, drop, none))
    entries = F.concat(F.array(row, column("lang"), column("source")), F.transform(F.sequence(F.lit(0), breaks), line))
    found = base.select("id", "row_key", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("id", "row_key", "e.*")
    # rows that repeat as a whole log the same operations; the exchange serves the join as well
    return found.groupBy(*_KEYS).agg(F.first("action").alias("action"), F.first("value").alias("value"))


def added(base: DataFrame, branch: str) -> DataFrame:
    """Rows that the branch adds: doc_id, text, lang, source. A document without an id adds none; of several rows for one id the smallest by text, lang and source counts."""
    code = _code(branch, F.lit("row"))
    rows = base.where(code.isin(3, 4) & F.col("doc_id").isNotNull()).select((F.lit(ADDED_FROM[branch]).cast("long") - F.col("doc_id")).alias("doc_id"), F.struct(F.when(code == 3, "!").otherwise("?").alias("text"), "lang", "source").alias("row"))
    return rows.groupBy("doc_id").agg(F.min("row").alias("row"))


def resolved(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row a document that either log touches: id, row_key, gone (the merge has no such row), patches (operations of the result), and counts by class.

    One-sided and equal operations are clean. Others conflict, and the left one holds: inserts in one gap are
    insert_insert, a line that one side drops is edit_delete, the rest are edit_edit. A dropped row counts alone: as
    edit_delete if the other side keeps it with changes of its own, else as clean.
    """
    side = lambda log, s: log.select(*_KEYS, F.struct("action", "value").alias(s))
    pairs = side(left, "l").join(side(right, "r"), _KEYS, "full")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    kind = (
        F.when(~both | (F.col("l") == F.col("r")) | F.col("l").eqNullSafe(F.col("r")), "n_clean")
        .when(F.col("unit") == "gap", "n_insert_insert")
        .when((F.col("l.action") == "drop") | (F.col("r.action") == "drop"), "n_edit_delete")
        .otherwise("n_edit_edit")
    )
    pairs = pairs.withColumn("kind", kind).withColumn("inner", F.col("unit") != "row").withColumn("op", F.coalesce("l", "r"))
    patch = F.struct("unit", "pos", "op.action", "op.value", F.col("l").isNotNull().alias("left"))
    docs = pairs.groupBy("id", "row_key").agg(
        F.max(~F.col("inner") & F.col("l").isNotNull()).alias("l_drop"),
        F.max(~F.col("inner") & F.col("r").isNotNull()).alias("r_drop"),
        F.max(F.col("inner") & F.col("l").isNotNull()).alias("l_change"),
        F.max(F.col("inner") & F.col("r").isNotNull()).alias("r_change"),
        F.collect_list(F.when(F.col("inner"), patch)).alias("patches"),
        *(F.count_if(F.col("inner") & (F.col("kind") == k)).alias(k) for k in _SUMS),
    )
    dropped = F.col("l_drop") | F.col("r_drop")
    fought = (F.col("l_drop") & ~F.col("r_drop") & F.col("r_change")) | (F.col("r_drop") & ~F.col("l_drop") & F.col("l_change"))
    alone = {"n_clean": ~fought, "n_edit_delete": fought}
    return docs.select(
        "id",
        "row_key",
        (F.col("l_drop") | (F.col("r_drop") & ~F.col("l_change"))).alias("gone"),
        F.when(F.col("r_drop"), F.filter("patches", lambda p: p["left"])).otherwise(F.col("patches")).alias("patches"),
        *(F.when(dropped, alone.get(k, F.lit(False)).cast("long")).otherwise(F.col(k)).alias(k) for k in _SUMS),
    )


def _patched(text: str, patches: list[dict]) -> str:
    """The text with its lines' patches applied."""
    line = {p["pos"]: p for p in patches if p["unit"] == "line"}
    gap = {p["pos"]: p["value"] for p in patches if p["unit"] == "gap"}
    if not line and not gap:
        return text
    out = []
    for i, old in enumerate(text.split("\n")):
        op = line.get(i)
        if op is None:
            out.append(old)
        elif op["action"] == "edit":
            out.append(old + op["value"])
        if i in gap:
            out.append(gap[i])
    return "\n".join(out)


def applied(base: DataFrame, patches: DataFrame) -> DataFrame:
    """Prepared rows with resolved patches applied: doc_id, lang, source, text (nulls where the merge has no such row) and counts by class."""
    rows = base.join(patches, ["id", "row_key"], "left").select("doc_id", "lang", "source", "text", "gone", "patches", *(F.coalesce(k, F.lit(0)).alias(k) for k in _SUMS))
    kind = base.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "lang", "source", "text", *_SUMS]

    def run(batches):
        for b in batches:
            new: dict[str, list] = {"lang": [], "source": [], "text": []}
            columns = (b.column(i).to_pylist() for i in range(1, 6))
            for lang, source, text, gone, ops in zip(*columns):
                ops = ops or []
                edits = {p["unit"]: p["value"] for p in ops if p["unit"] in ("lang", "source")}
                new["lang"].append(None if gone else edits.get("lang", lang))
                new["source"].append(None if gone else edits.get("source", source))
                new["text"].append(None if gone else _patched(text, ops))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in new.values()), *(b.column(i) for i in range(6, 10))], names)

    return mapped(rows, run, f"doc_id {kind}, lang string, source string, text string, " + ", ".join(f"{k} long" for k in _SUMS))


def merged_added(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows added by either branch, the left one's where they differ, in the columns of `applied`."""
    pairs = left.withColumnRenamed("row", "l").join(right.withColumnRenamed("row", "r"), "doc_id", "full")
    fight = F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("l") != F.col("r"))
    counts = {"n_clean": ~fight, "n_insert_insert": fight}
    row = F.coalesce("l", "r").alias("row")
    return pairs.select("doc_id", row, *(F.coalesce(counts.get(k, F.lit(False)), F.lit(False)).cast("long").alias(k) for k in _SUMS)).select("doc_id", "row.lang", "row.source", "row.text", *_SUMS)


def merge(docs: DataFrame) -> DataFrame:
    """Branches L and R of docs merged: a row for each document, and one for each id at which a branch adds a row; doc_id, lang, source, text, n_clean, n_edit_edit, n_edit_delete, n_insert_insert.

    Nulls in text, lang and source count as empty; a null id is named by the empty string and adds no row. Rows that repeat
    an id are merged each for itself, each with a row; columns beyond the four play no part. An added row whose id is
    that of a document stands beside it. An empty table gives no rows.
    """
    base = prepared(docs)
    old = applied(base, resolved(edit_log(base, "L"), edit_log(base, "R")))
    return old.unionByName(merged_added(added(base, "L"), added(base, "R")))


def op11_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge of all of `documents`, texts as hashes."""
    return merge(table(spark, sf_dir, "documents")).withColumn("text", F.sha2("text", 256)).withColumnRenamed("text", "text_sha256")


_CRC = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""


def crc32_sql(text: str) -> str:
    """SQL for crc32 of an ASCII string; needs the table `crc` at hand."""
    return f"(4294967295 - list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"


CRC_TABLE_SQL = _CRC

ORACLE_SQL = f"""
WITH {_CRC}, base AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), lines AS (
  SELECT doc_id, pos, string_split(text, chr(10))[pos + 1] AS line FROM (SELECT doc_id, text, unnest(range(length(text) - length(replace(text, chr(10), '')) + 1)) AS pos FROM base)
), names AS (
  SELECT doc_id, CAST(pos AS VARCHAR) AS name FROM lines UNION ALL SELECT doc_id, unnest(['row', 'lang', 'source']) FROM base
), codes AS (
  SELECT doc_id, name, {crc32_sql("'L:' || doc_id || ':' || name")} % 17 AS cl, {crc32_sql("'R:' || doc_id || ':' || name")} % 17 AS cr FROM names, crc
), columns AS (
  SELECT doc_id, name, v, CASE cl WHEN 0 THEN '' WHEN 1 THEN v || '!' WHEN 2 THEN v || '?' ELSE v END AS lv, CASE cr WHEN 0 THEN '' WHEN 1 THEN v || '!' WHEN 2 THEN v || '?' ELSE v END AS rv
  FROM (SELECT doc_id, 'lang' AS name, lang AS v FROM base UNION ALL SELECT doc_id, 'source', source FROM base) JOIN codes USING (doc_id, name)
), units AS (
  SELECT doc_id, CASE WHEN lv <> v THEN 1 END AS l, CASE WHEN rv <> v THEN 1 END AS r, lv = rv AS same, 'n_edit_edit' AS kind FROM columns
  UNION ALL SELECT doc_id, CASE WHEN cl <= 2 THEN cl END, CASE WHEN cr <= 2 THEN cr END, cl = cr, CASE WHEN cl = 0 OR cr = 0 THEN 'n_edit_delete' ELSE 'n_edit_edit' END FROM codes WHERE name NOT IN ('row', 'lang', 'source')
  UNION ALL SELECT doc_id, CASE WHEN cl IN (3, 4) THEN cl END, CASE WHEN cr IN (3, 4) THEN cr END, cl = cr, 'n_insert_insert' FROM codes WHERE name NOT IN ('row', 'lang', 'source')
), counted AS (
  SELECT doc_id, count(l) AS l_changes, count(r) AS r_changes,
    count(*) FILTER ((l IS NOT NULL OR r IS NOT NULL) AND (l IS NULL OR r IS NULL OR same)) AS n_clean,
    count(*) FILTER (l IS NOT NULL AND r IS NOT NULL AND NOT same AND kind = 'n_edit_edit') AS n_edit_edit,
    count(*) FILTER (l IS NOT NULL AND r IS NOT NULL AND NOT same AND kind = 'n_edit_delete') AS n_edit_delete,
    count(*) FILTER (l IS NOT NULL AND r IS NOT NULL AND NOT same AND kind = 'n_insert_insert') AS n_insert_insert
  FROM units GROUP BY doc_id
), states AS (
  SELECT doc_id, pos, line, CASE WHEN cl <= 2 THEN cl END AS lo, CASE WHEN cl <= 2 THEN cl WHEN cr <= 2 THEN cr END AS mo, CASE WHEN cl IN (3, 4) THEN cl END AS lg, CASE WHEN cl IN (3, 4) THEN cl WHEN cr IN (3, 4) THEN cr END AS mg
  FROM lines JOIN codes USING (doc_id) WHERE name = CAST(pos AS VARCHAR)
), pieces AS (
  SELECT doc_id, pos, 0 AS part, CASE WHEN lo = 0 THEN NULL ELSE line || CASE lo WHEN 1 THEN '!' WHEN 2 THEN '?' ELSE '' END END AS lt, CASE WHEN mo = 0 THEN NULL ELSE line || CASE mo WHEN 1 THEN '!' WHEN 2 THEN '?' ELSE '' END END AS mt FROM states
  UNION ALL SELECT doc_id, pos, 1, CASE lg WHEN 3 THEN '!' WHEN 4 THEN '?' END, CASE mg WHEN 3 THEN '!' WHEN 4 THEN '?' END FROM states
), texts AS (
  SELECT doc_id, coalesce(string_agg(lt, chr(10) ORDER BY pos, part), '') AS lt, coalesce(string_agg(mt, chr(10) ORDER BY pos, part), '') AS mt FROM pieces GROUP BY doc_id
), drops AS (
  SELECT doc_id, cl = 0 AS ld, cr = 0 AS rd FROM codes WHERE name = 'row'
), merged AS (
  SELECT doc_id, ld OR rd AS alone, (ld AND NOT rd AND r_changes > 0) OR (rd AND NOT ld AND l_changes > 0) AS fought, ld OR (rd AND l_changes = 0) AS gone,
    CASE WHEN rd THEN a.lv WHEN a.lv <> a.v THEN a.lv ELSE a.rv END AS lang, CASE WHEN rd THEN b.lv WHEN b.lv <> b.v THEN b.lv ELSE b.rv END AS source,
    CASE WHEN rd THEN lt ELSE mt END AS text, n_clean, n_edit_edit, n_edit_delete, n_insert_insert
  FROM drops JOIN counted USING (doc_id) JOIN texts USING (doc_id) JOIN (SELECT doc_id, v, lv, rv FROM columns WHERE name = 'lang') a USING (doc_id) JOIN (SELECT doc_id, v, lv, rv FROM columns WHERE name = 'source') b USING (doc_id)
), new_l AS (
  SELECT -1 - doc_id AS doc_id, lang, source, CASE cl WHEN 3 THEN '!' ELSE '?' END AS text FROM base JOIN codes USING (doc_id) WHERE name = 'row' AND cl IN (3, 4)
), new_r AS (
  SELECT -5 - doc_id AS doc_id, lang, source, CASE cr WHEN 3 THEN '!' ELSE '?' END AS text FROM base JOIN codes USING (doc_id) WHERE name = 'row' AND cr IN (3, 4)
), news AS (
  SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN r.lang ELSE l.lang END AS lang, CASE WHEN l.doc_id IS NULL THEN r.source ELSE l.source END AS source, coalesce(l.text, r.text) AS text,
    l.doc_id IS NOT NULL AND r.doc_id IS NOT NULL AND (l.lang <> r.lang OR l.source <> r.source OR l.text <> r.text) AS fought
  FROM new_l l FULL JOIN new_r r ON l.doc_id = r.doc_id
)
SELECT doc_id, CASE WHEN NOT gone THEN lang END AS lang, CASE WHEN NOT gone THEN source END AS source, CASE WHEN NOT gone THEN sha256(text) END AS text_sha256,
  CASE WHEN alone THEN CAST(NOT fought AS BIGINT) ELSE n_clean END AS n_clean, CASE WHEN alone THEN 0 ELSE n_edit_edit END AS n_edit_edit,
  CASE WHEN alone THEN CAST(fought AS BIGINT) ELSE n_edit_delete END AS n_edit_delete, CASE WHEN alone THEN 0 ELSE n_insert_insert END AS n_insert_insert
FROM merged
UNION ALL SELECT doc_id, lang, source, sha256(text), CAST(NOT fought AS BIGINT), 0, 0, CAST(fought AS BIGINT) FROM news
"""
