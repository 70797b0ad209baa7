"""Relations between the files of a source tree, from the facts of `pyast`: imports, calls, symbols.

All lookups are equi-joins on names. The index of modules has one row a key: when several files have one stem, the last by path counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import sinks
from . import pyast


#: Keys that are looked up, at most, for which the index is broadcast.
BROADCAST_KEYS = 100_000


def fact_table(files: DataFrame, *kinds: str) -> DataFrame:
    """The facts of files (path, text), or those of the named kinds, written once to the shared folder by kind and read from there: relations share one parse, and each reads only the kinds that it names."""
    return sinks.kept(pyast.python_facts(files, *kinds), "facts", "kind")


def module_index(files: DataFrame) -> DataFrame:
    """key, target: each file by its stem and by its dotted path; files: path."""
    stem = F.regexp_extract("path", r"([^/]+)\.py$", 1)
    dotted = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    keys = files.select(F.explode(F.array_distinct(F.array(stem, dotted))).alias("key"), "path")
    return keys.groupBy("key").agg(F.max("path").alias("target"))


def _dealt(df: DataFrame) -> DataFrame:
    """df, never broadcast: the plan takes tables that are made from small ones for small."""
    return df.hint("merge")


def _held(index: DataFrame, keys: DataFrame):
    """What the index (key, target) holds of keys (key), stored, and the hint for joins with it.

    The different keys are stored and counted first: names repeat, so they are few beside the rows they stand in, and only what the index holds of them
    is joined; the index is made once for it. Few enough are broadcast, so that rows are not shuffled by names of which one may be in every file; for more of them the joins shuffle.
    """
    asked = sinks.kept(keys.where("key is not null").distinct(), "asked")
    few = F.broadcast if asked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else _dealt
    return sinks.kept(index.join(few(asked), "key", "left_semi"), "held"), few


def _looked_up(rows: DataFrame, held, *keys: str) -> DataFrame:
    """rows with target: that of the first of the named columns that is in the index, null if none is."""
    (index, few), found = held, rows
    for n, key in enumerate(keys):
        found = found.join(few(index.select(F.col("key").alias(f"_key{n}"), F.col("target").alias(f"_target{n}"))), F.col(key) == F.col(f"_key{n}"), "left")
    return found.withColumn("target", F.coalesce(*(F.col(f"_target{n}") for n in range(len(keys))))).drop(*(c for n in range(len(keys)) for c in (f"_key{n}", f"_target{n}")))


def resolved_imports(facts: DataFrame, files: DataFrame) -> DataFrame:
    """path, lineno, full, module, resolved: the file an import names, by its full name, else by its first part; null: external."""
    rows = facts.where("kind = 'import'").select("path", "lineno", F.col("name").alias("full"), F.col("detail").alias("module"))
    held = _held(module_index(files), rows.select(F.explode(F.array("full", "module")).alias("key")))
    return _looked_up(rows, held, "full", "module").withColumnRenamed("target", "resolved")


def degrees(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: internal imports and importing files, and whether it is a leaf, an entry or coupled (five importers or more)."""
    inside = imports.where("resolved is not null")
    out = inside.groupBy("path").agg(F.count("*").alias("imports"))
    into = inside.groupBy(F.col("resolved").alias("path")).agg(F.count_distinct("path").alias("importers"))
    rows = files.select("path").join(_dealt(out), "path", "left").join(_dealt(into), "path", "left").na.fill(0, ["imports", "importers"])
    return rows.select("*", (F.col("imports") == 0).alias("is_leaf"), (F.col("importers") == 0).alias("is_entry"), (F.col("importers") >= 5).alias("coupled"))


def call_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """caller, lineno, func, via, callee: calls on a receiver named like a module, and of names imported from one; not within one file."""
    calls = facts.where("kind = 'call'")
    on = calls.where("mode = 'attribute'").select("path", "lineno", F.col("name").alias("func"), "detail")
    names = facts.where("kind = 'alias'").select("path", "lineno", "name", "mode", "detail", F.split("detail", r"\.")[0].alias("top"))
    # receivers and modules are looked up together; each side's are made different first, as the union would carry them all
    held = _held(module_index(files), on.select(F.col("detail").alias("key")).distinct().unionAll(names.select("detail").distinct().select(F.explode(F.array("detail", F.split("detail", r"\.")[0])).alias("key"))))
    on_module = _looked_up(on, held, "detail").withColumn("via", F.lit("attribute"))
    known = _looked_up(names, held, "detail", "top").where("target is not null and target != path")
    last = known.groupBy(F.col("path").alias("_path"), "name").agg(F.max(F.struct("lineno", "mode", "target")).alias("a"))  # the last import of a name counts
    direct = calls.where("mode = 'direct' and array_contains(flags, 'imported')").select("path", "lineno", "name").join(_dealt(last), "name").where("path = _path").select("path", "lineno", F.col("a.mode").alias("func"), F.col("a.target").alias("target"), F.lit("from-import").alias("via"))
    both = on_module.where("target is not null and target != path").select("path", "lineno", "func", "via", "target").unionByName(direct)
    return both.select(F.col("path").alias("caller"), "lineno", "func", "via", F.col("target").alias("callee"))


def symbols(facts: DataFrame) -> DataFrame:
    """path, owner, name, kind, internal, shown, doc: functions and methods at the top of a module with signatures, constants (capitals) with values, classes with attributes."""
    top = F.array_contains("flags", "top")
    upper = (F.upper("name") == F.col("name")) & (F.lower("name") != F.col("name"))
    kept = facts.where(((F.col("kind") == "function") & top) | ((F.col("kind") == "class") & top) | ((F.col("kind") == "assign") & upper))
    kind = F.when(F.col("kind") == "assign", "constant").otherwise(F.col("kind"))
    shown = F.when(F.col("kind") == "class", F.array_join("names", ", ")).otherwise(F.col("detail"))
    return kept.select("path", "owner", "name", kind.alias("kind"), F.col("name").startswith("_").alias("internal"), shown.alias("shown"), "doc")


def import_relations(facts: DataFrame, files: DataFrame) -> DataFrame:
    """path, name, relation, source, shown: names imported at the top of a file and where they are defined.

    A file is a facade if at least three such names, and more than 60 % of them, are not used in it; only then are unused names
    looked up. The module's file is the first of these that exists: next to the importing file, below the root; for a
    relative import, below the folder it starts at; as module before package. relation is facade (unused), neighbour (used)
    or unresolved.
    """
    names = facts.where("kind = 'alias'").where(F.array_contains("flags", "top")).groupBy("path", "name").agg(F.max(F.struct("lineno", "mode", "detail", "value", F.array_contains("flags", "used").alias("used"))).alias("a")).select("path", "name", "a.*")
    per_file = names.groupBy(F.col("path").alias("_path")).agg(F.count_if(~F.col("used")).alias("unused"), F.count("*").alias("n"))
    facade = (F.col("unused") >= 3) & (F.col("unused") > 0.6 * F.col("n"))
    wanted = names.join(_dealt(per_file), F.col("path") == F.col("_path")).where(facade | F.col("used")).select("path", "name", F.col("mode").alias("original"), "used", "detail", "value")
    module = F.replace("detail", F.lit("."), F.lit("/"))
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    below = lambda up: F.concat(F.array_join(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - up, F.lit(0))), "/"), F.lit("/"), module)
    bases = F.when(F.col("value") > 0, F.array(below(F.col("value").cast("int") - 1))).otherwise(F.array(below(F.lit(0)), module))
    candidates = F.transform(F.flatten(F.transform(bases, lambda b: F.array(F.concat(b, F.lit(".py")), F.concat(b, F.lit("/__init__.py"))))), lambda p: F.ltrim(p, F.lit("/")))
    tried = wanted.select("*", F.posexplode(candidates).alias("pos", "candidate")).join(_dealt(files.select(F.col("path").alias("_file"))), F.col("candidate") == F.col("_file"))
    first = tried.groupBy(F.col("path").alias("_p"), F.col("name").alias("_n")).agg(F.min_by("candidate", "pos").alias("target"))
    placed = wanted.join(_dealt(first), (F.col("path") == F.col("_p")) & (F.col("name") == F.col("_n")), "left").drop("_p", "_n")
    defined = facts.where("(kind = 'assign') or (kind = 'function' and array_contains(flags, 'top') and owner = '<module>')")
    defined = defined.groupBy(F.col("path").alias("_p"), F.col("name").alias("_n")).agg(F.min_by("detail", "lineno").alias("shown"))
    found = placed.join(_dealt(defined), (F.col("target") == F.col("_p")) & (F.col("original") == F.col("_n")), "left")
    relation = F.when(F.col("_p").isNull(), "unresolved").when(F.col("used"), "neighbour").otherwise("facade")
    return found.select("path", "name", relation.alias("relation"), F.col("_p").alias("source"), "shown")


def signatures(wanted: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    """wanted (path, signature) with status: file_missing, ok or missing.

    "def name" and "class name" are looked up among all functions and classes of a file, anything else in its text; nothing is found in a file that does not parse.
    """
    s = F.trim("signature")
    kind = F.when(s.startswith("def "), "function").when(s.startswith("class "), "class").otherwise("text")
    name = F.trim(F.regexp_extract(s, r"^(?:def|class) ([^(:]*)", 1))
    # all sides are dealt by path, once each, and none is broadcast: how long texts are is not known to the plan
    texts = files.select(F.col("path").alias("_file"), F.col("text").alias("_text"))
    named = F.collect_set(F.when(F.col("kind") != "error", F.concat_ws(" ", "kind", "name"))).alias("_names")
    defined = facts.where("kind in ('function', 'class', 'error')").groupBy(F.col("path").alias("_p")).agg(named, F.bool_or(F.col("kind") == "error").alias("_broken"))
    rows = wanted.join(_dealt(texts), F.col("path") == F.col("_file"), "left")
    rows = rows.select(*wanted.columns, "_file", kind.alias("_kind"), F.concat_ws(" ", kind, name).alias("_name"), F.when(kind == "text", F.contains("_text", s)).alias("_held"))
    rows = rows.join(_dealt(defined), F.col("path") == F.col("_p"), "left")
    there = F.coalesce(F.when(F.col("_kind") == "text", F.col("_held")).otherwise(F.array_contains("_names", F.col("_name"))), F.lit(False))
    status = F.when(F.col("_file").isNull(), "file_missing").when(~F.coalesce("_broken", F.lit(False)) & there, "ok").otherwise("missing")
    return rows.select(*wanted.columns, status.alias("status"))
