"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

The distinct five-word shingles of a text are hashed once. The top bits of a hash name one of
BINS bins, each bin keeps its smallest hash. Empty bins are filled by optimal densification: each
walks the bins in a pseudo-random order of its own, the same for all documents, and copies
the first that is filled. Of each bin the BITS low-order bits are stored, packed
into hexadecimal digits. Two fingerprints agree in a bin by chance with probability 2**-BITS, so
likeness = (agreement - 2**-BITS) / (1 - 2**-BITS), at least 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import partitions, table

BINS, BITS, SHINGLE = 128, 8, 5
_LOG_BINS = BINS.bit_length() - 1


def fingerprint(text: str, k: int = SHINGLE) -> Column:
    """Hexadecimal fingerprint of the whole text in the named column; empty string for a text without words (null included).

    Fewer than k words make one shingle of all.
    """
    words = f"filter(split(coalesce({text}, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '')"
    top = 64 - _LOG_BINS
    # a chain of one-element transforms names intermediate arrays, so that none is computed twice
    shingles = f"""
      if(size(h) = 0, cast(array() as array<bigint>),
      if(size(h) < {k}, array(aggregate(h, 17L, (a, x) -> xxhash64(a, x))),
         transform(sequence(0, size(h) - {k}), i -> xxhash64({", ".join(f"h[i + {j}]" if j else "h[i]" for j in range(k))}))))"""
    firsts = f"filter(s, (x, i) -> i = 0 or shiftrightunsigned(x, {top}) != shiftrightunsigned(s[i - 1], {top}))"
    low = (1 << BITS) - 1
    # d holds the filled bins; an empty bin takes the bits of the filled bin that comes first in its own order of bins
    bin_of = f"cast(shiftrightunsigned(v, {top}) as int)"
    borrowed = f"array_min(transform(f, v -> (xxhash64({bin_of}, b) & {2**63 - 1 - low}L) | (v & {low}L)))"
    packed = f"""
      array_join(transform(sequence(0, {BINS - 1}), b -> lpad(hex(coalesce(d[b], {borrowed}) & {low}L), {BITS // 4}, '0')), '')"""
    named = lambda var, value, body: f"transform(array({value}), {var} -> {body})[0]"
    return F.lower(F.expr(named("h", f"transform({words}, w -> xxhash64(w))", named("s", f"sort_array({shingles})", named("f", firsts, named("d", f"map_from_arrays(transform(f, v -> {bin_of}), f)", f"if(size(f) = 0, '', {packed})"))))))


def likeness(a: str, b: str) -> Column:
    """Bias-corrected share of agreeing bins; two empty fingerprints are alike (1.0), an empty and another are not (0.0)."""
    d, chance = BITS // 4, 2.0**-BITS
    agree = f"aggregate(sequence(0, {BINS - 1}), 0, (n, i) -> n + if(substring({a}, i * {d} + 1, {d}) = substring({b}, i * {d} + 1, {d}), 1, 0)) / {float(BINS)}D"
    return F.expr(f"case when {a} = {b} then 1.0D when {a} = '' or {b} = '' then 0.0D else greatest(0.0D, ({agree} - {chance}D) / {1 - chance}D) end")


def with_next(docs: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """Adds next_<c> for c in carried: the values of the row after this one by key, of the first row after the last.

    Rows go to ranges of the key that hold about equally many, null keys to ranges of the hash of the first carried column; the first row of
    each range also goes, as an extra row, to the range before it. Rows are ordered by key, nulls first, then by that hash. Only
    bounds and the first key and hash of each range are gathered: a few hundred.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    ids = docs.select(key).where(F.col(key).isNotNull())
    cuts = ids.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n).alias("c")).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    if cuts:
        steps = len(cuts).bit_length()
        bounds = F.lit(cuts)
        mid = lambda s: ((s["lo"] + s["hi"]) / 2).cast("int")
        bucket = F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")),
            lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(bounds, mid(s)) <= F.col(key), F.struct((mid(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid(s).alias("hi"))),
            lambda s: s["lo"],
        )
    else:
        bucket = F.lit(0)
    at = docs.withColumn("_h", F.xxhash64(carried[0]))
    by_hash = (F.floor((F.col("_h").cast("double") + 2.0**63) * (n / 2.0**64)).cast("int") - n).cast("int")  # -n to -1
    at = at.withColumn("_b", F.when(F.col(key).isNull(), F.greatest(F.lit(-n), F.least(by_hash, F.lit(-1)))).otherwise(bucket))
    heads = at.groupBy("_b").agg(F.min(F.struct(F.col(key).alias("k"), "_h")).alias("first")).orderBy("_b").collect()
    if not heads:
        return docs.select("*", *(F.col(c).alias(f"next_{c}") for c in carried))
    kind, by_bucket = docs.schema[key].dataType.simpleString(), {h["_b"]: h["first"] for h in heads}
    buckets, places = sorted(by_bucket), range(-n, max(0, max(by_bucket)) + 1)
    before = {b: buckets[i - 1] for i, b in enumerate(buckets)}
    listed = lambda values, kind: F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>")
    of = lambda values, kind: F.get(listed(values, kind), F.col("_b") + n)
    is_head = F.col(key).eqNullSafe(of([by_bucket[b]["k"] if b in by_bucket else None for b in places], kind)) & (F.col("_h") == of([by_bucket[b]["_h"] if b in by_bucket else None for b in places], "bigint"))
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("extra"))
    copies = F.when(is_head, F.array(own, F.struct(of([before.get(b) for b in places], "int").alias("b"), F.lit(True).alias("extra")))).otherwise(F.array(own))
    rows = at.select("*", F.explode(copies).alias("_at"))
    w = Window.partitionBy("_at.b").orderBy("_at.extra", F.col(key).asc_nulls_first(), "_h", *(F.xxhash64(c) for c in carried[1:]))
    return rows.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried)).where(~F.col("_at.extra")).drop("_at", "_b", "_h")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprint of its text and of its edited text, and both likenesses.

    Null texts count as empty. Repeated ids are taken in the order of id, then text hash; null ids come first. A single
    row is its own next document. An empty table gives an empty result; other columns are not read.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fingerprint", fingerprint("text"))
    rows = with_next(own, "doc_id", ["text", "fingerprint"]).withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = rows.select("*", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint("edited").alias("edited_fingerprint")).drop("edited")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all of `documents` and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
