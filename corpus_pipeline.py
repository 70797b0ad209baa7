"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, secrets are
masked, sources are mixed to their weights, and the result is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marlstone.llm import mixing, neardup, packing, secrets, toxicity

#: Not expressible in SQL: learned models, sketches and packing. Tests hold the stages against brute force.
ORACLE_SQL = None


def _free(name: str, docs: DataFrame) -> str:
    """The name, with as many underscores as it takes to be none of the table's."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold; labels come from the corpus's table of labels. Rows that repeat go or stay together."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = _free("toxicity_score", docs)
    return toxicity.judged(docs, model, name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles, 0.8 or more); documents without words or without an id stay.

    Rows that repeat an id and a text go or stay together; of an id with several texts only the rows go whose text is a copy.
    """
    gone = neardup.near_duplicates(docs, k=5, hashed=True).where("not kept").select("doc_id", "text_hash").distinct().toDF("gone_id", "gone_hash")
    same = (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"])
    return docs.join(gone, same, "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by [SECRET]; n_chars follows the text."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, with its output shard and the key that orders it there.

    Rows that repeat an id and a text share the places of all of them in turn, whatever their other columns.
    """
    at, nth, places, place = (_free(x, docs) for x in ("row_at", "row_nth", "row_places", "row_place"))
    taken = mixing.mix(docs, hashed=True).select("row_hash", F.arrays_zip(F.col("shards").alias("shard"), F.col("orders").alias("shard_order")).alias("p"))
    taken = taken.groupBy(F.col("row_hash").alias(at)).agg(F.sort_array(F.collect_list("p")).alias(places))
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # what can be hashed
    rows = docs.withColumn(nth, F.row_number().over(Window.partitionBy(mixing.row_hash()).orderBy(F.xxhash64(*plain)))).withColumn(f"{at}_", mixing.row_hash())
    rows = rows.join(taken, F.col(f"{at}_") == F.col(at)).withColumn(place, F.explode(F.get(places, F.col(nth) - 1)))
    return rows.select(*docs.columns, F.col(f"{place}.shard").alias(_free("shard", docs)), F.col(f"{place}.shard_order").alias(_free("shard_order", docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their place in sequences of at most 4096 tokens."""
    return packing.pack(packing.pieces(docs, packing.vocabulary()))


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`: each works on what the one before kept, written and read again."""
    from marlstone.llm.shared import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
