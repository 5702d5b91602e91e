"""From raw documents to shards: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. It works on all rows that the stage before has
left; its result is written as Parquet and read again as the next one's ``docs``. Whole texts stay where they are read:
rows that a stage drops are found by short keys, and only rows that a Bloom filter of these keys lets through are shuffled. All but the last return the
columns of ``documents`` (and any others that came with them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmine.llm import decontaminate, mixture, neardup, ring, toxicity
from threadmine.operators.bloom import bloom_anti_join, bloom_semi_join
from threadmine.session import discard_staged, stage, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a null or empty text is scored like one without features."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean_rows(docs, model)


def _row_key() -> Column:
    """Names a row by doc_id and text, so that verdicts hold for that text alone; in the order of ids, null ids last."""
    text = [F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")]
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), text[0].alias("h1"), text[1].alias("h2"))


def _with_keys(docs: DataFrame) -> DataFrame:
    """(key, whole): a key for each row, and the row."""
    return docs.select(_row_key().alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("whole"))


def _searched(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with row keys for ids."""
    return docs.select(_row_key().alias("doc_id"), "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of like texts stays, the one with the smallest doc_id (null after all others).

    Each row is judged by its own text, whether its doc_id is null or repeated. Texts without words are in no group
    and stay; of those that repeat a doc_id and the text one stays.
    """
    found = stage(neardup.near_duplicates(_searched(docs)).select(F.col("doc_id").alias("key"), "n_shingles", "kept"), "groups")
    copies = stage(found.where(~F.col("kept")).select("key").distinct(), "copies")
    left = bloom_anti_join(_with_keys(docs), copies, ["key"])
    repeated = stage(found.where(F.col("kept") & ((F.col("n_shingles") > 0) | ~F.col("key.unnamed"))).groupBy("key").count().where(
        "count > 1").select("key"), "repeated")
    if repeated.isEmpty():
        return left.select("whole.*")
    # Written, so that tasks drop their own repeats before the rest meet.
    once = stage(bloom_semi_join(left, repeated, ["key"]), "once").dropDuplicates(["key"])
    return bloom_anti_join(left, repeated, ["key"]).unionByName(once.select("key", "whole")).select("whole.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text contains a benchmark item go, whether their doc_id is null or repeated."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = stage(decontaminate.contained_items(_searched(docs), items).select(F.col("doc_id").alias("key")).distinct(), "leaks")
    return bloom_anti_join(_with_keys(docs), leaks, ["key"]).select("whole.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is taken to its target: documents beyond it go, those of sources short of it come two or three times.

    Texts without words weigh nothing and go.
    """
    taken = mixture.mix_sources(docs, whole=True).where(F.col("taken") > 0)
    times = F.expr("taken div size").cast("int")
    return taken.select("row", F.explode(F.sequence(F.lit(1), times)).alias("time")).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; repetitions have slots of their own."""
    return ring.ring_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

# Trained models, MinHash groups and the ring can't be stated in SQL; tests/llm/test_pipeline.py holds
# each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        before = staged()
        docs = stage(function(spark, docs, sf_dir), name)
        discard_staged(spark, before, docs)  # what the stage wrote on its way; its result stays
    return docs
