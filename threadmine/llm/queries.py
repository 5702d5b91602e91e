"""One query per operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmine.llm import alignment, collocations, decontaminate, language, line_quality, mixture, neardup, quality_rules, ring, secrets, tokens, toxicity, warc
from threadmine.llm.common import documents
from threadmine.llm.registry import ORACLES, QUERIES, query  # noqa: F401


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query()
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), k=3, percent=85)


@query(decontaminate.ORACLE)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query(quality_rules.ORACLE)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")

    def joined(kinds: tuple[str, ...]):
        wanted = F.filter(spans, lambda s: s.kind.isin(*kinds))
        return F.concat_ws(",", F.transform(wanted, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))

    def number(kind: str):
        return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return secrets.scan_secrets(documents(spark, sf_dir)).select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(joined(secrets.KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        joined(secrets.KINDS).alias("spans"),
    )


@query()
def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality(documents(spark, sf_dir), _labels(spark, sf_dir))


@query()
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixture.mix_sources(docs).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


@query()
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.round_trip(spark, pages).drop("payload")


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), _labels(spark, sf_dir))


VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), tokens.read_vocabulary(path))


@query()
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.ring_shards(documents(spark, sf_dir))


@query(collocations.ORACLE)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


BYTE_LEVEL, PIECE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@query()
def op12_alignment(spark: SparkSession, sf_dir: str, a: str = BYTE_LEVEL, b: str = PIECE_LEVEL) -> DataFrame:
    with open(a, encoding="utf-8") as left, open(b, "rb") as right:
        sides = alignment.ByteLevel(left.read()), alignment.PieceLevel(right.read())
    return alignment.align_tokens(documents(spark, sf_dir), *sides)


@query()
def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.train(docs))
