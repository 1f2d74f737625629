"""Registered queries of the operators: whole tables, production parameters, result columns by contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.collocations import mine_collocations
from quarry.llm.common import table
from quarry.llm.hosts import judge_urls
from quarry.llm.lattice import score_documents
from quarry.llm.mixing import mix
from quarry.llm.near_embeddings import near_duplicates
from quarry.llm.ngram_join import jaccard_components
from quarry.llm.oracles import ORACLE  # noqa: F401
from quarry.llm.packing import pack_documents
from quarry.llm.pieces import encoding_digests
from quarry.llm.quality import quality_verdicts
from quarry.llm.secret_scan import KINDS, find_secrets, joined_spans
from quarry.llm.sharding import shard_rows
from quarry.llm.spelling import spelling_variants
from quarry.llm.toxicity import score_toxicity, train_toxicity


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("places")).alias("taken"),
                      F.transform("places", lambda p: p["shard"]).alias("shards"),
                      F.transform("places", lambda p: p["order"]).alias("orders"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of equal id stand in for labelled page outcomes: low quality counts as bad."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")
    return found.select("doc_id", count(0), count(1), count(2),
                        F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"),
                        joined_spans(F.concat("base", "live")).alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "cost")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_embedding_near_dedup, op2_quality_rules, op3_sharding, op4_lm_scoring, op5_mixing, op6_url_filters,
        op7_sentencepiece, op8_secret_scans, op9_toxicity, op10_ngram_jaccard_join, op11_packing,
        op12_spelling_variants, op13_collocations)}
