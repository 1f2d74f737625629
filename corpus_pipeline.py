"""Corpus pipeline: raw documents to token ids in five stages.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns the rows it keeps. Between stages the rows are written as Parquet
to the shared folder and read again. All stages take null ids and texts, empty
texts, repeated rows and empty tables (which give empty tables), and pass on
columns of any names unchanged, but for the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table
from quarry.llm.mixing import mix
from quarry.llm.ngram_join import keep_one_per_group
from quarry.llm.pieces import token_ids
from quarry.llm.secret_scan import redact_secrets
from quarry.llm.toxicity import drop_toxic, train_toxicity
from quarry.session import scratch_dir

#: Tasks that write one output shard of the mix.
WRITERS_PER_SHARD = 8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the positive-unlabelled classifier calls toxic."""
    return drop_toxic(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one of smallest id, of each group of near copies."""
    return keep_one_per_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts; all documents stay, ``n_chars`` follows the new text."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every document as often as the mix says (0 to 3 times), in shuffled shards."""
    taken = mix(docs, keep_row=True).select("row", F.explode("places").alias("place"))
    part = F.pmod(F.col("place.order"), F.lit(WRITERS_PER_SHARD))
    return (taken.repartition(F.col("place.shard"), part).sortWithinPartitions("place.shard", "place.order")
            .select("row.*"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: ``doc_id, n_tokens, ids``."""
    return token_ids(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("piece_encoding", piece_encoding),
]

#: Classification, exact set similarity and piece encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
