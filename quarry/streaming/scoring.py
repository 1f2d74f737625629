"""Scoring a stream with a saved pipeline.

``PipelineModel.transform`` is a chain of projections for expression-based
learners (linear models, naive Bayes, boosted stumps, and forests small enough
to be sent to every task), so it applies unchanged to a streaming DataFrame:
rows arriving in a source folder are scored as they land and appended to a
sink. Learners that need a join against stored rows (k nearest neighbours,
larger forests) score batches via ``foreachBatch`` instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.score import predict


def score_stream(spark: SparkSession, model: PipelineModel, source_dir: str, schema: T.StructType | str,
                 prepare: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of scored rows read from ``source_dir``."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.load(source_dir)
    if prepare is not None:
        rows = prepare(rows)
    return predict(model, rows)


def start_scoring(scored: DataFrame, sink_dir: str, checkpoint_dir: str, fmt: str = "parquet",
                  once: bool = False) -> StreamingQuery:
    """Append scored rows to ``sink_dir``; progress lives in ``checkpoint_dir`` (exactly-once file sink)."""
    writer = scored.writeStream.format(fmt).option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
    writer = writer.outputMode("append")
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def score_batches(spark: SparkSession, model: PipelineModel, source_dir: str, schema: T.StructType | str,
                  sink_dir: str, checkpoint_dir: str, prepare: Callable[[DataFrame], DataFrame] | None = None,
                  fmt: str = "parquet") -> StreamingQuery:
    """Score each micro-batch as a static DataFrame (for learners with joins / cogroups).

    A batch owns the folder ``batch_id=<n>`` of the sink and overwrites it, so
    a batch that is run again after a failure is not written twice.
    """
    rows = spark.readStream.format(fmt).schema(schema).load(source_dir)

    def run(batch: DataFrame, batch_id: int) -> None:
        data = prepare(batch) if prepare is not None else batch
        predict(model, data).write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_dir).trigger(
        availableNow=True).start()
