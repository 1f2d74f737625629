"""Run registry: persisted pipelines, metadata, metrics and the cross-run leaderboard.

A run directory holds ``model/`` (``PipelineModel`` persistence), and
``metadata/`` and ``metrics/`` as one-record JSON tables written by Spark, so
the registry works on any filesystem Spark can write (local, HDFS, object
stores). The leaderboard is a Parquet table; an upsert replaces rows of the
same run by an anti join and a by-name union that tolerates new columns.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Metadata keys copied into the leaderboard with a ``meta_`` prefix.
META_KEYS = ["model", "model_type", "problem_type", "target"]
BOARD_SCHEMA = ("run_name string, timestamp string, meta_model string, meta_model_type string, "
                "meta_problem_type string, meta_target string")


class RunNotFoundError(FileNotFoundError):
    pass


def _is_missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def _json_table(spark: SparkSession, record: Mapping, path: str) -> None:
    spark.createDataFrame([(json.dumps(record, default=str),)], "j string").coalesce(1).write.mode("overwrite").text(path)


def _read_json_table(spark: SparkSession, path: str) -> dict:
    try:
        rows = spark.read.text(path).collect()
    except AnalysisException as e:
        if not _is_missing(e):
            raise
        raise RunNotFoundError(path) from e
    return json.loads(rows[0]["value"]) if rows else {}


def save_run(spark: SparkSession, run_dir: str, model: PipelineModel, metadata: Mapping, metrics: Mapping | None = None,
             feature_names: list[str] | None = None, params: Mapping | None = None) -> str:
    """Persist model, metadata (+ timestamp, params, feature names) and metrics; refuse a missing model."""
    if model is None:
        raise ValueError("refusing to save a run without a model")
    model.write().overwrite().save(f"{run_dir}/model")
    meta = dict(metadata) | {"timestamp": _dt.datetime.now().isoformat(timespec="seconds"),
                             "params": dict(params or {}), "feature_names": list(feature_names or [])}
    _json_table(spark, meta, f"{run_dir}/metadata")
    _json_table(spark, dict(metrics or {}), f"{run_dir}/metrics")
    return run_dir


def load_run(spark: SparkSession, run_dir: str) -> tuple[PipelineModel, dict, dict]:
    """Model, metadata and metrics of a run; ``RunNotFoundError`` when the run is absent."""
    meta = _read_json_table(spark, f"{run_dir}/metadata")
    try:
        model = PipelineModel.load(f"{run_dir}/model")
    except AnalysisException as e:
        if not _is_missing(e):
            raise
        raise RunNotFoundError(f"{run_dir}/model") from e
    try:
        metrics = _read_json_table(spark, f"{run_dir}/metrics")
    except RunNotFoundError:
        metrics = {}
    return model, meta, metrics


def run_registry(spark: SparkSession, root: str) -> DataFrame:
    """Every run under ``root`` that has metadata, with its metrics (empty when missing), by run name."""
    meta = spark.read.text(f"{root}/*/metadata").select(
        F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"/([^/]+)/metadata/[^/]+$", 1).alias("run_name"),
        F.col("value").alias("metadata"))
    try:
        metrics = spark.read.text(f"{root}/*/metrics").select(
            F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"/([^/]+)/metrics/[^/]+$", 1).alias("run_name"),
            F.col("value").alias("metrics"))
    except AnalysisException as e:
        if not _is_missing(e):
            raise
        # no run has metrics yet
        metrics = spark.createDataFrame([], "run_name string, metrics string")
    return (meta.join(metrics, "run_name", "left")
            .select("run_name", F.get_json_object("metadata", "$.model").alias("model"),
                    F.get_json_object("metadata", "$.problem_type").alias("problem_type"),
                    F.get_json_object("metadata", "$.target").alias("target"),
                    F.coalesce("metrics", F.lit("{}")).alias("metrics"))
            .orderBy("run_name"))


def leaderboard_row(spark: SparkSession, run_name: str, metadata: Mapping, metrics: Mapping,
                    timestamp: str | None = None) -> DataFrame:
    """One board row: run name, timestamp, metrics as columns, selected metadata as ``meta_*``."""
    ts = timestamp or _dt.datetime.now().isoformat(timespec="seconds")
    fields = [("run_name", "string", run_name), ("timestamp", "string", ts)]
    fields += [(f"meta_{k}", "string", None if metadata.get(k) is None else str(metadata.get(k))) for k in META_KEYS]
    fields += [(k, "double", None if v is None else float(v)) for k, v in metrics.items()]
    schema = ", ".join(f"`{n}` {t}" for n, t, _ in fields)
    return spark.createDataFrame([tuple(v for _, _, v in fields)], schema)


def leaderboard_load(spark: SparkSession, path: str) -> DataFrame:
    """The board, or an empty table with the base columns when none exists yet.

    A board that cannot be read is an error. Where an upsert was cut off
    between its two renames, the board it set aside is read.
    """
    for place in (path, _aside(path)):
        try:
            return spark.read.parquet(place)
        except AnalysisException as e:
            if not _is_missing(e):
                raise
    return spark.createDataFrame([], BOARD_SCHEMA)


def _aside(path: str) -> str:
    return f"{path.rstrip('/')}.previous"


def _switch(spark: SparkSession, new: str, path: str) -> None:
    """Make ``new`` the folder ``path``; a whole board stands under ``path`` or aside at every moment."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    here, aside = to_path(path), to_path(_aside(path))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(here):
        fs.delete(aside, True)
        if not fs.rename(here, aside):
            raise OSError(f"cannot set {path} aside")
    if not fs.rename(to_path(new), here):
        raise OSError(f"cannot rename {new} to {path}")


def leaderboard_upsert(spark: SparkSession, path: str, row: DataFrame) -> DataFrame:
    """Replace the rows of the same run, keep the others; column sets may differ between runs.

    The new board is written to a sibling folder and then renamed into place;
    the one before is kept aside, so a failure never leaves a half-written board.
    """
    current = leaderboard_load(spark, path)
    kept = current.join(row.select("run_name"), "run_name", "left_anti")
    board = kept.unionByName(row, allowMissingColumns=True)
    # a name of its own: a second writer never deletes this one's work
    tmp = f"{path.rstrip('/')}.next-{uuid.uuid4().hex[:12]}"
    board.write.parquet(tmp)
    _switch(spark, tmp, path)
    return spark.read.parquet(path)


def copy_board_to_report(board: DataFrame, report_dir: str, run_name: str | None = None) -> str:
    """Write the given rows (or one run's row) into a run's report folder as CSV."""
    rows = board.where(F.col("run_name") == run_name) if run_name else board
    rows.write.mode("overwrite").option("header", True).csv(f"{report_dir}/leaderboard.csv")
    return f"{report_dir}/leaderboard.csv"
