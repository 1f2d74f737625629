"""End-to-end run: prepare -> train and compare -> explain -> save -> one result record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import explain as ex
from quarry.operators import models as md
from quarry.operators.prepare import prepare_dataset
from quarry.sources import registry as reg


@dataclass
class RunResult:
    record: DataFrame
    leaderboard: DataFrame
    importance: DataFrame | None
    run_dir: str
    shap: DataFrame | None = None


def run_analysis(spark: SparkSession, df: DataFrame, target: str, key: str, runs_root: str, *, cv: int = 5,
                 tune: bool = False, class_weight: bool = False, profile: str = "reference",
                 only=None, parallelism: int = 1, problem_type: str | None = None, progress=None,
                 with_shap: bool = True) -> RunResult:
    """Train every candidate, keep the best, explain it, persist it, return one result row.

    The explanation holds sampled Shapley values unless ``with_shap`` is off.
    Best score = accuracy (classification) or r2 (regression), else f1.
    """
    prep = prepare_dataset(df, target=target, key=key, problem_type=problem_type)
    comp = md.train_and_compare(prep, cv=cv, tune=tune, class_weight=class_weight, profile=profile, only=only,
                                parallelism=parallelism, progress=progress)
    best = comp.best
    explained = ex.explain_model(best.model, prep.test, prep.train, key, target, prep.problem_type,
                                 prep.feature_columns, with_shap=with_shap)
    run_dir = f"{runs_root}/{best.name.replace(' ', '%20')}_{prep.problem_type}"
    meta = {"model": best.name, "model_type": type(ex.learner_stage(best.model)).__name__,
            "problem_type": prep.problem_type, "target": target}
    reg.save_run(spark, run_dir, best.model, meta, best.metrics, prep.feature_columns, best.params)
    score = best.metrics.get("accuracy", best.metrics.get("r2", best.metrics.get("f1")))
    record = spark.createDataFrame(
        [(best.name, prep.problem_type, target, float(score) if score is not None else None, sum(r.error is None for r in comp.results),
          explained["method"], best.feature_count)],
        "best_model string, problem_type string, target string, best_score double, models_trained int, "
        "explain_method string, feature_count int")
    return RunResult(record, comp.leaderboard, explained["importance"], run_dir, explained["shap"])
