"""Scoring new tables with a saved run.

The ``PipelineModel`` carries the fitted preprocessing, the learner and the
label decoder, so scoring is one ``transform``: columns are appended to the
input rows (no positional concatenation, no join back). The same call works on
a streaming DataFrame (see ``quarry.streaming``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.frames import q


class ScoringInputError(ValueError):
    pass


def validate_scoring_input(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Checks ``(check, passed, detail)``: has rows; has every required column (missing ones listed)."""
    missing = [c for c in required if c not in df.columns]
    has_rows = df.limit(1).count() > 0
    return df.sparkSession.createDataFrame(
        [("has_rows", has_rows, ""), ("required_columns", not missing, ",".join(missing))],
        "check string, passed boolean, detail string")


def assert_scorable(df: DataFrame, required: Sequence[str]) -> None:
    bad = [r for r in validate_scoring_input(df, required).collect() if not r["passed"]]
    if bad:
        raise ScoringInputError("; ".join(f"{r['check']} {r['detail']}".strip() for r in bad))


def class_labels(model: PipelineModel) -> list[str] | None:
    dec = next((s for s in model.stages if isinstance(s, IndexToString)), None)
    return list(dec.getLabels()) if dec is not None else None


def preprocessing_stages(model: PipelineModel) -> PipelineModel:
    """The fitted stages up to and including the feature assembler."""
    from pyspark.ml.feature import VectorAssembler

    idx = max(i for i, s in enumerate(model.stages) if isinstance(s, VectorAssembler))
    return PipelineModel(stages=model.stages[: idx + 1])


def transform_features(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Apply the fitted preprocessing to exactly the trained columns."""
    return preprocessing_stages(model).transform(df.select(*[q(c) for c in features]))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with ``prediction`` (decoded class label for classifiers)."""
    out = model.transform(df)
    if "predicted_label" in out.columns:
        return out.withColumn("prediction", F.col("predicted_label")).drop("predicted_label")
    return out


def predict_proba(model: PipelineModel, df: DataFrame) -> DataFrame | None:
    """Rows with ``proba_<class>`` columns, or None when the learner gives no probabilities."""
    labels = class_labels(model)
    out = predict(model, df)
    if labels is None or "probability" not in out.columns:
        return None
    arr = vector_to_array("probability")
    return out.withColumns({f"proba_{lab}": arr[i] for i, lab in enumerate(labels)})


def score_table(model: PipelineModel, df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Input rows + ``prediction`` + ``proba_<class>`` (when available); model internals dropped."""
    if features:
        assert_scorable(df, features)
    keep = df.columns
    proba = predict_proba(model, df)
    out = proba if proba is not None else predict(model, df)
    extra = ["prediction"] + [c for c in out.columns if c.startswith("proba_")]
    return out.select(*[q(c) for c in keep], *[q(c) for c in extra])


def score_to_csv(model: PipelineModel, df: DataFrame, path: str, features: Sequence[str] | None = None) -> str:
    score_table(model, df, features).write.mode("overwrite").option("header", True).csv(path)
    return path
