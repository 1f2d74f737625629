"""Dataset validation and preparation for modelling.

Checks return small tables ``(check, passed, detail)``; choices (target,
problem type, feature lists) are driver-side decisions over schema plus one
aggregate. The preprocessor is an unfitted ``pyspark.ml.Pipeline`` (median
imputation + population-std scaling for numbers, mode imputation + one-hot
with an all-zero slot for unseen categories for strings). The split is a
deterministic hash of a key: no shuffle, independent of partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.dates import parse_ts
from quarry.functions.frames import field_types, is_bool, is_numeric, is_string, is_temporal, nan_to_null, q
from quarry.functions.ranks import prefix_counts
from quarry.operators.stages import MedianStandardScaler, ModeImputer
from quarry.session import stored

# Gates, hint lists and defaults of the preparation step.
MIN_ROWS = 20
MIN_ROWS_LOOSE = 10
MIN_COLS = 2
TARGET_HINTS = ["target", "label", "class", "y", "price", "salary", "revenue", "score", "result", "churn", "outcome"]
LAST_COLUMN_UNIQUE_RATIO = 0.90
CLASSIFICATION_MAX_UNIQUE_RATIO = 0.05
CLASSIFICATION_MAX_UNIQUE_ABS = 20
ID_HINTS = ["id", "customer_id", "order_id", "emp_id", "employee_id", "uuid", "index"]
ID_UNIQUE_RATIO = 0.98
DATETIME_SHARE = 0.8
IMBALANCE_SHARE = 0.95
TEST_SIZE = 0.20
SEED = 42
HASH_BUCKETS = 10000


class InvalidDatasetError(ValueError):
    pass


class TargetNotFoundError(ValueError):
    pass


class UnsupportedTargetError(ValueError):
    pass


def validate_dataset(df: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Checks ``(check, passed, severity)``: non-empty, >= min_rows rows, >= 2 columns,
    unique column names (errors) and no duplicate rows (warning).

    One job: grouping on every column gives rows and distinct rows together.
    """
    spark = df.sparkSession
    unique_names = len(set(df.columns)) == len(df.columns)
    if unique_names and df.columns:
        g = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_c"))
        row = g.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("d")).first()
        n, distinct = int(row["n"]), int(row["d"])
    else:
        n = df.count()
        distinct = n
    rows = [
        ("non_empty", n > 0, "error"),
        ("min_rows", n >= min_rows, "error"),
        ("min_columns", len(df.columns) >= MIN_COLS, "error"),
        ("unique_column_names", unique_names, "error"),
        ("no_duplicate_rows", n == distinct, "warning"),
    ]
    return spark.createDataFrame(rows, "check string, passed boolean, severity string")


def assert_valid(checks: DataFrame) -> None:
    failed = [r["check"] for r in checks.collect() if not r["passed"] and r["severity"] == "error"]
    if failed:
        raise InvalidDatasetError(f"dataset failed checks: {failed}")


def _distinct_count(df: DataFrame, col: str) -> int:
    return df.select(q(col)).where(q(col).isNotNull()).distinct().count()


def detect_target(df: DataFrame, user_target: str | None = None) -> str:
    """User choice (must exist); else first column whose trimmed lower name is a hint;
    else the last column if distinct/rows < 0.90; else error."""
    if user_target:
        if user_target not in df.columns:
            raise TargetNotFoundError(f"no column is named {user_target!r}")
        return user_target
    for c in df.columns:
        if c.strip().lower() in TARGET_HINTS:
            return c
    last = df.columns[-1]
    row = df.agg(F.count(F.lit(1)).alias("n")).first()
    n = row["n"] or 0
    if n and _distinct_count(df, last) / n < LAST_COLUMN_UNIQUE_RATIO:
        return last
    raise TargetNotFoundError("no column looks like a target; name one")


def target_stats(df: DataFrame, target: str) -> DataFrame:
    """One row: rows, non-null count, distinct non-null values of the target."""
    y = q(target)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(y).alias("n_present"),
                  F.count_distinct(y).alias("n_unique"))


def validate_target(df: DataFrame, target: str) -> DataFrame:
    """Checks: not all null, more than one value (errors); <= 50 % null and >= 2 values (loose gate)."""
    s = target_stats(df, target)
    return s.select(F.inline(F.array(
        F.struct(F.lit("not_all_null").alias("check"), (F.col("n_present") > 0).alias("passed"),
                 F.lit("error").alias("severity")),
        F.struct(F.lit("more_than_one_value").alias("check"), (F.col("n_unique") > 1).alias("passed"),
                 F.lit("error").alias("severity")),
        F.struct(F.lit("missing_at_most_half").alias("check"),
                 (F.col("n_rows") - F.col("n_present") <= F.col("n_rows") * 0.5).alias("passed"),
                 F.lit("warning").alias("severity")),
        F.struct(F.lit("at_least_two_classes").alias("check"), (F.col("n_unique") >= 2).alias("passed"),
                 F.lit("warning").alias("severity")),
    )))


def problem_type_expr(is_text: bool) -> Column:
    if is_text:
        return F.lit("classification")
    ratio = F.col("n_unique") / F.col("n_rows")
    return F.when((ratio <= CLASSIFICATION_MAX_UNIQUE_RATIO) | (F.col("n_unique") <= CLASSIFICATION_MAX_UNIQUE_ABS),
                  "classification").otherwise("regression")


def detect_problem_type_df(df: DataFrame, target: str) -> DataFrame:
    """One row ``(target, problem_type, n_unique, n_rows)``."""
    dt = field_types(df)[target]
    s = target_stats(df, target)
    return s.select(F.lit(target).alias("target"), problem_type_expr(is_string(dt) or is_bool(dt)).alias("problem_type"),
                    "n_unique", "n_rows")


def detect_problem_type(df: DataFrame, target: str) -> str:
    return detect_problem_type_df(df, target).first()["problem_type"]


def split_features_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(q(target))


def detect_feature_types(df: DataFrame) -> dict[str, list[str]]:
    types = field_types(df)
    return {
        "numerical_columns": [c for c in df.columns if is_numeric(types[c])],
        "categorical_columns": [c for c in df.columns if is_string(types[c])],
        "boolean_columns": [c for c in df.columns if is_bool(types[c])],
        "datetime_columns": [c for c in df.columns if is_temporal(types[c])],
    }


def feature_types_table(df: DataFrame) -> DataFrame:
    ft = detect_feature_types(df)
    rows = [(c, i, kind.replace("_columns", "")) for kind, cols in ft.items() for c in cols
            for i in [df.columns.index(c)]]
    return df.sparkSession.createDataFrame(rows, "column string, position int, feature_type string")


def convert_datetime_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """String columns become timestamps when every non-null value parses and non-null share > 0.8."""
    types = field_types(df)
    cols = [c for c in df.columns if is_string(types[c])]
    if not cols:
        return df, []
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(q(c).isNotNull() & parse_ts(q(c)).isNull()).alias(f"b{i}"), F.count(q(c)).alias(f"p{i}")]
    row = df.agg(*aggs).first()
    conv = [c for i, c in enumerate(cols) if row[f"b{i}"] == 0 and row[f"p{i}"] > row["_n"] * DATETIME_SHARE]
    out = df.withColumns({c: parse_ts(q(c)).cast("timestamp_ntz") for c in conv}) if conv else df
    return out, conv


def detect_id_columns(df: DataFrame) -> list[str]:
    """Exact lower name in the hint set, or distinct/rows >= 0.98 for any type, by exact counts in one VF pass."""
    from quarry.functions.frames import value_counts

    named = [c for c in df.columns if c.lower() in ID_HINTS]
    rest = [c for c in df.columns if c not in named]
    n = df.count() if rest else 0
    if n == 0:
        return named
    counts = {r["column"]: r["n"] for r in value_counts(df, rest).groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [c for c in df.columns if c in named or counts.get(c, 0) / n >= ID_UNIQUE_RATIO]


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """One row: largest class share among non-null labels and whether it exceeds 0.95."""
    counts = df.where(q(target).isNotNull()).groupBy(q(target)).agg(F.count(F.lit(1)).alias("cnt"))
    agg = counts.agg((F.max("cnt") / F.sum("cnt")).alias("max_share"))
    return agg.select(F.round("max_share", 6).alias("max_share"), (F.col("max_share") > IMBALANCE_SHARE).alias("is_imbalanced"))


def hash_bucket(key: Column, seed: int = SEED, salt: str = "") -> Column:
    """Integer in [0, 10000) from the first 8 hex digits of md5(key:seed[salt]); same in Spark and DuckDB."""
    h = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}{salt}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % HASH_BUCKETS


def train_test_split(df: DataFrame, key: str, test_size: float = TEST_SIZE, seed: int = SEED,
                     stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Deterministic split on ``key``.

    Unstratified: test iff hash bucket < test_size * 10000 (a row-level expression).
    Stratified on a label: within each class, rows ordered by (hash, key); the
    first round(test_size * class size) go to test. Ranks come from the
    distributed prefix counts, so a class holding most rows is still spread
    over many tasks.
    """
    marked = mark_split(df, key, test_size, seed, stratify)
    return (marked.where(~F.col("_is_test")).drop("_is_test"), marked.where(F.col("_is_test")).drop("_is_test"))


def mark_split(df: DataFrame, key: str, test_size: float = TEST_SIZE, seed: int = SEED,
               stratify: str | None = None) -> DataFrame:
    """Add boolean ``_is_test`` (see ``train_test_split``)."""
    b = hash_bucket(q(key), seed)
    if stratify is None:
        return df.withColumn("_is_test", b < F.lit(int(round(test_size * HASH_BUCKETS))))
    ordered = (df.withColumn("_cls", F.coalesce(q(stratify).cast("string"), F.lit("\u0000null")))
               .withColumn("_b", b).withColumn("_k", q(key)))
    d = ordered.groupBy("_cls", "_b", "_k").agg(F.count(F.lit(1)).alias("cnt")).withColumn("_ord", F.struct("_b", "_k"))
    ranked = prefix_counts(d, ["_cls"], "_ord", "cnt")
    sizes = d.groupBy("_cls").agg(F.sum("cnt").alias("_size"))  # one row per class
    cut = ranked.join(F.broadcast(sizes), "_cls").select(
        "_cls", "_b", "_k", (F.col("before") < F.round(F.col("_size") * test_size)).alias("_is_test"))
    return ordered.join(cut, ["_cls", "_b", "_k"]).drop("_cls", "_b", "_k")


@dataclass
class PreparedData:
    train: DataFrame
    test: DataFrame
    target: str
    problem_type: str
    numerical_columns: list[str]
    categorical_columns: list[str]
    boolean_columns: list[str]
    datetime_columns: list[str]
    id_columns: list[str]
    is_imbalanced: bool
    key: str
    preprocessor: Pipeline = field(repr=False, default=None)

    @property
    def feature_columns(self) -> list[str]:
        return self.numerical_columns + self.categorical_columns


def build_preprocessor(numerical: Sequence[str], categorical: Sequence[str], features_col: str = "features") -> Pipeline:
    """Numeric block (median impute + population-std scale), then one-hot block; the rest dropped."""
    stages = []
    num_out = [f"__num_{i}" for i in range(len(numerical))]
    if numerical:
        stages.append(MedianStandardScaler(inputCols=list(numerical), outputCols=num_out))
    cat_out = []
    if categorical:
        filled = [f"__cat_{i}" for i in range(len(categorical))]
        idx = [f"__idx_{i}" for i in range(len(categorical))]
        cat_out = [f"__ohe_{i}" for i in range(len(categorical))]
        stages += [
            ModeImputer(inputCols=list(categorical), outputCols=filled),
            StringIndexer(inputCols=filled, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=idx, outputCols=cat_out, dropLast=True),
        ]
    stages.append(VectorAssembler(inputCols=num_out + cat_out, outputCol=features_col, handleInvalid="keep"))
    return Pipeline(stages=stages)


def assemble_features(df: DataFrame, numerical: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Fit the preprocessor on ``df`` and return it with the ``features`` vector."""
    return build_preprocessor(numerical, categorical).fit(df).transform(df)


def prepare_dataset(df: DataFrame, target: str | None = None, key: str | None = None, test_size: float = TEST_SIZE,
                    seed: int = SEED, problem_type: str | None = None, min_rows: int = MIN_ROWS,
                    max_classes: int | None = None) -> PreparedData:
    """validate -> target -> problem type -> convert dates -> drop IDs -> preprocessor -> split -> imbalance."""
    # the input is read by a dozen small jobs (checks, type detection, split):
    # materialise it once in the shared checkpoint folder
    df = stored(nan_to_null(df))
    assert_valid(validate_dataset(df, min_rows))
    tgt = detect_target(df, target)
    chk = validate_target(df, tgt).collect()
    bad = [r["check"] for r in chk if r["severity"] == "error" and not r["passed"]]
    if bad:
        raise UnsupportedTargetError(f"target {tgt} failed: {bad}")
    ptype = problem_type or detect_problem_type(df, tgt)
    if ptype == "classification" and max_classes is not None:
        n_classes = target_stats(df, tgt).first()["n_unique"]
        if n_classes > max_classes:
            raise UnsupportedTargetError(f"{n_classes} classes; pass problem_type='regression' or raise max_classes")
    if key is None:
        key = "_row_key"
        df = df.withColumn(key, F.xxhash64(*[q(c) for c in df.columns]))
    features, conv_cols = convert_datetime_features(df.drop(tgt, key))
    ids = detect_id_columns(features)
    features = features.drop(*ids)
    ft = detect_feature_types(features)
    data = df.select(q(key), q(tgt), *[q(c) for c in features.columns])
    conv_cols = [c for c in conv_cols if c in features.columns]
    if conv_cols:
        data = data.withColumns({c: parse_ts(q(c)).cast("timestamp_ntz") for c in conv_cols})
    # materialise the split once in the shared checkpoint folder: every later fit,
    # fold and score reads it instead of recomputing the split lineage
    marked = stored(mark_split(data, key, test_size, seed, stratify=tgt if ptype == "classification" else None))
    train = marked.where(~F.col("_is_test")).drop("_is_test")
    test = marked.where(F.col("_is_test")).drop("_is_test")
    imbalanced = False
    if ptype == "classification":
        imbalanced = bool(class_imbalance(train, tgt).first()["is_imbalanced"])
    return PreparedData(
        train=train, test=test, target=tgt, problem_type=ptype,
        numerical_columns=ft["numerical_columns"], categorical_columns=ft["categorical_columns"],
        boolean_columns=ft["boolean_columns"], datetime_columns=ft["datetime_columns"], id_columns=ids,
        is_imbalanced=imbalanced, key=key,
        preprocessor=build_preprocessor(ft["numerical_columns"], ft["categorical_columns"]),
    )
