"""Literal edge tables: empty, one row, all-null, constant, zero IQR, ties, NaN, thresholds."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.functions.frames import nan_to_null
from quarry.functions.stats import quartiles
from quarry.operators import clean as cl
from quarry.operators import eda as ed
from quarry.operators import features as fe
from quarry.operators import prepare as dp
from quarry.operators import profile as pr


def test_quartiles_match_linear_interpolation(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 10]], "x double")
    row = quartiles(df, ["x"]).first()
    assert (row["q1"], row["median"], row["q3"]) == (2.0, 3.0, 4.0)


def test_quartiles_ties_and_single_value(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (5.0,)], "x double")
    row = quartiles(df, ["x"], probs=(0.5, 0.9), names=("m", "p90")).first()
    assert row["m"] == 1.0 and abs(row["p90"] - (1.0 + 0.7 * 4.0)) < 1e-12
    one = spark.createDataFrame([(7.0,)], "x double")
    assert quartiles(one, ["x"]).first()["median"] == 7.0


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    pc = pr.profile_columns(df).first()
    assert pc["missing_count"] == 2 and pc["n_unique"] == 1
    assert nan_to_null(df).where(F.col("x").isNull()).count() == 2


def test_empty_table_profile(spark):
    df = spark.createDataFrame([], "a double, b string")
    ov = pr.profile_overview(df).first()
    assert ov["n_rows"] == 0 and ov["missing_pct"] == 0.0 and ov["dup_rows"] == 0


def test_constant_column_skew_and_penalty(spark):
    df = spark.createDataFrame([(1.0, "a") for _ in range(10)], "x double, s string")
    st = ed.descriptive_stats(df).first()
    assert st["skewness"] == 0.0 and st["kurtosis"] == 0.0 and st["std"] == 0.0
    q = pr.quality_score(df).first()
    assert q["constant_penalty"] == 4.0


def test_zero_iqr_variants(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(5.0,)], "x double")
    # profile: no guard -> the stray value is an outlier
    assert pr.iqr_outlier_count(df).first()["outliers"] == 1
    # detection skips zero-IQR columns
    assert cl.outlier_issues(df).count() == 0
    # EDA collapses the fences to (q1, q3)
    assert ed.eda_outliers(df).first()["count"] == 1


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert cl.mode_of(df, "s") == "a"
    filled = cl.fill_mode(df, "s")
    assert filled.where(F.col("s").isNull()).count() == 0 and filled.where(F.col("s") == "a").count() == 3


def test_fill_constant_refuses_wrong_type(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    with pytest.raises(ValueError):
        cl.fill_constant(df, "x", "Unknown")


def test_winsorize_keeps_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (100.0,), (None,)], "x double")
    out = cl.winsorize(df, "x")
    assert out.where(F.col("x").isNull()).count() == 1
    assert out.agg(F.max("x")).first()[0] < 100.0


def test_drop_outlier_rows_keeps_null_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (100.0,), (None,)], "x double")
    out = cl.drop_outlier_rows(df, "x")
    assert out.count() == 5 and out.where(F.col("x").isNull()).count() == 1


def test_numeric_type_threshold_is_strict(spark):
    vals = [str(i) for i in range(9)] + ["x"]  # exactly 90 % parse: not converted
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    assert cl.numeric_type_issues(df).count() == 0
    df2 = spark.createDataFrame([(v,) for v in vals + ["9"]], "s string")
    assert cl.numeric_type_issues(df2).count() == 1


def test_rare_category_at_exactly_one_percent_is_kept(spark):
    rows = [("common",)] * 99 + [("edge",)]
    out = fe.rare_categories(spark.createDataFrame(rows, "c string"))
    assert out.where(F.col("c") == "edge").count() == 1
    rows2 = [("common",)] * 199 + [("rare",)]
    out2 = fe.rare_categories(spark.createDataFrame(rows2, "c string"))
    assert out2.where(F.col("c") == "Other").count() == 1


def test_problem_type_thresholds(spark):
    exactly_20 = spark.createDataFrame([(i % 20,) for i in range(1000)], "y long")
    assert dp.detect_problem_type(exactly_20, "y") == "classification"
    ratio = spark.createDataFrame([(i % 25,) for i in range(500)], "y long")  # 25 / 500 = 0.05
    assert dp.detect_problem_type(ratio, "y") == "classification"
    many = spark.createDataFrame([(i % 26,) for i in range(500)], "y long")
    assert dp.detect_problem_type(many, "y") == "regression"


def test_validate_dataset_row_gate(spark):
    small = spark.createDataFrame([(i, i) for i in range(19)], "a long, b long")
    big = spark.createDataFrame([(i, i) for i in range(20)], "a long, b long")
    gate = {r["check"]: r["passed"] for r in dp.validate_dataset(small).collect()}
    assert gate["min_rows"] is False
    assert {r["check"]: r["passed"] for r in dp.validate_dataset(big).collect()}["min_rows"] is True


def test_target_detection_on_inline_sample(spark):
    # the reference's 5-row example: the first hinted column wins
    df = spark.createDataFrame([(22, 25000, "Delhi", 0), (34, 54000, "Mumbai", 1)],
                               "age long, salary long, city string, target long")
    assert dp.detect_target(df) == "salary"


def test_id_substring_and_token_match(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "paid double, width double, amount double")
    assert set(fe.id_feature_columns(df)) == {"paid", "width"}
    assert fe.id_feature_columns(df, match="token") == []


def test_interaction_zero_divisor(spark):
    df = spark.createDataFrame([(4.0, 0.0), (4.0, 2.0)], "a double, b double")
    out = fe.interaction_features(df, [("a", "b")]).orderBy("b").collect()
    assert out[0]["a_div_b"] is None and out[1]["a_div_b"] == 2.0 and out[1]["a_x_b"] == 8.0


def test_unseen_category_encodes_to_zeros(spark):
    from pyspark.ml.functions import vector_to_array

    train = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    test = spark.createDataFrame([("z",), (None,)], "c string")
    model = dp.build_preprocessor([], ["c"]).fit(train)
    rows = model.transform(test).select(vector_to_array("features").alias("v")).collect()
    assert rows[0]["v"] == [0.0, 0.0]
    assert rows[1]["v"] == [1.0, 0.0]  # null -> mode 'a'


def test_histogram_constant_column_and_last_bin(spark):
    const = spark.createDataFrame([(3.0,)] * 4, "x double")
    h = ed.histograms(const).orderBy("bin").collect()
    assert h[0]["lower_edge"] == 2.5 and h[-1]["upper_edge"] == 3.5 and sum(r["count"] for r in h) == 4
    df = spark.createDataFrame([(float(v),) for v in range(101)], "x double")
    h2 = ed.histograms(df).orderBy("bin").collect()
    assert len(h2) == 10 and h2[-1]["count"] == 11 and sum(r["count"] for r in h2) == 101


def test_pearson_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "c double, x double")
    m = {(r["col_a"], r["col_b"]): r["r"] for r in ed.pearson_matrix(df).collect()}
    assert m[("c", "x")] is None and m[("x", "x")] == 1.0 and m[("c", "c")] is None


def test_spearman_is_rank_correlation(spark):
    df = spark.createDataFrame([(float(i), float(i) ** 3) for i in range(1, 30)], "a double, b double")
    m = {(r["col_a"], r["col_b"]): r["r"] for r in ed.spearman_matrix(df).collect()}
    assert math.isclose(m[("a", "b")], 1.0)
