"""Derived test views over the driver tables, and loading helpers.

The driver tables have no nulls or duplicate rows, so cleaning operators
would be tested on nothing. These views plant nulls, outliers, numeric text,
a constant column and duplicate rows. They only shape input; every operator
run on them is generic and takes nothing from how they were made.
The same definitions exist as SQL text in ``sqlcheck.VIEWS`` for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    base = o.select(
        "o_orderkey",
        F.when(k % 13 == 0, F.lit(None).cast("double"))
        .when(k % 101 == 0, F.col("o_totalprice") * 20)
        .otherwise(F.col("o_totalprice")).alias("amount"),
        F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(k % 50 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string")).alias("cust_txt"),
        F.col("o_orderdate").cast("date").cast("string").alias("date_txt"),
        (F.col("o_orderstatus") == "F").alias("is_final"),
        F.lit(1).cast("int").alias("const_one"),
        F.when(k % 3 != 0, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus")).alias("mostly_null"),
    )
    return base.unionAll(base.where(k % 20 == 0))


def scored_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    m = (F.col("o_orderkey") * 37) % 1000
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
        (m.cast("double") / F.lit(1000.0)).alias("score"),
        F.when(m > 500, 1).otherwise(0).alias("prediction"),
    )


def scored_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"),
        F.col("o_orderpriority").alias("label"),
        F.when(k % 7 == 0, F.lit("NONE")).when(k % 2 == 0, F.col("o_orderpriority"))
        .otherwise(F.lit("1-URGENT")).alias("prediction"),
    )


def scored_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("label"),
        (F.col("o_totalprice") * (F.lit(90.0) + (F.col("o_orderkey") % 21).cast("double")) / F.lit(100.0)).alias(
            "prediction"
        ),
    )


def scored_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiclass scores: a softmax over per-class affinities derived from order keys."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    classes = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    raw = [((k * (i + 3)) % 97).cast("double") / F.lit(97.0) + F.when(F.col("o_orderpriority") == c, 0.5).otherwise(0.0)
           for i, c in enumerate(classes)]
    total = sum((F.exp(r) for r in raw), F.lit(0.0))
    return o.select(
        k.alias("id"), F.col("o_orderpriority").alias("label"),
        *[(F.exp(r) / total).alias(f"p{i}") for i, r in enumerate(raw)],
    )


def fe_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer: an ID, a date as text, a doubled price, a boolean,
    a tiny-variance rate and a constant text, for the feature-engineering steps."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").cast("date").cast("string").alias("order_date"),
        F.col("o_totalprice").alias("total_price"),
        (F.col("o_totalprice") * 2).alias("price_double"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_acctbal").alias("acct_balance"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_name").alias("customer_name"),
        (F.col("o_orderstatus") == "F").alias("is_final"),
        F.col("c_nationkey").alias("nation"),
        ((F.col("o_orderkey") % 3).cast("double") / F.lit(100.0)).alias("discount_rate"),
        F.lit("x").alias("const_txt"),
    )


def doc_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with text-derived features (whole texts), target ``quality`` (0/1)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    words = F.size(F.split(F.trim(F.col("text")), r"\s+"))
    return d.join(lab, "doc_id").select(
        "doc_id", "lang", "source", "n_chars",
        words.alias("n_words"),
        F.size(F.split(F.col("text"), "\n")).alias("n_lines"),
        (F.col("n_chars") / F.greatest(words, F.lit(1))).alias("chars_per_word"),
        F.length(F.regexp_replace(F.col("text"), r"[^0-9]", "")).alias("n_digits"),
        F.length(F.regexp_replace(F.col("text"), r"[^A-Z]", "")).alias("n_upper"),
        "toxic", "quality",
    )


def order_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with per-order line aggregates and customer fields, target ``o_totalprice``."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    c = table(spark, sf_dir, "customer")
    lines = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
        F.sum("l_extendedprice").alias("sum_base"), F.avg("l_discount").alias("avg_discount"),
        F.avg("l_tax").alias("avg_tax"))
    return (o.join(lines, o["o_orderkey"] == lines["l_orderkey"])
            .join(c, o["o_custkey"] == c["c_custkey"])
            .select("o_orderkey", "o_orderpriority", "c_mktsegment", "c_acctbal", "n_lines", "sum_qty", "sum_base",
                    "avg_discount", "avg_tax", "o_totalprice"))
