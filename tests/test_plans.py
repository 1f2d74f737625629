"""Physical-plan properties the design relies on (checked with the executed plan text)."""

from pyspark.sql import functions as F

from quarry.functions.frames import top_k, value_counts
from quarry.sources.files import preview

from data_dirs import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_limits_rows_per_group_before_the_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        vf = value_counts(spark.read.parquet(f"{SF001}/lineitem.parquet"), ["l_partkey", "l_suppkey"])
        plan = _plan(top_k(vf, ["column"], [F.col("cnt").desc()], 5))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in plan


def test_preview_is_a_per_task_top_n(spark):
    plan = _plan(preview(spark.read.parquet(f"{SF001}/orders.parquet"), "o_orderkey", 10))
    assert "TakeOrderedAndProject" in plan


def test_numeric_pass_reads_only_numeric_columns(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    nums = [c for c, t in li.dtypes if t in ("bigint", "int", "double")]
    plan = _plan(value_counts(li.select(*nums)))
    read = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "l_quantity" in read and "l_returnflag" not in read and "l_shipdate" not in read
