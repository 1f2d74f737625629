"""quarry: automated data analysis as Spark DataFrame operators.

Every operator takes a DataFrame (plus parameters) and returns a DataFrame.
Work over rows runs as Spark jobs built from built-in expressions and
``pyspark.ml``; only scalars that steer a later step (fences, fill values,
column choices) come back to the driver.
"""

from quarry.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
