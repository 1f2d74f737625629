"""Independent SQL oracles and a local Spark-vs-DuckDB comparison harness."""
