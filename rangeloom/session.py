"""Parallelism of the current session."""

from pyspark.sql import SparkSession


def default_threads(spark: SparkSession) -> int:
    """How many partitions a shuffle makes; operators leave the rest to Spark."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
