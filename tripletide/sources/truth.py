"""Ground truth: one subject per line."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("s")).distinct()
