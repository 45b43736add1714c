"""Quads on disk: one folder per predicate, sorted by graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_quads(quads: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet laid out for pattern queries: predicates become folders that a scan can skip,
    and inside a file the rows run by graph number so that row groups can be skipped too."""
    dealt = quads.repartitionByRange("p", "graph_no")  # few files per predicate, each with its own graphs
    dealt.sortWithinPartitions("p", "graph_no").write.mode(mode).partitionBy("p").parquet(path)


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    """The quads as written; predicates stay text, also those that look like numbers or dates."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField("p", T.StringType()) if f.name == "p" else f for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(path)
