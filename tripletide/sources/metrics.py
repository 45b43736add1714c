"""Result files: writing run metrics, and reading published ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletide.schema import BENCH_RESULTS

# The settings a result folder is named after, and the seven published columns.
SETTING_COLUMNS = ("policy", "n_triples", "size", "evict")
HEADER = ("sparql", "precision", "recall", "fmeasure", "explain", "evict", "memory")
FILE_NAME = r"([A-Za-z]+?)(FEFO|LRU|LFU)([A-Za-z]+)_bench_(\d+)_(\d+)_(\d+)\.csv$"


def averages(metrics: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums over the ``evictions`` + 1 windows of each run, divided by them; without ``evictions`` by those there are."""
    evictions = F.max("evictions") if "evictions" in metrics.columns else F.lit(None).cast("int")
    windows = F.coalesce(evictions + 1, F.count(F.lit(1)))
    return metrics.groupBy(*by).agg(*[(F.sum(c) / windows).alias(c) for c in measures])


def write_metrics(metrics: DataFrame, path: str, averaged: bool, fmt: str = "csv") -> None:
    """Rows per window, or one averaged row per run, in a folder per setting.

    ``metrics`` holds the columns policy, n_triples, size, evict, the measures, and
    for averaging ``evictions`` (null: average over the windows there are).
    """
    if averaged:
        numbers = [
            c for c, t in metrics.dtypes
            if c not in (*SETTING_COLUMNS, "config_id", "epoch", "evictions") and t not in ("string", "boolean")
        ]
        metrics = averages(metrics, SETTING_COLUMNS, numbers)
    writer = metrics.write.partitionBy(*SETTING_COLUMNS)
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def read_bench(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Published result files; the setting comes from the file name.

    Values are separated by a comma and blanks. Rows with six values have no
    ``explain`` under the seven-column header, so theirs is null.
    """
    name = F.col("_metadata.file_name")
    values = F.split(F.trim("value"), r"\s*,\s*")
    rows = spark.read.text(path).select(name.alias("name"), values.alias("v"))
    rows = rows.filter((F.size("v") >= 6) & (F.element_at("v", 1) != HEADER[0]))
    full = F.size("v") >= len(HEADER)

    def number(i: int):
        return F.try_element_at("v", F.lit(i)).cast("double")

    setting = [F.regexp_extract("name", FILE_NAME, g) for g in range(1, 7)]
    return rows.select(
        setting[0].alias("store"),
        setting[1].alias("policy"),
        setting[2].alias("storage"),
        *[setting[i].cast("int").alias(c) for i, c in zip((3, 4, 5), ("n_triples", "size", "evict"))],
        *[number(i).alias(c) for i, c in enumerate(HEADER[:4], 1)],
        F.when(full, number(5)).alias("explain"),
        F.when(full, number(6)).otherwise(number(5)).alias("evict_ms"),
        F.when(full, number(7)).otherwise(number(6)).alias("memory"),
    ).to(BENCH_RESULTS)
