"""Reading the given tables and keeping intermediate ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tripletide.scratch import literal_rows, scratch_path

# Rows of an Arrow batch are worked on in runs of about this many bytes of text.
RUN_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once to the shared scratch folder and read back, with its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def listed(spark: SparkSession, rows: Sequence[tuple], columns: str) -> DataFrame:
    """A short list as a table in the plan; ``columns`` as in DDL, all nullable."""
    return literal_rows(spark, rows, T.StructType.fromDDL(columns))


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that no later plan reads."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name (case ignored)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def runs(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of about RUN_BYTES of text; a longer text makes a run of its own."""
    lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > RUN_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
