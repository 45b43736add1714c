"""Intermediate tables in the folder the cluster shares for checkpoints.

Loops cut their lineage by writing Parquet here and reading it back: the data
outlives a lost executor, and the write also reports how many rows and bytes
it holds, which is what a broadcast is decided on.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BROADCAST_BYTES = 32 << 20

_roots: dict[str, str] = {}


@dataclass(frozen=True)
class Stored:
    """A written DataFrame with its measured size, and the spans asked for."""

    df: DataFrame
    rows: int
    bytes: int
    spans: dict[str, tuple] = field(default_factory=dict)

    def small(self) -> bool:
        return self.bytes <= BROADCAST_BYTES

    def hinted(self, df: DataFrame | None = None) -> DataFrame:
        """The table, or a narrowing of it, marked for broadcast when its measured size allows."""
        df = self.df if df is None else df
        return F.broadcast(df) if self.small() else df

    def plus(self, other: Stored) -> Stored:
        return Stored(self.df.unionByName(other.df), self.rows + other.rows, self.bytes + other.bytes)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the session's checkpoint folder."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        set_on_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = spark.conf.get("spark.checkpoint.dir", None) or (
            set_on_context.get() if set_on_context.isDefined() else None
        )
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="tripletide-")
        _roots[app] = f"{folder.rstrip('/')}/tripletide-{app}-{uuid.uuid4().hex[:8]}"
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_roots[app])
        root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(root)
    return f"{_roots[app]}/{name}-{uuid.uuid4().hex[:12]}"


def _row_bytes(schema: T.StructType):
    text = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in schema if isinstance(f.dataType, T.StringType)]
    return sum(text, F.lit(16 * len(schema)))


def store(
    df: DataFrame,
    name: str,
    sort_by: Sequence[str] = (),
    spans: dict[str, tuple[Column, Column]] | None = None,
    sets: dict[str, Column] | None = None,
    folder_by: str | None = None,
    path: str | None = None,
) -> Stored:
    """Write ``df`` once and return it as a scan with its measured size.

    ``sort_by`` orders the rows of each file, so that later filters on a range skip
    row groups. ``spans`` names pairs of columns; the write reports the least value
    of the first and the greatest of the second. ``sets`` names columns of few
    different values, which the write reports. ``folder_by`` gives every value of a
    column a folder of its own. ``path`` is a fresh folder of the caller's.
    """
    path = path or scratch_path(df.sparkSession, name)
    seen, spans, sets = Observation(), spans or {}, sets or {}
    measured = df.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.sum(_row_bytes(df.schema)).alias("bytes"),
        *[F.min(low).alias(f"low_{k}") for k, (low, _) in spans.items()],
        *[F.max(high).alias(f"high_{k}") for k, (_, high) in spans.items()],
        *[F.collect_set(c).alias(f"set_{k}") for k, c in sets.items()],
    )
    written = (measured.sortWithinPartitions(*sort_by) if sort_by else measured).write
    (written.partitionBy(folder_by) if folder_by else written).parquet(path)
    size = seen.get
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    found = {k: (size.get(f"low_{k}"), size.get(f"high_{k}")) for k in spans}
    found |= {k: tuple(sorted(size.get(f"set_{k}") or ())) for k in sets}
    return Stored(back, size.get("rows") or 0, size.get("bytes") or 0, found)


class Appended:
    """A table that grows by a folder per step; however many steps, it is read by one scan."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, scratch_path(spark, name)

    def path(self, step: int) -> str:
        return f"{self.root}/step={step}"

    def read(self, schema: T.StructType, number: str) -> DataFrame:
        """All steps so far, of rows of ``schema``, the step as the column ``number``."""
        numbered = T.StructType([*schema, T.StructField("step", T.LongType())])
        return self.spark.read.schema(numbered).parquet(self.root).withColumnRenamed("step", number)


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A short list of rows as a table held in the plan itself."""
    fields = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=fields), schema)


# A table of at most this many rows may be held in the plan instead of in a file.
LISTED_ROWS = 2000


def pin(df: DataFrame, name: str) -> Stored:
    """Like ``store`` for tables that are nearly always short, such as an ontology's.

    Up to LISTED_ROWS rows become part of the plan, which saves writing and scanning
    files for a few lines; anything longer is stored.
    """
    rows = df.limit(LISTED_ROWS + 1).collect()
    if len(rows) > LISTED_ROWS:
        return store(df, name)
    held = literal_rows(df.sparkSession, [tuple(r) for r in rows], df.schema)
    size = sum(16 * len(r) + sum(len(v.encode()) for v in r if isinstance(v, str)) for r in rows)
    return Stored(held, len(rows), size)
