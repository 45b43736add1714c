"""Consecutive numbers over an ordered stream, and the graphs cut from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripletide.operators.joins import skew_join
from tripletide.scratch import store

# monotonically_increasing_id keeps the partition above this bit and the row below it.
ROW_BITS = 33


def number_rows(df: DataFrame, order: Sequence[str], key: str | None = None, name: str = "pos") -> DataFrame:
    """Adds the 0-based position in the total order ``order``, per ``key`` if given.

    One range shuffle sorts the rows; the written result has its place inside its
    partition, and the partition sizes (one row each) give every partition's start.
    No task ever holds a whole key or the whole stream.
    """
    ordered = df.orderBy(*([key] if key else []), *order).withColumn("_at", F.monotonically_increasing_id())
    placed = store(ordered, "ordered").df
    part = F.shiftright("_at", ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    # At most one row per shuffle partition.
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    ).drop("_part", "_start", "_at")
    if key is None:
        return numbered
    firsts = store(numbered.groupBy(key).agg(F.min(name).alias("_first")), "firsts").hinted()
    return skew_join(numbered, firsts, [key]).withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def assign_graphs(
    triples: DataFrame,
    n: int,
    order: Sequence[str],
    key: str | None = None,
    trailing: str = "keep",
    position: str | None = None,
) -> DataFrame:
    """Every ``n`` consecutive triples become one graph: adds ``graph_no``.

    ``position`` names a column that already numbers the stream 0, 1, 2, ... without
    gaps; then nothing is sorted. ``trailing="drop"`` leaves out a last graph with
    fewer than ``n`` triples.
    """
    if trailing not in ("keep", "drop"):
        raise ValueError("trailing must be keep or drop")
    pos = position or "_pos"
    rows = triples if position else number_rows(triples, order, key, pos)
    quads = rows.withColumn("graph_no", F.expr(f"`{pos}` div {int(n)}"))
    if trailing == "drop":
        groups = [key] if key else []
        ends = quads.groupBy(*groups).agg(F.expr(f"(max(`{pos}`) + 1) div {int(n)}").alias("_full"))
        if key:
            quads = skew_join(quads, ends, groups).filter(F.col("graph_no") < F.col("_full")).drop("_full")
        else:
            quads = quads.filter(F.col("graph_no") < ends.scalar())
    return quads if position else quads.drop(pos)
