"""Transitive closure of edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletide.operators.joins import skew_join
from tripletide.scratch import Stored, store


def closure_table(edges: DataFrame, src: str = "src", dst: str = "dst", by: Sequence[str] = ()) -> Stored:
    """All (src, dst) pairs joined by a path, per group of ``by``; cycles are fine.

    Every round doubles the reachable path length: the pairs found last are
    extended by every pair known so far, so the number of rounds is the logarithm
    of the longest shortest path.
    """
    cols = [*by, src, dst]
    known = delta = store(edges.select(cols).dropna(subset=[src, dst]).distinct(), "closure")
    while delta.rows:
        heads = delta.df.withColumnRenamed(dst, "_mid")
        tails = known.hinted(known.df.withColumnRenamed(src, "_mid"))
        reached = skew_join(heads, tails, [*by, "_mid"]).select(cols).distinct()
        delta = store(reached.join(known.hinted(), cols, "left_anti"), "closure")
        known = known.plus(delta)
    return known


def closure(edges: DataFrame, src: str = "src", dst: str = "dst", by: Sequence[str] = ()) -> DataFrame:
    return closure_table(edges, src, dst, by).df


def close_property(triples: DataFrame, prop: str, by: Sequence[str] = ()) -> DataFrame:
    """Closure of one transitive property over instance data, as (s, p, o)."""
    edges = triples.filter((F.col("p") == prop) & (F.col("o_kind") == "iri")).select(*by, "s", "o")
    pairs = closure(edges, "s", "o", by)
    return pairs.select(*by, "s", F.lit(prop).alias("p"), "o")
