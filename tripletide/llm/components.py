"""Connected components of an edge table by alternating large and small stars.

Every round points each node at the least node of its neighbourhood, so chains shorten
geometrically and no task ever holds the neighbours of a node: minima are partial
aggregates, and a hub's edges meet its minimum in an ordinary join that can be split.
Rounds cut their lineage by tables in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tripletide.llm.tables import dropped
from tripletide.scratch import scratch_path

ROUNDS = 60


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """``edges`` has u > v. Both stars of a round."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))  # every node u with its larger neighbours v
    large = larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.filter("m < u").select("u", F.col("m").alias("v"))  # a node keeps its way to the least neighbour
    large = large.unionByName(own).filter("u > v").distinct()
    small = large.join(_least(large), "u")
    moved = small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of ``edges``: component is the least id reachable.

    Null ends and loops are ignored; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    now = edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).distinct()
    seen, path = None, None
    for _ in range(ROUNDS):
        to, stat = scratch_path(spark, "stars"), Observation()
        out = _round(now) if path else now
        mark = F.xxhash64("u", "v")
        out.observe(stat, F.count(F.lit(1)).alias("n"), F.sum(F.pmod(mark, F.lit(1 << 30))).alias("s")).write.parquet(to)
        now = spark.read.schema(out.schema).parquet(to)
        if path:
            dropped(spark, path)
        path, found = to, (stat.get.get("n"), stat.get.get("s"))
        if found == seen or not found[0]:
            break
        seen = found
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
