"""Equi-joins whose left side may hold a very frequent key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKEW_CHECK_BYTES = 1 << 30
HOT_SHARE = 0.01


def input_bytes(df: DataFrame) -> int:
    """Estimated size of all tables ``df`` is computed from; huge where Spark cannot tell."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def marked_small(df: DataFrame) -> bool:
    """Whether ``df`` carries a broadcast mark, so that a join with it moves nothing of the other side."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() != "ResolvedHint":
        below = plan.children()
        if below.size() != 1:
            return False
        plan = below.apply(0)
    return True


def hot_keys(df: DataFrame, on: list[str], share: float = HOT_SHARE) -> list[int]:
    """Hashes of the keys holding at least ``share`` of the rows; at most ``1/share`` of them."""
    top = int(1 / share)
    row = df.agg(
        F.expr(f"approx_top_k(xxhash64({', '.join(f'`{c}`' for c in on)}), {top}, {50 * top})").alias("top"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    return [item["item"] for item in (row["top"] or []) if item["count"] >= share * row["n"]]


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    check_bytes: int = SKEW_CHECK_BYTES,
) -> DataFrame:
    """``left.join(right, on, how)`` with the frequent keys of ``left`` spread over many tasks.

    Inputs below ``check_bytes``, or against a broadcast side, are joined directly. Else one sketch pass finds
    the frequent keys. Their left rows are dealt over salts and their right rows
    are repeated once per salt; all other keys take the ordinary join. Works for
    inner, left_semi and left_anti, and for a right side of any size.
    """
    if input_bytes(left) < check_bytes or marked_small(right):
        return left.join(right, on, how)
    hot = hot_keys(left, on)
    if not hot:
        return left.join(right, on, how)
    spark = left.sparkSession
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    is_hot = F.xxhash64(*on).isin(hot)
    dealt = left.filter(is_hot).withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    every_salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    copies = right.filter(is_hot).withColumn("_salt", every_salt)
    spread = dealt.join(copies, [*on, "_salt"], how).drop("_salt")
    rest = left.filter(~is_hot).join(right, on, how)
    return rest.unionByName(spread)
