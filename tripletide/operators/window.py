"""The bounded window: filling, expiry, use, and eviction of graphs.

Entries are ``(graph_no, use_count, arrival_ts, expire_ts)``, one row per graph, plus
whatever columns tell windows apart (``by``). A window never holds more than its
``size`` graphs, so ranking inside one window is a small sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripletide.schema import MAX_TTL_SECONDS

ENTRY = ("graph_no", "use_count", "arrival_ts", "expire_ts")
POLICIES = ("FEFO", "LRU", "LFU")


def seconds(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def random_ttl(seed: int = 0, by: Sequence[str] = ()) -> Column:
    """Uniform 1 .. 25000 seconds, the same for a graph whenever it is computed again."""
    return F.pmod(F.xxhash64(F.lit(seed), *by, "graph_no"), F.lit(MAX_TTL_SECONDS)) + 1


def assign_ttl(quads: DataFrame, ttl: Column | None = None, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Window entries: a graph arrives with its last triple and expires ``ttl`` seconds later."""
    arrived = quads.groupBy(*by, "graph_no").agg(F.max(ts).alias("arrival_ts"))
    ttl = random_ttl(by=by) if ttl is None else ttl
    return arrived.select(
        *by,
        "graph_no",
        F.lit(0).cast("bigint").alias("use_count"),
        "arrival_ts",
        (F.col("arrival_ts") + seconds(ttl)).alias("expire_ts"),
    )


def fill(
    all_entries: DataFrame, entries: DataFrame, size: int, cursor: int | Column, by: Sequence[str] = ()
) -> DataFrame:
    """Entries topped up to ``size`` with the next graphs from ``cursor`` on (a number, or a column over ``by``)."""
    if not by:
        free = F.lit(size) - entries.agg(F.count(F.lit(1))).scalar()
        taken = all_entries.filter((F.col("graph_no") >= cursor) & (F.col("graph_no") < cursor + free))
        return entries.unionByName(taken.select(entries.columns))
    held = entries.groupBy(*by).agg(F.count(F.lit(1)).alias("_held"))
    upcoming = all_entries.filter((F.col("graph_no") >= cursor) & (F.col("graph_no") < cursor + size))
    taken = upcoming.join(held, list(by), "left").filter(
        F.col("graph_no") < cursor + size - F.coalesce("_held", F.lit(0))
    )
    return entries.unionByName(taken.select(entries.columns))


def expire(entries: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(live, expired); an entry expires strictly after its time."""
    gone = F.col("expire_ts") < now
    return entries.filter(~gone), entries.filter(gone)


def policy_order(policy: str | Column) -> list[Column]:
    """What goes first under each policy; equal entries go by graph number."""
    if isinstance(policy, str):
        if policy not in POLICIES:
            raise ValueError(f"policy must be one of {POLICIES}")
        first = {"FEFO": "expire_ts", "LRU": "arrival_ts", "LFU": "use_count"}[policy]
        return [F.col(first), F.col("graph_no")]
    return [
        F.when(policy == "FEFO", F.col("expire_ts")),
        F.when(policy == "LRU", F.col("arrival_ts")),
        F.when(policy == "LFU", F.col("use_count")),
        F.col("graph_no"),
    ]


def evict(
    entries: DataFrame,
    policy: str,
    evict: int,
    n_expired: DataFrame | int = 0,
    size: int | None = None,
    key: Sequence[str] | str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted): the window loses ``max(0, evict - n_expired)`` graphs by policy.

    ``n_expired`` is a number, or for windows told apart by ``key`` a DataFrame
    (key..., n_expired). When ``evict`` equals ``size`` everything goes, without ranking.
    """
    if isinstance(n_expired, DataFrame) and not key:
        raise ValueError("n_expired per window needs a key; one window takes a number")
    if size is not None and evict == size:
        return entries.filter(F.lit(False)), entries
    by = [key] if isinstance(key, str) else list(key or [])
    if not by:
        gone = entries.orderBy(*policy_order(policy)).limit(max(0, evict - n_expired))
    else:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*policy_order(policy)))
        ranked = entries.withColumn("_rank", rank).filter(F.col("_rank") <= evict)
        if isinstance(n_expired, DataFrame):
            ranked = ranked.join(n_expired, by, "left")
            ranked = ranked.filter(F.col("_rank") <= evict - F.coalesce("n_expired", F.lit(0)))
        else:
            ranked = ranked.filter(F.col("_rank") <= evict - n_expired)
        gone = ranked.select(entries.columns)
    return entries.join(gone.select(*by, "graph_no"), [*by, "graph_no"], "left_anti"), gone


def touch(entries: DataFrame, usage: DataFrame, now: Column, by: Sequence[str] = ()) -> DataFrame:
    """Least-recently-used bookkeeping: used graphs count as having arrived now."""
    used = usage.select(*by, "graph_no", F.lit(True).alias("_used"))
    return entries.join(used, [*by, "graph_no"], "left").withColumn(
        "arrival_ts", F.when(F.col("_used"), now).otherwise(F.col("arrival_ts"))
    ).select(entries.columns)


def bump(entries: DataFrame, usage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Least-frequently-used bookkeeping: adds each graph's usage to its count."""
    return entries.join(usage.select(*by, "graph_no", "usage"), [*by, "graph_no"], "left").withColumn(
        "use_count", F.col("use_count") + F.coalesce("usage", F.lit(0))
    ).select(entries.columns)


def trace(entries: DataFrame, now: Column, config: str | Column, epoch: int | Column) -> DataFrame:
    """One row per entry and step: what the window held, and what had expired."""
    config = F.lit(config) if isinstance(config, str) else config
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return entries.select(
        config.alias("config_id"), epoch.alias("epoch"), *ENTRY, (F.col("expire_ts") < now).alias("expired")
    )


# Fixed value: what the IRIs of graphs begin with.
GRAPH_BASE = "http://example.org/graphID"


def graph_label(number: Column, base: str = GRAPH_BASE) -> Column:
    """The graph's IRI, for output; inside, graphs are numbers."""
    return F.concat(F.lit(base), number.cast("string"))
