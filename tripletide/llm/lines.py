"""Removal of boilerplate lines by the number of distinct sites that hold them.

Every line (trimmed, not empty) is known by a 96-bit hash. One aggregation merges a HyperLogLog
sketch of the sites of each line, partial sketches first, so a line that a third of all documents
share is as cheap as any other. Lines whose estimate lies within BAND standard errors of the
threshold get an exact distinct count; others are decided by the sketch. The documents then
lose every line of at least ``sites`` sites.

Cases: a null text has no lines and becomes an empty one. A null site is no site. Repeated rows
are each returned, with the same result; a document counts for its own site only, however
often it holds a line. Null ids pass through. A table without text lines or rows gives
its rows unchanged, or none. Extra columns are passed on by ``without_boilerplate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripletide.llm.tables import fresh_name, saved
from tripletide.scratch import store

SITES = 10
LOG_K = 10
BAND = 5
ERROR = 0.8326 / 2 ** (LOG_K / 2)


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def boilerplate(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """(line) of every line hash of at least ``sites`` distinct values of ``site`` in ``docs`` (text and site)."""
    lines = docs.select(F.col(site).alias("site"), F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) != ''")
    lines = lines.select("site", _key(F.trim("line")).alias("line"))
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("estimate"))
    spread, _ = saved(spread.filter(F.col("estimate") >= sites * (1 - BAND * ERROR)), "spread")
    near = spread.filter(F.col("estimate") <= sites * (1 + BAND * ERROR)).select("line")
    exact = lines.filter("site is not null").join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    sure = spread.filter(F.col("estimate") > sites * (1 + BAND * ERROR)).select("line")
    return sure.unionByName(exact.filter(F.col("n") >= sites).select("line"))


def without_boilerplate(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """``docs`` with cleaned ``text``, and ``n_lines`` and ``n_removed`` (lines that are not empty)."""
    found = store(boilerplate(docs, sites, site).select("line.h", "line.g"), "boilerplate")
    text = fresh_name(docs.columns, "text__")
    own, at = (fresh_name([*docs.columns, text], c) for c in ("own__", "at__"))
    key = F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b"), F.length("text").alias("n"))
    # equal texts lose the same lines, so places are looked up by text
    places = docs.select(key.alias(own), F.posexplode(F.split("text", "\n")).alias("at", "line")).filter("trim(line) != ''")
    places = places.select(own, "at", _key(F.trim("line")).alias("k")).select(own, "at", F.col("k.h").alias("h"), F.col("k.g").alias("g"))
    gone = places.join(found.hinted(), ["h", "g"], "left_semi").distinct().groupBy(own).agg(F.collect_list("at").alias(at))
    rows = docs.withColumn(own, F.coalesce(key, F.lit(None))).join(gone, own, "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains(F.col(at), i), F.lit(False)))
    out = rows.select(
        *[F.array_join(kept, "\n").alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.size(F.filter(lines, lambda x: F.trim(x) != "")).alias(fresh_name(docs.columns, "n_lines")),
        F.coalesce(F.size(F.col(at)), F.lit(0)).alias(fresh_name(docs.columns, "n_removed")),
    )
    return out
