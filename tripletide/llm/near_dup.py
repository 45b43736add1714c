"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of its distinct five-word shingles (`words` of bytes other than white
space, A-Z lower-cased). Equal sets make one class at once, so copies are compared once. Each
class is sketched in rounds: in as many rounds as there are coordinates every shingle falls into a random
coordinate, in the following ones into the coordinate of the round, so that every coordinate
is filled even by a single shingle; a coordinate keeps its least (round, hash). Rows of
ROWS coordinates are bands; classes that share a band are candidates.

No bucket of candidates is expanded into pairs. Its hub (the class whose bands are the most
common) is verified against all members. A member that is not joined to the hub can be linked only
with members that differ from the hub in some of the same shingles. So these differences, rarest
first, are joined by shingle instead: only as many of each set as a link needs, and only if the
places of the common shingle leave room for enough others.
Every pair of a bucket is therefore verified, excluded by a bound, or already connected.

The number of bands follows from the threshold t, so that banding misses a pair at t with a chance
(1 - t**5)**bands of at most MISSED: 26 bands (2.4e-7) at 0.85, 39 (1.9e-7) at 0.80.

Cases: a text without words, or null, has no shingles and links with nothing; a shorter text
has its whole sequence as its only shingle. Documents with a null id take part in links; they
are never kept if a document of their component has an id. Repeated rows are one class and
each is returned; rows of one id with different texts are told apart by their sets. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletide.llm.components import components
from tripletide.llm.tables import dropped, fresh_name, runs, saved
from tripletide.llm.words import mix, shingle_hashes, word_hashes

SHINGLE = 5
ROWS = 5
MISSED = 2.5e-7
_U = np.uint64
_SKETCH = "doc_id long, n_shingles long, class binary, bands array<long>"
_SETS = "class binary, shingles array<long>"


def bands_for(percent: int) -> int:
    """Bands with which a pair at the threshold is missed with a chance of at most MISSED."""
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS)))) if percent < 100 else 1


def sketch(shingles: np.ndarray, size: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes."""
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for r in range(2 * size):
        h = mix(shingles, r + 1)
        value = (_U(r) << _U(48)) | (h >> _U(16))
        if r < size:
            np.minimum.at(out, ((h & _U(0xFFFF)) * _U(size) >> _U(16)).astype(np.int64), value)
        else:
            out[r - size] = min(out[r - size], value.min())
        if out.max() < _U((r + 1) << 48):
            break
    return out


def bands(sketched: np.ndarray) -> np.ndarray:
    parts = sketched.reshape(-1, ROWS)
    total = np.arange(1, len(parts) + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        total = mix(total ^ parts[:, i], i)
    return total.view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[bytes | None]]]:
    """Runs of rows with the shingle set and class of each."""
    for batch in batches:
        for part in runs(batch, "text"):
            words, first = word_hashes(part.column("text"))
            sets = [np.unique(shingle_hashes(words[a:b], SHINGLE)) for a, b in zip(first[:-1], first[1:])]
            ids = [
                np.array([mix(s, 101).sum(), mix(s, 102).sum()], np.uint64).tobytes() if len(s) else None for s in sets
            ]
            yield part, sets, ids


def _sketched(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets, ids in _sets(batches):
            marks = [bands(sketch(s, size)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(marks, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "class", "bands"],
            )

    return work


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets, ids in _sets(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["class", "shingles"]
        )


def _verified(pairs: DataFrame, sets: DataFrame, n: str = "shingles") -> DataFrame:
    """``pairs`` (a, b) with the sizes of their union and intersection."""
    left = sets.select(F.col("class").alias("a"), F.col(n).alias("set_a"))
    right = sets.select(F.col("class").alias("b"), F.col(n).alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return both.select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b") - shared).alias("joined"))


def _differences(spokes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A row per class and shingle in which it differs from its hub, rarest first by ``place``.

    With D the differences from the hub H, two sets are linked only if 2 |Da & Db| >= |Da| + |Db|
    - r (|A| + |B|), where r = (100 - percent) / (100 + percent). If A is not linked to H, this is at
    least (1 - r) |Db|, and at least |Da| - r (|A| + |H|) + (1 - r). So the first ``reach`` places of A
    and the first ``near_reach`` places of B hold a common shingle.
    """
    left = sets.select(F.col("class").alias("hub"), F.col("shingles").alias("of_hub"))
    both = spokes.join(left, "hub").join(sets, "class")
    found = both.select(
        "hub", "class", "part", "apart", F.size("shingles").cast("long").alias("n"),
        (F.col("joined") + F.col("shared")).alias("total"), (F.col("joined") - F.col("shared")).alias("differ"),
        F.explode(F.concat(F.array_except("shingles", "of_hub"), F.array_except("of_hub", "shingles"))).alias("x"),
    )
    found, _ = saved(found, "differing")
    held = found.groupBy("hub", "x").agg(F.count(F.lit(1)).alias("k"))
    place = F.row_number().over(Window.partitionBy("hub", "class").orderBy("k", "x"))
    whole = 100 + percent
    near_least = F.ceil(percent * F.col("differ") / whole - 1e-9)
    least = F.ceil((whole * F.col("differ") - (100 - percent) * F.col("total") + 2 * percent) / (2 * whole) - 1e-9)
    return found.join(held, ["hub", "x"]).withColumn("place", place).filter("k > 1").select(
        "hub", "class", "part", "apart", "n", "differ", "x", "place",
        (F.col("differ") - F.greatest(least, F.lit(1)) + 1).alias("reach"),
        (F.col("differ") - F.greatest(near_least, F.lit(1)) + 1).alias("near_reach"),
    )


def near_duplicates(docs: DataFrame, percent: int = 85, with_class: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Documents are linked if 100 * intersection >= ``percent`` * union. ``with_class`` adds
    ``class``, the digest of the set, by which rows can be joined with their texts again.
    """
    texts = docs.select("doc_id", "text")
    sketched, _ = saved(texts.mapInArrow(_sketched(ROWS * bands_for(percent)), _SKETCH), "sketches")
    classes = (
        sketched.filter("class is not null")
        .groupBy("class")
        .agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    rows, rows_at = saved(
        classes.select("class", "n", "first_id", F.posexplode("bands").alias("band", "mark")).select(
            "class", "n", "first_id", F.xxhash64("band", "mark").alias("bucket")
        ),
        "bands",
    )
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared, shared_at = saved(rows.join(buckets, "bucket"), "buckets")
    dropped(docs.sparkSession, rows_at)
    # the more common its bands, the nearer a class is to the middle of its group
    central = shared.groupBy("class").agg(F.sum("size").alias("weight"), F.first("first_id").alias("first_id"))
    weighted = shared.select("class", "n", "bucket").join(central.select("class", "weight"), "class")
    hubs = weighted.groupBy("bucket").agg(F.max_by(F.col("class"), F.struct("weight", "class")).alias("hub"))
    members, members_at = saved(weighted.select("class", "bucket").join(hubs, "bucket").select("class", "hub").distinct(), "members")
    # the sets of candidates only; on large inputs Spark filters the texts by a Bloom filter first
    wanted = central.select("first_id", F.lit(True).alias("wanted"))
    wanted = wanted.distinct().hint("merge")  # the same plan at every size
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["first_id"]), "left_semi")
    sets = found.mapInArrow(_shingled, _SETS).filter("class is not null").dropDuplicates(["class"])
    sets, _ = saved(sets.join(central.select("class"), "class", "left_semi"), "sets")
    dropped(docs.sparkSession, shared_at)

    enough = F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("joined")
    stars = members.filter("class != hub").select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct()
    star, _ = saved(_verified(stars, sets).withColumn("linked", enough), "stars")
    dropped(docs.sparkSession, members_at)
    links = star.filter("linked").select("a", "b")
    group = components(links)

    # Members outside their hub's component, against all members of the hub by shared differences.
    label = group.select(F.col("id").alias("class"), F.col("component").alias("part"))
    hub_label = group.select(F.col("id").alias("hub"), F.col("component").alias("hub_part"))
    spokes = star.select(F.col("a").alias("hub"), F.col("b").alias("class"), "shared", "joined")
    spokes = spokes.join(label, "class", "left").join(hub_label, "hub", "left")
    part, hub_part = F.coalesce("part", "class"), F.coalesce("hub_part", "hub")
    spokes, _ = saved(spokes.select("hub", "class", "shared", "joined", part.alias("part"), (part != hub_part).alias("apart")), "spokes")
    unsettled = spokes.filter("apart").select("hub").distinct()
    ranked, _ = saved(_differences(spokes.join(unsettled, "hub", "left_semi"), sets, percent), "differences")
    columns = ("class", "part", "apart", "n", "differ", "place")
    rest = ranked.filter("apart and place <= reach").select("hub", "x", *[F.col(c).alias(f"{c}_a") for c in columns])
    others = ranked.filter("place <= near_reach").select("hub", "x", *[F.col(c).alias(f"{c}_b") for c in columns])
    common = 1 + F.least(F.col("differ_a") - F.col("place_a"), F.col("differ_b") - F.col("place_b"))
    needed = (100 + percent) * (F.col("differ_a") + F.col("differ_b")) - (100 - percent) * (F.col("n_a") + F.col("n_b"))
    pairs = rest.join(
        others,
        (rest["hub"] == others["hub"]) & (rest["x"] == others["x"]) & (F.col("part_a") != F.col("part_b"))
        & (2 * (100 + percent) * common >= needed),
    ).select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()
    more = _verified(pairs, sets).filter(enough).select("a", "b")
    joined = components(links.unionByName(more))

    parts = classes.select("class", "first_id").join(joined.withColumnRenamed("id", "class"), "class", "left")
    parts = parts.select("class", "first_id", F.coalesce("component", "class").alias("component"))
    lowest = parts.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_class = parts.join(lowest, "component").select("class", "component", "component_id")
    out = sketched.select("doc_id", "n_shingles", "class").join(by_class, "class", "left")
    component_id = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    columns = [
        F.col("doc_id"), F.col("n_shingles"), component_id.alias("component_id"),
        F.coalesce(F.col("doc_id") == component_id, F.lit(False)).alias("kept"),
    ]
    return out.select(*columns, *(["class", "component"] if with_class else []))


def _with_class(text: str, name: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, ids in _sets(batches):
            yield part.append_column(name, pa.array(ids, pa.binary()))

    return work


def keep_first(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each component: that of the least id, nulls last.

    Documents without words are all kept.
    """
    own, best_id, best_class = (fresh_name(docs.columns, c) for c in ("class__", "best_id", "best_class"))
    found = near_duplicates(docs, percent, with_class=True).filter("class is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("best")
    best = found.groupBy("component").agg(first)
    best = best.select(F.col("best.doc_id").alias(best_id), F.col("best.class").alias(best_class))
    named = docs.mapInArrow(_with_class("text", own), T.StructType([*docs.schema, T.StructField(own, T.BinaryType())]))
    alone = named.filter(F.col(own).isNull()).drop(own)
    kept = named.filter(F.col(own).isNotNull()).join(
        best, F.col(own).eqNullSafe(F.col(best_class)) & F.col("doc_id").eqNullSafe(F.col(best_id)), "left_semi"
    )
    return kept.dropDuplicates(["doc_id", own]).drop(own).unionByName(alone)
