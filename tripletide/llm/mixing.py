"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the schedule is the van der Corput point of t (its 31 bits reversed), looked up in
the cumulative targets of the sources, so every stretch of slots holds each source close to its
share. The slots of a source are ranked and read its blocks in turn. A source's words, in
documents ordered by a hash, are read pass after pass until its target, rounded to a word, is
met; blocks are BLOCK consecutive words of that reading, so the last one may be shorter and one
may run from the end of a pass into the next. Slots ranked beyond a source's last block are left
out, blocks that no slot reaches (few words are less than a slot's share) are read after the
others: every source is taken to the word. Points are integers, so reruns agree.

No source is ordered in one task: documents are range partitioned by (source, hash) and
positions are sums inside a partition plus the partition's start. Slots are dealt in stretches;
how many slots of a source lie before a stretch follows from the bits of the stretch's number,
so no counts pass from one to another. The driver holds one row per source, and one per partition
and source in it.

Cases: a null text has size 0, and a document of size 0 is in no block. A null source is a
source of its own, in the last place. A null id is an id like any other. Repeated rows are
separate documents. An empty table gives an empty result, and a table without words has
targets of 0. Extra columns are not read; ``mixed`` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletide.llm.tables import fresh_name, listed, runs, saved
from tripletide.llm.words import text_bytes, word_spans

BLOCK = 64
MOST = 3
FEW = 10_000  # sources up to which tables of them are broadcast
BITS = 31
POINTS = 1 << BITS
STRETCH = 1 << 20


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.expr(f"regexp_count(`{text}`, r'[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], most: int = MOST) -> list[float]:
    """Shares of the total by weight; what lies above ``most`` sizes is shared again by weight."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        each = left / sum(weights[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if each * weights[i] > most * sizes[i]]
        for i in full or sorted(open_):
            out[i] = float(most * sizes[i]) if full else each * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= set(full)
    return out


@dataclass(frozen=True)
class Plan:
    """One entry per source, in code point order with null last."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]

    def bounds(self) -> np.ndarray:
        """Upper end of each source's points."""
        total = sum(self.sizes)
        out = np.array([int(POINTS * c / total) if total else 0 for c in np.cumsum(self.targets)], np.int64)
        out[-1:] = POINTS
        return out

    def slots(self, block: int) -> int:
        return -(-sum(self.sizes) // block)

    def wanted(self) -> list[int]:
        """Words that the mix takes of each source."""
        return [int(t + 0.5) for t in self.targets]

    def blocks(self, block: int) -> np.ndarray:
        return np.array([-(-w // block) for w in self.wanted()], np.int64)


def plan_of(sized: DataFrame, weights: Sequence[float], most: int = MOST) -> Plan:
    found = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    names = sorted(found, key=lambda s: (s is None, s or ""))
    sizes = [found[s] for s in names]
    return Plan(names, sizes, targets(sizes, [weights[i % len(weights)] for i in range(len(names))], most))


def point_of(t: np.ndarray) -> np.ndarray:
    """The van der Corput points of slots: their low BITS bits in reverse."""
    out = np.zeros_like(t)
    for i in range(BITS):
        out |= ((t >> i) & 1) << (BITS - 1 - i)
    return out


def points_below(slots: int, bounds: np.ndarray) -> np.ndarray:
    """How many of the first ``slots`` points lie below each bound.

    Slots that share their upper bits are an even grid of points, so one division counts them.
    """
    whole, rest = divmod(slots, POINTS)
    out, start = whole * bounds, 0
    for j in reversed(range(BITS)):
        if rest >> j & 1:
            offset = int(point_of(np.array([start]))[0])
            out = out + np.clip(-((offset - bounds) >> (BITS - j)), 0, 1 << j)
            start += 1 << j
    return out


def schedule(plan: Plan, spark: SparkSession, block: int = BLOCK) -> DataFrame:
    """(slot, source_no, block): which block of which source every slot reads, each block once."""
    slots, bounds, blocks = plan.slots(block), plan.bounds(), plan.blocks(block)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                t = np.arange(c * STRETCH, min(slots, (c + 1) * STRETCH), dtype=np.int64)
                source = np.searchsorted(bounds, point_of(t), side="right")
                before = np.diff(points_below(c * STRETCH, bounds), prepend=0)
                order = np.argsort(source, kind="stable")
                n = np.bincount(source, minlength=len(bounds))
                rank = np.empty(len(t), np.int64)
                rank[order] = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n) + before[source[order]]
                some = rank < blocks[source]
                parts = [t[some], source[some].astype(np.int64), rank[some]]
                for i in range(0, len(parts[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(p[i : i + (1 << 16)]) for p in parts], ["slot", "source_no", "block"])

    dealt = spark.range(-(-slots // STRETCH)).mapInArrow(ranked, "slot long, source_no long, block long")
    reached = np.diff(points_below(slots, bounds), prepend=0) if len(bounds) else blocks
    short = np.flatnonzero(reached < blocks)
    after = slots + np.cumsum((blocks - reached)[short]) - (blocks - reached)[short]
    rest = [(int(k), int(reached[k]), int(blocks[k]) - 1, int(a)) for k, a in zip(short, after)]
    rest = listed(spark, rest, "source_no long, low long, high long, after long")
    rest = rest.select("source_no", "low", "after", F.explode(F.sequence("low", "high")).alias("block"))
    return dealt.unionByName(rest.select((F.col("after") + F.col("block") - F.col("low")).alias("slot"), "source_no", "block"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (source, hash), with the words before each in this partition and source."""
    shard, now, at = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        source = batch.column("source_no").to_numpy()
        size = batch.column("size").to_numpy()
        before = np.empty(len(size), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(source)) + 1).tolist(), len(source)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            at = at if source[a] == now else 0
            now = source[a]
            total = np.cumsum(size[a:b])
            before[a:b] = at + total - size[a:b]
            at += int(total[-1])
        yield batch.append_column("before", pa.array(before)).append_column("shard", pa.array(np.full(len(size), shard, np.int32)))


def _uses(sized: DataFrame, plan: Plan, block: int) -> tuple[DataFrame, DataFrame]:
    """The documents with their places, and (row, pass, from, to) of every stretch of words a slot takes."""
    spark = sized.sparkSession
    numbers = listed(spark, [(s, i) for i, s in enumerate(plan.sources)], "source_name string, source_no long")
    numbered = sized.join(_hinted(numbers, plan), F.col("source").eqNullSafe(F.col("source_name"))).drop("source", "source_name")
    order = ["source_no", "mark", "tie"]
    spread = numbered.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = spread.withColumns({"before": F.lit(0).cast("long"), "shard": F.lit(0)}).schema
    placed, _ = saved(spread.mapInArrow(_placed, schema), "placed")
    total, starts, wanted = {}, [], plan.wanted()
    for r in placed.groupBy("source_no", "shard").agg(F.sum("size").alias("n")).orderBy("source_no", "shard").collect():
        k = r["source_no"]
        starts.append((k, r["shard"], total.get(k, 0), plan.sizes[k], wanted[k]))
        total[k] = starts[-1][2] + r["n"]
    starts = listed(spark, starts, "source_no long, shard int, start long, of long, wanted long")
    placed = placed.join(_hinted(starts, plan), ["source_no", "shard"]).withColumn("first", F.col("start") + F.col("before"))
    placed = placed.drop("start", "before", "shard")
    # the passes that reach a document, and the blocks of the source's reading that each of them meets
    passes = placed.filter("size > 0 AND first < wanted").withColumn("pass", F.explode(F.expr("sequence(0L, (wanted - 1 - first) div of)")))
    passes = passes.withColumn("low", F.expr("pass * of + first"))
    passes = passes.withColumn("high", F.expr("least(low + size, wanted)"))
    cut = passes.withColumn("block", F.explode(F.expr(f"sequence(low div {block}, (high - 1) div {block})")))
    # each side holds a row per block of the mix: no broadcast, however well it compresses
    taken = cut.join(schedule(plan, spark, block).hint("merge"), ["source_no", "block"]).select(
        "source_no", "doc_id", "tie", "first", "pass",
        F.expr(f"greatest(block * {block}, low) - low").alias("from"),
        F.expr(f"least((block + 1) * {block}, high) - low").alias("to"),
    )
    return placed.drop("of", "wanted"), taken


def _hinted(per_source: DataFrame, plan: Plan) -> DataFrame:
    """A table of the sources, marked for broadcast if there are few of them."""
    return F.broadcast(per_source) if len(plan.sources) <= FEW else per_source


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "source", size_of().alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("mark"), F.xxhash64(*docs.columns).alias("tie")
    )


def mix(docs: DataFrame, weights: Sequence[float], block: int = BLOCK, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs`` (doc_id, source, text).

    ``weights`` are dealt to the sources in code point order, repeating. ``taken`` counts the
    words of the document in the mix, repeats included; it is at most ``most`` sizes.
    """
    sized = _sized(docs.select("doc_id", "source", "text"))
    sized, _ = saved(sized, "sized")
    plan = plan_of(sized, weights, most)
    placed, taken = _uses(sized, plan, block)
    key = ["source_no", "first", "doc_id", "tie"]
    counted = taken.groupBy("source_no", "first").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    facts = list(zip(range(len(plan.sizes)), plan.sources, plan.sizes, plan.targets))
    facts = listed(docs.sparkSession, facts, "source_no long, source string, source_size long, target double")
    # documents of a source have different places unless they are empty
    some = placed.filter("size > 0").select(*key, "size").join(counted, ["source_no", "first"], "left")
    none = placed.filter("size = 0").select(*key, "size", F.lit(0).cast("long").alias("taken"))
    rows = some.unionByName(none).join(_hinted(facts, plan), "source_no")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def _pieces(start: str, end: str):
    """Cuts the words ``start`` to ``end`` out of a text; a whole text is left as it is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "text"):
                raw, starts = text_bytes(part.column("text"))
                begin, stop, first = word_spans(raw, starts)
                out = []
                for i, (a, b) in enumerate(zip(part.column(start).to_pylist(), part.column(end).to_pylist())):
                    low = starts[i] if a == 0 else begin[first[i] + a]
                    high = starts[i + 1] if b == first[i + 1] - first[i] else stop[first[i] + b - 1]
                    out.append(raw[low:high].tobytes().decode())
                yield part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(out, part.schema.field("text").type))

    return work


def mixed(docs: DataFrame, weights: Sequence[float], block: int = BLOCK, most: int = MOST) -> DataFrame:
    """The mix itself: ``docs`` with a row for every pass that takes words of a document.

    A pass takes a whole document or the stretch of its words that lies in the pass's blocks;
    ``n_chars`` follows the text. Documents of which nothing is taken do not appear.
    """
    tie, doc, start, end = (fresh_name(docs.columns, c) for c in ("tie__", "doc__", "from__", "to__"))
    sized, _ = saved(_sized(docs), "sized")
    plan = plan_of(sized, weights, most)
    _, taken = _uses(sized, plan, block)
    pieces = taken.groupBy("source_no", "first", "pass", F.col("doc_id").alias(doc), F.col("tie").alias(tie)).agg(
        F.min("from").alias(start), F.max("to").alias(end)
    ).drop("source_no", "first", "pass")
    texts = docs.withColumn(tie, F.xxhash64(*docs.columns)).dropDuplicates(["doc_id", tie])
    pieces = pieces.withColumnRenamed(tie, tie + "r")
    rows = texts.join(pieces, texts["doc_id"].eqNullSafe(pieces[doc]) & (texts[tie] == pieces[tie + "r"])).drop(tie, doc, tie + "r")
    out = rows.mapInArrow(_pieces(start, end), rows.schema).drop(start, end)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
