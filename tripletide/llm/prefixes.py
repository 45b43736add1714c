"""The prefix trie of conversations: which first turns are shared by which conversations.

A node is a different sequence of first turns (role, text). It is known by two 64-bit digests, each the exclusive or of
a hash of every turn at its place, so prefixes of a long conversation are digested in parallel, chunk by chunk.

A count-min sketch screens the prefixes. Each task counts its digests in two rows of cells, up to "more than one",
and sends on two bits per touched cell; merged, they say which cells hold more than one prefix. A prefix one
of whose cells counts one is in one conversation only, and so is every prefix that continues it. These tails are
written where they are: nothing about them is shuffled but one row for the count of the parent's children.
Only prefixes that may be shared are grouped, exactly. CELLS bounds the sketch (it has about four cells a prefix and row
up to there); beyond that more prefixes are grouped for nothing, and no result changes.

Sums over subtrees need no walk along the tree. Each node belongs to the smallest of its members, so summing a member's
own nodes from the end of the conversation upwards, and then all members of a node, counts every node below it once.

Hot groups: counts and sums are combined before the shuffle; parents of very many children are looked up in a table of
HOT_PARENTS rows at most, all others by an ordinary join; the ids that end in one node are first joined per 4,096
neighbouring ids, then hashed in order as a stream. A conversation of very many turns is cut into chunks of CHUNK turns.

Cases: rows without conv_id are left out; a null role or text is empty; turns are ordered by turn (null first), ties by
role and the text's md5, so equal turns count as often as they stand there. Conversations listed without turns
are members of the root. Texts are hashed whole. Other columns are not read and cannot clash. An empty table has no
nodes. Two different prefixes get equal digests with a chance of about 2**-128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripletide.llm.words import mix
from tripletide.operators.joins import skew_join
from tripletide.operators.numbering import number_rows
from tripletide.scratch import store

CHUNK = 4096
CELLS = 1 << 27
BLOCK = 1 << 13
HOT_PARENTS = 10_000
WORD = r"[^\x20\x09-\x0D]+"
NOBODY = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, a, b, words): the turns of every conversation, numbered from 0, as two hashes and a length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.md5(text).alias("tie"), F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), text, role).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return number_rows(turns, ["turn", "role", "tie"], key="conv_id", name="at").select("conv_id", "at", "a", "b", "words")


def _running(df: DataFrame, values: list[str], fold: Callable, join: Callable, backwards: bool = False) -> DataFrame:
    """``df`` with ``values`` replaced by their running fold along each conversation's depth, its own row included.

    Works in chunks: what lies before a chunk of a long conversation is folded once per chunk.
    """
    way = F.desc if backwards else F.asc
    placed = df.withColumn("chunk", F.expr(f"depth div {CHUNK}"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy(way("depth")).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumns({v: fold(v).over(inside) for v in values})
    long = store(placed.filter("chunk > 0").select("conv_id").distinct(), "long")
    totals = placed.join(long.hinted(), "conv_id", "left_semi").groupBy("conv_id", "chunk").agg(*[fold(v).alias(f"{v}_0") for v in values])
    before = Window.partitionBy("conv_id").orderBy(way("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    starts = store(totals.withColumns({f"{v}_0": F.coalesce(fold(f"{v}_0").over(before), F.lit(0)) for v in values}), "starts")
    known = run.join(starts.hinted(), ["conv_id", "chunk"], "left")
    return known.withColumns({v: join(F.col(v), F.coalesce(f"{v}_0", F.lit(0))) for v in values}).drop("chunk", *[f"{v}_0" for v in values])


def _prefixes(turns: DataFrame, everyone: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, px, py, words, last): every prefix of every conversation and its parent's digests."""
    own = turns.select(
        "conv_id", (F.col("at") + 1).alias("depth"), "words",
        F.xxhash64("at", "a", "b").alias("tx"), F.xxhash64(F.lit(1), "at", "b", "a").alias("ty"),
    )
    run = _running(own.withColumns({"x": F.col("tx"), "y": F.col("ty")}), ["x", "y"], F.bit_xor, lambda v, w: v.bitwiseXOR(w))
    lengths = everyone.join(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth")), "conv_id", "left").select(
        "conv_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.lit(True).alias("last")
    )
    roots = everyone.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("x", "y", "px", "py", "words")]
    )
    whole = run.select(
        "conv_id", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("tx")).alias("px"), F.col("y").bitwiseXOR(F.col("ty")).alias("py"), "words"
    ).unionByName(roots)
    return whole.join(lengths, ["conv_id", "depth"], "left").withColumn("last", F.coalesce("last", F.lit(False)))


# --- the sketch ----------------------------------------------------------------------


def _cells(x: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(x.view(np.uint64), row) & np.uint64(width - 1)).astype(np.int64) + row * width


def _bit(cells: np.ndarray) -> np.ndarray:
    return np.left_shift(1, cells & 7).astype(np.uint8)


def _sketch(prefixes: DataFrame, width: int) -> np.ndarray:
    """A bit per cell of two rows: whether it counts more than one prefix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(width // 4, np.uint8), np.zeros(width // 4, np.uint8)
        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in ("x", "y"))
            for row, digest in enumerate((x, y)):
                cells, times = np.unique(_cells(digest, row, width), return_counts=True)
                again = (one[cells >> 3] & _bit(cells)) != 0
                more = cells[again | (times > 1)]
                np.bitwise_or.at(two, more >> 3, _bit(more))
                np.bitwise_or.at(one, cells >> 3, _bit(cells))
        yield from packed({int(b): (one[b * BLOCK : (b + 1) * BLOCK], two[b * BLOCK : (b + 1) * BLOCK])
                           for b in np.unique(np.flatnonzero(one) // BLOCK)})

    def packed(blocks: dict) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(blocks), 64):
            part = list(blocks.items())[start : start + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in part], pa.int32()), *[pa.array([v[k].tobytes() for _, v in part], pa.binary()) for k in (0, 1)]],
                ["block", "one", "two"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple] = {}
        for batch in batches:
            for block, one, two in zip(*(batch.column(c).to_pylist() for c in ("block", "one", "two"))):
                one, two = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
                held = blocks.get(block)
                blocks[block] = (one, two) if held is None else (held[0] | one, held[1] | two | (held[0] & one))
        yield from packed(blocks)

    schema = "block int, one binary, two binary"
    local = prefixes.filter("depth > 0").select("x", "y").mapInArrow(count, schema)
    merged = local.repartition("block").mapInArrow(merge, schema)
    bits = np.zeros(width // 4, np.uint8)
    # At most 2 * CELLS bits, 32 MiB, reach the driver.
    for r in merged.select("block", "two").toLocalIterator():
        bits[r["block"] * BLOCK : r["block"] * BLOCK + len(r["two"])] = np.frombuffer(r["two"], np.uint8)
    return bits


def _screened(prefixes: DataFrame, rows: int) -> DataFrame:
    """Adds ``alone`` (proven to be in one conversation only) and ``below`` (so is the parent)."""
    width = max(4 * BLOCK, min(CELLS, 1 << (4 * rows).bit_length()))
    sketch = prefixes.sparkSession.sparkContext.broadcast(_sketch(prefixes, width))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value

        def single(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            found = np.zeros(len(x), bool)
            for row, digest in enumerate((x, y)):
                cells = _cells(digest, row, width)
                found |= (bits[cells >> 3] & _bit(cells)) == 0
            return found

        for batch in batches:
            depth, x, y, px, py = (batch.column(c).to_numpy() for c in ("depth", "x", "y", "px", "py"))
            below = (depth > 1) & single(px, py)
            alone = below | ((depth > 0) & single(x, y))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone), pa.array(below)], [*batch.schema.names, "alone", "below"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema)
    return prefixes.mapInArrow(screen, f"{schema}, alone boolean, below boolean")


# --- exact grouping ------------------------------------------------------------------


def _hashed_ends(shared: DataFrame) -> DataFrame:
    """(x, y, ends_sha256) of the conversations that end in a node."""
    near = shared.filter("last").groupBy("x", "y", F.shiftright("conv_id", 12).alias("at")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for x, y, ids in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "ids"))):
                if node != (x, y):
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (x, y), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield table(done)
        if node is not None:
            yield table([(*node, state.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        x, y, h = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(h, pa.string())], ["x", "y", "ends_sha256"])

    in_order = near.repartition("x", "y").sortWithinPartitions("x", "y", "at").select("x", "y", "ids")
    return in_order.mapInArrow(digest, "x long, y long, ends_sha256 string")


NODE = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
)


def _with_parents(asking: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """``asking`` (px, py, ...) with the smallest member of the parent node; its own conversation where that is a tail."""
    cut = max(1000, total // HOT_PARENTS)
    parents = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("found"), "n_children")
    # Children add up to ``total``, so at most HOT_PARENTS nodes have ``cut`` of them.
    hot = F.broadcast(parents.filter(F.col("n_children") >= cut).select("px", "py", F.col("found").alias("hot")))
    first = asking.join(hot, ["px", "py"], "left")
    rest = first.filter("hot is null").join(parents.filter(F.col("n_children") < cut).drop("n_children"), ["px", "py"], "left")
    found = rest.unionByName(first.filter("hot is not null").withColumn("found", F.col("hot")))
    return found.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("found", "conv_id"))).drop("found", "hot", "px", "py")


def trie(turns: DataFrame, everyone: DataFrame) -> DataFrame:
    """The nodes of conversations given by ordered turns; ``everyone`` (conv_id) also lists those without turns."""
    stored = store(_prefixes(turns, everyone), "prefixes")
    screened = store(_screened(stored.df, stored.rows), "screened").df
    shared, tails = screened.filter("not alone").drop("alone", "below"), screened.filter("alone")

    grouped = store(shared.groupBy("x", "y").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("px").alias("px"), F.min("py").alias("py"),
        F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
    ), "grouped").df
    tops = tails.filter("not below")
    edges = grouped.filter("depth > 0").select("px", "py").unionByName(tops.select("px", "py"))
    children = edges.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("more"))
    counted = store(
        grouped.join(children, ["x", "y"], "left").withColumn("n_children", F.coalesce("more", F.lit(0))).drop("more"), "counted"
    )
    nodes = counted.df

    # Each node counts for its smallest member; a conversation that ends in a node which others share, or which goes on, has no leaf.
    owned = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), "n_children")
    member = shared.join(owned, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "x", "y", F.coalesce("saved", F.lit(0)).alias("saved"),
        (F.col("last") & (F.coalesce("n_children", F.lit(1)) > 0)).cast("long").alias("blunt"),
    )
    upwards = _running(store(member, "members").df, ["saved", "blunt"], F.sum, lambda v, w: v + w, backwards=True)
    sums = upwards.groupBy("x", "y").agg(
        F.sum("saved").alias("saved_tokens"), (F.count(F.lit(1)) - F.sum("blunt")).alias("n_leaves")
    )
    full = nodes.join(sums, ["x", "y"]).join(_hashed_ends(shared), ["x", "y"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY))
    )
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    singles = tails.withColumns({
        "n_convs": one, "n_children": F.when(F.col("last"), none).otherwise(one), "n_leaves": one, "saved_tokens": none,
        "ends_sha256": F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOBODY)),
    })
    columns = [c for c in NODE if c != "parent_conv_id"] + ["px", "py"]
    asking = full.select(columns).unionByName(singles.filter("not below").select(columns))
    inner = singles.filter("below").withColumn("parent_conv_id", F.col("conv_id"))
    return _with_parents(asking, nodes, stored.rows).select(*NODE).unionByName(inner.select(*NODE))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of a table of conversations (conv_id, turn, role, text) as they are."""
    turns = store(ordered_turns(conversations), "turns").df
    return trie(turns, turns.select("conv_id").distinct())


def regrouped_trie(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """The nodes after every conversation takes over the first turns of its group's first one.

    Conversation c starts with the first crc32(c) % heads turns of c - c % group, then follow its own after as many.
    """
    turns = store(ordered_turns(conversations), "turns").df
    lengths = store(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "lengths").df
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = store(
        lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), head.alias("head")).join(bases, "base", "left").select(
            "conv_id", "base", "head", F.least("head", F.coalesce("n_base", F.lit(0))).alias("got")
        ), "plan",
    )
    # At most ``group`` conversations take over the same few turns.
    first = turns.filter(F.col("at") < heads - 1).withColumnRenamed("conv_id", "base").join(plan.df, "base").filter("at < head")
    rest = skew_join(turns, plan.hinted(), ["conv_id"]).filter("at >= head").withColumn("at", F.col("at") - F.col("head") + F.col("got"))
    columns = ["conv_id", "at", "a", "b", "words"]
    built = store(first.select(columns).unionByName(rest.select(columns)), "rebuilt").df
    return trie(built, plan.df.select("conv_id"))
