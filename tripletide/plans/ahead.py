"""Many steps of windows at once, though what is evicted depends on what the answers used.

Steps follow each other, but their answers need not wait: a run through the entries guesses which graphs each step
uses, which gives the content of the steps to come; one job then answers all of them, each as a window of its own, and
counts what they used. The next run takes a step as settled if its content is what was answered, and guesses on from the
first step whose content differs. Every round settles a step at least, and all of them where the guess holds. The runs
see a row per graph, never triples, and hold the graphs of one window and what is known of the steps looked ahead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tripletide.operators.entail import members
from tripletide.operators.lineage import usage_counts
from tripletide.operators.window import ENTRY
from tripletide.plans.epoch import PLACE, SETTINGS, Reasoning, Windows
from tripletide.scratch import Stored, store

# Steps looked ahead in the first round, and graphs of a window's steps held at a time.
AHEAD, GRAPHS = 256, 1 << 18


def _low(value) -> tuple:
    """Nulls before all values, as Spark sorts."""
    return value is not None, value


class _Supply:
    """The graphs still to come to a window, pulled in their order."""

    def __init__(self, rows: Iterator[tuple], cursor: int, n_graphs: int) -> None:
        self.rows, self.cursor, self.n_graphs = rows, cursor, n_graphs
        self.next = next(rows, None)

    def left(self) -> int:
        return self.n_graphs - self.cursor

    def take(self, n: int) -> list[tuple]:
        self.cursor += min(n, self.left())
        found = []
        while self.next is not None and self.next[0] < self.cursor:
            found.append(self.next)
            self.next = next(self.rows, None)
        return found


def _order(policy: str, graph: tuple) -> tuple:
    return _low(graph[{"FEFO": 3, "LRU": 2, "LFU": 1}[policy]]), graph[0]


def _steps(
    settings: tuple, place: tuple, held: list[tuple], known: dict[int, dict], supply: Iterator[tuple], look: int, final: bool
) -> Iterator[tuple]:
    """(kind, epoch, n_expired, n_evicted, cursor, evict_no, graphs): the ``settled`` steps, the window as ``left``
    after them, and up to ``look`` steps ``ahead``. Graphs are (graph_no, use_count, arrival, expiry).

    ``known`` are the uses of graphs by epoch, each for the content it was counted for.
    """
    (policy, size, evict, evictions), (n_graphs, cursor, evict_no) = settings, place
    coming = _Supply(supply, cursor, n_graphs)
    guess = {graph: used for epoch in sorted(known) for graph, used in known[epoch].items()}
    settling, ahead = True, 0
    while True:
        held = held + coming.take(size - len(held))
        now = max((g[2] for g in held if g[2] is not None), default=None)
        live = [g for g in held if g[3] is None or now is None or g[3] >= now]
        n_expired = len(held) - len(live)
        able = len(held) == size and (final or n_expired <= coming.left()) or final and evict_no == 1
        before = ("left", None, None, None, coming.cursor, evict_no, held)
        if not able:
            if settling:
                yield before
            return
        live += coming.take(size - len(live))
        epoch, content = evict_no - 1, {g[0] for g in live}
        if settling and known.get(epoch, {None: None}).keys() != content:
            settling = False
            yield before
        last = evictions is not None and evict_no > evictions
        out = 0 if last else size if evict == size else max(0, evict - n_expired)
        if settling:
            yield "settled", epoch, n_expired, min(len(live), out), coming.cursor, evict_no, []
        elif ahead == look:
            return
        else:
            ahead += 1
            yield "ahead", epoch, n_expired, min(len(live), out), coming.cursor, evict_no, live
        if policy != "FEFO" and evict != size and not last:
            used = known[epoch] if settling else {g: guess.get(g, 1) for g in content}
            live = [_used(g, policy, used.get(g[0]), now) for g in live]
        held = sorted(live, key=lambda g: _order(policy, g))[out:]
        free = size - len(held)
        if last or final and coming.left() < free:
            return
        evict_no += 1


def _used(graph: tuple, policy: str, use: int | None, now) -> tuple:
    number, count, arrival, expiry = graph
    if use is None:
        return graph
    return (number, count, now, expiry) if policy == "LRU" else (number, None if count is None else count + use, arrival, expiry)


def _played(rows: DataFrame, all_entries: DataFrame, known: DataFrame | None, win: Windows, look: int, final: bool) -> DataFrame:
    """(kind, epoch, n_expired, n_evicted, and the columns of windows) of what ``_steps`` yields for every window."""
    names = list(dict.fromkeys([*win.by, *win.source]))
    heads = rows.filter("graph_no is null").select(*names, F.col("cursor").alias("_from"))
    supply = all_entries.select(*win.source, *ENTRY)
    supply = supply.join(heads, list(win.source)) if win.source else supply.crossJoin(F.broadcast(heads))  # one window
    columns = [*names, *SETTINGS, *PLACE, *ENTRY, "_kind", "_epoch", "_used"]

    def as_kind(df: DataFrame, kind: int) -> DataFrame:
        return df.withColumn("_kind", F.lit(kind)).select(*[c for c in columns if c in (*df.columns, "_kind")])

    parts = [as_kind(rows, 1), as_kind(supply.filter("graph_no >= _from"), 3)]
    if known is not None:
        parts.append(as_kind(known, 2))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for late in ("_epoch", "_used"):
        if late not in whole.columns:
            whole = whole.withColumn(late, F.lit(None).cast("bigint"))
    # A window's own row opens it, then come its graphs, what is known of its steps, and the graphs to come.
    in_order = whole.select(columns).repartition(*win.by).sortWithinPartitions(*win.by, "_kind", F.col("graph_no").asc_nulls_first())
    kept = [whole.schema[c] for c in (*names, *SETTINGS, *PLACE, *ENTRY)]
    counts = [T.StructField(c, T.LongType()) for c in ("epoch", "n_expired", "n_evicted")]
    schema = T.StructType([T.StructField("kind", T.StringType()), *counts, *[T.StructField(f.name, f.dataType) for f in kept]])
    arrow = to_arrow_schema(schema)
    n, by = len(names), len(win.by)
    at = n + len(SETTINGS) + len(PLACE)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))
        out: list[tuple] = []
        for _, window in groupby(flat, key=lambda row: row[:by]):
            head, held, seen, first = next(window), [], {}, []
            for row in window:
                kind, epoch, used = row[at + 4 :]
                if kind == 3:
                    first = [row]
                    break
                if kind == 1:
                    held.append(row[at : at + 4])
                else:
                    of_epoch = seen.setdefault(epoch, {})
                    if row[at] is not None:
                        of_epoch[row[at]] = used
            settings, place = head[n : n + len(SETTINGS)], head[n + len(SETTINGS) : at]
            supply = (row[at : at + 4] for row in chain(first, window))
            for kind, epoch, gone, evicted, cursor, evict_no, graphs in _steps(settings, place, held, seen, supply, look, final):
                common = (kind, epoch, gone, evicted, *head[:n], *settings, place[0], cursor, evict_no)
                out += [(*common, *graph) for graph in ((None,) * 4, *graphs)]
                if len(out) > 50_000:
                    yield packed(out)
                    out = []
        if out:
            yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return in_order.mapInArrow(step, schema)


def advance_all(
    rows: DataFrame, all_entries: DataFrame, reasoning: Reasoning, win: Windows, tracked: bool, final: bool
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps every window as far as its graphs reach: the windows left, and of all steps the answers (by..., s, epoch)
    and moves (by..., epoch, n_expired, n_evicted).

    A step needs a full window and the graphs that replace its expired ones. At the end of the stream, ``final``, a
    window takes what is there and is through when it cannot be filled again. ``tracked``: evictions look at use.
    """
    of_epoch = [*win.by, "epoch"]
    most = max(1, GRAPHS // (rows.agg(F.max("size")).first()[0] or 1))
    look, known, said, asked, answers, moves = min(AHEAD, most), None, None, 0, [], []
    while True:
        played: Stored = store(_played(rows, all_entries, known, win, look, final), "ahead", spans=reasoning.spans())
        n = {r["kind"]: r["count"] for r in played.df.filter("graph_no is null").groupBy("kind").count().collect()}
        settled = played.df.filter("kind = 'settled'").select(*of_epoch, "n_expired", "n_evicted")
        moves.append(settled)
        if said is not None:
            answers.append(said.join(played.hinted(settled.select(of_epoch)), of_epoch, "left_semi"))
        rows = played.df.filter("kind = 'left'").select(win.columns)
        steps = played.df.filter("kind = 'ahead'")
        inside = played.hinted(
            steps.filter("graph_no is not null").select(*dict.fromkeys([*of_epoch, *win.source, "graph_no"]))
        )

        def within(goal):
            return reasoning.reach(played, goal).within(inside, [*win.source, "graph_no"], of_epoch)

        found = members(within(reasoning.query), reasoning.query, reasoning.query_class, of_epoch).select(*win.by, "s", "epoch")
        if not n.get("ahead"):
            answers = answers or [found.limit(0)]
            return rows, reduce(DataFrame.unionByName, answers), reduce(DataFrame.unionByName, moves)
        said = store(found, "answers").df
        names = list(dict.fromkeys([*win.by, *win.source]))
        known = steps.select(*names, "graph_no", F.col("epoch").alias("_epoch"))
        if tracked:
            explained = within(reasoning.explain)
            usage = usage_counts(said, explained, reasoning.explain, reasoning.explain_class, of_epoch)
            usage = store(usage.select(*of_epoch, "graph_no", F.col("usage").cast("bigint").alias("_used")), "usage").df
            known = known.join(usage.withColumnRenamed("epoch", "_epoch"), [*win.by, "_epoch", "graph_no"], "left")
        if asked:
            look = min(most, look * 4) if n.get("settled", 0) >= asked else max(min(8, most), look // 2)
        asked = n["ahead"]
