"""Replaying a stored stream through windows: one setting, or a whole grid in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tripletide.operators.entail import LEAF, Facts, facts_of, members
from tripletide.operators.ontology import TBox, goal_for
from tripletide.operators.quality import window_quality
from tripletide.operators.window import assign_ttl
from tripletide.plans.epoch import Reasoning, Windows, advance, open_windows, store_windows, to_evict, top_up
from tripletide.plans.spec import WindowSpec
from tripletide.scratch import Appended, Stored, store


# Places of the stream per folder of extracted facts.
WIDTH = 1 << 20


def reasoning_over(
    quads: DataFrame,
    axioms: DataFrame | TBox,
    query_class: str,
    explain_class: str,
    regime: str,
    source: Sequence[str],
    place: str = "graph_no",
    width: int = WIDTH,
    first: str = "graph_no",
    last: str = "graph_no",
    into: Callable[[DataFrame], DataFrame] | None = None,
) -> Reasoning:
    """Scans the triples once for everything both classes need, and writes it down by ``place``.

    Later steps only read this extract, and of it only the folders their windows' graphs lie in.
    """
    spark, tbox = quads.sparkSession, TBox.of(axioms, regime)
    keep = [c for c in source if c in quads.columns]
    found = facts_of(quads, goal_for(spark, tbox, query_class, explained=(explain_class,)), [*keep, place])
    parts = (found.evidence, found.links, found.edges)

    def kept(df: DataFrame) -> DataFrame:
        return store(df.withColumn("bucket", F.expr(f"`{place}` div {width}")), "facts", sort_by=["bucket", place], folder_by="bucket").df

    reasoning = Reasoning(
        Facts(*(None if df is None else kept(df) for df in parts)),
        goal_for(spark, tbox, query_class),
        query_class,
        goal_for(spark, tbox, explained=(explain_class,)),
        explain_class,
        place,
        first,
        last,
        into,
        width,
    )
    if reasoning.explain.rounds != 0:
        return reasoning
    shown = reasoning.facts.for_goal(reasoning.explain).evidence.filter(F.col("cls") == explain_class).drop("bucket")
    shown = into(shown) if into else shown
    per_graph = [*source, "graph_no", "node"]
    weights = shown.select(*per_graph, *LEAF).distinct().groupBy(per_graph).agg(F.count(F.lit(1)).alias("n"))
    weights = weights.withColumn("bucket", F.expr(f"({first}) div {width}"))
    return replace(reasoning, weights=store(weights, "weights", sort_by=["bucket", "graph_no"], folder_by="bucket").df)


@dataclass(frozen=True)
class Played:
    """All steps of all windows, each of the two tables read by one scan.

    moves: (by..., epoch, n_expired, n_evicted); answers: (by..., epoch, s).
    """

    moves: DataFrame
    answers: DataFrame


def _play(size: int, evict: int, evictions: int | None, graphs: Iterator[tuple]) -> Iterator[tuple]:
    """Steps of a window whose content does not depend on answers: (epoch, graphs, n_expired, n_evicted).

    ``graphs`` are (graph_no, arrival, expiry) in the order of the stream, pulled as the window has room.
    """
    held, epoch = list(islice(graphs, size)), 0
    while True:
        now = max((g[1] for g in held), default=None)
        live = [g for g in held if g[2] >= now]
        n_expired = len(held) - len(live)
        live += islice(graphs, size - len(live))
        last = evictions is not None and epoch >= evictions
        out = 0 if last else size if evict == size else max(0, evict - n_expired)
        yield epoch, live, n_expired, min(out, len(live))
        held = sorted(live, key=lambda g: (g[2], g[0]))[out:]
        fresh = list(islice(graphs, size - len(held)))
        if last or len(held) + len(fresh) < size:
            return
        held, epoch = held + fresh, epoch + 1


def scheduled(settings: Stored, all_entries: DataFrame, by: Sequence[str], source: Sequence[str]) -> DataFrame:
    """(by..., source..., epoch, graph_no, n_expired, n_evicted) of windows that need no answers to step: first to
    expire goes, or everything. One pass, each window in the order of its stream, holding ``size`` graphs at a time.
    A window of no graphs has a row without one.
    """
    names = list(dict.fromkeys([*by, *source]))
    on = list(source) or ["_stream"]
    asked, supply = settings.df.select(*names, "size", "evict", "evictions"), all_entries
    if not source:
        asked, supply = asked.withColumn("_stream", F.lit(0)), supply.withColumn("_stream", F.lit(0))
    times = [F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("arrival_ts", "expire_ts")]
    # What a window can take: its size at first, and as much twice a step at most.
    reach = F.col("evictions").isNull() | (F.col("graph_no") < F.col("size") * (2 * F.col("evictions") + 3))
    rows = supply.select(*on, "graph_no", *times).join(settings.hinted(asked), on).filter(reach)
    bare = asked.select(*[F.col(c) if c in asked.columns else F.lit(None).cast("bigint").alias(c) for c in rows.columns])
    # A row without a graph opens every window, those without a stream included.
    in_order = rows.unionByName(bare).repartition(*by).sortWithinPartitions(*by, F.col("graph_no").asc_nulls_first())
    fields = [settings.df.schema[c] for c in names]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("epoch", "graph_no", "n_expired", "n_evicted")]])
    arrow = to_arrow_schema(schema)
    columns = [*names, "size", "evict", "evictions", "graph_no", "arrival_ts", "expire_ts"]
    n, keys = len(names), len(by)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))
        out: list[tuple] = []
        for _, window in groupby(flat, key=lambda row: row[:keys]):
            opening = next(window)
            size, evict, evictions = opening[n : n + 3]
            for epoch, graphs, n_expired, n_evicted in _play(size, evict, evictions, (r[n + 3 :] for r in window)):
                out += [(*opening[:n], epoch, g, n_expired, n_evicted) for g in (None, *(g[0] for g in graphs))]
                if len(out) > 50_000:
                    yield packed(out)
                    out = []
        if out:
            yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return in_order.select(columns).mapInArrow(step, schema)


def _together(rows: Stored, reasoning: Reasoning, by: list[str], source: Sequence[str]) -> Played:
    """Answers all epochs of all scheduled windows in one job: each epoch is a window of its own."""
    of_epoch = [*by, "epoch"]
    inside = rows.hinted(rows.df.filter("graph_no is not null").select(*dict.fromkeys([*of_epoch, *source, "graph_no"])))
    facts = reasoning.reach(rows, reasoning.query).within(inside, [*source, "graph_no"], of_epoch)
    answers = store(members(facts, reasoning.query, reasoning.query_class, of_epoch), "answers").df
    return Played(rows.df.filter("graph_no is null").select(*of_epoch, "n_expired", "n_evicted"), answers)


def _one_by_one(settings: Stored, all_entries: DataFrame, reasoning: Reasoning, win: Windows) -> Played:
    """Steps windows whose evictions depend on what their graphs were used for, all at once, step by step."""
    spark, by = settings.df.sparkSession, list(win.by)
    seen, said = Appended(spark, "current"), Appended(spark, "answers")
    opened = top_up(open_windows(settings.df, all_entries, win), all_entries, win)
    rows, n, shown = store_windows(opened.select(win.columns), reasoning), 0, None
    while rows.rows:
        shown = advance(rows, all_entries, reasoning, win, paths=(seen.path(n), said.path(n)))
        rows, n = shown.following, n + 1
    current = seen.read(shown.current.df.schema, "epoch")
    moves = current.groupBy(*by, "epoch").agg(
        F.max("n_expired").alias("n_expired"), F.least(F.count("graph_no"), F.max(to_evict())).cast("bigint").alias("n_evicted")
    )
    return Played(moves, said.read(shown.answers.df.schema, "epoch"))


def run_windows(
    settings: DataFrame, all_entries: DataFrame, reasoning: Reasoning, by: Sequence[str], source: Sequence[str]
) -> Played:
    """Steps all windows until each has used up its evictions or its stream."""
    by = list(by)
    tracked = (F.col("policy") != "FEFO") & (F.col("evict") != F.col("size"))
    stepping, fixed = store(settings.filter(tracked), "settings"), store(settings.filter(~tracked), "settings")
    parts = []
    if fixed.rows:
        rows = store(
            scheduled(fixed, all_entries, by, source), "schedule", spans=reasoning.spans(), sets=reasoning.sets()
        )
        parts.append(_together(rows, reasoning, by, source))
    if stepping.rows:
        slots = stepping.df.agg(F.sum("size")).first()[0]
        parts.append(_one_by_one(stepping, all_entries, reasoning, Windows(tuple(by), tuple(source), slots)))
    if not parts:
        raise ValueError("no settings to replay")
    return Played(
        reduce(DataFrame.unionByName, [p.moves for p in parts]), reduce(DataFrame.unionByName, [p.answers for p in parts])
    )


def epoch_metrics(played: Played, truth: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per window and step: quality of the answer, and what expired and was evicted."""
    keys = [*by, "epoch"]
    return window_quality(played.answers, truth, keys, windows=played.moves).join(played.moves, keys)


def sweep(
    stream: DataFrame,
    axioms: DataFrame | TBox,
    configs: DataFrame,
    truth: DataFrame,
    query_class: str,
    explain_class: str,
    position: str = "pos",
    ttl: Column | None = None,
    all_entries: DataFrame | None = None,
    regime: str = "restriction",
    width: int = WIDTH,
) -> DataFrame:
    """Every configuration over the same stream, stepping together; a row per config and epoch.

    ``stream`` is triples with a dense ``position`` (see number_rows) and, unless
    ``all_entries`` (n_triples, graph_no, use_count, arrival_ts, expire_ts) is given, a ``ts``.
    The triples are scanned once; cutting them into graphs of different lengths
    happens on the extract.
    """
    configs = store(configs, "configs").df
    # The lengths in a settings table: a handful of integers.
    lengths = sorted(r["n_triples"] for r in configs.select("n_triples").distinct().collect())

    def cut(df: DataFrame) -> DataFrame:
        per_length = df.withColumn("n_triples", F.explode(F.array(*[F.lit(n) for n in lengths])))
        return per_length.withColumn("graph_no", F.expr(f"`{position}` div n_triples"))

    if all_entries is None:
        all_entries = assign_ttl(cut(stream.select(position, "ts")), ttl, ["n_triples"])
    all_entries = store(all_entries, "entries", sort_by=["graph_no"]).df
    reasoning = reasoning_over(
        stream, axioms, query_class, explain_class, regime, ["n_triples"], position,
        max(width, *lengths, 1), "graph_no * n_triples", "graph_no * n_triples + n_triples - 1", cut,
    )
    return epoch_metrics(run_windows(configs, all_entries, reasoning, ["config_id"], ["n_triples"]), truth, ["config_id"])


def replay(
    quads: DataFrame,
    all_entries: DataFrame,
    axioms: DataFrame | TBox,
    spec: WindowSpec,
    truth: DataFrame,
    key: str | None = None,
    config_id: str = "run",
    width: int = WIDTH,
) -> DataFrame:
    """One setting over stored quads: a row per step, and per ``key`` when windows are keyed.

    ``quads`` carry ``graph_no`` (and ``key``); ``all_entries`` has one row per graph.
    """
    keys = [key] if key else []
    all_entries = store(all_entries, "entries", sort_by=["graph_no"]).df
    streams = all_entries.select(key).distinct() if key else quads.sparkSession.range(1).select()
    settings = streams.select(
        *keys,
        F.lit(config_id).alias("config_id"),
        F.lit(spec.policy).alias("policy"),
        F.lit(spec.size).alias("size"),
        F.lit(spec.evict).alias("evict"),
        F.lit(spec.evictions).cast("int").alias("evictions"),
    )
    reasoning = reasoning_over(
        quads, axioms, spec.query_class, spec.explain_class, spec.regime, keys, width=max(1, width // spec.n_triples)
    )
    by = ["config_id", *keys]
    return epoch_metrics(run_windows(settings, all_entries, reasoning, by, keys), truth, by)
