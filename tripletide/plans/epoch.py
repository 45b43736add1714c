"""One step of many independent windows at once.

A window's rows are one header (``graph_no`` null) and one row per graph it holds.
Every row carries the window's settings and its place in the stream:

    by..., source..., policy, size, evict, evictions, n_graphs, cursor, evict_no,
    graph_no, use_count, arrival_ts, expire_ts

``by`` tells windows apart; ``source`` names the stream a window reads, so that
several windows can read the same one. The header keeps a window known while it is
empty. A window holds at most ``size`` rows, so all of this stays small next to the
triples, which are only touched through ``facts``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripletide.operators.entail import Facts, members
from tripletide.operators.joins import skew_join
from tripletide.operators.lineage import usage_counts
from tripletide.operators.ontology import Goal
from tripletide.operators.window import ENTRY, policy_order
from tripletide.scratch import BROADCAST_BYTES, Stored, store

SETTINGS = ("policy", "size", "evict", "evictions")
PLACE = ("n_graphs", "cursor", "evict_no")

# Generous width of one window row, for the bound on what a broadcast may hold.
WINDOW_ROW_BYTES = 256


@dataclass(frozen=True)
class Reasoning:
    """What the windows ask (``query``) and what they explain (``explain``), over shared facts.

    ``place`` is the column the stored facts are sorted by, and ``first``/``last`` say for
    a window row which places its graph takes up; ``into`` turns facts into facts with
    ``graph_no`` where they do not have one yet. With ``width``, stored facts have a folder
    per ``width`` places, and only those of graphs in a window are listed and read.
    ``weights`` (source..., graph_no, node, n): how many leaves of a graph show that a node is of the explained
    class, where single triples can show it; then explaining needs no triples at all.
    """

    facts: Facts
    query: Goal
    query_class: str
    explain: Goal
    explain_class: str
    place: str = "graph_no"
    first: str = "graph_no"
    last: str = "graph_no"
    into: Callable[[DataFrame], DataFrame] | None = None
    width: int | None = None
    weights: DataFrame | None = None

    def spans(self) -> dict[str, tuple[Column, Column]]:
        return {"place": (F.expr(self.first), F.expr(self.last))}

    def sets(self) -> dict[str, Column]:
        """The folders of a window row's graph: a graph is no longer than one is wide."""
        if self.width is None:
            return {}
        return {end: F.expr(f"({place}) div {self.width}") for end, place in (("first", self.first), ("last", self.last))}

    def held(self, rows: Stored, df: DataFrame) -> DataFrame:
        """The part of a stored table that the graphs of ``rows`` may lie in."""
        if self.width is None:
            return df
        return df.filter(F.col("bucket").isin(sorted({*rows.spans["first"], *rows.spans["last"]}))).drop("bucket")

    def reach(self, rows: Stored, goal: Goal) -> Facts:
        """The goal's facts in the stretch of the stream that ``rows`` hold; plain filters, so the scan skips the rest."""
        span = rows.spans["place"]

        def cut(df: DataFrame | None) -> DataFrame | None:
            if df is None:
                return None
            df = self.held(rows, df)
            if None not in span:
                df = df.filter(F.col(self.place).between(*span))
            return self.into(df) if self.into else df

        facts = self.facts.for_goal(goal)
        return Facts(cut(facts.evidence), cut(facts.links), cut(facts.edges))


@dataclass(frozen=True)
class Windows:
    """Names of the key columns, and the bound on rows all windows together can hold."""

    by: tuple[str, ...]
    source: tuple[str, ...]
    slots: int

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.by, *self.source, *SETTINGS, *PLACE, *ENTRY]))

    def hint(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.slots * WINDOW_ROW_BYTES <= BROADCAST_BYTES else df

    def over(self) -> Window:
        return Window.partitionBy(*self.by)


def open_windows(settings: DataFrame, all_entries: DataFrame, win: Windows) -> DataFrame:
    """Header rows of fresh windows, one per row of ``settings``."""
    supply = all_entries.groupBy(*win.source).agg(F.count(F.lit(1)).alias("n_graphs"))
    headers = settings.join(supply, list(win.source), "left") if win.source else settings.select(
        "*", supply.scalar().alias("n_graphs")
    )
    return headers.select(
        *dict.fromkeys([*win.by, *win.source, *SETTINGS]),
        F.coalesce("n_graphs", F.lit(0)).alias("n_graphs"),
        F.lit(0).cast("bigint").alias("cursor"),
        F.lit(1).cast("bigint").alias("evict_no"),
        F.lit(None).cast("bigint").alias("graph_no"),
        F.lit(None).cast("bigint").alias("use_count"),
        F.lit(None).cast(all_entries.schema["arrival_ts"].dataType).alias("arrival_ts"),
        F.lit(None).cast(all_entries.schema["expire_ts"].dataType).alias("expire_ts"),
    )


def held(win: Windows) -> Column:
    return F.count("graph_no").over(win.over())


def store_windows(rows: DataFrame, reasoning: Reasoning | None, path: str | None = None) -> Stored:
    """Writes window rows, noting how far their cursors and the graphs they hold reach."""
    spans, sets = {"cursor": (F.col("cursor"), F.col("cursor") + 2 * F.col("size"))}, {}
    if reasoning is not None:
        spans, sets = spans | reasoning.spans(), reasoning.sets()
    return store(rows, "window", spans=spans, sets=sets, path=path)


def within_reach(all_entries: DataFrame, rows: Stored) -> DataFrame:
    """The entries the next step can take: a range the scan can skip by."""
    low, high = rows.spans["cursor"]
    return all_entries if low is None else all_entries.filter(F.col("graph_no").between(low, high))


def refill(rows: DataFrame, all_entries: DataFrame, win: Windows) -> DataFrame:
    """Adds the next ``take`` graphs (a column of every row) of its stream to each window."""
    moved = rows.withColumn("_from", F.col("cursor")).withColumn("cursor", F.col("cursor") + F.col("take"))
    heads = moved.filter(F.col("graph_no").isNull() & (F.col("take") > 0))
    upcoming = F.explode(F.sequence(F.col("_from"), F.col("cursor") - 1)).alias("graph_no")
    kept_cols = [c for c in moved.columns if c not in (*ENTRY, "_from")]
    wanted = heads.select(*kept_cols, upcoming)
    keys = [*win.source, "graph_no"]
    arrived = all_entries.select(*keys, *[c for c in ENTRY if c != "graph_no"]).join(win.hint(wanted), keys)
    return moved.drop("_from", "take").unionByName(arrived.drop("take"))


def top_up(rows: DataFrame, all_entries: DataFrame, win: Windows) -> DataFrame:
    missing = F.col("size") - held(win)
    return refill(
        rows.withColumn("take", F.least(missing, F.col("n_graphs") - F.col("cursor"))), all_entries, win
    )


def drop_expired(rows: DataFrame, win: Windows) -> DataFrame:
    """Adds the clock ``now`` and ``n_expired``; takes expired graphs out; ``take`` refills them."""
    clocked = rows.withColumn("now", F.max("arrival_ts").over(win.over()))
    marked = clocked.withColumn("_gone", F.coalesce(F.col("expire_ts") < F.col("now"), F.lit(False)))
    counted = marked.withColumns(
        {"n_expired": F.count_if("_gone").over(win.over()), "_held": held(win)}
    )
    free = F.col("size") - F.col("_held") + F.col("n_expired")
    return counted.filter(~F.col("_gone")).withColumn(
        "take", F.least(free, F.col("n_graphs") - F.col("cursor"))
    ).drop("_gone", "_held")


def is_last() -> Column:
    return F.coalesce(F.col("evict_no") > F.col("evictions"), F.lit(False))


def to_evict() -> Column:
    """How many graphs this step takes out: all, or what expiry has not already taken."""
    net = F.greatest(F.lit(0), F.col("evict") - F.col("n_expired"))
    return F.when(is_last(), 0).when(F.col("evict") == F.col("size"), F.col("size")).otherwise(net)


def wants_usage() -> Column:
    return (F.col("policy") != "FEFO") & (F.col("evict") != F.col("size")) & ~is_last()


def answer(current: Stored, reasoning: Reasoning, win: Windows) -> DataFrame:
    """(by..., s) over what each window holds now."""
    inside = current.df.filter(F.col("graph_no").isNotNull())
    facts = reasoning.reach(current, reasoning.query)
    facts = facts.within(win.hint(inside), [*win.source, "graph_no"], win.by)
    return members(facts, reasoning.query, reasoning.query_class, win.by)


def usage_of(current: Stored, answers: DataFrame, reasoning: Reasoning, win: Windows) -> DataFrame:
    """(by..., graph_no, usage) of the windows whose policy looks at use."""
    inside = current.df.filter(F.col("graph_no").isNotNull() & wants_usage())
    if reasoning.weights is not None:
        asked = win.hint(inside.select(*dict.fromkeys([*win.by, *win.source, "graph_no"])))
        shown = reasoning.held(current, reasoning.weights).join(asked, [*win.source, "graph_no"])
        used = skew_join(shown, answers.withColumnRenamed("s", "node"), [*win.by, "node"])
        return used.groupBy(*win.by, "graph_no").agg(F.sum("n").alias("usage"))
    facts = reasoning.reach(current, reasoning.explain)
    facts = facts.within(win.hint(inside), [*win.source, "graph_no"], win.by)
    return usage_counts(answers, facts, reasoning.explain, reasoning.explain_class, win.by)


def apply_usage(current: DataFrame, usage: DataFrame, win: Windows) -> DataFrame:
    keys = [*win.by, "graph_no"]
    known = current.join(usage, keys, "left")
    used = F.col("usage").isNotNull()
    return known.withColumns(
        {
            "arrival_ts": F.when(used & (F.col("policy") == "LRU"), F.col("now")).otherwise(F.col("arrival_ts")),
            "use_count": F.when(used & (F.col("policy") == "LFU"), F.col("use_count") + F.col("usage")).otherwise(
                F.col("use_count")
            ),
        }
    ).drop("usage")


def evict_step(current: DataFrame, win: Windows, stop_when_short: bool) -> DataFrame:
    """Takes out the lowest graphs by policy; ``take`` refills; finished windows leave."""
    ranked = current.withColumns(
        {
            "_rank": F.row_number().over(win.over().orderBy(F.col("graph_no").isNull(), *policy_order(F.col("policy")))),
            "_held": held(win),
            "_out": to_evict().cast("bigint"),
        }
    )
    free = F.col("size") - F.greatest(F.col("_held") - F.col("_out"), F.lit(0))
    take = F.least(free, F.col("n_graphs") - F.col("cursor"))
    done = is_last() | (take < free) if stop_when_short else is_last()
    kept = ranked.withColumn("take", take).filter(~done).filter(
        F.col("graph_no").isNull() | (F.col("_rank") > F.col("_out"))
    )
    return kept.withColumn("evict_no", F.col("evict_no") + 1).drop("_rank", "_held", "_out", "now", "n_expired")


@dataclass(frozen=True)
class Step:
    """current: the rows the query saw, with now and n_expired; answers; following: the next rows."""

    current: Stored
    answers: Stored | None
    following: Stored


def advance(
    rows: Stored,
    all_entries: DataFrame,
    reasoning: Reasoning | None,
    win: Windows,
    any_usage: bool = True,
    stop_when_short: bool = True,
    paths: tuple[str | None, str | None] = (None, None),
) -> Step:
    """Expire, refill, ask, explain, evict, refill - for every window in ``rows``.

    ``paths`` are folders for the rows the query saw and for its answers.
    """
    supply = within_reach(all_entries, rows)
    filled = refill(drop_expired(rows.df, win), supply, win)
    current = store_windows(filled.select(*win.columns, "now", "n_expired"), reasoning, paths[0])
    answers, used = None, current.df
    if reasoning is not None:
        answers = store(answer(current, reasoning, win), "answers", path=paths[1])
        if any_usage:
            used = apply_usage(current.df, usage_of(current, answers.df, reasoning, win), win)
    following = refill(evict_step(used, win, stop_when_short), supply, win)
    return Step(current, answers, store_windows(following.select(win.columns), reasoning))
