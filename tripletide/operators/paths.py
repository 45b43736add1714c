"""Reachability over edges: which nodes reach a set of nodes, and what lies on the walks from given nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletide.operators.joins import skew_join
from tripletide.scratch import Stored, store


def _jumps(lone: Stored, ends: Stored, by: list[str]) -> Stored:
    """(by..., node, jump, found) of nodes with one edge: where following such edges leads, and whether an end
    lies on the way, the last node included. Every round doubles the length of the jumps."""
    key = [*by, "node"]
    at_end = ends.hinted(ends.df.select(*by, F.col("node").alias("jump"), F.lit(True).alias("found")))
    first = lone.df.join(at_end, [*by, "jump"], "left").select(*key, "jump", F.coalesce("found", F.lit(False)).alias("found"))
    known = store(first.withColumn("open", ~F.col("found")), "jumps")
    rounds, moved = 0, known.rows
    # Round n covers 2**n edges, so a circle is gone round once all nodes could have been passed.
    while moved and 1 << rounds <= 2 * known.rows:
        on = known.df.select(*by, F.col("node").alias("jump"), F.col("jump").alias("on"), F.col("found").alias("then"))
        on = _ahead(known.df.filter("open"), "jump", on, by)
        step = known.df.filter("open").join(on, [*by, "jump"], "left").select(
            *key, F.coalesce("on", "jump").alias("jump"), F.coalesce("then", F.lit(False)).alias("found"),
            (F.col("on").isNotNull() & ~F.coalesce("then", F.lit(False))).alias("open"),
        )
        known = store(step.unionByName(known.df.filter("not open")), "jumps")
        moved = not known.df.filter("open").isEmpty()
        rounds += 1
    return known


def reaching(edges: DataFrame, ends: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., node) of every node with a path of one edge or more to one of ``ends`` (by..., node).

    ``edges`` are (by..., src, dst). Stretches of nodes with a single edge are jumped over, which takes as many rounds as
    the logarithm of their length; between nodes with several edges the search goes back edge by edge. No pairs of nodes
    are made, and circles end by themselves. Nodes that no edge leads to lie on no way but their own: all rounds go without
    them, and they are joined once at the end.
    """
    by = list(by)
    every = store(edges.select(*by, "src", "dst").dropna().distinct(), "edges").df
    inner = every.select(*by, F.col("dst").alias("src")).distinct()
    known = store(skew_join(every, inner, [*by, "src"], "left_semi"), "inner-edges").df
    ends = store(ends.select(*by, "node").dropna().distinct(), "ends")
    degree = known.groupBy(*by, "src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("jump"))
    lone = store(degree.filter("n = 1").select(*by, F.col("src").alias("node"), "jump"), "lone")
    jumps = _jumps(lone, ends, by)
    forks = skew_join(known, degree.filter("n > 1").select(*by, "src"), [*by, "src"], "left_semi")
    # Each edge of a fork: does it lead to an end, or else to which node with several edges?
    is_end = ends.df.select(*by, F.col("node").alias("dst"), F.lit(True).alias("is_end"))
    on = jumps.df.select(*by, F.col("node").alias("dst"), "jump", "found")
    led = store(
        forks.join(ends.hinted(is_end), [*by, "dst"], "left").join(on, [*by, "dst"], "left").select(
            *by, F.col("src").alias("node"), F.coalesce("jump", "dst").alias("next"),
            (F.coalesce("is_end", F.lit(False)) | F.coalesce("found", F.lit(False))).alias("hit"),
        ).distinct(), "forks",
    ).df
    reached = new = store(led.filter("hit").select(*by, "node").distinct(), "reached")
    back = store(led.filter("not hit").select(*by, "node", "next"), "back").df
    while new.rows:
        before = skew_join(back, new.df.withColumnRenamed("node", "next"), [*by, "next"], "left_semi").select(*by, "node").distinct()
        new = store(before.join(reached.df, [*by, "node"], "left_anti"), "reached")
        reached = reached.plus(new)
    through = jumps.df.filter("not found").join(reached.df.withColumnRenamed("node", "jump"), [*by, "jump"], "left_semi")
    parts = [jumps.df.filter("found").select(*by, "node"), through.select(*by, "node"), reached.df]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    good = store(found.unionByName(ends.df).distinct().withColumnRenamed("node", "dst"), "good")
    return skew_join(every, good.hinted(), [*by, "dst"], "left_semi").select(*by, F.col("src").alias("node")).distinct()


def _ahead(at: DataFrame, column: str, table: DataFrame, by: list[str]) -> DataFrame:
    """The rows of ``table`` (by..., column, ...) for the values of ``column`` in ``at``. Jumps soon end in few nodes: their
    rows are then marked for broadcast, so that not all rows that jumped there meet in one task."""
    targets = store(at.select(*by, column).distinct(), "targets")
    return store(table.join(F.broadcast(targets.df), [*by, column], "left_semi"), "targets").hinted() if targets.small() else table


def _lifts(lone: Stored, by: list[str]) -> list[Stored]:
    """(by..., node, jump): the node 1, 2, 4, ... steps on, for as long as nodes with one edge follow each other."""
    lifts = [lone]
    while lifts[-1].rows and 1 << len(lifts) <= 2 * lone.rows:
        last = lifts[-1].df
        on = _ahead(last, "jump", last.select(*by, F.col("node").alias("jump"), F.col("jump").alias("on")), by)
        lifts.append(store(last.join(on, [*by, "jump"]).select(*by, "node", F.col("on").alias("jump")), "lifts"))
    return [x for x in lifts if x.rows]


def walks(edges: DataFrame, starts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., start, node): the nodes on all walks along ``edges`` (by..., src, dst) from each of ``starts`` (by..., node),
    the start itself included.

    The search goes from fork to fork, jumping over stretches of nodes with a single edge. Only stretches it has entered are
    listed, by jumps of doubling length, once for all starts that enter them. Pairs are made for the given starts alone.
    """
    by = list(by)
    known = store(edges.select(*by, "src", "dst").dropna().distinct(), "edges").df
    degree = known.groupBy(*by, "src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("jump"))
    lone = store(degree.filter("n = 1").select(*by, F.col("src").alias("node"), "jump"), "lone")
    forks = store(skew_join(known, degree.filter("n > 1").select(*by, "src"), [*by, "src"], "left_semi"), "forks").df
    fork = store(forks.select(*by, F.col("src").alias("node")).distinct(), "fork")
    # Where an entry leads: the fork it is, or the fork behind its stretch.
    leads = _jumps(lone, fork, by).df.filter("found").select(*by, F.col("node").alias("entry"), F.col("jump").alias("src"))
    leads = leads.unionByName(fork.df.select(*by, F.col("node").alias("entry"), F.col("node").alias("src")))
    entered = new = store(starts.select(*by, F.col("node").alias("start"), F.col("node").alias("entry")).dropna().distinct(), "entered")
    while new.rows:
        at = skew_join(new.df, leads, [*by, "entry"]).select(*by, "start", "src").distinct()
        ahead = skew_join(forks, at, [*by, "src"]).select(*by, "start", F.col("dst").alias("entry")).distinct()
        new = store(ahead.join(entered.df, [*by, "start", "entry"], "left_anti"), "entered")
        entered = entered.plus(new)
    along = store(entered.df.select(*by, "entry", F.col("entry").alias("node")).distinct(), "stretches").df
    for lift in _lifts(lone, by):
        on = skew_join(along, lift.df, [*by, "node"]).select(*by, "entry", F.col("jump").alias("node"))
        along = store(along.unionByName(on).distinct(), "stretches").df
    return skew_join(along, entered.df, [*by, "entry"]).select(*by, "start", "node").distinct()
