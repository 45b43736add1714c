"""Which asserted triples, and so which graphs, support an answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletide.operators.entail import LEAF, RULE, Facts, PathLeaves, facts_of, types_of
from tripletide.operators.joins import skew_join
from tripletide.operators.ontology import Goal, TBox, goal_for
from tripletide.scratch import store


def requests_of(
    answers: DataFrame, facts: Facts, goal: Goal, target: str, by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """What showing "s is a ``target``" comes down to: requests (by..., s, node, cls), "node being a cls counts for
    s", and support (by..., node, cls, leaf, graph_no), the triples that show a node to be of a class or link it so.

    Each rule that shows a request adds requests for the two classes the rule rests on.
    """
    by = list(by)
    node_cls = [*by, "node", "cls"]
    evidence = facts.evidence.select(*node_cls, *LEAF, "graph_no")
    first = answers.select(*by, "s", F.col("s").alias("node"), F.lit(target).alias("cls"))
    if goal.rounds == 0:
        return first, evidence
    types = store(types_of(facts, goal, by), "types")
    known_types = types.hinted()
    links = facts.links.select(*by, "x", "y", *RULE, *LEAF, *({"graph_no"} - set(by)))
    paths = PathLeaves(facts, goal, types.df, by) if facts.edges is not None else None
    far = known_types.select(*by, F.col("node").alias("y"), F.col("cls").alias("d"))
    near = known_types.select(*by, F.col("node").alias("x"), F.col("cls").alias("c"))
    held = skew_join(links, far, [*by, "y", "d"], "left_semi")
    held = held.filter(F.col("c").isNull()).unionByName(skew_join(held.filter("c is not null"), near, [*by, "x", "c"], "left_semi"))
    held = store(held.select(*by, F.col("x").alias("node"), F.col("need").alias("cls"), "y", "c", "d", *LEAF, "graph_no"), "links").df
    rests = store(held.select(*node_cls, "y", "c", "d").distinct(), "rests").df

    def follow(asked: DataFrame) -> DataFrame:
        used = skew_join(rests, asked, node_cls)
        base = used.select(*by, "s", F.col("node").alias("node"), F.col("c").alias("cls")).filter("cls is not null")
        found = base.unionByName(used.select(*by, "s", F.col("y").alias("node"), F.col("d").alias("cls")))
        return (found.unionByName(paths.follow(asked)) if paths else found).distinct()

    asked = new = store(first, "requests")
    rounds = 0
    while new.rows and (goal.rounds is None or rounds < goal.rounds):
        new = store(follow(new.df).join(asked.df, [*node_cls, "s"], "left_anti"), "requests")
        asked, rounds = asked.plus(new), rounds + 1
    support = evidence.unionByName(held.select(evidence.columns))
    return asked.df, support.unionByName(paths.support().select(evidence.columns)) if paths else support


def leaves_of(
    answers: DataFrame, facts: Facts, goal: Goal, target: str, by: Sequence[str] = ()
) -> DataFrame:
    """Lineage (by..., s, leaf_s, leaf_p, leaf_o, graph_no) of "s is a ``target``"."""
    asked, support = requests_of(answers, facts, goal, target, by)
    return skew_join(support, asked, [*by, "node", "cls"]).select(*by, "s", *LEAF, "graph_no").distinct()


def usage_counts(
    answers: DataFrame, facts: Facts, goal: Goal, target: str, by: Sequence[str] = ()
) -> DataFrame:
    """How many different (answer, leaf) pairs each graph supplies, without making the pairs.

    A graph's leaves are counted by what they show, (node, cls), and multiplied by the answers that ask for it. Only
    leaves that show several things asked for need the answers themselves, so that none counts twice.
    """
    by, node_cls = list(by), [*by, "node", "cls"]
    asked, support = requests_of(answers, facts, goal, target, by)
    askers = asked.groupBy(*node_cls).agg(F.count(F.lit(1)).alias("askers"))
    if goal.rounds == 0:  # every answer asks for itself only
        shown = support.filter(F.col("cls") == target).distinct().groupBy(*node_cls, "graph_no").agg(F.count(F.lit(1)).alias("n"))
        counted = skew_join(shown, askers, node_cls).select(*by, "graph_no", (F.col("n") * F.col("askers")).alias("usage"))
        return counted.groupBy(*by, "graph_no").agg(F.sum("usage").alias("usage"))
    askers = store(askers, "askers")
    wanted = skew_join(support, askers.hinted(askers.df.select(node_cls)), node_cls, "left_semi")
    shows = wanted.groupBy(*by, "graph_no", *LEAF).agg(F.sort_array(F.collect_set(F.struct("node", "cls"))).alias("shows"))
    alike = store(shows.groupBy(*by, "graph_no", "shows").agg(F.count(F.lit(1)).alias("n")), "alike").df
    one = alike.filter("size(shows) = 1").select(*by, "graph_no", "n", F.inline("shows"))
    single = skew_join(one, askers.hinted(), node_cls).select(*by, "graph_no", (F.col("n") * F.col("askers")).alias("usage"))
    several = alike.filter("size(shows) > 1").select(*by, "graph_no", "n", "shows", F.inline("shows"))
    once = skew_join(several, asked, node_cls).groupBy(*by, "graph_no", "shows", "n").agg(F.countDistinct("s").alias("askers"))
    multiple = once.select(*by, "graph_no", (F.col("n") * F.col("askers")).alias("usage"))
    return single.unionByName(multiple).groupBy(*by, "graph_no").agg(F.sum("usage").alias("usage"))


def explain_leaves(
    answers: DataFrame,
    quads: DataFrame,
    axioms: DataFrame | TBox,
    target: str,
    by: Sequence[str] = (),
    regime: str = "restriction",
) -> DataFrame:
    """Lineage of every answer at once; the ontology itself never counts as a leaf."""
    goal = goal_for(quads.sparkSession, TBox.of(axioms, regime), explained=(target,))
    return leaves_of(answers, facts_of(quads, goal, [*by, "graph_no"]), goal, target, by)


def graph_usage_of(
    answers: DataFrame,
    quads: DataFrame,
    axioms: DataFrame | TBox,
    target: str,
    by: Sequence[str] = (),
    regime: str = "restriction",
) -> DataFrame:
    """``graph_usage`` of all answers' explanations, straight from the triples."""
    goal = goal_for(quads.sparkSession, TBox.of(axioms, regime), explained=(target,))
    return usage_counts(answers, facts_of(quads, goal, [*by, "graph_no"]), goal, target, by)


def graph_usage(lineage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many distinct (answer, leaf) pairs each graph supplies."""
    pairs = lineage.select(*by, "graph_no", "s", *LEAF).distinct()
    return pairs.groupBy(*by, "graph_no").agg(F.count(F.lit(1)).alias("usage"))
