"""Entailed property and class facts over instance data.

``by`` always lists the columns that separate independent windows. They are part
of every join and distinct, so facts of one window never support another.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripletide.operators.joins import skew_join
from tripletide.operators.ontology import Goal, TBox, cue_of, goal_for, property_paths
from tripletide.operators.paths import reaching, walks
from tripletide.scratch import pin, store

LEAF = ("leaf_s", "leaf_p", "leaf_o")


# --- single rules -----------------------------------------------------------


def propagate_types(types: DataFrame, order: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(node, cls) extended to all super-classes in ``order`` (sub, sup)."""
    above = types.join(pin(order.select("sub", "sup"), "order").hinted(), F.col("cls") == F.col("sub"))
    return types.select(*by, "node", "cls").unionByName(above.select(*by, "node", F.col("sup").alias("cls"))).distinct()


def propagate_props(triples: DataFrame, axioms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Triples implied by sub-properties and inverses, the asserted ones included."""
    paths = pin(property_paths(axioms), "property-paths")
    implied = triples.join(paths.hinted(), "p").filter(~F.col("flip") | (F.col("o_kind") == "iri"))
    turned = implied.select(
        *by,
        F.when(F.col("flip"), F.col("o")).otherwise(F.col("s")).alias("s"),
        F.col("q").alias("p"),
        F.when(F.col("flip"), F.col("s")).otherwise(F.col("o")).alias("o"),
        F.when(F.col("flip"), F.lit("iri")).otherwise(F.col("o_kind")).alias("o_kind"),
    )
    return triples.select(*by, "s", "p", "o", "o_kind").unionByName(turned).distinct()


def types_from_domain(triples: DataFrame, axioms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    domains = axioms.filter(F.col("kind") == "domain").select(F.col("a").alias("p"), F.col("b").alias("cls"))
    found = triples.join(pin(domains, "domains").hinted(), "p")
    return found.select(*by, F.col("s").alias("node"), "cls").distinct()


def types_from_range(triples: DataFrame, axioms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    ranges = axioms.filter(F.col("kind") == "range").select(F.col("a").alias("p"), F.col("b").alias("cls"))
    found = triples.filter(F.col("o_kind") == "iri").join(pin(ranges, "ranges").hinted(), "p")
    return found.select(*by, F.col("o").alias("node"), "cls").distinct()


def types_from_restrictions(
    types: DataFrame, triples: DataFrame, axioms: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """One application of the defined classes: x in C with an edge p to a member of D is an E.

    Takes the types and triples as they are: closing them first is the caller's part.
    """
    defined = axioms.filter(F.col("kind") == "equiv_some").select(
        F.col("a").alias("need"), F.col("b").alias("c"), F.col("c").alias("p"), F.col("d").alias("d"),
        F.col("b").isNull().alias("c_given"), F.lit(False).alias("d_given"),
    )
    linked = triples.filter(F.col("o_kind") == "iri").join(pin(defined, "defined").hinted(), "p")
    links = linked.select(*by, F.col("s").alias("x"), F.col("o").alias("y"), "need", "c", "d", "c_given", "d_given")
    return _apply_rules(types, links, by)


# --- the fused form ----------------------------------------------------------


@dataclass(frozen=True)
class Facts:
    """What one scan of the triples yields for a goal.

    evidence: (keep..., leaf, node, cls) - the leaf triple alone shows node is a cls.
    links:    (keep..., leaf, x, y, need, c, d, c_given, d_given) - x is a ``need``
              if x is a c and y is a d. None when no rule applies.
    edges:    (keep..., leaf, src, dst, via) of transitive properties used by rules.
    """

    evidence: DataFrame
    links: DataFrame | None
    edges: DataFrame | None

    def within(self, windows: DataFrame, on: Sequence[str], by: Sequence[str]) -> Facts:
        """The facts of the graphs listed in ``windows``, now labelled by ``by``."""

        def cut(df: DataFrame | None) -> DataFrame | None:
            if df is None:
                return None
            rest = [c for c in df.columns if c not in on]
            keys = list(dict.fromkeys([*by, "graph_no"]))
            return df.join(windows.select(*dict.fromkeys([*on, *keys])), list(on)).select(*keys, *rest)

        return Facts(cut(self.evidence), cut(self.links), cut(self.edges))

    def for_goal(self, goal: Goal) -> Facts:
        """Only what the goal rests on, when these facts were gathered for several goals."""
        def among(df: DataFrame, column: str) -> DataFrame:
            if goal.needs is not None:
                return df.filter(F.col(column).isin(*goal.needs))
            return df.join(goal.wanted.toDF(column), column, "left_semi").select(df.columns)

        links = None if self.links is None or goal.rules is None else among(self.links, "need")
        return Facts(among(self.evidence, "cls"), links, self.edges if goal.steps is not None else None)


def facts_of(quads: DataFrame, goal: Goal, keep: Sequence[str] = ()) -> Facts:
    """One pass over the triples; ``keep`` lists the columns carried along (graph_no, key, ...)."""
    rows = quads.select(*dict.fromkeys([*keep, "s", "p", "o", "o_kind"]))
    resources = rows.filter(F.col("o_kind") == "iri")

    def among(df: DataFrame, condition: Column | None) -> DataFrame:
        return df if condition is None else df.filter(condition)

    leaf = [F.col("s").alias("leaf_s"), F.col("p").alias("leaf_p"), F.col("o").alias("leaf_o")]
    shown = skew_join(among(rows, goal.cue_filter).withColumn("cue", cue_of()), goal.cues, ["cue"])
    evidence = shown.filter((F.col("side") == "s") | (F.col("o_kind") == "iri")).select(
        *keep, *leaf, F.when(F.col("side") == "s", F.col("s")).otherwise(F.col("o")).alias("node"), "cls"
    )
    links = edges = None
    if goal.rules is not None:
        direct = goal.rules.filter("via is null").drop("via")
        linked = skew_join(among(resources, goal.link_filter), direct, ["p"])
        links = linked.select(*keep, *leaf, _near(), _far(), "need", "c", "d", "c_given", "d_given")
    if goal.steps is not None:
        stepped = skew_join(among(resources, goal.step_filter), goal.steps.withColumnRenamed("q", "via"), ["p"])
        edges = stepped.select(*keep, *leaf, _near().alias("src"), _far().alias("dst"), "via")
    return Facts(evidence, links, edges)


def _near() -> Column:
    return F.when(F.col("flip"), F.col("o")).otherwise(F.col("s")).alias("x")


def _far() -> Column:
    return F.when(F.col("flip"), F.col("s")).otherwise(F.col("o")).alias("y")


RULE = ("need", "c", "d", "c_given", "d_given")


def plain_links(facts: Facts, goal: Goal, by: Sequence[str]) -> DataFrame | None:
    """Links of single triples, and of paths whose far end needs no proof: one edge shows that there is a path."""
    if facts.links is None:
        return None
    base = [*by, "x", "y", *RULE]
    links = facts.links.select(base)
    if facts.edges is None or goal.rules is None:
        return links
    short = facts.edges.select(*by, "via", "src", "dst").join(goal.rules.filter("via is not null and d_given").drop("p"), "via")
    return links.unionByName(short.select(*by, *_turned("x", "y"), *RULE))


def _turned(near: str, far: str) -> list[Column]:
    return [
        F.when(F.col("flip"), F.col("dst")).otherwise(F.col("src")).alias(near),
        F.when(F.col("flip"), F.col("src")).otherwise(F.col("dst")).alias(far),
    ]


class Paths:
    """Rules over transitive properties: x is a ``need`` if a path leads to a member of d (and x is a c)."""

    def __init__(self, facts: Facts, goal: Goal, by: Sequence[str]) -> None:
        self.by, self.rules = list(by), goal.rules.filter("via is not null and not d_given").drop("p").distinct()
        self.way = ["via", "flip", "d"]
        ways = self.rules.select(self.way).distinct()
        # One set of edges per property, direction and class looked for.
        self.edges = store(
            facts.edges.select(*by, "via", "src", "dst").join(ways, "via").select(*by, *self.way, *_turned("_src", "_dst")), "path-edges"
        ).df.withColumnsRenamed({"_src": "src", "_dst": "dst"})
        self.ways = ways

    def proven(self, types: DataFrame) -> DataFrame:
        """(by..., x, need, c, c_given) of the paths that end in a member."""
        ends = types.select(*self.by, "node", F.col("cls").alias("d")).join(self.ways, "d")
        found = reaching(self.edges, ends, [*self.by, *self.way])
        return found.join(self.rules, self.way).select(*self.by, F.col("node").alias("x"), "need", "c", "c_given")


class PathLeaves:
    """The edges that show rules over transitive properties, for requested nodes only.

    A rule (need if a path of ``via`` leads to a d, and c) rests on the edges that lie on a path from the node to any
    member of d: those met on the walks from the node that still lead to a member. A walk's nodes are requests of a class
    of their own, named by property, direction and d, which the edges out of them support.
    """

    def __init__(self, facts: Facts, goal: Goal, types: DataFrame, by: Sequence[str]) -> None:
        self.by, self.way = list(by), ["via", "flip", "d"]
        leaf = [*LEAF, "graph_no"]
        self.rules = goal.rules.filter("via is not null").select(F.col("need").alias("cls"), "c", *self.way).distinct()
        ways, key = self.rules.select(self.way).distinct(), [*self.by, *self.way]
        own = [c for c in leaf if c not in self.by]
        edges = facts.edges.select(*self.by, "via", "src", "dst", *own).join(ways, "via")
        edges = edges.select(*key, *_turned("_src", "_dst"), *own).withColumnsRenamed({"_src": "src", "_dst": "dst"})
        edges = store(edges, "path-edges").df
        ends = store(types.select(*self.by, "node", F.col("cls").alias("d")).join(ways, "d").select(*key, "node"), "path-ends").df
        self.leading = store(reaching(edges, ends, key), "leading").df
        self.ends = ends.withColumnRenamed("node", "dst")
        live = self.leading.unionByName(ends).distinct().withColumnRenamed("node", "dst")
        self.edges = store(skew_join(edges, live, [*key, "dst"], "left_semi"), "live-edges").df
        self.types = types

    def _token(self) -> Column:
        return F.concat_ws("\u0001", "via", F.col("flip").cast("string"), "d").alias("cls")

    def support(self) -> DataFrame:
        """(by..., node, cls, leaf, graph_no): an edge is a leaf for each walk that passes its first node."""
        return self.edges.select(*self.by, F.col("src").alias("node"), self._token(), *LEAF, *({"graph_no"} - set(self.by)))

    def follow(self, asked: DataFrame) -> DataFrame:
        """Requests (by..., s, node, cls) that the rules over paths add to those asked."""
        by, key = self.by, [*self.by, *self.way]
        near = self.types.select(*by, "node", F.col("cls").alias("c"))
        ruled = asked.join(self.rules, "cls").select(*key, "s", "node", "c")
        held = ruled.filter("c is null").unionByName(skew_join(ruled.filter("c is not null"), near, [*by, "node", "c"], "left_semi"))
        started = store(skew_join(held, self.leading, [*key, "node"], "left_semi").select(*key, "s", "node", "c"), "started")
        if not started.rows:
            return asked.limit(0)
        passed = walks(self.edges.select(*key, "src", "dst"), started.df.select(*key, "node").distinct(), key)
        who = started.df.select(*key, "s", F.col("node").alias("start")).distinct()
        met = store(skew_join(passed, who, [*key, "start"]).select(*key, "s", "node").distinct(), "passed").df
        steps = self.edges.select(*key, F.col("src").alias("node"), "dst").distinct()
        to_end = skew_join(steps, self.ends, [*key, "dst"], "left_semi")
        shown = skew_join(to_end, met, [*key, "node"]).select(*by, "s", F.col("dst").alias("node"), F.col("d").alias("cls"))
        base = started.df.filter("c is not null").select(*by, "s", "node", F.col("c").alias("cls"))
        return met.select(*by, "s", "node", self._token()).unionByName(shown).unionByName(base).distinct()


def _apply_rules(
    types: DataFrame, links: DataFrame, by: Sequence[str], goal: Goal | None = None, paths: Paths | None = None
) -> DataFrame:
    """(node, cls) newly shown by the links, given the types known so far."""
    def among(classes: tuple[str, ...] | None) -> DataFrame:
        return types if classes is None else types.filter(F.col("cls").isin(*classes))

    far, near = (goal.far, goal.near) if goal else (None, None)
    ends = among(far).select(*by, F.col("node").alias("y"), F.col("cls").alias("d"))
    starts = among(near).select(*by, F.col("node").alias("x"), F.col("cls").alias("c"))
    far_ok = skew_join(links.filter(~F.col("d_given")), ends, [*by, "y", "d"], "left_semi").unionByName(
        links.filter("d_given")
    )
    # A node may have very many links; once their far end is checked one per rule is enough.
    per_start = far_ok.select(*by, "x", "need", "c", "c_given")
    if paths is not None:
        per_start = per_start.unionByName(paths.proven(types))
    per_start = per_start.distinct()
    near_ok = per_start.filter(~F.col("c_given")).join(starts, [*by, "x", "c"], "left_semi").unionByName(
        per_start.filter("c_given"), allowMissingColumns=True
    )
    return near_ok.select(*by, F.col("x").alias("node"), F.col("need").alias("cls")).distinct()


def types_of(facts: Facts, goal: Goal, by: Sequence[str] = ()) -> DataFrame:
    """All (node, cls) of the goal's classes and the classes they depend on."""
    types = facts.evidence.select(*by, "node", "cls").distinct()
    links = plain_links(facts, goal, by)
    if links is None:
        return types
    paths = Paths(facts, goal, by) if facts.edges is not None else None
    if goal.rounds == 1 and paths is None:
        return types.unionByName(_apply_rules(types, links, by, goal)).distinct()
    # Each round reads the last one several times, so rounds are written down.
    links = store(links.distinct(), "links").df
    known = store(types, "types")
    rounds = 0
    while goal.rounds is None or rounds < goal.rounds:
        new = store(_apply_rules(known.df, links, by, goal, paths).join(known.df, [*by, "node", "cls"], "left_anti"), "types")
        if not new.rows:
            break
        known, rounds = known.plus(new), rounds + 1
    return known.df


def members(facts: Facts, goal: Goal, cls: str, by: Sequence[str] = ()) -> DataFrame:
    """Answers (by..., s): the distinct nodes entailed to be a ``cls``."""
    types = types_of(facts, goal, by).filter(F.col("cls") == cls)
    return types.select(*by, F.col("node").alias("s"))


def instances_of(
    quads: DataFrame,
    axioms: DataFrame | TBox,
    cls: str,
    regime: str = "restriction",
    by: Sequence[str] = (),
) -> DataFrame:
    """The distinct subjects that are instances of ``cls`` under the regime, per group of ``by``."""
    goal = goal_for(quads.sparkSession, TBox.of(axioms, regime), cls)
    return members(facts_of(quads, goal, by), goal, cls, by)
