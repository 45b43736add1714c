"""Ontology tables, closed once so that data is only ever joined with finished rules.

All schema-level reasoning (sub-classes, sub-properties, inverses, existential
subsumption) happens here, on the axiom rows. What is left for the data is one
pass: a triple's predicate (or its class, for typing triples) tells directly
which classes its two ends belong to.

Axiom rows are ``(kind, a, b, c, d)``: ``subclass``/``subprop`` (sub, super),
``domain``/``range`` (property, class), ``inverse`` (property, property),
``transitive`` (property), ``equiv_some`` (class, conjunct, property, filler)
and ``sub_some`` (class, -, property, filler).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletide.operators.closure import closure_table
from tripletide.schema import TYPE_PREDICATES
from tripletide.scratch import LISTED_ROWS, Stored, literal_rows, pin, store

REGIMES = ("none", "rdfs++", "restriction")


def is_typing() -> Column:
    return F.col("p").isin(*TYPE_PREDICATES)


def cue_of() -> Column:
    """What a triple is looked up by: the class it asserts, or the predicate it uses."""
    return F.when(is_typing(), F.concat(F.lit("is "), "o")).otherwise(F.concat(F.lit("has "), "p"))


# Up to this many edges are closed on the spot, without a job per round.
CLOSED_IN_PLACE = 300


def closed(edges: DataFrame, src: str = "src", dst: str = "dst") -> Stored:
    """Closure of an ontology's edges: a few rows right here, more by distributed joins."""
    given = pin(edges.select(src, dst).dropna().distinct(), "edges")
    if given.rows > CLOSED_IN_PLACE:
        return closure_table(given.df, src, dst)
    steps: dict[str, set[str]] = {}
    for a, b in given.df.collect():
        steps.setdefault(a, set()).add(b)
    pairs = set()
    for start in steps:
        ahead = list(steps[start])
        while ahead:
            node = ahead.pop()
            if (start, node) not in pairs:
                pairs.add((start, node))
                ahead.extend(steps.get(node, ()))
    return pin(literal_rows(edges.sparkSession, sorted(pairs), given.df.schema), "closure")


def _kind(axioms: DataFrame, *kinds: str) -> DataFrame:
    return axioms.filter(F.col("kind").isin(*kinds))


def class_names(axioms: DataFrame) -> DataFrame:
    mentioned = (
        F.when(F.col("kind") == "subclass", F.array("a", "b"))
        .when(F.col("kind").isin("domain", "range"), F.array("b"))
        .when(F.col("kind").isin("equiv_some", "sub_some"), F.array("a", "b", "d"))
    )
    return axioms.select(F.explode(mentioned).alias("name")).dropna().distinct()


def property_names(axioms: DataFrame) -> DataFrame:
    mentioned = (
        F.when(F.col("kind").isin("subprop", "inverse"), F.array("a", "b"))
        .when(F.col("kind").isin("domain", "range", "transitive"), F.array("a"))
        .when(F.col("kind").isin("equiv_some", "sub_some"), F.array("c"))
    )
    return axioms.select(F.explode(mentioned).alias("name")).dropna().distinct()


def class_edges(axioms: DataFrame, regime: str) -> DataFrame:
    """Direct (sub, sup) edges; a defined class also lies below its named conjunct."""
    kinds = ("subclass", "equiv_some") if regime == "restriction" else ("subclass",)
    return _kind(axioms, *kinds).select(F.col("a").alias("sub"), F.col("b").alias("sup")).dropna().distinct()


def property_paths(axioms: DataFrame) -> DataFrame:
    """(p, q, flip): asserting p implies q, with the two ends swapped when ``flip``."""
    straight = _kind(axioms, "subprop").select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(False).alias("turn"))
    there = _kind(axioms, "inverse").select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(True).alias("turn"))
    back = there.select(F.col("y").alias("x"), F.col("x").alias("y"), "turn")
    steps = straight.unionByName(there).unionByName(back)
    # A sign in front of the name makes "read backwards" a node of its own.
    both_ways = steps.select("x", "y", "turn", F.explode(F.array(F.lit(False), F.lit(True))).alias("backwards"))
    edges = both_ways.select(
        F.concat(F.when(F.col("backwards"), "-").otherwise("+"), "x").alias("src"),
        F.concat(F.when(F.col("backwards") != F.col("turn"), "-").otherwise("+"), "y").alias("dst"),
    )
    reached = closed(edges).df.filter(F.col("src").startswith("+"))
    paths = reached.select(
        F.expr("substring(src, 2)").alias("p"),
        F.expr("substring(dst, 2)").alias("q"),
        F.col("dst").startswith("-").alias("flip"),
    )
    itself = property_names(axioms).select(
        F.col("name").alias("p"), F.col("name").alias("q"), F.lit(False).alias("flip")
    )
    return paths.unionByName(itself).distinct()


def class_order(axioms: DataFrame, edges: DataFrame) -> Stored:
    """Reflexive-transitive (sub, sup)."""
    strict = closed(edges, "sub", "sup").df
    itself = class_names(axioms).select(F.col("name").alias("sub"), F.col("name").alias("sup"))
    return pin(strict.unionByName(itself).distinct(), "class-order")


def existential_edges(axioms: DataFrame, order: DataFrame, paths: DataFrame) -> DataFrame:
    """New (sub, sup) edges: A with an existential over p.B lies below E defined by C and q.D."""
    owns = _kind(axioms, "sub_some", "equiv_some").select(F.col("a").alias("owner"), F.col("c").alias("p"), F.col("d").alias("filler"))
    inherited = owns.join(order.select("sub", F.col("sup").alias("owner")), "owner")
    widened = inherited.join(paths.filter(~F.col("flip")).select("p", "q"), "p").join(
        order.select(F.col("sub").alias("filler"), F.col("sup").alias("some_of")), "filler"
    )
    defined = _kind(axioms, "equiv_some").select(
        F.col("a").alias("sup"), F.col("b").alias("conjunct"), F.col("c").alias("q"), F.col("d").alias("some_of")
    )
    candidates = widened.join(defined, ["q", "some_of"]).select("sub", "sup", "conjunct").distinct()
    free = candidates.filter(F.col("conjunct").isNull()).select("sub", "sup")
    bound = candidates.join(order.select("sub", F.col("sup").alias("conjunct")), ["sub", "conjunct"], "left_semi")
    return free.unionByName(bound.select("sub", "sup")).distinct().join(order, ["sub", "sup"], "left_anti")


def saturated_order(axioms: DataFrame, regime: str, existential: bool, paths: DataFrame) -> Stored:
    edges = class_edges(axioms, regime)
    order = class_order(axioms, edges)
    while regime == "restriction" and existential:
        new = pin(existential_edges(axioms, order.df, paths), "existential")
        if not new.rows:
            break
        edges = order.df.filter("sub <> sup").unionByName(new.df)
        order = class_order(axioms, edges)
    return order


def saturate_tbox(axioms: DataFrame) -> DataFrame:
    """The axioms with every entailed sub-class row added, existential subsumption included."""
    paths = pin(property_paths(axioms), "property-paths").df
    order = saturated_order(axioms, "restriction", True, paths).df
    rows = order.filter("sub <> sup").select(
        F.lit("subclass").alias("kind"),
        F.col("sub").alias("a"),
        F.col("sup").alias("b"),
        F.lit(None).cast("string").alias("c"),
        F.lit(None).cast("string").alias("d"),
    )
    return axioms.unionByName(rows).distinct()


def _cues(axioms: DataFrame, order: DataFrame, paths: DataFrame) -> DataFrame:
    """(cue, side, cls): a triple looked up by ``cue`` shows that its end ``side`` is a ``cls``."""
    typed = order.select(F.concat(F.lit("is "), "sub").alias("cue"), F.lit("s").alias("side"), F.col("sup").alias("cls"))
    ends = _kind(axioms, "domain", "range").select(
        F.col("a").alias("q"), F.col("b").alias("sub"), (F.col("kind") == "domain").alias("subject")
    )
    used = paths.join(ends, "q").join(order, "sub").select(
        F.concat(F.lit("has "), "p").alias("cue"),
        F.when(F.col("subject") != F.col("flip"), "s").otherwise("o").alias("side"),
        F.col("sup").alias("cls"),
    )
    return typed.unionByName(used).distinct()


def _rules(axioms: DataFrame, order: DataFrame, paths: DataFrame, cues: DataFrame) -> DataFrame:
    """(p, flip, via, need, c, d, c_given, d_given): how triples of p put their subject into ``need``.

    One row per class above a defined class, unless its own conjunct already lies
    below that class. ``via`` names a transitive property whose paths, not only its
    single triples, count. ``c_given``/``d_given`` say that the triple itself
    already proves the conjunct or the filler.
    """
    defined = _kind(axioms, "equiv_some").select(
        F.col("a").alias("sub"), F.col("b").alias("c"), F.col("c").alias("q"), F.col("d").alias("d")
    )
    above = defined.join(order.withColumnRenamed("sup", "need"), "sub").select("c", "q", "d", "need").distinct()
    circular = order.select(F.col("sub").alias("c"), F.col("sup").alias("need"))
    useful = above.join(circular, ["c", "need"], "left_anti")
    direct = useful.join(paths, "q").select("p", "flip", F.lit(None).cast("string").alias("via"), "need", "c", "d")
    transitive = _kind(axioms, "transitive").select(F.col("a").alias("p"))
    along = useful.join(paths.join(transitive, "p", "left_semi"), "q").select(
        "p", "flip", F.col("p").alias("via"), "need", "c", "d"
    )
    rules = direct.unionByName(along).distinct()
    near, far = F.when(F.col("flip"), "o").otherwise("s"), F.when(F.col("flip"), "s").otherwise("o")
    given = cues.filter(F.col("cue").startswith("has "))
    c_given = given.select(
        F.expr("substring(cue, 5)").alias("p"), F.col("side").alias("near"), F.col("cls").alias("c"), F.lit(True).alias("c_given")
    )
    d_given = given.select(
        F.expr("substring(cue, 5)").alias("p"), F.col("side").alias("far"), F.col("cls").alias("d"), F.lit(True).alias("d_given")
    )
    return (
        rules.withColumns({"near": near, "far": far})
        .join(c_given, ["p", "near", "c"], "left")
        .join(d_given, ["p", "far", "d"], "left")
        .select(
            "p", "flip", "via", "need", "c", "d",
            (F.col("c").isNull() | F.coalesce("c_given", F.lit(False))).alias("c_given"),
            F.coalesce("d_given", F.lit(False)).alias("d_given"),
        )
    )


@dataclass(frozen=True)
class TBox:
    """The finished rule tables of one ontology under one entailment regime.

    ``rests_on`` (src, dst): membership of src can rest on membership of dst.
    ``proven_by`` leaves out what the linking triple already proves by itself: enough
    for finding members, not for explaining them.
    """

    regime: str
    order: Stored | None = None
    paths: Stored | None = None
    cues: Stored | None = None
    rules: Stored | None = None
    rests_on: Stored | None = None
    proven_by: Stored | None = None

    @staticmethod
    def of(axioms: DataFrame | TBox, regime: str = "restriction", existential: bool = True) -> TBox:
        if isinstance(axioms, TBox):
            return axioms
        if regime not in REGIMES:
            raise ValueError(f"regime must be one of {REGIMES}")
        if regime == "none":
            return TBox(regime)
        axioms = pin(axioms, "axioms").df
        paths = pin(property_paths(axioms), "property-paths")
        order = saturated_order(axioms, regime, existential, paths.df)
        cues = pin(_cues(axioms, order.df, paths.df), "cues")
        if regime == "rdfs++":
            return TBox(regime, order, paths, cues)
        rules = pin(_rules(axioms, order.df, paths.df, cues.df), "rules")
        every = F.array("c", "d")
        looked_up = F.array(F.when(~F.col("c_given"), F.col("c")), F.when(~F.col("d_given"), F.col("d")))
        rests_on, proven_by = (
            closed(rules.df.select(F.col("need").alias("src"), F.explode(classes).alias("dst")))
            for classes in (every, looked_up)
        )
        return TBox(regime, order, paths, cues, rules, rests_on, proven_by)


@dataclass(frozen=True)
class Goal:
    """The part of a TBox that can prove membership of the wanted classes.

    ``cues``, ``rules`` and ``steps`` (predicates feeding transitive properties that
    rules follow) are marked for broadcast when measured small. ``rounds`` is how
    often the rules have to be applied, or None when they depend on each other in a
    circle. ``wanted`` (cls) and ``needs`` hold the wanted classes and those looked up
    on the way, ``far`` and ``near`` list those looked up at either end of a link. The
    ``_filter`` columns keep only triples that can matter, as plain comparisons that
    reach the file scan. Lists and filters are None when they would be long: joins with
    the tables do the same then, and the results are equal.
    """

    wanted: DataFrame
    needs: tuple[str, ...] | None
    cues: DataFrame
    rules: DataFrame | None
    steps: DataFrame | None
    rounds: int | None
    far: tuple[str, ...] | None
    near: tuple[str, ...] | None
    cue_filter: Column | None
    link_filter: Column | None
    step_filter: Column | None


def goal_for(spark: SparkSession, tbox: TBox, *classes: str, explained: tuple[str, ...] = ()) -> Goal:
    """What finding the members of ``classes``, and explaining those of ``explained``, takes."""
    start = T.StructType([T.StructField("cls", T.StringType())])
    wanted = literal_rows(spark, [(c,) for c in (*classes, *explained)], start)
    for reach, sources in ((tbox.proven_by, classes), (tbox.rests_on, explained)):
        if reach is not None and reach.rows and sources:
            below = reach.df.filter(F.col("src").isin(*sources)).select(F.col("dst").alias("cls"))
            wanted = wanted.unionByName(below)
    wanted, names = _listed(wanted, "wanted")

    def about(table: Stored, column: str, few: list | None, of: DataFrame) -> DataFrame:
        if few is not None:
            return table.df.filter(F.col(column).isin([r[0] for r in few]))
        return table.df.join(of.toDF(column), column, "left_semi")

    cues = wanted.select(F.concat(F.lit("is "), "cls").alias("cue"), F.lit("s").alias("side"), "cls")
    if tbox.cues is not None:
        cues = about(tbox.cues, "cls", names, wanted).unionByName(cues)
    cues, cue_rows = _listed(cues, "goal-cues")
    rules, rule_rows = None, []
    if tbox.rules is not None and tbox.rules.rows:
        rules, rule_rows = _listed(about(tbox.rules, "need", names, wanted), "goal-rules")
        rules = None if rule_rows == [] else rules
    steps, step_rows = None, []
    if rules is not None:
        via, followed = _listed(rules.filter("via is not null").select(F.col("via").alias("q")), "goal-via")
        if followed != []:
            steps, step_rows = _listed(about(tbox.paths, "q", followed, via), "goal-steps")

    def listed(rows: list | None, value) -> tuple[str, ...] | None:
        return None if rows is None else tuple(sorted({v for v in map(value, rows) if v is not None}))

    return Goal(
        wanted=wanted,
        needs=listed(cue_rows, lambda r: r["cls"]),
        cues=cues,
        rules=rules,
        steps=steps,
        rounds=None if rule_rows is None else _depth(rule_rows, bool(explained)),
        far=listed(rule_rows, lambda r: None if r["d_given"] else r["d"]),
        near=listed(rule_rows, lambda r: None if r["c_given"] else r["c"]),
        cue_filter=None if cue_rows is None else _cue_filter([r["cue"] for r in cue_rows]),
        link_filter=_uses(listed(rule_rows, lambda r: r["p"])),
        step_filter=_uses(listed(step_rows, lambda r: r["p"])),
    )


def _listed(df: DataFrame, name: str) -> tuple[DataFrame, list | None]:
    """The distinct rows, marked for broadcast when small, and as a list when they are few."""
    df = df.distinct()
    rows = df.limit(LISTED_ROWS + 1).collect()
    if len(rows) > LISTED_ROWS:
        return store(df, name).hinted(), None
    return F.broadcast(literal_rows(df.sparkSession, [tuple(r) for r in rows], df.schema)), rows


def _depth(rule_rows: list, whole: bool) -> int | None:
    """Longest chain of classes that are each proven by rules on the next; None if it closes."""
    wants: dict[str, set[str]] = {}
    for r in rule_rows:
        looked_up = {r["c"]} if whole or not r["c_given"] else set()
        looked_up |= {r["d"]} if whole or not r["d_given"] else set()
        wants.setdefault(r["need"], set()).update(looked_up)
    depth = {c: 1 for c in wants}
    for _ in range(len(wants) + 1):
        raised = {c: 1 + max((depth.get(w, 0) for w in wants[c]), default=0) for c in wants}
        if raised == depth:
            return max(depth.values(), default=0)
        depth = raised
    return None


def _uses(predicates: tuple[str, ...] | None) -> Column | None:
    return F.col("p").isin(*predicates) if predicates else None


def _cue_filter(cues: list[str]) -> Column:
    classes = sorted(c[3:] for c in cues if c.startswith("is "))
    typed = is_typing() & F.col("o").isin(*classes)
    used = sorted({c[4:] for c in cues if c.startswith("has ")})
    return (typed | F.col("p").isin(*used)) if used else typed
