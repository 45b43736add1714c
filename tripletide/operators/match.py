"""Triple patterns, joins of patterns, and whole-graph set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripletide.operators.joins import SKEW_CHECK_BYTES, input_bytes, skew_join
from tripletide.scratch import store

TERMS = ("s", "p", "o")


def match(
    quads: DataFrame,
    s: str | None = None,
    p: str | None = None,
    o: str | None = None,
    graph: bool = False,
    distinct: bool = True,
) -> DataFrame:
    """Triples with the given constant terms.

    Without ``graph`` the answer is over the union of all graphs, so a triple held
    by two graphs counts once. With it, ``graph_no`` is a result column and rows of
    the default graph (no number) are left out.
    """
    rows = quads
    for name, value in zip(TERMS, (s, p, o)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    cols = [*TERMS, "o_kind"]
    if graph:
        rows = rows.filter(F.col("graph_no").isNotNull())
        cols = ["graph_no", *cols]
    rows = rows.select(cols)
    return rows.distinct() if distinct else rows


Pattern = tuple[str, str, str]


def _variables(pattern: Pattern) -> list[str]:
    return list(dict.fromkeys(t for t in pattern if t.startswith("?")))


def _fits(pattern: Pattern) -> Column:
    """Whether a triple has the pattern's constants, and equal terms where a variable stands twice."""
    fits, seen = F.lit(True), {}
    for name, term in zip(TERMS, pattern):
        if not term.startswith("?"):
            fits = fits & (F.col(name) == term)
        elif term in seen:
            fits = fits & (F.col(name) == F.col(seen[term]))
        seen.setdefault(term, name)
    return fits


def _bindings(quads: DataFrame, patterns: Sequence[Pattern]) -> tuple[list[DataFrame], list[int]]:
    """Per pattern the distinct values of its variables and their number, all from one scan of the triples."""
    places = [{v: TERMS[t.index(v)] for v in _variables(t)} for t in patterns]
    found = F.array(*[
        F.when(_fits(t), F.struct(F.lit(i).alias("pattern"), *[
            (F.col(c) if c in at.values() else F.lit(None).cast("string")).alias(c) for c in TERMS
        ]))
        for i, (t, at) in enumerate(zip(patterns, places))
    ])
    some = quads.filter(reduce(Column.__or__, map(_fits, patterns)))
    tagged = some.select(F.explode(found).alias("t")).filter("t is not null").select("t.*").distinct()
    tagged = store(tagged, "bindings", folder_by="pattern").df
    counts = dict(tagged.groupBy("pattern").count().collect())  # a number per pattern
    rows = [
        tagged.filter(F.col("pattern") == i).select([F.col(c).alias(v[1:]) for v, c in at.items()])
        for i, at in enumerate(places)
    ]
    return rows, [counts.get(i, 0) for i in range(len(patterns))]


def _join_order(patterns: Sequence[Pattern], counts: Sequence[int]) -> list[int]:
    """The fewest bindings first, then always the fewest among those that share a variable with what is there."""
    waiting = sorted(range(len(patterns)), key=lambda i: (counts[i], i))
    ordered = [waiting.pop(0)]
    while waiting:
        bound = {v for i in ordered for v in _variables(patterns[i])}
        linked = next((i for i in waiting if bound.intersection(_variables(patterns[i]))), None)
        if linked is None:
            raise ValueError("patterns must be connected by shared variables")
        ordered.append(linked)
        waiting.remove(linked)
    return ordered


# A pattern with so many times fewer bindings than another thins that one out before they are joined.
THINS = 4


def bgp(quads: DataFrame, patterns: Sequence[Pattern], select: Sequence[str]) -> DataFrame:
    """Distinct answers of a conjunction of triple patterns over the union of all graphs.

    Bindings are counted as they are read; the counts give the order of the joins, and patterns with few
    bindings first take out of larger ones what can have no partner.
    """
    open_patterns = [t for t in patterns if _variables(t)]
    rows, counts = _bindings(quads, open_patterns)
    order = _join_order(open_patterns, counts)

    def shared(left: DataFrame, right: DataFrame) -> list[str]:
        return [c for c in left.columns if c in right.columns]

    thin = dict(enumerate(rows))
    for k, i in enumerate(order):
        for j in order[:k]:
            on = shared(thin[i], rows[j])
            if on and THINS * counts[j] <= counts[i]:
                thin[i] = skew_join(thin[i], rows[j].select(on), on, "left_semi")
    answers = thin[order[0]]
    for i in order[1:]:
        if input_bytes(answers) >= SKEW_CHECK_BYTES:  # else looking for frequent keys would repeat the joins before
            answers = store(answers, "answers").df
        answers = skew_join(answers, thin[i], shared(answers, thin[i]))
    for s, p, o in (t for t in patterns if not _variables(t)):
        answers = answers.filter(match(quads, s, p, o, distinct=False).exists())
    return answers.select([v.lstrip("?") for v in select]).distinct()


def count_quads(quads: DataFrame) -> DataFrame:
    """Number of distinct (graph, s, p, o) in named graphs."""
    held = quads.filter(F.col("graph_no").isNotNull()).select("graph_no", *TERMS).distinct()
    return held.agg(F.count(F.lit(1)).alias("n_quads"))


def drop_graphs(quads: DataFrame, graph_nos: DataFrame, on: Sequence[str] = ("graph_no",)) -> DataFrame:
    """Quads of all graphs but the listed ones; rows of the default graph stay."""
    return skew_join(quads, graph_nos.select(*on), list(on), "left_anti")


def union_graphs(quads: DataFrame, tbox_triples: DataFrame) -> DataFrame:
    """The merged graph: every triple once, background knowledge included."""
    cols = [*TERMS, "o_kind"]
    return quads.select(cols).unionByName(tbox_triples.select(cols)).distinct()
