"""Reachability, usage counts and patterns against plain-Python models."""

import random

import pytest
from pyspark.sql import functions as F

from tests import university
from tripletide import TBox, bgp, instances_of
from tripletide.operators.lineage import explain_leaves, graph_usage, graph_usage_of
from tripletide.operators.paths import reaching, walks


def brute_reaching(edges, ends):
    before = {}
    for a, b in edges:
        before.setdefault(b, set()).add(a)
    found, ahead = set(), list(ends)
    while ahead:
        for a in before.get(ahead.pop(), ()):
            if a not in found:
                found.add(a)
                ahead.append(a)
    return found


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def ends_of(spark, nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node string")


@pytest.mark.parametrize("seed, n, m", [(1, 12, 14), (2, 40, 44), (3, 30, 70)])
def test_reaching_equals_brute_force(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] + [("loop", "loop"), (None, "n1")]
    ends = [f"n{rng.randrange(n)}" for _ in range(2)]
    got = [r.node for r in reaching(frame(spark, edges), ends_of(spark, ends)).collect()]
    assert sorted(got) == sorted(brute_reaching([e for e in edges if None not in e], ends))


def test_a_long_chain_takes_few_rounds(spark):
    edges = [(f"c{i}", f"c{i + 1}") for i in range(5000)] + [("side", "c4000"), ("side", "off"), ("round1", "round2"), ("round2", "round1")]
    got = {r.node for r in reaching(frame(spark, edges), ends_of(spark, ["c4500"])).collect()}
    assert got == {f"c{i}" for i in range(4500)} | {"side"}


def test_a_class_defined_over_a_long_path(spark):
    rules = university.axioms(spark, [("transitive", "partOf", None, None, None), ("equiv_some", "Local", None, "partOf", "Country")])
    triples = [(f"p{i}", "partOf", f"p{i + 1}", "iri") for i in range(3000)] + [("p2500", "rdf:type", "Country", "iri")]
    got = {r.s for r in instances_of(university.quads(spark, triples), TBox.of(rules), "Local").collect()}
    assert got == {f"p{i}" for i in range(2500)}


def counts(df):
    return {(r.graph_no, r.usage) for r in df.collect()}


@pytest.mark.parametrize("target", ["Professor", "Person", "Employee", "Student"])
def test_usage_counts_equal_counted_pairs(spark, target):
    quads, rules = university.quads(spark), TBox.of(university.axioms(spark))
    doubled = quads.unionByName(quads.filter("graph_no < 2")).unionByName(quads.withColumn("graph_no", F.col("graph_no") + 3))
    answers = instances_of(doubled, rules, target)
    assert counts(graph_usage_of(answers, doubled, rules, target)) == counts(graph_usage(explain_leaves(answers, doubled, rules, target)))


def test_a_leaf_that_shows_several_things_counts_once(spark):
    rules = TBox.of(university.axioms(spark, [
        ("domain", "knows", "Person", None, None), ("range", "knows", "Person", None, None), ("equiv_some", "Known", "Person", "knows", "Person"),
    ]))
    people = [("a", "knows", "b", "iri"), ("b", "knows", "a", "iri"), ("c", "knows", "a", "iri"), ("c", "knows", "c", "iri")]
    quads = university.quads(spark, people, n=1)
    answers = instances_of(quads, rules, "Known")
    assert counts(graph_usage_of(answers, quads, rules, "Known")) == counts(graph_usage(explain_leaves(answers, quads, rules, "Known")))


def test_usage_around_a_hub_makes_no_pairs(spark):
    n = 10_000
    rules = TBox.of(university.axioms(spark, [("equiv_some", "Member", None, "in", "Club"), ("domain", "fee", "Club", None, None)]))
    rows = spark.range(2 * n).select(
        F.col("id").alias("seq"), (F.col("id") >= n).cast("bigint").alias("graph_no"),
        F.when(F.col("id") < n, F.concat(F.lit("m"), "id")).otherwise("hub").alias("s"), F.when(F.col("id") < n, "in").otherwise("fee").alias("p"),
        F.when(F.col("id") < n, "hub").otherwise(F.col("id").cast("string")).alias("o"), F.when(F.col("id") < n, "iri").otherwise("lit").alias("o_kind"),
    )
    answers = rows.filter("p = 'in'").select("s")
    assert counts(graph_usage_of(answers, rows, rules, "Member")) == {(0, n), (1, n * n)}


STAR = [("?x", "a", "?p"), ("?x", "b", "?q"), ("?x", "c", "?r"), ("?x", "rdf:type", "K"), ("?x", "d", "?q")]
CHAIN = [("?v", "a", "?w"), ("?w", "b", "?x"), ("?x", "c", "?y"), ("?y", "d", "?z"), ("?z", "a", "?z")]


@pytest.mark.parametrize("patterns", [STAR, CHAIN, [("?x", "?p", "?x")], [("?x", "a", "?y"), ("n1", "b", "?y"), ("n1", "a", "n1")]])
def test_patterns_of_five_triples(spark, patterns):
    rng = random.Random(7)
    names = [f"n{i}" for i in range(5)]
    triples = sorted({(rng.choice(names), rng.choice("aabcd"), rng.choice(names), "iri") for _ in range(90)} | {(n, "rdf:type", "K", "iri") for n in names[:3]} | {("n1", "a", "n1", "iri")})
    quads = university.quads(spark, triples, n=3)
    variables = list(dict.fromkeys(t for p in patterns for t in p if t.startswith("?")))
    found = [{}]
    for pattern in patterns:
        step = []
        for bound in found:
            for triple in triples:
                new = dict(bound)
                if all((new.setdefault(t, v) == v) if t.startswith("?") else t == v for t, v in zip(pattern, triple)):
                    step.append(new)
        found = step
    want = {tuple(b[v] for v in variables) for b in found}
    got = [tuple(r) for r in bgp(quads, patterns, variables).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def brute_walks(edges, starts):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for start in starts:
        seen, ahead = {start}, [start]
        while ahead:
            for b in after.get(ahead.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    ahead.append(b)
        out |= {(start, n) for n in seen}
    return out


@pytest.mark.parametrize("seed, n, m", [(4, 14, 13), (5, 40, 40)])
def test_walks_equal_brute_force(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] + [("loop", "loop"), ("r1", "r2"), ("r2", "r1"), (None, "n1")]
    starts = [f"n{rng.randrange(n)}" for _ in range(4)] + ["loop", "r1", "nowhere"]
    got = [tuple(r) for r in walks(frame(spark, edges), ends_of(spark, starts)).select("start", "node").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_walks([e for e in edges if None not in e], starts)


def brute_path_leaves(triples, prop, answers, members, back):
    edges = [(o, s) if back else (s, o) for s, p, o, _ in triples if p == prop]
    reach = {a: {n for _, n in brute_walks(edges, [a])} for a in {x for e in edges for x in e}}
    out = set()
    for a in answers:
        for u, v in edges:
            if u in reach.get(a, {a}) and reach[v] & members:
                out.add((a, *((v, prop, u) if back else (u, prop, v))))
        shown = {m for m in members if any(u in reach.get(a, {a}) and m in reach[v] for u, v in edges)}
        out |= {(a, m, "rdf:type", "Country") for m in shown}
    return out


@pytest.mark.parametrize("seed, back", [(1, False), (3, True)])
def test_leaves_of_a_class_over_paths_equal_brute_force(spark, seed, back):
    rng = random.Random(seed)
    inverse = [("inverse", "partOf", "holds", None, None)] if back else []
    rules = TBox.of(university.axioms(spark, [("transitive", "partOf", None, None, None), ("equiv_some", "Local", None, "holds" if back else "partOf", "Country"), *inverse]))
    triples = sorted({(f"n{rng.randrange(16)}", "partOf", f"n{rng.randrange(16)}", "iri") for _ in range(20)})
    members = {rng.choice(triples)[0 if back else 2] for _ in range(2)}
    quads = university.quads(spark, [*triples, *[(m, "rdf:type", "Country", "iri") for m in sorted(members)]])
    answers = instances_of(quads, rules, "Local")
    answers = spark.createDataFrame(answers.collect(), "s string")
    lineage = explain_leaves(answers, quads, rules, "Local").collect()
    got = [(r.s, r.leaf_s, r.leaf_p, r.leaf_o) for r in lineage]
    want = brute_path_leaves(triples, "partOf", {r.s for r in answers.collect()}, members, back)
    assert want and len(got) == len(set(got)) and set(got) == want
    assert counts(graph_usage_of(answers, quads, rules, "Local")) == counts(graph_usage(spark.createDataFrame(lineage)))


def test_leaves_over_a_chain_of_5000_edges_are_made_for_the_answers_asked_for(spark):
    rules = TBox.of(university.axioms(spark, [("transitive", "partOf", None, None, None), ("equiv_some", "Local", None, "partOf", "Country")]))
    triples = [(f"p{i}", "partOf", f"p{i + 1}", "iri") for i in range(5000)] + [("p4500", "rdf:type", "Country", "iri"), ("p10", "partOf", "q", "iri")]
    quads = university.quads(spark, triples)
    got = {(r.s, r.leaf_s) for r in explain_leaves(spark.createDataFrame([("p0",), ("p4000",), ("p4600",)], "s string"), quads, rules, "Local").collect()}
    assert got == {("p0", f"p{i}") for i in range(4501)} | {("p4000", f"p{i}") for i in range(4000, 4501)}


def test_nodes_that_no_edge_leads_to_stay_out_of_the_rounds(spark, monkeypatch):
    from tripletide.operators import paths

    seen, plain = [], paths._jumps
    monkeypatch.setattr(paths, "_jumps", lambda lone, *rest: (seen.append(lone.rows), plain(lone, *rest))[1])
    pairs = [(f"leaf{i}", "hub" if i % 2 else "far") for i in range(200)] + [("hub", "mid"), ("mid", "end"), ("far", "off")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    found = paths.reaching(edges, spark.createDataFrame([("end",)], "node string"))
    assert {r.node for r in found.collect()} == {"hub", "mid", *(f"leaf{i}" for i in range(1, 200, 2))}
    assert seen == [3]
