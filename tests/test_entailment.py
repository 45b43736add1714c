import pytest
from pyspark.sql import functions as F

from tests import university
from tests.university import names, subjects
from tripletide.operators.ontology import _listed
from tripletide import (
    TBox,
    close_property,
    drop_graphs,
    explain_leaves,
    graph_usage,
    instances_of,
    propagate_props,
    propagate_types,
    saturate_tbox,
    types_from_domain,
    types_from_range,
    types_from_restrictions,
)
from tripletide.operators.ontology import is_typing
from tripletide.scratch import store


@pytest.fixture(scope="module")
def quads(spark):
    return university.quads(spark)


@pytest.fixture(scope="module")
def tbox(spark):
    return TBox.of(university.axioms(spark))


@pytest.mark.parametrize(
    "cls, regime, expected",
    [
        ("Professor", "none", set()),
        ("FullProfessor", "none", {"b"}),
        ("Professor", "rdfs++", {"b"}),
        ("Student", "rdfs++", set()),
    ],
)
def test_weaker_regimes(spark, quads, cls, regime, expected):
    assert names(instances_of(quads, university.axioms(spark), cls, regime)) == expected


@pytest.mark.parametrize(
    "cls, expected",
    [
        ("Professor", {"a", "b"}),
        ("Student", {"c", "f"}),
        ("Faculty", {"a", "b", "h"}),
        ("Employee", {"a", "b", "e", "h"}),
        ("Person", {"a", "b", "c", "e", "f", "h"}),
        ("Organization", {"d1", "u1", "w"}),
        ("Unheard", set()),
    ],
)
def test_restriction_regime(quads, tbox, cls, expected):
    assert names(instances_of(quads, tbox, cls)) == expected


def test_student_without_existential_subsumption(spark, quads):
    tbox = TBox.of(university.axioms(spark), existential=False)
    assert names(instances_of(quads, tbox, "Student")) == {"c"}


def test_saturated_axioms(spark):
    sub = {(r.a, r.b) for r in saturate_tbox(university.axioms(spark)).filter("kind = 'subclass'").collect()}
    assert {("GraduateStudent", "Student"), ("ResearchAssistant", "Employee"), ("Director", "Employee")} <= sub
    assert ("FullProfessor", "Person") in sub
    assert ("Student", "GraduateStudent") not in sub


def test_transitive_property(quads):
    pairs = {(r.s, r.o) for r in close_property(quads, "subOrganizationOf").collect()}
    assert pairs == {("d1", "u1"), ("u1", "w"), ("d1", "w")}


def test_dropped_graph_takes_its_support_away(spark, quads, tbox):
    gone = quads.filter("graph_no = 0").select("graph_no")
    assert names(instances_of(drop_graphs(quads, gone), tbox, "Professor")) == {"b"}


def test_windows_do_not_support_each_other(quads, tbox):
    # a's headship and d1's type sit in one graph; as windows of one triple they prove nothing.
    apart = quads.withColumn("win", F.col("seq"))
    assert names(instances_of(apart, tbox, "Chair", by=["win"])) == set()
    together = quads.withColumn("win", F.col("graph_no"))
    found = {(r.win, r.s) for r in instances_of(together, tbox, "Chair", by=["win"]).collect()}
    assert found == {(0, "a")}


def test_leaves_of_a_chair(spark, quads, tbox):
    answers = subjects(spark, "a")
    found = {(r.graph_no, r.leaf_s, r.leaf_p, r.leaf_o) for r in explain_leaves(answers, quads, tbox, "Professor").collect()}
    # The conjunct Person of Chair is shown by the headship itself.
    assert found == {(0, "a", "headOf", "d1"), (0, "d1", "rdf:type", "Department")}


def test_usage_for_the_explained_class(quads, tbox):
    answers = instances_of(quads, tbox, "Professor")
    usage = graph_usage(explain_leaves(answers, quads, tbox, "Person"))
    assert {(r.graph_no, r.usage) for r in usage.collect()} == {(0, 1), (1, 2)}


def test_rules_one_by_one_agree_with_the_fused_pass(spark, quads, tbox):
    axioms = saturate_tbox(university.axioms(spark))
    order = axioms.filter("kind = 'subclass'").select(F.col("a").alias("sub"), F.col("b").alias("sup"))
    triples = store(propagate_props(quads, axioms), "triples").df
    closed = close_property(triples, "subOrganizationOf").withColumn("o_kind", F.lit("iri"))
    triples = store(triples.unionByName(closed).distinct(), "triples").df
    asserted = triples.filter(is_typing()).select(F.col("s").alias("node"), F.col("o").alias("cls"))
    types = asserted.unionByName(types_from_domain(triples, axioms)).unionByName(types_from_range(triples, axioms))
    for _ in range(3):
        types = propagate_types(types, order)
        types = types.unionByName(types_from_restrictions(types, triples, axioms)).distinct()
        types = store(types, "types").df
    types = store(propagate_types(types, order), "types").df
    for cls in ("Professor", "Student", "Employee", "Person", "Organization", "Course"):
        assert names(types.filter(F.col("cls") == cls), "node") == names(instances_of(quads, tbox, cls))


def test_restriction_over_a_transitive_property(spark):
    axioms = university.axioms(
        spark,
        [
            ("transitive", "partOf", None, None, None),
            ("subprop", "insideOf", "partOf", None, None),
            ("inverse", "contains", "partOf", None, None),
            ("equiv_some", "Local", None, "partOf", "Country"),
        ],
    )
    quads = university.quads(
        spark,
        [
            ("house", "insideOf", "town", "iri"),
            ("county", "contains", "town", "iri"),
            ("county", "partOf", "land", "iri"),
            ("land", "rdf:type", "Country", "iri"),
            ("land", "partOf", "sea", "iri"),
        ],
        n=1,
    )
    tbox = TBox.of(axioms)
    assert names(instances_of(quads, tbox, "Local")) == {"house", "town", "county"}
    leaves = explain_leaves(subjects(spark, "town"), quads, tbox, "Local")
    assert names(leaves, "graph_no") == {1, 2, 3}


def test_classes_defined_by_each_other(spark):
    # Ancestry written with two classes that rest on each other: needs the looping form.
    axioms = university.axioms(
        spark,
        [
            ("equiv_some", "Even", None, "next", "Odd"),
            ("equiv_some", "Odd", None, "next", "Even"),
        ],
    )
    chain = [(f"n{i}", "next", f"n{i + 1}", "iri") for i in range(6)]
    quads = university.quads(spark, [*chain, ("n6", "rdf:type", "Even", "iri")], n=1)
    tbox = TBox.of(axioms)
    assert names(instances_of(quads, tbox, "Even")) == {"n0", "n2", "n4", "n6"}
    leaves = explain_leaves(subjects(spark, "n4"), quads, tbox, "Even")
    assert names(leaves, "graph_no") == {4, 5, 6}


def test_lists_of_many_repeated_rows_are_whole(spark):
    rows = spark.range(9000).selectExpr("concat('c', id % 1900) AS cls")
    listed, known = _listed(rows, "wanted")
    assert listed.count() == len(known) == 1900
    listed, known = _listed(spark.range(9000).selectExpr("concat('c', id % 2500) AS cls"), "wanted")
    assert listed.count() == 2500 and known is None
