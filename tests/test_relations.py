"""Patterns, numbering, closure and joins."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests import university
from tests.university import names
from tripletide import assign_graphs, bgp, closure, count_quads, match, number_rows, union_graphs
from tripletide.operators.joins import hot_keys, marked_small, skew_join
from tripletide.scratch import literal_rows

PAIRS = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())])


def test_pattern_over_all_graphs_counts_a_triple_once(spark):
    quads = university.quads(spark)
    twice = quads.unionByName(quads.withColumn("graph_no", F.col("graph_no") + 10))
    assert match(twice, p="headOf").count() == 1
    assert match(twice, p="headOf", graph=True).count() == 2
    assert match(twice, s="c", distinct=False).count() == 4
    assert count_quads(twice.unionByName(twice)).first().n_quads == 24


def test_background_belongs_to_the_union_but_to_no_graph(spark):
    quads = university.quads(spark)
    background = quads.filter("graph_no = 0").withColumn("graph_no", F.lit(None).cast("bigint"))
    both = quads.filter("graph_no > 0").unionByName(background)
    assert match(both).count() == 12
    assert match(both, graph=True).count() == 10
    assert union_graphs(quads, background).count() == 12


def test_joined_patterns(spark):
    quads = university.quads(spark)
    found = bgp(quads, [("?x", "takesCourse", "?k"), ("?t", "teacherOf", "?k"), ("k1", "rdf:type", "GraduateCourse")], ["?x", "?t"])
    assert [tuple(r) for r in found.collect()] == [("c", "h")]
    assert bgp(quads, [("?x", "takesCourse", "?k"), ("k1", "rdf:type", "Nothing")], ["?x"]).count() == 0
    with pytest.raises(ValueError):
        bgp(quads, [("?x", "takesCourse", "?k"), ("?a", "teacherOf", "?b")], ["?x"])


def test_closure_of_a_random_graph_with_cycles(spark):
    rnd = random.Random(5)
    edges = {(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(45)}
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            break
        reach |= more
    got = closure(literal_rows(spark, sorted(edges), PAIRS))
    assert {tuple(r) for r in got.collect()} == reach


def test_numbers_run_on_across_partitions(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("t"), (F.col("id") % 3).alias("k"))
    numbered = number_rows(rows.repartition(5), ["t"])
    assert all(r.pos == r.t for r in numbered.collect())
    # One key holds most rows; its numbering still runs through.
    skewed = rows.withColumn("k", F.when(F.col("t") % 10 < 8, 0).otherwise(F.col("k")))
    per_key = number_rows(skewed, ["t"], key="k").collect()
    for k in {r.k for r in per_key}:
        mine = sorted((r.t, r.pos) for r in per_key if r.k == k)
        assert [p for _, p in mine] == list(range(len(mine)))


@pytest.mark.parametrize("trailing, n_graphs", [("keep", 4), ("drop", 3)])
def test_last_short_graph(spark, trailing, n_graphs):
    rows = spark.range(10).withColumnRenamed("id", "t")
    assert assign_graphs(rows, 3, ["t"], trailing=trailing).select("graph_no").distinct().count() == n_graphs
    assert assign_graphs(rows, 3, [], position="t", trailing=trailing).select("graph_no").distinct().count() == n_graphs


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_hot_keys_are_dealt_without_changing_the_join(spark, how):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k")).unionByName(spark.range(1).select(F.col("id").alias("k")))
    assert len(hot_keys(left, ["k"])) == 1
    want = sorted(map(tuple, left.join(right, ["k"], how).collect()))
    assert sorted(map(tuple, skew_join(left, right, ["k"], how, check_bytes=0).collect())) == want
    assert names(left.limit(1), "k") == {0}


def test_broadcast_sides_need_no_sketch(spark):
    small = spark.range(3).withColumnRenamed("id", "k")
    assert marked_small(F.broadcast(small).filter("k > 0").withColumnRenamed("k", "j"))
    assert not marked_small(small)
