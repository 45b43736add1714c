import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tripletide.llm import mixing

WEIGHTS = (5, 2, 1)
DOC = "doc_id long, text string, source string"


def _corpus(spark):
    r = random.Random(11)
    rows = [(i, " ".join(["w"] * r.randint(1, 400)), "big") for i in range(300)]
    for size in (1, 2, 5, 10, 20, 40, 63, 64, 65, 100, 130, 200):
        at = 0
        while at < size:
            n = min(size - at, r.randint(1, 50))
            rows.append((len(rows), " ".join(["w"] * n), f"s{size:03}"))
            at += n
    rows += [(len(rows) + i, t, s) for i, (t, s) in enumerate([(None, "empty"), ("", "empty"), (" \n", "s001"), ("a b c", None), (None, None)])]
    rows += [(None, "x y", "s200"), (7, "q " * 9, "s100"), (7, "q " * 9, "s100")]
    return spark.createDataFrame(rows, DOC), rows


def test_small_sources_meet_their_targets(spark):
    docs, rows = _corpus(spark)
    got = mixing.mix(docs, WEIGHTS).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    assert sum(t > 0 for t in target.values()) == 14 and target["empty"] == 0
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(5), WEIGHTS).collect()))


def test_the_mix_holds_the_words_taken_and_passes_other_columns_on(spark):
    docs, _ = _corpus(spark)
    docs = docs.withColumns({"size": F.lit("a"), "pass": F.col("doc_id"), "tie__": F.lit(1), "first": F.lit(None).cast("int"), "n_chars": F.length("text")})
    out = mixing.mixed(docs, WEIGHTS)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs, WEIGHTS).collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    have = Counter()
    for r in out.withColumn("words", mixing.size_of()).collect():
        assert r["n_chars"] == len(r["text"]) and r["pass"] == r["doc_id"]
        have[r["doc_id"], r["source"]] += r["words"]
    assert have == +want


def test_schedule_gives_every_block_one_slot_and_spreads_sources(spark):
    sizes = [60_000, 9, 30_000, 0]
    plan = mixing.Plan(list("abc") + [None], sizes, mixing.targets(sizes, [5, 2, 1, 5]))
    rows = mixing.schedule(plan, spark, block=2).collect()
    assert Counter((r["source_no"], r["block"]) for r in rows) == Counter((k, b) for k, n in enumerate(plan.blocks(2)) for b in range(n))
    assert len({r["slot"] for r in rows}) == len(rows)
    by_slot = np.array([r["source_no"] for r in sorted(rows, key=lambda r: r["slot"])])
    share = (by_slot == 2).mean()
    for i in range(0, len(by_slot) - 1000, 1000):
        assert abs((by_slot[i : i + 1000] == 2).mean() - share) < 0.02


def test_points_below_equals_a_count():
    bounds = np.array([0, 100, 5_000_000, 900_000_000, mixing.POINTS], np.int64)
    for slots in (0, 1, 7, 1000, 65_537):
        points = mixing.point_of(np.arange(slots, dtype=np.int64))
        assert mixing.points_below(slots, bounds).tolist() == [int((points < b).sum()) for b in bounds]
    assert mixing.points_below(3 * mixing.POINTS, bounds).tolist() == (3 * bounds).tolist()


def test_long_text_and_tables_without_words(spark):
    long = spark.createDataFrame([(1, "w " * 1_000_000, "a"), (2, "v", "b")], DOC)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(long, WEIGHTS).collect()} == {1: 999_998, 2: 3}
    empty = spark.createDataFrame([(1, None, "a"), (2, " ", None)], DOC)
    assert {(r["target"], r["taken"]) for r in mixing.mix(empty, WEIGHTS).collect()} == {(0.0, 0)}
    assert mixing.mixed(empty, WEIGHTS).collect() == []
