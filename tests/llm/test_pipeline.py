from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tripletide.llm import mixing, near_dup
from tripletide.llm.tables import saved, table

SF = "/root/testdata/sf0.001"


def test_stages_act_on_what_is_kept(spark):
    docs, before = table(spark, SF, "documents"), None
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, SF), "stage")[0]
        seen[name] = docs
        if name != "token files":
            assert docs.columns == before.columns
    good, unique = seen["quality classifier"], seen["MinHash near-dedup"]
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert {r["doc_id"] for r in unique.collect()} == {d for d, n, _, kept in brute.near_duplicates(rows, corpus_pipeline.NEAR) if kept or not n}
    clean, mix = seen["benchmark decontamination"], seen["mixing sources"]
    items = [" ".join(brute.words(r["text"])) for r in table(spark, SF, "benchmark").collect()]
    held = {r["doc_id"] for r in unique.collect() if any(i in " ".join(brute.words(r["text"])) for i in items)}
    assert held.isdisjoint({r["doc_id"] for r in clean.collect()})
    assert unique.count() - clean.count() >= len(held)
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(clean, (5, 2, 1)).collect() if r["taken"]}
    got = mix.groupBy("doc_id").agg(F.sum(mixing.size_of()).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == want
    final = seen["token files"].collect()
    assert Counter(r["doc_id"] for r in final) == Counter(r["doc_id"] for r in mix.collect())


def test_near_duplicates_from_eighty_hundredths_on_go(spark):
    base = [f"w{i}" for i in range(100)]
    texts = {1: base, 2: base + [f"x{i}" for i in range(20)], 3: base + [f"y{i}" for i in range(30)]}  # 96 of 116 and of 126 shingles
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert kept == {d for d, _, _, k in brute.near_duplicates(rows, percent=80) if k} == {1, 3}


def test_bands_follow_from_the_threshold():
    assert near_dup.bands_for(85) == 26
    for percent in (50, 80, 85, 95):
        assert (1 - (percent / 100) ** near_dup.ROWS) ** near_dup.bands_for(percent) <= near_dup.MISSED
