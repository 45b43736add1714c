"""Window operators against plain-Python models on small inputs."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests import university
from tripletide import WindowSpec, assign_ttl, bump, evict, expire, fill, replay, run_average, touch, trace, window_quality
from tripletide.operators.window import graph_label, random_ttl
from tripletide.scratch import literal_rows
from tripletide.workload.tables import axioms, clock_entries

ENTRIES = T.StructType([T.StructField(c, T.LongType()) for c in ("graph_no", "use_count", "arrival_ts", "expire_ts")])
USAGE = T.StructType([T.StructField(c, T.LongType()) for c in ("graph_no", "usage")])


def entries(spark, arrivals, expiries, counts=None):
    counts = counts or [0] * len(arrivals)
    return literal_rows(spark, [(i, *r) for i, r in enumerate(zip(counts, arrivals, expiries))], ENTRIES)


def graphs(df):
    return sorted(r.graph_no for r in df.collect())


EXPIRY = [50, 10, 30, 20, 60, 40]


def test_first_expire_first_out(spark):
    _, out = evict(entries(spark, range(6), EXPIRY), "FEFO", 2, size=6)
    assert graphs(out) == [1, 3]


@pytest.mark.parametrize("now, expired, net", [(15, [1], [3]), (35, [1, 2, 3], [])])
def test_expired_graphs_pay_for_eviction(spark, now, expired, net):
    live, gone = expire(entries(spark, range(6), EXPIRY), F.lit(now))
    assert graphs(gone) == expired
    kept, out = evict(live, "FEFO", 2, len(expired), size=6)
    assert graphs(out) == net
    assert graphs(kept) == sorted(set(range(6)) - set(expired) - set(net))


def test_use_decides_for_lru_and_lfu(spark):
    start = entries(spark, range(6), [99] * 6)
    usage = literal_rows(spark, [(0, 1), (1, 2)], USAGE)
    assert graphs(evict(bump(start, usage), "LFU", 2, size=6)[1]) == [2, 3]
    assert graphs(evict(touch(start, usage, F.lit(100)), "LRU", 2, size=6)[1]) == [2, 3]
    # Use of a graph the window does not hold changes nothing.
    strange = literal_rows(spark, [(77, 5)], USAGE)
    assert graphs(bump(start, strange)) == [0, 1, 2, 3, 4, 5]


def test_whole_window_goes(spark):
    kept, out = evict(entries(spark, range(6), EXPIRY), "LFU", 6, size=6)
    assert graphs(kept) == [] and graphs(out) == list(range(6))


def test_fill_takes_the_next_graphs(spark):
    everything = entries(spark, range(9), [99] * 9)
    assert graphs(fill(everything, everything.filter("graph_no in (0, 2)"), 5, 3)) == [0, 2, 3, 4, 5]


def test_trace_marks_expired(spark):
    rows = trace(entries(spark, [0, 1], [5, 9]), F.lit(6), "c", 3).collect()
    assert {(r.graph_no, r.epoch, r.expired) for r in rows} == {(0, 3, True), (1, 3, False)}


@pytest.mark.parametrize(
    "answers, truth, expected",
    [
        ("ab", "abz", (2, 2, 1.0, 2 / 3, 0.8)),
        ("a", "z", (1, 0, 0.0, 0.0, 0.0)),
        ("", "z", (0, 0, 0.0, 0.0, 0.0)),
    ],
)
def test_quality_of_one_window(spark, answers, truth, expected):
    row = window_quality(university.subjects(spark, *answers), university.subjects(spark, *truth)).first()
    assert (row.n_results, row.hits) == expected[:2]
    assert [row.precision, row.recall, row.fmeasure] == pytest.approx(expected[2:])


def test_empty_windows_count_in_the_average(spark):
    cols = T.StructType([T.StructField("epoch", T.LongType())])
    windows = literal_rows(spark, [(0,), (1,)], cols)
    answers = university.subjects(spark, "a").withColumn("epoch", F.lit(0).cast("bigint"))
    quality = window_quality(answers, university.subjects(spark, "a"), ["epoch"], windows)
    assert quality.count() == 2
    row = run_average(quality.withColumn("config_id", F.lit("c")), 1).first()
    assert (row.precision, row.recall, row.fmeasure) == (0.5, 0.5, 0.5)


def test_time_to_live_and_labels(spark):
    quads = spark.range(400).select((F.col("id") / 2).cast("bigint").alias("graph_no"), F.lit(0).cast("timestamp").alias("ts"))
    made = assign_ttl(quads, random_ttl(7)).withColumn("ttl", F.unix_micros("expire_ts") / 1e6 - F.unix_micros("arrival_ts") / 1e6)
    ttls = [r.ttl for r in made.collect()]
    assert len(ttls) == 200 and len(set(ttls)) > 150
    assert all(1 <= t <= 25000 and t == int(t) for t in ttls)
    assert made.select(graph_label(F.col("graph_no")).alias("g")).filter("g like '%graphID7'").count() == 1


# --- the whole loop ------------------------------------------------------------

N_GRAPHS, N_USERS = 24, 5


def stream(seed=3):
    """Triples of a few users, three per event, four triples per graph."""
    rnd = random.Random(seed)
    triples = []
    for e in range(N_GRAPHS * 4 // 3):
        kind = rnd.choice(["Purchase", "Click", "Error", "View"])
        done = "p:purchased" if kind == "Purchase" else "p:performed"
        triples += [
            (f"u:{rnd.randrange(N_USERS)}", done, f"e:{e}", "iri"),
            (f"e:{e}", "rdf:type", f"c:{kind}", "iri"),
            (f"e:{e}", "p:cents", str(rnd.randrange(999)), "lit"),
        ]
    return triples


def modelled(triples, spec, per_graph):
    """The loop by hand: what each step answers, drops and evicts."""
    graphs_of = [triples[i : i + per_graph] for i in range(0, len(triples), per_graph)]
    fresh = {g: [0, g * 1000, g * 1000 + 1 + (g * 7919) % 25000] for g in range(len(graphs_of))}
    window, cursor, evict_no, steps = {}, 0, 1, []

    def refill():
        nonlocal cursor
        while len(window) < spec.size and cursor < len(graphs_of):
            window[cursor] = list(fresh[cursor])
            cursor += 1
        return len(window) == spec.size

    refill()
    while True:
        now = max(w[1] for w in window.values())
        gone = [g for g, w in window.items() if w[2] < now]
        for g in gone:
            del window[g]
        refill()
        facts = {t for g in window for t in graphs_of[g]}
        did = {(s, o) for s, p, o, _ in facts if p in ("p:purchased", "p:performed")}
        buyers = {s for s, o in did if (o, "rdf:type", "c:Purchase", "iri") in facts}
        last = spec.evictions is not None and evict_no > spec.evictions
        if spec.policy != "FEFO" and spec.size != spec.evict and not last:
            for g in window:
                used = len({t for t in graphs_of[g] if t[1] in ("p:purchased", "p:performed") and t[0] in buyers})
                if used and spec.policy == "LRU":
                    window[g][1] = now
                elif used:
                    window[g][0] += used
        k = 0 if last else spec.size if spec.evict == spec.size else max(0, spec.evict - len(gone))
        rank = {"FEFO": 2, "LRU": 1, "LFU": 0}[spec.policy]
        out = sorted(window, key=lambda g: (window[g][rank], g))[:k]
        steps.append((len(buyers), len(gone), len(out)))
        if last:
            return steps
        for g in out:
            del window[g]
        evict_no += 1
        if not refill():
            return steps


@pytest.mark.parametrize("policy, size, out, evictions", [("LFU", 6, 3, None), ("LRU", 6, 2, 3), ("FEFO", 6, 6, None), ("FEFO", 6, 2, 4), ("LRU", 6, 6, 2)])
def test_replay_follows_the_model(spark, policy, size, out, evictions):
    triples = stream()
    quads = university.quads(spark, triples, n=4)
    spec = WindowSpec(size, out, policy, "c:Buyer", "c:User", 4, evictions)
    truth = university.subjects(spark, *[f"u:{i}" for i in range(N_USERS)])
    # Folders of two graphs each: a step lists only those its window reaches into.
    got = replay(quads, clock_entries(quads), axioms(spark, "events"), spec, truth, width=8).orderBy("epoch").collect()
    want = modelled(triples, spec, 4)
    assert [(r.n_results, r.n_expired, r.n_evicted) for r in got] == want
    assert all(r.precision in (0.0, 1.0) for r in got)


def keyed_quads(spark, per_key):
    """Graphs of four triples for every key's own stream."""
    parts = [
        university.quads(spark, triples, n=4).withColumn("key", F.lit(k).cast("bigint")) for k, triples in per_key.items()
    ]
    return parts[0].unionByName(parts[1])


def test_keyed_windows_follow_their_own_streams(spark):
    per_key = {1: stream(1), 2: stream(2)[:64]}
    quads = keyed_quads(spark, per_key)
    spec = WindowSpec(6, 3, "LRU", "c:Buyer", "c:User", 4, 1)
    truth = university.subjects(spark, *[f"u:{i}" for i in range(N_USERS)])
    entries = clock_entries(quads, ("key",))
    rows = replay(quads, entries, axioms(spark, "events"), spec, truth, key="key").orderBy("key", "epoch").collect()
    for k, triples in per_key.items():
        got = [(r.n_results, r.n_expired, r.n_evicted) for r in rows if r.key == k]
        assert got == modelled(triples, spec, 4)


def test_the_replay_query_reaches_the_end_of_its_stream(spark, tmp_path):
    # Only the last third of a long stream holds a purchase.
    from tripletide.workload.queries import registered

    events = spark.range(3000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") < 2000, 1).otherwise(2).cast("bigint").alias("user_id"),
        F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") < 2000, "click").otherwise("purchase").alias("event_type"),
        F.lit(1.0).alias("value"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = {r.epoch: r.hits for r in registered()["window_replay"](spark, str(tmp_path)).collect()}
    assert rows[0] == 0 and rows[max(rows)] == 1
