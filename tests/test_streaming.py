"""Streams cut into micro-batches give what the replay of the whole gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests import university
from tests.test_windows import keyed_quads, modelled, stream
from tripletide import WindowSpec
from tripletide.streaming.keyed import keyed_policy_window
from tripletide.streaming import semantic
from tripletide.streaming.semantic import end_semantic_window, read_steps, start_semantic_window
from tripletide.workload.tables import axioms, clock_entries


def files(df, folder, bounds):
    """One Parquet file per range of ``at``, written one after the other."""
    for low, high in zip(bounds, bounds[1:]):
        df.filter(F.col("at").between(low, high - 1)).coalesce(1).write.mode("append").parquet(folder)


def run_in_batches(spark, rows, bounds, spec, folder, **options):
    """Moves and answers per step of a stream in batches and of its end."""
    files(rows, f"{folder}/in", bounds)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    settings = (axioms(spark, "events"), spec, f"{folder}/state", ["at"])
    start_semantic_window(source, *settings, **options).awaitTermination()
    for _ in range(2):  # ending twice is ending once
        end_semantic_window(spark, *settings, **options)
    return (read_steps(spark, f"{folder}/state/tables", name) for name in ("moves", "answers"))


@pytest.mark.parametrize("policy, evictions, gather", [("LFU", None, 16), ("LRU", 2, 2)])
def test_semantic_window_over_micro_batches(spark, tmp_path, monkeypatch, policy, evictions, gather):
    monkeypatch.setattr(semantic, "COMPACT", gather)
    triples = stream()[:94]  # the last graph is short
    spec = WindowSpec(6, 3, policy, "c:Buyer", "c:User", 4, evictions)
    rows = university.quads(spark, triples, n=4).select(F.col("seq").alias("at"), "s", "p", "o", "o_kind")
    moves, answers = run_in_batches(spark, rows, [0, 30, 50, 94], spec, str(tmp_path), entries=clock_entries)
    counts = dict(answers.groupBy("epoch").count().collect())
    got = {r.epoch: (counts.get(r.epoch, 0), r.n_expired, r.n_evicted) for r in moves.collect()}
    assert got == dict(enumerate(modelled(triples, spec, 4)))


def test_a_stream_that_never_fills_its_window_is_asked_once(spark, tmp_path):
    triples = stream()[:18]
    spec = WindowSpec(8, 2, "LRU", "c:Buyer", "c:User", 4)
    rows = university.quads(spark, triples, n=4).select(F.col("seq").alias("at"), "s", "p", "o", "o_kind")
    moves, _ = run_in_batches(spark, rows, [0, 18], spec, str(tmp_path), entries=clock_entries)
    assert [(r.epoch, r.n_expired, r.n_evicted) for r in moves.collect()] == [(0, *modelled(triples, spec, 4)[0][1:])]


def test_keyed_window_keeps_state_between_batches(spark, tmp_path):
    # Two keys with the same eight graphs that never expire; size 3, one evicted per step.
    rows = spark.range(16).select(
        (F.col("id") % 2).alias("key"), (F.col("id") / 2).cast("bigint").alias("graph_no"), F.col("id").alias("at"),
        F.lit(0).cast("bigint").alias("use_count"),
        (F.lit(1700000000) + F.col("id")).cast("timestamp").alias("arrival_ts"),
        (F.lit(1800000000) - F.col("id")).cast("timestamp").alias("expire_ts"),
    )
    files(rows, str(tmp_path / "in"), [0, 5, 16])
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spec = WindowSpec(3, 1, "FEFO", "c:Buyer", "c:User")
    out = str(tmp_path / "out")
    keyed_policy_window(source, "key", spec).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "progress")
    ).trigger(availableNow=True).start().awaitTermination()
    left = {(r.key, r.epoch): (r.graph_no, r.cause) for r in spark.read.parquet(out).collect()}
    # The later a graph comes the sooner it expires: the newest of the three leaves each time.
    assert left == {(k, e): (e + 2, "evicted") for k in (0, 1) for e in range(6)}


def test_event_time_ends_graphs_of_a_quiet_key(spark, tmp_path):
    def graph(key, number, arrival, expiry):
        return (key, number, 0, dt.datetime.fromtimestamp(arrival, dt.UTC), dt.datetime.fromtimestamp(expiry, dt.UTC))

    rows = spark.createDataFrame(
        [graph(1, 0, 1000, 1050), graph(1, 1, 1001, 9000), graph(2, 0, 5000, 9000), graph(2, 1, 5001, 9000),
         graph(1, 2, 6000, 9500), graph(1, 3, 6001, 9400)],
        "key long, graph_no long, use_count long, arrival_ts timestamp, expire_ts timestamp",
    ).withColumn("at", F.monotonically_increasing_id())
    parts = [rows.filter("key = 1 and graph_no < 2"), rows.filter("key = 2"), rows.filter("key = 1 and graph_no >= 2")]
    for part in parts:
        part.drop("at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.drop("at").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    timed = source.withWatermark("arrival_ts", "0 seconds")
    out = str(tmp_path / "out")
    keyed_policy_window(timed, "key", WindowSpec(3, 2, "FEFO", "c:Buyer", "c:User"), timers=True).writeStream.format("parquet").option(
        "path", out
    ).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    left = sorted((r.key, r.epoch, r.graph_no, r.cause) for r in spark.read.parquet(out).collect())
    # Graph 0 ends while its key is quiet, and pays for one of the two graphs the full window gives up.
    assert left == [(1, 0, 0, "expired"), (1, 0, 1, "evicted")]


def test_keyed_semantic_windows(spark, tmp_path):
    per_key = {1: stream(1)[:60], 2: stream(2)[:44]}
    spec = WindowSpec(6, 6, "FEFO", "c:Buyer", "c:User", 4)
    rows = keyed_quads(spark, per_key).select(F.col("seq").alias("at"), "key", "s", "p", "o", "o_kind")
    files(rows, str(tmp_path / "in"), [0, 30, 60])
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = start_semantic_window(
        source, axioms(spark, "events"), spec, str(tmp_path / "state"), ["at"], key="key",
        entries=lambda quads: clock_entries(quads, ("key",)),
    )
    query.awaitTermination()
    tables = str(tmp_path / "state" / "tables")
    moves = {(r.key, r.epoch): (r.n_expired, r.n_evicted) for r in read_steps(spark, tables, "moves").collect()}
    counts = {(r.key, r.epoch): r["count"] for r in read_steps(spark, tables, "answers").groupBy("key", "epoch").count().collect()}
    assert {k for k, _ in moves} == {1, 2}
    for (k, epoch), move in moves.items():
        want = modelled(per_key[k], spec, 4)
        assert (counts.get((k, epoch), 0), *move) == want[epoch]


def test_many_steps_take_few_jobs(spark, tmp_path, monkeypatch):
    # Every graph shows a buyer of its own, so each step answers with its four graphs and the oldest goes.
    from pyspark.sql.readwriter import DataFrameWriter

    triples = [
        t for i in range(40) for t in ((f"u:{i}", "p:purchased", f"e:{i}", "iri"), (f"e:{i}", "rdf:type", "c:Purchase", "iri"))
    ]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(triples)], "at long, s string, p string, o string, o_kind string")
    written, plain = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append(path), plain(self, path, *a, **k))[1])
    spec = WindowSpec(4, 1, "LRU", "c:Buyer", "c:User", 2)

    def entries(quads):
        return quads.groupBy("graph_no").agg(F.lit(0).cast("bigint").alias("use_count")).select(
            "graph_no", "use_count", F.timestamp_seconds(F.col("graph_no") + 1).alias("arrival_ts"),
            F.timestamp_seconds(F.col("graph_no") + 1_000_000).alias("expire_ts"),
        )

    moves, answers = run_in_batches(spark, rows, [0, 80], spec, str(tmp_path), entries=entries)
    assert sorted((r.epoch, r.n_expired, r.n_evicted) for r in moves.collect()) == [(e, 0, 1) for e in range(37)]
    assert {(r.epoch, r.s) for r in answers.collect()} == {(e, f"u:{e + i}") for e in range(37) for i in range(4)}
    assert len(written) < 60  # a few tables a batch, none for each of the 37 steps
