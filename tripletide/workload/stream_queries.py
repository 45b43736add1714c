"""Streaming queries over the given tables, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripletide.operators.quality import window_quality
from tripletide.plans.spec import WindowSpec
from tripletide.scratch import scratch_path, store
from tripletide.streaming.keyed import keyed_policy_window
from tripletide.streaming.semantic import end_semantic_window, read_steps, start_semantic_window
from tripletide.workload.queries import STREAM, query, table, truth, user_entries
from tripletide.workload.tables import EXPLAIN_CLASS, QUERY_CLASS, clock_entries, event_triples, tbox

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


FILES = 3


def in_order(df, column, name):
    """The rows as a folder of FILES files, each with the next stretch of ``column``, written one after the other."""
    folder = scratch_path(df.sparkSession, name)
    high = df.agg(F.max(column)).first()[0] or 0
    for i in range(FILES):
        part = df.filter(F.expr(f"{column} * {FILES} div {high + 1} = {i}"))
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


@query("semantic_window_stream")
def semantic_window_stream(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    policy, n, size, out, evictions = STREAM
    folder = in_order(events, "event_id", "events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    spec = WindowSpec(size, out, policy, QUERY_CLASS, EXPLAIN_CLASS, n, evictions)
    state = scratch_path(spark, "stream")
    started = start_semantic_window(
        event_triples(stream).withColumnRenamed("pos", "at"), tbox(spark, "events"), spec, state, ["at"],
        entries=clock_entries,
    )
    started.awaitTermination()
    end_semantic_window(spark, tbox(spark, "events"), spec, state, ["at"], entries=clock_entries)
    moves, answers = (read_steps(spark, f"{state}/tables", name) for name in ("moves", "answers"))
    known = store(truth(spark, sf_dir), "truth").df
    return window_quality(answers, known, ["epoch"], windows=moves).join(moves.drop("config_id"), "epoch")


@query("keyed_policy_window")
def keyed_window(spark, sf_dir):
    entries = store(user_entries(spark, sf_dir), "entries")
    path = in_order(entries.df, "graph_no", "user-entries")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        stream = spark.readStream.schema(entries.df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        spec = WindowSpec(6, 3, "LFU", QUERY_CLASS, EXPLAIN_CLASS)
        out = scratch_path(spark, "left")
        keyed_policy_window(stream, "user_id", spec).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", scratch_path(spark, "progress")
        ).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema("user_id bigint, epoch bigint, graph_no bigint, cause string").parquet(out)
