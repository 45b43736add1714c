"""A semantic window over arriving triples.

Every micro-batch is numbered, cut into graphs and reduced to the facts the query
and the explanation need; then all windows step on as far as their arrived graphs reach,
many steps in one job. What lies between batches is a set of Parquet tables under
``state_dir/<batch_id>``: windows, waiting triples, entries and facts. A batch reads
the tables of those before and overwrites its own, so a repeated batch has the
same outcome.

Facts are written once, by the batch they arrive in. Every COMPACT batches the facts that a
window still needs are gathered into one table, and the older ones go once that batch is done.
``finish`` ends the stream: the short last graph counts, and windows take their last steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tripletide.operators.entail import Facts, facts_of
from tripletide.operators.joins import skew_join
from tripletide.operators.numbering import number_rows
from tripletide.operators.ontology import Goal, TBox, goal_for
from tripletide.operators.window import assign_ttl
from tripletide.plans.ahead import advance_all
from tripletide.plans.epoch import Reasoning, Windows, open_windows
from tripletide.plans.spec import WindowSpec
from tripletide.scratch import store

TERMS = ("s", "p", "o", "o_kind")

# Batches between gatherings of the facts still needed.
COMPACT = 16


class SemanticWindow:
    """The per-batch work: ``stream.writeStream.foreachBatch(window.step)``.

    ``order`` is a total order inside a batch (batches follow each other). ``key``
    keeps one window per value of a column. ``entries`` turns finished quads into window
    entries; by default a graph arrives at its last ``ts`` and lives ``ttl`` seconds.
    """

    def __init__(
        self,
        spark: SparkSession,
        axioms: DataFrame | TBox,
        spec: WindowSpec,
        state_dir: str,
        order: Sequence[str],
        key: str | None = None,
        ttl: Column | None = None,
        entries: Callable[[DataFrame], DataFrame] | None = None,
    ) -> None:
        self.spark, self.spec, self.state_dir = spark, spec, state_dir.rstrip("/")
        self.order, self.key, self.ttl = list(order), key, ttl
        self.source = [key] if key else []
        self.by = ["config_id", *self.source]
        self.entries = entries or (lambda quads: assign_ttl(quads, ttl, self.source))
        tbox = TBox.of(axioms, spec.regime)
        self.both = goal_for(spark, tbox, spec.query_class, explained=(spec.explain_class,))
        self.query: Goal = goal_for(spark, tbox, spec.query_class)
        self.explain: Goal = goal_for(spark, tbox, explained=(spec.explain_class,))

    # --- state tables

    def _path(self, batch_id: int, name: str) -> str:
        return f"{self.state_dir}/{batch_id}/{name}"

    def _exists(self, batch_id: int, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._path(batch_id, name)}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _read(self, batch_id: int, name: str) -> DataFrame | None:
        return self.spark.read.parquet(self._path(batch_id, name)) if self._exists(batch_id, name) else None

    def _write(self, df: DataFrame, batch_id: int, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(batch_id, name))
        return self.spark.read.schema(df.schema).parquet(self._path(batch_id, name))

    def _with_before(self, new: DataFrame, batch_id: int, name: str) -> DataFrame:
        before = self._read(batch_id - 1, name)
        return new if before is None else before.unionByName(new)

    # --- one micro-batch

    def step(self, batch: DataFrame, batch_id: int) -> None:
        self._forget(batch_id)
        finished, waiting = self._cut(batch, batch_id)
        self._move(finished, waiting, batch_id, final=False)

    def finish(self) -> None:
        """Ends the stream after its last batch; repeating it has the same outcome."""
        done = [i for i in self._batches() if self._exists(i, "moves") and not self._exists(i, "ended")]
        if not done:
            return
        batch_id = max(done) + 1
        waiting = self._read(batch_id - 1, "waiting")
        finished = waiting.withColumn("graph_no", F.expr(f"pos div {self.spec.n_triples}"))
        self._write(self.spark.range(1), batch_id, "ended")
        self._move(finished, waiting.filter("false"), batch_id, final=True)

    def _move(self, finished: DataFrame, waiting: DataFrame, batch_id: int, final: bool) -> None:
        new = facts_of(finished, self.both, [*self.source, "graph_no"])
        parts = {"evidence": new.evidence, "links": new.links, "edges": new.edges}
        gathers = batch_id % COMPACT == 0
        facts = {}
        for name, df in parts.items():
            if df is not None:
                fresh = self._write(df, batch_id, f"new-{name}" if gathers else name)
                facts[name] = self._since_gathered(fresh, batch_id, name)
        entries = store(self._with_before(self.entries(finished), batch_id, "entries"), "entries", sort_by=["graph_no"]).df
        reasoning = Reasoning(
            Facts(facts["evidence"], facts.get("links"), facts.get("edges")),
            self.query, self.spec.query_class, self.explain, self.spec.explain_class,
        )
        rows, answers, moves = self._advance_ready(self._windows(entries, batch_id), entries, reasoning, final)
        rows = self._write(rows, batch_id, "windows")
        self._write(waiting, batch_id, "waiting")
        # Graphs that no window holds any more and every window has passed are not carried on.
        live = rows.filter("graph_no is not null").select(*self.source, "graph_no")
        passed = rows.filter("graph_no is null").select(*self.source, "cursor")

        def needed(df: DataFrame) -> DataFrame:
            keys = [*self.source, "graph_no"]
            inside = df.join(live, keys, "left_semi")
            if self.key:
                ahead = skew_join(df, passed, self.source).filter("graph_no >= cursor").drop("cursor")
            else:
                ahead = df.filter(F.col("graph_no") >= passed.select("cursor").scalar())
            return inside.unionByName(ahead)

        self._write(needed(entries), batch_id, "entries")
        if gathers:
            for name, df in facts.items():
                self._write(needed(df), batch_id, name)
        self._write(answers, batch_id, "answers")
        self._write(moves, batch_id, "moves")

    def _since_gathered(self, fresh: DataFrame, batch_id: int, name: str) -> DataFrame:
        """All facts that windows may need: those of the last gathering, of the batches since, and the new ones."""
        start = (batch_id - 1) // COMPACT * COMPACT
        for i in range(max(0, start), batch_id):
            before = self._read(i, name)
            fresh = fresh if before is None else fresh.unionByName(before.select(fresh.columns))
        return fresh

    def _batches(self) -> list[int]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.state_dir)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.listStatus(root) if fs.exists(root) else []
        return sorted(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())

    def _forget(self, batch_id: int) -> None:
        """Deletes state that no batch from ``batch_id`` on reads; the batches before it are done."""
        start = max(0, (batch_id - 1) // COMPACT * COMPACT)
        for i in self._batches():
            old = ["evidence", "links", "edges", "new-evidence", "new-links", "new-edges"] if i < start else []
            old += ["entries", "windows", "waiting", "next"] if i < batch_id - 1 else []
            for name in old:
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(i, name))
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _cut(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """(quads of finished graphs, numbered triples of the unfinished one), numbering on from before."""
        numbered = number_rows(batch, self.order, self.key)
        start = self._read(batch_id - 1, "next")
        if start is None:
            placed = numbered.withColumn("_next", F.lit(0).cast("bigint"))
        elif self.key:
            placed = skew_join(numbered, start, self.source, "left")
        else:
            placed = numbered.withColumn("_next", start.select("_next").scalar())
        placed = placed.withColumn("pos", F.col("pos") + F.coalesce("_next", F.lit(0))).drop("_next")
        before = self._read(batch_id - 1, "waiting")
        if before is not None:
            placed = placed.unionByName(before)
        placed = store(placed, "placed").df
        ends = placed.groupBy(*self.source).agg((F.max("pos") + 1).alias("_next"))
        if start is not None:
            ends = ends.unionByName(start).groupBy(*self.source).agg(F.max("_next").alias("_next"))
        ends = self._write(ends, batch_id, "next")
        cut = placed.withColumn("graph_no", F.expr(f"pos div {self.spec.n_triples}"))
        full = F.expr(f"_next div {self.spec.n_triples}")
        if self.key:
            cut = skew_join(cut, ends.select(*self.source, full.alias("_full")), self.source)
        else:
            cut = cut.withColumn("_full", ends.select(full).scalar())
        done = F.col("graph_no") < F.col("_full")
        return cut.filter(done).drop("_full"), cut.filter(~done).drop("graph_no", "_full")

    def _windows(self, entries: DataFrame, batch_id: int) -> DataFrame:
        """Window rows as left by the last batch, with the graphs now available."""
        settings = entries.select(*self.source).distinct() if self.key else self.spark.range(1).select()
        settings = settings.select(
            *self.source, F.lit("stream").alias("config_id"), F.lit(self.spec.policy).alias("policy"),
            F.lit(self.spec.size).alias("size"), F.lit(self.spec.evict).alias("evict"),
            F.lit(self.spec.evictions).cast("int").alias("evictions"),
        )
        fresh = open_windows(settings, entries, self._naming(0))
        before = self._read(batch_id - 1, "windows")
        if before is None:
            return fresh
        ends = entries.groupBy(*self.source).agg((F.max("graph_no") + 1).alias("_now"))
        if self.key:
            known = before.join(ends, self.source, "left")
            fresh = fresh.join(before, self.by, "left_anti")
        else:
            known, fresh = before.withColumn("_now", ends.scalar()), None
        known = known.withColumn("n_graphs", F.greatest("n_graphs", F.coalesce("_now", F.lit(0)))).drop("_now")
        return known if fresh is None else known.unionByName(fresh)

    def _naming(self, slots: int) -> Windows:
        return Windows(tuple(self.by), tuple(self.source), slots)

    def _advance_ready(
        self, rows: DataFrame, entries: DataFrame, reasoning: Reasoning, final: bool
    ) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Steps every window for which all the graphs a step may read have arrived.

        At the end of the stream, ``final``, nothing more arrives: a full window takes what is there, one that never
        stepped does with fewer graphs, and a window that cannot be filled again is through.
        """
        tracked = self.spec.policy != "FEFO" and self.spec.evict != self.spec.size
        return advance_all(rows, entries, reasoning, self._naming(0), tracked, final)


def read_steps(spark: SparkSession, state_dir: str, name: str) -> DataFrame:
    """``answers`` or ``moves`` of all batches so far."""
    return spark.read.parquet(f"{state_dir.rstrip('/')}/*/{name}")


def start_semantic_window(
    stream: DataFrame, axioms: DataFrame | TBox, spec: WindowSpec, state_dir: str, order: Sequence[str], **options
) -> StreamingQuery:
    """Starts the window on a stream of triples; ``options`` as for SemanticWindow, and ``trigger``.

    When a stream has come to its end for good, ``end_semantic_window`` takes the last steps.
    """
    trigger = options.pop("trigger", {"availableNow": True})
    window = SemanticWindow(stream.sparkSession, axioms, spec, f"{state_dir}/tables", order, **options)
    return (
        stream.writeStream.foreachBatch(window.step)
        .option("checkpointLocation", f"{state_dir}/progress")
        .trigger(**trigger)
        .start()
    )


def end_semantic_window(
    spark: SparkSession, axioms: DataFrame | TBox, spec: WindowSpec, state_dir: str, order: Sequence[str], **options
) -> None:
    """The last steps of a terminated stream started with the same settings; then ``read_steps`` has all of them."""
    options.pop("trigger", None)
    SemanticWindow(spark, axioms, spec, f"{state_dir}/tables", order, **options).finish()
