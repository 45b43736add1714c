"""Queries that go through files: written from the given tables, read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripletide.operators.quality import MEASURES
from tripletide.scratch import scratch_path, store
from tripletide.sources.metrics import read_bench
from tripletide.sources.ntriples import read_ntriples
from tripletide.sources.ontology import read_ontology
from tripletide.sources.quads import read_quads, write_quads
from tripletide.sources.result_files import write_results
from tripletide.sources.truth import read_truth
from tripletide.workload import files
from tripletide.workload.queries import N, SIZE, event_quads, query, table, tumbling_quality


@query("nt_scan")
def nt_scan(spark, sf_dir):
    path = files.write_lines(files.event_lines(table(spark, sf_dir, "events")), "lines")
    return read_ntriples(spark, path).select("seq", "s", "p", "o", "o_kind")


@query("nt_scan_compat")
def nt_scan_compat(spark, sf_dir):
    path = files.write_lines(files.event_lines(table(spark, sf_dir, "events")), "lines")
    return read_ntriples(spark, path, mode="compat")


@query("ontology_axioms")
def ontology_axioms(spark, sf_dir):
    path = files.write_lines(files.documents(files.part_classes(table(spark, sf_dir, "part"))), "classes")
    return read_ontology(spark, path, base="http://example.org/parts")


@query("ground_truth_scan")
def ground_truth_scan(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    lines = events.select(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("value"))
    return read_truth(spark, files.write_lines(lines, "truth"))


@query("metrics_sink")
def metrics_sink(spark, sf_dir):
    """Window rows and averages as result files of exact names, read back by the scan of published files."""
    settings = {"policy": F.lit("FEFO"), "n_triples": F.lit(N), "size": F.lit(SIZE), "evict": F.lit(SIZE)}
    metrics = store(tumbling_quality(spark, sf_dir, N, SIZE).withColumns(settings), "metrics").df
    parts = []
    for kind in ("window", "average"):
        path = scratch_path(spark, f"results-{kind}")
        write_results(metrics, path, averaged=kind == "average")
        parts.append(read_bench(spark, path).withColumn("kind", F.lit(kind)))
    columns = ["kind", "store", "policy", "storage", "n_triples", "size", "evict", "explain"]
    return parts[0].unionByName(parts[1]).select(*columns, *[F.round(c, 9).alias(c) for c in MEASURES])


# Policy and length of graphs in the name of each event type's file.
BENCH_KINDS = {"click": ("FEFO", 10), "purchase": ("LRU", 10), "view": ("LFU", 10), "error": ("FEFO", 100), "signup": ("LRU", 100)}


@query("bench_results_scan")
def bench_results_scan(spark, sf_dir):
    """A result file per store and event type; the second store's files lack one value, as published ones do."""
    events = table(spark, sf_dir, "events")
    folder = scratch_path(spark, "bench")
    header = "sparql, precision, recall, fmeasure, explain, evict, memory"
    n, low, high = F.count(F.lit(1)), F.min("event_id"), F.max("event_id")
    counts = store(events.groupBy("event_type").agg(n.alias("n"), low.alias("low"), high.alias("high")), "counts").df
    paths = []
    for kind, (policy, length) in BENCH_KINDS.items():
        for name, explain in (("one", "7, "), ("two", "")):
            row = F.array(F.lit(header), F.concat("n", F.lit(", 1.0, 0.5, 0.25, " + explain), "low", F.lit(", "), "high"))
            lines = counts.filter(F.col("event_type") == kind).select(F.explode(row).alias("value"))
            paths.append(files.named_file(lines, folder, f"{name}{policy}mem_bench_{length}_100_25.csv"))
    return read_bench(spark, paths)


@query("quad_store_scan")
def quad_store_scan(spark, sf_dir):
    """Quads written by predicate and read back for one pattern: only one folder is scanned."""
    path = scratch_path(spark, "quads")
    write_quads(event_quads(spark, sf_dir).select("graph_no", "s", "p", "o", "o_kind"), path)
    return read_quads(spark, path).filter("p = 'p:purchased'").select("graph_no", "s", "o")
