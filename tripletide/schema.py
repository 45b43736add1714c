"""Schemas and fixed names."""

from pyspark.sql import types as T

# The full and the short spelling of the typing predicate.
TYPE_PREDICATES = (
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#type",
    "rdf:type",
)

IRI = "iri"
LITERAL = "lit"

AXIOMS = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "a", "b", "c", "d")])

BENCH_RESULTS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("store", "policy", "storage")]
    + [T.StructField(c, T.IntegerType()) for c in ("n_triples", "size", "evict")]
    + [
        T.StructField(c, T.DoubleType())
        for c in ("sparql", "precision", "recall", "fmeasure", "explain", "evict_ms", "memory")
    ]
)

# Largest time-to-live of a graph, in seconds (fixed value of the benchmark being matched).
MAX_TTL_SECONDS = 25000
