"""Semantic window analytics over RDF-style triples, on Spark DataFrames."""

from tripletide.operators.closure import close_property, closure
from tripletide.operators.entail import (
    instances_of,
    propagate_props,
    propagate_types,
    types_from_domain,
    types_from_range,
    types_from_restrictions,
)
from tripletide.operators.lineage import explain_leaves, graph_usage
from tripletide.operators.match import bgp, count_quads, drop_graphs, match, union_graphs
from tripletide.operators.numbering import assign_graphs, number_rows
from tripletide.operators.ontology import TBox, saturate_tbox
from tripletide.operators.quality import hits, policy_pivot, run_average, window_quality
from tripletide.operators.window import assign_ttl, bump, evict, expire, fill, touch, trace
from tripletide.plans.replay import replay, sweep
from tripletide.plans.spec import WindowSpec
from tripletide.sources.metrics import read_bench, write_metrics
from tripletide.sources.result_files import write_results
from tripletide.sources.ntriples import read_ntriples, rejected_lines
from tripletide.sources.ontology import read_ontology
from tripletide.sources.quads import read_quads, write_quads
from tripletide.sources.truth import read_truth

__all__ = [
    "TBox", "WindowSpec", "assign_graphs", "assign_ttl", "bgp", "bump", "close_property", "closure",
    "count_quads", "drop_graphs", "evict", "expire", "explain_leaves", "fill", "graph_usage", "hits",
    "instances_of", "match", "number_rows", "policy_pivot", "propagate_props", "propagate_types",
    "read_bench", "read_ntriples", "read_ontology", "read_quads", "read_truth", "rejected_lines", "replay", "run_average",
    "saturate_tbox", "sweep", "touch", "trace", "types_from_domain", "types_from_range",
    "types_from_restrictions", "union_graphs", "window_quality", "write_metrics", "write_quads", "write_results",
]
