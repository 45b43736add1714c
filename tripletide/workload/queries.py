"""One query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletide.operators.closure import close_property, closure
from tripletide.operators.entail import (
    instances_of,
    propagate_props,
    propagate_types,
    types_from_domain,
    types_from_range,
    types_from_restrictions,
)
from tripletide.operators.lineage import explain_leaves, graph_usage_of
from tripletide.operators.match import bgp, count_quads, drop_graphs, match, union_graphs
from tripletide.operators.numbering import assign_graphs
from tripletide.operators.ontology import is_typing
from tripletide.operators.quality import MEASURES, hits, policy_pivot, run_average, window_quality
from tripletide.operators.window import POLICIES, assign_ttl, bump, evict, expire, fill, seconds, touch, trace
from tripletide.plans.replay import replay, sweep
from tripletide.plans.spec import WindowSpec
from tripletide.schema import AXIOMS
from tripletide.scratch import literal_rows, store
from tripletide.workload import files
from tripletide.workload.tables import (
    EXPLAIN_CLASS,
    QUERY_CLASS,
    axioms,
    clock_arrival,
    clock_entries,
    clock_ttl,
    event_quads,
    event_triples,
    table,
    tbox,
    trade_triples,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

N = 100  # triples per graph, where a query does not say otherwise
SIZE = 10  # graphs per window


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


# --- patterns -------------------------------------------------------------------


@query("match_distinct")
def match_distinct(spark, sf_dir):
    return match(event_quads(spark, sf_dir), p="rdf:type", o="c:Purchase").select("s").distinct()


def kind_quads(spark, sf_dir):
    """(user, did, class of event): many graphs repeat the same triple."""
    quads = event_triples(table(spark, sf_dir, "events")).filter(is_typing())
    kinds = quads.select(
        F.expr(f"pos div {N}").alias("graph_no"),
        F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("s"),
        F.lit("p:did").alias("p"), "o", "o_kind",
    )
    return kinds


def kind_quads_on_background(spark, sf_dir):
    return kind_quads(spark, sf_dir).unionByName(background(spark), allowMissingColumns=True)


def background(spark):
    """The ontology's sub-class axioms as triples of the default graph."""
    return axioms(spark, "events").filter("kind = 'subclass'").select(
        F.col("a").alias("s"), F.lit("rdfs:subClassOf").alias("p"), F.col("b").alias("o"), F.lit("iri").alias("o_kind")
    )


@query("match_all_graphs")
def match_all_graphs(spark, sf_dir):
    return match(kind_quads_on_background(spark, sf_dir))


@query("match_graph_var")
def match_graph_var(spark, sf_dir):
    return match(kind_quads_on_background(spark, sf_dir), graph=True)


@query("bgp_join")
def bgp_join(spark, sf_dir):
    patterns = [("?u", "p:purchased", "?e"), ("?e", "p:cents", "?cents"), ("?e", "rdf:type", "c:Purchase")]
    return bgp(event_quads(spark, sf_dir), patterns, ["?u", "?e", "?cents"])


@query("count_quads")
def count_quads_query(spark, sf_dir):
    quads = event_quads(spark, sf_dir)
    return count_quads(quads.unionByName(quads).unionByName(background(spark), allowMissingColumns=True))


@query("graph_union")
def graph_union(spark, sf_dir):
    return union_graphs(kind_quads(spark, sf_dir), background(spark))


# --- entailment -----------------------------------------------------------------


def _count(df: DataFrame, **labels: str) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return n.select(*[F.lit(v).alias(k) for k, v in labels.items()], "n")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("entailment_regime")
def entailment_regime(spark, sf_dir):
    quads = event_quads(spark, sf_dir)
    return _union(
        [
            _count(instances_of(quads, tbox(spark, "events", regime), cls), regime=regime, cls=cls)
            for regime in ("none", "rdfs++", "restriction")
            for cls in ("c:Click", "c:Conversion", "c:Buyer")
        ]
    )


@query("instances_of")
def instances_of_buyers(spark, sf_dir):
    return instances_of(event_quads(spark, sf_dir), tbox(spark, "events"), QUERY_CLASS)


@query("instances_of_trade")
def instances_of_trade(spark, sf_dir):
    triples = trade_triples(spark, sf_dir)
    return _union(
        [
            instances_of(triples, tbox(spark, "trade"), cls).select(F.lit(cls).alias("cls"), "s")
            for cls in ("Employee", "Customer", "Organization")
        ]
    )


@query("subclass_closure")
def subclass_closure(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    item = F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
    edges = _union(
        [
            part.select(item.alias("src"), F.col("p_brand").alias("dst")),
            part.select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")),
            part.select(F.col("p_type").alias("src"), F.lit("Product").alias("dst")),
        ]
    )
    return closure(edges)


def within_triples(spark, sf_dir):
    """Order within customer within nation within region within World."""
    def edge(name, a, key, b, parent):
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(a), F.col(key).cast("string")).alias("s"), F.lit("within").alias("p"),
            F.concat(F.lit(b), F.col(parent).cast("string")).alias("o"), F.lit("iri").alias("o_kind"),
        )

    return _union(
        [
            edge("orders", "or:", "o_orderkey", "cu:", "o_custkey"),
            edge("customer", "cu:", "c_custkey", "n:", "c_nationkey"),
            edge("nation", "n:", "n_nationkey", "r:", "n_regionkey"),
            edge("region", "r:", "r_regionkey", "r:", "r_regionkey").withColumn("o", F.lit("o:World")),
        ]
    )


@query("transitive_closure_prop")
def transitive_closure_prop(spark, sf_dir):
    return close_property(within_triples(spark, sf_dir), "within")


def asserted_types(triples: DataFrame) -> DataFrame:
    return triples.filter(is_typing()).select(F.col("s").alias("node"), F.col("o").alias("cls"))


def within_asia(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The triples of places, a graph per kind of place, with the region Asia typed, and the rules of the class over their paths."""
    region = table(spark, sf_dir, "region").filter("r_name = 'ASIA'")
    typed = region.select(
        F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("s"), F.lit("rdf:type").alias("p"),
        F.lit("AsianRegion").alias("o"), F.lit("iri").alias("o_kind"),
    )
    rules = literal_rows(
        spark, [("transitive", "within", None, None, None), ("equiv_some", "Asian", None, "within", "AsianRegion")], AXIOMS
    )
    kind = F.expr("CASE split_part(s, ':', 1) WHEN 'or' THEN 0L WHEN 'cu' THEN 1L WHEN 'n' THEN 2L ELSE 3L END")
    return within_triples(spark, sf_dir).unionByName(typed).withColumn("graph_no", kind), rules


@query("path_class")
def path_class(spark, sf_dir):
    """Whatever lies within Asia, at any distance: a class defined over a transitive property."""
    return instances_of(*within_asia(spark, sf_dir), "Asian")


@query("path_leaves")
def path_leaves(spark, sf_dir):
    """The triples on the way from whatever lies within Asia up to Asia."""
    quads, rules = within_asia(spark, sf_dir)
    answers = store(instances_of(quads, rules, "Asian"), "answers").df
    return explain_leaves(answers, quads, rules, "Asian")


@query("type_propagation")
def type_propagation(spark, sf_dir):
    return propagate_types(asserted_types(event_quads(spark, sf_dir)), tbox(spark, "events").order.df)


@query("subproperty_propagation")
def subproperty_propagation(spark, sf_dir):
    only = axioms(spark, "events").filter("kind = 'subprop'")
    return propagate_props(event_quads(spark, sf_dir), only)


@query("inverse_props")
def inverse_props(spark, sf_dir):
    only = axioms(spark, "trade").filter("kind = 'inverse'")
    return propagate_props(trade_triples(spark, sf_dir), only)


@query("domain_types")
def domain_types(spark, sf_dir):
    return types_from_domain(event_quads(spark, sf_dir), axioms(spark, "events"))


@query("range_types")
def range_types(spark, sf_dir):
    return types_from_range(event_quads(spark, sf_dir), axioms(spark, "events"))


@query("restriction_types")
def restriction_types(spark, sf_dir):
    trade = axioms(spark, "trade")
    triples = store(propagate_props(trade_triples(spark, sf_dir), trade), "triples").df
    direct = _union([asserted_types(triples), types_from_domain(triples, trade), types_from_range(triples, trade)])
    types = propagate_types(direct, tbox(spark, "trade").order.df)
    return types_from_restrictions(types, triples, trade)


@query("existential_subsumption")
def existential_subsumption(spark, sf_dir):
    """Users with an error event, stated to be subscribers: signers by the ontology alone."""
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'")
    user = F.concat(F.lit("u:"), F.col("user_id").cast("string"))
    stated = errors.select(
        user.alias("s"), F.lit("rdf:type").alias("p"), F.lit("c:Subscriber").alias("o"), F.lit("iri").alias("o_kind")
    )
    return instances_of(stated, tbox(spark, "events"), "c:Signer")


# --- window content -----------------------------------------------------------------


@query("assign_graphs")
def assign_graphs_query(spark, sf_dir):
    triples = event_triples(table(spark, sf_dir, "events")).select("ts", "pos", "s", "p", "o")
    return assign_graphs(triples, N, ["ts", "pos"]).drop("ts")


@query("assign_graphs_keyed")
def assign_graphs_keyed(spark, sf_dir):
    triples = event_triples(table(spark, sf_dir, "events")).select("user_id", "ts", "pos", "s", "p", "o")
    return assign_graphs(triples, 10, ["ts", "pos"], key="user_id", trailing="drop").drop("ts")


@query("assign_ttl")
def assign_ttl_query(spark, sf_dir):
    return assign_ttl(event_quads(spark, sf_dir), clock_ttl())


def user_entries(spark, sf_dir) -> DataFrame:
    """Per user, graphs of ten of their triples; ``use_count`` is the purchases in each."""
    triples = event_triples(table(spark, sf_dir, "events"))
    numbered = assign_graphs(triples.select("user_id", "pos", "p"), 10, ["pos"], key="user_id")
    graphs = numbered.groupBy("user_id", "graph_no").agg(F.count_if(F.col("p") == "p:purchased").alias("use_count"))
    return graphs.select(
        "user_id", "graph_no", "use_count", clock_arrival().alias("arrival_ts"),
        (clock_arrival() + seconds(clock_ttl())).alias("expire_ts"),
    )


@query("window_fill")
def window_fill(spark, sf_dir):
    entries = store(user_entries(spark, sf_dir), "entries").df
    return fill(entries, entries.filter("graph_no < 3 and use_count > 0"), SIZE, 3, by=["user_id"])


def at_last_arrival(entries: DataFrame) -> DataFrame:
    """Every entry with the latest arrival of its user, ``now``."""
    return entries.join(entries.groupBy("user_id").agg(F.max("arrival_ts").alias("now")), "user_id")


@query("expire")
def expire_query(spark, sf_dir):
    entries = at_last_arrival(store(user_entries(spark, sf_dir), "entries").df)
    live, gone = expire(entries, F.col("now"))
    return live.withColumn("state", F.lit("live")).unionByName(gone.withColumn("state", F.lit("expired"))).select(
        "user_id", "graph_no", "state"
    )


@query("window_trace")
def window_trace(spark, sf_dir):
    entries = store(clock_entries(event_quads(spark, sf_dir)), "entries").df
    now = entries.agg(F.max("arrival_ts").alias("now")).scalar()
    return trace(entries, now, "events", 0)


def _evicted(spark, sf_dir, policy: str) -> DataFrame:
    _, out = evict(store(user_entries(spark, sf_dir), "entries").df, policy, 5, key="user_id")
    return out.select("user_id", "graph_no")


@query("evict_fefo")
def evict_fefo(spark, sf_dir):
    return _evicted(spark, sf_dir, "FEFO")


@query("evict_lru")
def evict_lru(spark, sf_dir):
    return _evicted(spark, sf_dir, "LRU")


@query("evict_lfu")
def evict_lfu(spark, sf_dir):
    return _evicted(spark, sf_dir, "LFU")


@query("evict_net_of_expired")
def evict_net_of_expired(spark, sf_dir):
    """A step of every window of SIZE graphs of every user: expire, refill, and evict what is left of five."""
    entries = store(user_entries(spark, sf_dir), "entries").df
    by = ["user_id", "window"]
    windows = entries.withColumn("window", F.expr(f"graph_no div {SIZE}"))
    now = windows.groupBy(*by).agg(F.max("arrival_ts").alias("now"))
    live, gone = expire(windows.join(now, by), F.col("now"))
    n_expired = gone.groupBy(*by).agg(F.count(F.lit(1)).alias("n_expired"))
    # A window refills from the graphs after it.
    after = windows.withColumn("window", F.col("window") - 1).filter("window >= 0")
    filled = fill(after, live.select(windows.columns), SIZE, (F.col("window") + 1) * SIZE, by=by)
    _, out = evict(filled, "FEFO", 5, n_expired, key=by)
    return out.select("user_id", "window", "graph_no")


@query("evict_all")
def evict_all(spark, sf_dir):
    """A window that loses everything each step is a tumbling window: its evicted graphs by step."""
    quads = event_quads(spark, sf_dir)
    entries = store(clock_entries(quads), "entries").df.withColumn("epoch", F.expr(f"graph_no div {SIZE}"))
    _, out = evict(entries, "FEFO", SIZE, size=SIZE, key="epoch")
    return quads.join(out.select("epoch", "graph_no"), "graph_no").groupBy("epoch").agg(
        F.countDistinct("graph_no").alias("n_graphs"), F.count(F.lit(1)).alias("n_triples")
    )


@query("drop_graphs")
def drop_graphs_query(spark, sf_dir):
    quads = event_quads(spark, sf_dir)
    entries = store(clock_entries(quads), "entries").df
    _, gone = expire(entries, entries.agg(F.max("arrival_ts").alias("now")).scalar())
    return drop_graphs(quads, gone).select("graph_no", "s", "p", "o")


# --- provenance ----------------------------------------------------------------------


@query("explain_leaves")
def explain_leaves_query(spark, sf_dir):
    quads, rules = event_quads(spark, sf_dir), tbox(spark, "events")
    answers = store(instances_of(quads, rules, QUERY_CLASS), "answers").df
    return explain_leaves(answers, quads, rules, QUERY_CLASS)


def usage(spark, sf_dir) -> DataFrame:
    quads, rules = event_quads(spark, sf_dir), tbox(spark, "events")
    answers = store(instances_of(quads, rules, QUERY_CLASS), "answers").df
    return graph_usage_of(answers, quads, rules, EXPLAIN_CLASS)


@query("graph_usage")
def graph_usage_query(spark, sf_dir):
    return usage(spark, sf_dir)


@query("touch_lru")
def touch_lru(spark, sf_dir):
    entries = store(clock_entries(event_quads(spark, sf_dir)), "entries").df
    used = usage(spark, sf_dir).filter(f"usage >= {N // 3}")
    return touch(entries, used, entries.agg(F.max("arrival_ts").alias("now")).scalar())


@query("bump_lfu")
def bump_lfu(spark, sf_dir):
    return bump(clock_entries(event_quads(spark, sf_dir)), usage(spark, sf_dir))


# --- quality --------------------------------------------------------------------------


def truth(spark, sf_dir) -> DataFrame:
    return instances_of(event_quads(spark, sf_dir), tbox(spark, "events"), QUERY_CLASS)


@query("truth_hits")
def truth_hits(spark, sf_dir):
    active = instances_of(event_quads(spark, sf_dir), tbox(spark, "events"), "c:ActiveUser")
    return hits(active, truth(spark, sf_dir))


def tumbling_quality(spark, sf_dir, n: int, size: int) -> DataFrame:
    quads = event_quads(spark, sf_dir, n).withColumn("epoch", F.expr(f"graph_no div {size}"))
    answers = store(instances_of(quads, tbox(spark, "events"), QUERY_CLASS, by=["epoch"]), "answers").df
    return window_quality(answers, truth(spark, sf_dir), ["epoch"], windows=quads.select("epoch").distinct())


@query("window_quality")
def window_quality_query(spark, sf_dir):
    return tumbling_quality(spark, sf_dir, N, SIZE)


# --- replay ---------------------------------------------------------------------------


# Graphs a whole stream is cut into for the replay.
SEGMENTS = 40
# (policy, triples per graph, graphs, evicted graphs, evictions)
STREAM = ("LRU", 1000, 10, 5, None)


@query("window_replay")
def window_replay(spark, sf_dir):
    """A window over the whole stream, however long: it steps until the graphs are used up."""
    n = max(1, -(-table(spark, sf_dir, "events").count() * 3 // SEGMENTS))
    quads = event_quads(spark, sf_dir, n)
    spec = WindowSpec(SIZE, SIZE // 2, "LFU", QUERY_CLASS, EXPLAIN_CLASS, n)
    known = store(truth(spark, sf_dir), "truth").df
    return replay(quads, clock_entries(quads), tbox(spark, "events"), spec, known)


# The settings of the published runs. Evictions per length of a graph; evicted graphs per window size.
LENGTHS = {1: 10, 10: 5, 100: 3}
SIZES = {10: (2, 5, 7, 10), 100: (25, 50, 75, 100), 1000: (250, 500, 750, 1000)}
SHARES = (25, 50, 75, 100)
PUBLISHED = [
    (f"{policy}_{n}_{size}_{out}", policy, n, size, out, evictions, share)
    for policy in POLICIES for n, evictions in LENGTHS.items() for size, outs in SIZES.items() for out, share in zip(outs, SHARES)
]


def published_configs(spark) -> DataFrame:
    return literal_rows(spark, [c[:6] for c in PUBLISHED], files.CONFIGS)


@query("policy_sweep")
def policy_sweep(spark, sf_dir):
    stream = event_triples(table(spark, sf_dir, "events"))
    graphs = stream.select(F.explode(F.array(*[F.lit(n) for n in LENGTHS])).alias("n_triples"), "pos").withColumn(
        "graph_no", F.expr("pos div n_triples")
    )
    known = store(truth(spark, sf_dir), "truth").df
    return sweep(
        stream, tbox(spark, "events"), published_configs(spark), known, QUERY_CLASS, EXPLAIN_CLASS,
        all_entries=clock_entries(graphs, ("n_triples",)),
    )


def averaged_sweep(spark, sf_dir) -> DataFrame:
    """The published table: each run's averages over its T + 1 windows, those of a stream that ended early count 0."""
    settings = F.broadcast(published_configs(spark))  # a literal list
    metrics = policy_sweep(spark, sf_dir).join(settings, "config_id")
    averaged = run_average(metrics, F.col("evictions"), by=["config_id", "policy", "n_triples", "size", "evict"])
    return averaged.withColumns({c: F.round(c, 9) for c in MEASURES})


@query("run_average")
def run_average_query(spark, sf_dir):
    return averaged_sweep(spark, sf_dir)


@query("policy_pivot")
def policy_pivot_query(spark, sf_dir):
    """F1 by window size and evicted share, a column per policy and length of graphs."""
    share = F.create_map(*[F.lit(x) for size, outs in SIZES.items() for out, s in zip(outs, SHARES) for x in (f"{size}/{out}", s)])
    averaged = averaged_sweep(spark, sf_dir).select(
        "size", share[F.concat_ws("/", "size", "evict")].alias("evict_pct"), F.concat_ws("_", "policy", "n_triples").alias("config"), "fmeasure"
    )
    return policy_pivot(averaged, "fmeasure", rows=["size", "evict_pct"], values=[f"{p}_{n}" for p in POLICIES for n in LENGTHS])


def registered() -> dict[str, Query]:
    from tripletide.workload import file_queries, stream_queries  # noqa: F401 - they add to QUERIES

    return dict(QUERIES)
