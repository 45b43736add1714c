"""The given tables as triples, and the small ontologies that describe them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletide.operators.ontology import TBox
from tripletide.operators.window import assign_ttl, seconds
from tripletide.schema import AXIOMS
from tripletide.scratch import literal_rows

# The ontology of the event stream.
EVENT_AXIOMS = [
    ("subclass", "c:Purchase", "c:Conversion", None, None),
    ("subclass", "c:Signup", "c:Conversion", None, None),
    ("subclass", "c:Conversion", "c:Engagement", None, None),
    ("subclass", "c:Click", "c:Engagement", None, None),
    ("subclass", "c:View", "c:Engagement", None, None),
    ("subclass", "c:Engagement", "c:Event", None, None),
    ("subclass", "c:Error", "c:Event", None, None),
    ("subclass", "c:Subscriber", "c:User", None, None),
    ("subprop", "p:purchased", "p:performed", None, None),
    ("domain", "p:performed", "c:User", None, None),
    ("range", "p:performed", "c:Event", None, None),
    ("domain", "p:cents", "c:Event", None, None),
    ("inverse", "p:performedBy", "p:performed", None, None),
    ("equiv_some", "c:Buyer", "c:User", "p:performed", "c:Purchase"),
    ("equiv_some", "c:ActiveUser", "c:User", "p:performed", "c:Engagement"),
    ("equiv_some", "c:Signer", "c:User", "p:performed", "c:Signup"),
    ("sub_some", "c:Subscriber", None, "p:performed", "c:Signup"),
]

# The ontology of the trading tables.
TRADE_AXIOMS = [
    ("subclass", "Nation", "Organization", None, None),
    ("subclass", "Region", "Organization", None, None),
    ("transitive", "subOrganizationOf", None, None, None),
    ("domain", "subOrganizationOf", "Organization", None, None),
    ("range", "subOrganizationOf", "Organization", None, None),
    ("subprop", "worksFor", "memberOf", None, None),
    ("inverse", "memberOf", "member", None, None),
    ("domain", "member", "Organization", None, None),
    ("range", "member", "Person", None, None),
    ("equiv_some", "Employee", "Person", "worksFor", "Organization"),
    ("equiv_some", "Customer", "Person", "placed", "Order"),
]

QUERY_CLASS, EXPLAIN_CLASS = "c:Buyer", "c:User"

_tboxes: dict[tuple, TBox] = {}


def axioms(spark: SparkSession, which: str) -> DataFrame:
    return literal_rows(spark, EVENT_AXIOMS if which == "events" else TRADE_AXIOMS, AXIOMS)


def tbox(spark: SparkSession, which: str, regime: str = "restriction") -> TBox:
    """The closed ontology, built once per application."""
    key = (spark.sparkContext.applicationId, which, regime)
    if key not in _tboxes:
        _tboxes[key] = TBox.of(axioms(spark, which), regime)
    return _tboxes[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _triple(s: Column, p: Column | str, o: Column | str, kind: str = "iri") -> list[Column]:
    def lit(x):
        return F.lit(x) if isinstance(x, str) else x

    return [s.alias("s"), lit(p).alias("p"), lit(o).alias("o"), F.lit(kind).alias("o_kind")]


def _name(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def event_triples(events: DataFrame) -> DataFrame:
    """Three triples per event; ``pos`` numbers them without gaps."""
    event, user = _name("e:", "event_id"), _name("u:", "user_id")
    done = F.when(F.col("event_type") == "purchase", "p:purchased").otherwise("p:performed")
    kind = F.concat(F.lit("c:"), F.initcap("event_type"))
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    three = F.array(
        *[
            F.struct(F.lit(i).alias("i"), *_triple(*t))
            for i, t in enumerate(
                [(user, done, event), (event, "rdf:type", kind), (event, "p:cents", cents, "lit")]
            )
        ]
    )
    rows = events.select("event_id", "user_id", "ts", F.inline(three))
    return rows.select(
        (F.col("event_id") * 3 + F.col("i")).alias("pos"), "s", "p", "o", "o_kind", "user_id", "ts"
    )


def event_quads(spark: SparkSession, sf_dir: str, n: int = 100) -> DataFrame:
    triples = event_triples(table(spark, sf_dir, "events"))
    return triples.withColumn("graph_no", F.expr(f"pos div {int(n)}"))


def trade_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer, supplier, orders = (
        table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "orders")
    )
    r, n = _name("r:", "r_regionkey"), _name("n:", "n_nationkey")
    order = _name("or:", "o_orderkey")
    parts = [
        region.select(*_triple(r, "subOrganizationOf", "o:World")),
        region.select(*_triple(r, "rdf:type", "Region")),
        nation.select(*_triple(n, "subOrganizationOf", _name("r:", "n_regionkey"))),
        nation.select(*_triple(n, "rdf:type", "Nation")),
        customer.select(*_triple(_name("cu:", "c_custkey"), "memberOf", _name("n:", "c_nationkey"))),
        supplier.select(*_triple(_name("su:", "s_suppkey"), "worksFor", _name("n:", "s_nationkey"))),
        orders.select(*_triple(_name("cu:", "o_custkey"), "placed", order)),
        orders.select(*_triple(order, "rdf:type", "Order")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


# --- the test clock -----------------------------------------------------------

START = "timestamp_ntz'2024-01-01 00:00:00'"


def clock_arrival() -> Column:
    return F.expr(START) + seconds(F.col("graph_no") * 1000)


def clock_ttl() -> Column:
    return 1 + (F.col("graph_no") * 7919) % 25000


def clock_entries(quads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Window entries whose arrival and expiry follow from the graph number alone."""
    return assign_ttl(quads.withColumn("ts", clock_arrival()), clock_ttl(), by)
