"""The registered queries as SQL over the same tables, written independently of the operators."""

from __future__ import annotations

from tripletide.operators.window import POLICIES
from tripletide.workload.queries import LENGTHS, N, PUBLISHED, SEGMENTS, SIZE, STREAM
from tripletide.workload.tables import EVENT_AXIOMS, TRADE_AXIOMS

EV = """ev AS (
  SELECT event_id * 3 + i AS pos, user_id, ts,
    CASE WHEN i = 0 THEN 'u:' || user_id ELSE 'e:' || event_id END AS s,
    CASE WHEN i = 1 THEN 'rdf:type' WHEN i = 2 THEN 'p:cents'
         WHEN event_type = 'purchase' THEN 'p:purchased' ELSE 'p:performed' END AS p,
    CASE WHEN i = 0 THEN 'e:' || event_id
         WHEN i = 1 THEN 'c:' || upper(event_type[1]) || event_type[2:]
         ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS o,
    CASE WHEN i = 2 THEN 'lit' ELSE 'iri' END AS o_kind
  FROM events, (VALUES (0), (1), (2)) AS three(i))"""

TRADE = """tr AS (
  SELECT 'r:' || r_regionkey AS s, 'subOrganizationOf' AS p, 'o:World' AS o FROM region
  UNION ALL SELECT 'r:' || r_regionkey, 'rdf:type', 'Region' FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'subOrganizationOf', 'r:' || n_regionkey FROM nation
  UNION ALL SELECT 'n:' || n_nationkey, 'rdf:type', 'Nation' FROM nation
  UNION ALL SELECT 'cu:' || c_custkey, 'memberOf', 'n:' || c_nationkey FROM customer
  UNION ALL SELECT 'su:' || s_suppkey, 'worksFor', 'n:' || s_nationkey FROM supplier
  UNION ALL SELECT 'cu:' || o_custkey, 'placed', 'or:' || o_orderkey FROM orders
  UNION ALL SELECT 'or:' || o_orderkey, 'rdf:type', 'Order' FROM orders),
tq AS (SELECT *, 'iri' AS o_kind FROM tr)"""


def quads(n: int | str = N) -> str:
    return f"{EV},\nq AS (SELECT *, pos // {n} AS graph_no FROM ev)"


def values(rows: list[tuple]) -> str:
    def sql(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(sql(v) for v in r) + ")" for r in rows) + ")"


def ontology(rows: list[tuple]) -> str:
    """Closed ontology tables: sub (with itself and existential subsumption) and props."""
    return f"""ax AS (SELECT * FROM {values(rows)} AS t(kind, a, b, c, d)),
names AS (SELECT a AS n FROM ax WHERE kind IN ('subclass', 'equiv_some', 'sub_some') UNION
          SELECT b FROM ax WHERE kind IN ('subclass', 'equiv_some', 'domain', 'range') UNION SELECT d FROM ax),
edge AS (SELECT a AS sub, b AS sup FROM ax WHERE kind IN ('subclass', 'equiv_some') AND b IS NOT NULL),
sub0 AS (SELECT n AS sub, n AS sup FROM names WHERE n IS NOT NULL UNION
         SELECT s.sub, e.sup FROM sub0 s JOIN edge e ON s.sup = e.sub),
step AS (SELECT a AS x, b AS y, false AS f FROM ax WHERE kind = 'subprop' UNION
         SELECT a, b, true FROM ax WHERE kind = 'inverse' UNION SELECT b, a, true FROM ax WHERE kind = 'inverse'),
props AS (SELECT n AS p, n AS q, false AS flip FROM (
            SELECT a AS n FROM ax WHERE kind IN ('subprop', 'inverse', 'domain', 'range', 'transitive') UNION
            SELECT b FROM ax WHERE kind IN ('subprop', 'inverse') UNION
            SELECT c FROM ax WHERE kind IN ('equiv_some', 'sub_some')) WHERE n IS NOT NULL
          UNION SELECT p.p, s.y, p.flip <> s.f FROM props p JOIN step s ON p.q = s.x),
more AS (SELECT DISTINCT sa.sub, e.a AS sup FROM sub0 sa
         JOIN ax h ON h.a = sa.sup AND h.kind IN ('sub_some', 'equiv_some')
         JOIN props pp ON pp.p = h.c AND NOT pp.flip
         JOIN ax e ON e.kind = 'equiv_some' AND e.c = pp.q
         JOIN sub0 sd ON sd.sub = h.d AND sd.sup = e.d
         WHERE e.b IS NULL OR EXISTS (SELECT 1 FROM sub0 sc WHERE sc.sub = sa.sub AND sc.sup = e.b)),
sub AS (SELECT sub, sup FROM sub0 UNION
        SELECT s.sub, e.sup FROM sub s JOIN (SELECT * FROM edge UNION SELECT * FROM more) e ON s.sup = e.sub)"""


def types(source: str, by: str = "", name: str = "types") -> str:
    """(by, node, cls) of ``source`` under all rules; one round of defined classes is enough here."""
    k, g, b, l = (f"{by}, ", f"i.{by}, ", f"b.{by} = l.{by} AND ", f"l.{by}, ") if by else ("", "", "", "")
    t = f"t.{by}, " if by else ""
    return f"""{name}_i AS (
  SELECT DISTINCT {g}CASE WHEN flip THEN i.o ELSE i.s END AS s, q AS p,
         CASE WHEN flip THEN i.s ELSE i.o END AS o, i.o_kind
  FROM {source} i JOIN props USING (p) WHERE NOT flip OR i.o_kind = 'iri'),
{name}_d AS (
  SELECT {k}s AS node, o AS cls FROM {source} WHERE p = 'rdf:type'
  UNION SELECT {g}i.s, ax.b FROM {name}_i i JOIN ax ON ax.kind = 'domain' AND ax.a = i.p
  UNION SELECT {g}i.o, ax.b FROM {name}_i i JOIN ax ON ax.kind = 'range' AND ax.a = i.p WHERE i.o_kind = 'iri'),
{name}_1 AS (SELECT {k}node, cls FROM {name}_d UNION SELECT {t}t.node, s.sup FROM {name}_d t JOIN sub s ON s.sub = t.cls),
{name}_r AS (
  SELECT DISTINCT {l}l.s AS node, ax.a AS cls FROM {name}_i l
  JOIN ax ON ax.kind = 'equiv_some' AND ax.c = l.p AND l.o_kind = 'iri'
  JOIN {name}_1 b ON {b}b.node = l.o AND b.cls = ax.d
  WHERE ax.b IS NULL OR EXISTS (SELECT 1 FROM {name}_1 b WHERE {b}b.node = l.s AND b.cls = ax.b)),
{name} AS (SELECT * FROM {name}_1 UNION SELECT {t}t.node, s.sup FROM {name}_r t JOIN sub s ON s.sub = t.cls)"""


EVENTS = f"WITH RECURSIVE {quads()},\n{ontology(EVENT_AXIOMS)}"
TRADES = f"WITH RECURSIVE {TRADE},\n{ontology(TRADE_AXIOMS)}"
EVENT_TYPES = f"{EVENTS},\n{types('q')}"
TRADE_TYPES = f"{TRADES},\n{types('tq')}"
KINDS = f"""WITH {EV},
bg AS (SELECT a AS s, 'rdfs:subClassOf' AS p, b AS o FROM {values(EVENT_AXIOMS)} AS t(kind, a, b, c, d) WHERE kind = 'subclass'),
kq AS (SELECT pos // {N} AS graph_no, 'u:' || user_id AS s, 'p:did' AS p, o, 'iri' AS o_kind FROM ev WHERE p = 'rdf:type'
       UNION ALL SELECT NULL, s, p, o, 'iri' FROM bg)"""

CLOCK = """TIMESTAMP '2024-01-01' + to_seconds(graph_no * 1000) AS arrival_ts,
  TIMESTAMP '2024-01-01' + to_seconds(graph_no * 1000 + 1 + (graph_no * 7919) % 25000) AS expire_ts"""
ENTRIES = f"entries AS (SELECT DISTINCT graph_no, CAST(0 AS BIGINT) AS use_count, {CLOCK} FROM q)"
USERS = f"""WITH {EV},
placed AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1) // 10 AS graph_no FROM ev),
entries AS (SELECT user_id, graph_no, count(*) FILTER (p = 'p:purchased') AS use_count, {CLOCK}
            FROM placed GROUP BY user_id, graph_no),
timed AS (SELECT *, max(arrival_ts) OVER (PARTITION BY user_id) AS now FROM entries)"""
USAGE = f"""{EVENT_TYPES}, {ENTRIES},
used AS (SELECT graph_no, count(*) AS usage FROM (
  SELECT DISTINCT graph_no, s, p, o FROM q
  WHERE p IN ('p:performed', 'p:purchased') AND s IN (SELECT node FROM types WHERE cls = 'c:Buyer')) GROUP BY graph_no)"""


def evicted(order: str, net: str = "5", extra: str = "") -> str:
    return f"""{USERS}{extra}
SELECT user_id, graph_no FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}, graph_no) AS rn FROM timed) r
WHERE rn <= {net}"""


def ratio(top: str, bottom: str) -> str:
    return f"coalesce(CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0), 0)"


def quality(windows: str, answers: str, truth: str, by: str) -> str:
    """SELECT of the quality columns per window of ``windows``."""
    keys = ", ".join(f"w.{k.strip()}" for k in by.split(","))
    return f"""SELECT {by}, n_results, hits, precision, recall,
    {ratio('2 * precision * recall', 'precision + recall')} AS fmeasure FROM (
  SELECT {by}, n_results, hits, {ratio('hits', 'n_results')} AS precision, {ratio('hits', f'(SELECT count(*) FROM {truth})')} AS recall FROM (
    SELECT {keys}, count(a.s) AS n_results, count(t.s) AS hits
    FROM {windows} w LEFT JOIN {answers} a USING ({by}) LEFT JOIN {truth} t ON t.s = a.s GROUP BY {keys}) c) d"""


def tumbling(n: int, size: int, tag: str) -> str:
    """CTEs ending in quality_<tag>: windows of ``size`` whole graphs."""
    return f"""w_{tag} AS (SELECT *, pos // {n} // {size} AS epoch FROM ev),
{types(f'w_{tag}', 'epoch', f'types_{tag}')},
answers_{tag} AS (SELECT epoch, node AS s FROM types_{tag} WHERE cls = 'c:Buyer'),
windows_{tag} AS (SELECT DISTINCT epoch FROM w_{tag}),
quality_{tag} AS ({quality(f'windows_{tag}', f'answers_{tag}', 'truth', 'epoch')})"""


TRUTH = f"{EVENT_TYPES},\ntruth AS (SELECT node AS s FROM types WHERE cls = 'c:Buyer')"
TUMBLING = f"{TRUTH},\n{tumbling(N, SIZE, 'one')}"
def replay_ctes(configs: list[tuple], steps: int) -> str:
    """The epoch loop unrolled: configs are (id, policy, triples per graph, size, evict, evictions or None for
    the whole stream). CTEs end in ``scored`` and ``moves``.

    Each step's tables carry its number. A config's row in st<k> holds its cursor and
    whether it still runs; en<k> holds its window at the start of step k.
    """
    ctes = [f"""cf AS (SELECT config_id, policy, n, size, evict, CAST(evictions AS BIGINT) AS evictions
  FROM {values(configs)} AS t(config_id, policy, n, size, evict, evictions)),
supply AS (SELECT n, CAST(((SELECT count(*) FROM ev) + n - 1) // n AS BIGINT) AS n_graphs FROM (SELECT DISTINCT n FROM cf)),
al AS (SELECT n, CAST(g AS BIGINT) AS graph_no, CAST(0 AS BIGINT) AS use_count,
  TIMESTAMP '2024-01-01' + to_seconds(g * 1000) AS arrival_ts,
  TIMESTAMP '2024-01-01' + to_seconds(g * 1000 + 1 + (g * 7919) % 25000) AS expire_ts
  FROM supply, unnest(range(n_graphs)) AS u(g)),
wq AS (SELECT n, ev.s, ev.p, ev.o, ev.o_kind, pos // n AS graph_no FROM ev, supply WHERE p <> 'p:cents'),
st0 AS (SELECT cf.*, n_graphs, least(size, n_graphs) AS cursor FROM cf JOIN supply USING (n)),
en0 AS (SELECT config_id, al.* FROM st0 JOIN al USING (n) WHERE graph_no < cursor)"""]
    for k in range(steps):
        ctes.append(f"""nw{k} AS (SELECT config_id, max(arrival_ts) AS now FROM en{k} GROUP BY config_id),
lv{k} AS (SELECT e.*, now FROM en{k} e JOIN nw{k} USING (config_id) WHERE expire_ts >= now),
sa{k} AS (SELECT s.*, (SELECT count(*) FROM en{k} e WHERE e.config_id = s.config_id)
                    - (SELECT count(*) FROM lv{k} e WHERE e.config_id = s.config_id) AS n_expired,
          cursor + least(size - (SELECT count(*) FROM lv{k} e WHERE e.config_id = s.config_id), n_graphs - cursor) AS filled
          FROM st{k} s),
cu{k} AS MATERIALIZED (SELECT * FROM lv{k} UNION ALL
  SELECT config_id, al.*, now FROM sa{k} JOIN nw{k} USING (config_id) JOIN al USING (n)
  WHERE al.graph_no >= cursor AND al.graph_no < filled),
wi{k} AS MATERIALIZED (SELECT config_id, graph_no, s, p, o, o_kind FROM wq JOIN cu{k} USING (n, graph_no)),
{types(f'wi{k}', 'config_id', f'ty{k}')},
an{k} AS MATERIALIZED (SELECT config_id, node AS s FROM ty{k} WHERE cls = 'c:Buyer'),
us{k} AS (SELECT config_id, graph_no, count(*) AS usage FROM (
    SELECT DISTINCT config_id, graph_no, s, p, o FROM wi{k} JOIN an{k} USING (config_id, s)
    WHERE p IN ('p:performed', 'p:purchased')) GROUP BY config_id, graph_no),
up{k} AS (SELECT c.config_id, c.n, c.graph_no, policy,
    CASE WHEN policy = 'LFU' AND evict < size THEN use_count + coalesce(usage, 0) ELSE use_count END AS use_count,
    CASE WHEN policy = 'LRU' AND evict < size AND usage IS NOT NULL THEN now ELSE arrival_ts END AS arrival_ts, expire_ts,
    CASE WHEN {k} >= evictions THEN 0 WHEN evict = size THEN size ELSE greatest(0, evict - n_expired) END AS k
  FROM cu{k} c JOIN sa{k} USING (config_id) LEFT JOIN us{k} u ON u.config_id = c.config_id AND u.graph_no = c.graph_no),
rk{k} AS (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY
    CASE policy WHEN 'FEFO' THEN epoch_us(expire_ts) WHEN 'LRU' THEN epoch_us(arrival_ts) ELSE use_count END, graph_no) AS rn FROM up{k}),
ke{k} AS MATERIALIZED (SELECT config_id, n, graph_no, use_count, arrival_ts, expire_ts FROM rk{k} WHERE rn > k),
mv{k} AS (SELECT s.config_id, CAST({k} AS BIGINT) AS epoch, CAST(n_expired AS BIGINT) AS n_expired,
    (SELECT count(*) FROM rk{k} r WHERE r.config_id = s.config_id AND rn <= k) AS n_evicted FROM sa{k} s),
ef{k} AS (SELECT s.config_id, policy, n, size, evict, evictions, n_graphs, filled AS cursor,
    size - (SELECT count(*) FROM ke{k} e WHERE e.config_id = s.config_id) AS free FROM sa{k} s),
st{k + 1} AS MATERIALIZED (SELECT config_id, policy, n, size, evict, evictions, n_graphs, cursor + free AS cursor FROM ef{k}
  WHERE n_graphs - cursor >= free AND ({k} < evictions OR evictions IS NULL)),
en{k + 1} AS MATERIALIZED (SELECT e.* FROM ke{k} e SEMI JOIN st{k + 1} USING (config_id) UNION ALL
  SELECT config_id, al.* FROM ef{k} f SEMI JOIN st{k + 1} USING (config_id) JOIN al USING (n)
  WHERE al.graph_no >= f.cursor AND al.graph_no < f.cursor + f.free)""")
    moves = " UNION ALL ".join(f"SELECT * FROM mv{k}" for k in range(steps))
    answers = " UNION ALL ".join(f"SELECT config_id, CAST({k} AS BIGINT) AS epoch, s FROM an{k}" for k in range(steps))
    ctes.append(f"moves AS ({moves}),\nans AS ({answers}),\nscored AS ({quality('moves', 'ans', 'truth', 'config_id, epoch')})")
    return f"{TRUTH},\n" + ",\n".join(ctes)


def replay_sql(configs: list[tuple], steps: int, columns: str = "*") -> str:
    return f"{replay_ctes(configs, steps)}\nSELECT {columns} FROM scored JOIN moves USING (config_id, epoch)"


def keyed_sql(size: int, evict: int) -> str:
    """Per-user windows ranked by use count, a row per step with the window as a list; a user steps while whole refills are there."""
    return f"""{USERS.replace("WITH ", "WITH RECURSIVE ", 1)},
al AS (SELECT user_id, list(struct_pack(u := use_count, g := graph_no, a := arrival_ts, e := expire_ts) ORDER BY graph_no) AS al FROM entries GROUP BY user_id),
st AS (SELECT user_id, al, CAST(-1 AS BIGINT) AS epoch, al[1:{size}] AS held, least({size}, len(al)) AS cursor, al[1:0] AS gone, al[1:0] AS evicted FROM al
  UNION ALL SELECT user_id, al, epoch + 1, ranked[k + 1:] || al[filled + 1:filled + k], least(len(al), filled + k), gone, ranked[1:k] FROM (
    SELECT user_id, al, epoch, gone, cursor + len(gone) AS filled, greatest(0, {evict} - len(gone)) AS k,
      list_sort(list_filter(held, lambda x: x.e >= now) || al[cursor + 1:cursor + len(gone)]) AS ranked FROM (
      SELECT user_id, al, epoch, held, cursor, now, list_filter(held, lambda x: x.e < now) AS gone FROM (
        SELECT user_id, al, epoch, held, cursor, list_max(list_transform(held, lambda x: x.a)) AS now FROM st WHERE len(held) = {size}) clocked) marked
    WHERE len(gone) <= len(al) - cursor) stepped)
SELECT user_id, epoch, unnest(gone).g AS graph_no, 'expired' AS cause FROM st
UNION ALL SELECT user_id, epoch, unnest(evicted).g, 'evicted' FROM st"""


PART_EDGES = """WITH RECURSIVE edge AS (
  SELECT 'part:' || p_partkey AS src, p_brand AS dst FROM part UNION SELECT p_brand, p_type FROM part
  UNION SELECT p_type, 'Product' FROM part),
reach AS (SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM reach r JOIN edge e ON r.dst = e.src)
SELECT src, dst FROM reach"""
WITHIN = """WITH RECURSIVE edge AS (
  SELECT 'or:' || o_orderkey AS s, 'cu:' || o_custkey AS o FROM orders
  UNION SELECT 'cu:' || c_custkey, 'n:' || c_nationkey FROM customer
  UNION SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation
  UNION SELECT 'r:' || r_regionkey, 'o:World' FROM region),
reach AS (SELECT s, o FROM edge UNION SELECT r.s, e.o FROM reach r JOIN edge e ON r.o = e.s)
SELECT s, 'within' AS p, o FROM reach"""
BASE = "http://example.org"
NT = f"""SELECT CAST(event_id * 2 + i AS BIGINT) AS seq,
  CASE WHEN i = 0 THEN '{BASE}/user/' || user_id ELSE '{BASE}/event/' || event_id END AS s,
  CASE WHEN i = 0 THEN '{BASE}/did' ELSE '{BASE}/props' END AS p"""

# A run with T evictions has T + 1 steps; the stream of 30 graphs ends before STREAM_STEPS, one of SEGMENTS graphs before REPLAY_STEPS.
SWEEP = [c[:6] for c in PUBLISHED]
SWEEP_STEPS = max(c[5] for c in SWEEP) + 1
STREAM_STEPS, REPLAY_STEPS = 16, 16
AVERAGED = f"""{replay_ctes(SWEEP, SWEEP_STEPS)},
averaged AS (SELECT config_id, policy, n, size, evict, {", ".join(f"round(sum({m}) / (evictions + 1), 9) AS {m}" for m in ("precision", "recall", "fmeasure"))}
  FROM scored JOIN cf USING (config_id) GROUP BY config_id, policy, n, size, evict, evictions)"""

ORACLES: dict[str, str] = {
    "match_distinct": f"WITH {EV} SELECT DISTINCT s FROM ev WHERE p = 'rdf:type' AND o = 'c:Purchase'",
    "match_all_graphs": f"{KINDS} SELECT DISTINCT s, p, o, o_kind FROM kq",
    "match_graph_var": f"{KINDS} SELECT DISTINCT graph_no, s, p, o, o_kind FROM kq WHERE graph_no IS NOT NULL",
    "bgp_join": f"""WITH {EV} SELECT DISTINCT a.s AS u, a.o AS e, c.o AS cents FROM ev a
JOIN ev b ON b.s = a.o AND b.p = 'rdf:type' AND b.o = 'c:Purchase' JOIN ev c ON c.s = a.o AND c.p = 'p:cents'
WHERE a.p = 'p:purchased'""",
    "count_quads": f"WITH {quads()} SELECT count(*) AS n_quads FROM (SELECT DISTINCT graph_no, s, p, o FROM q)",
    "graph_union": f"{KINDS} SELECT DISTINCT s, p, o, o_kind FROM kq",
    "entailment_regime": f"""{EVENT_TYPES},
plain AS (SELECT DISTINCT q.s AS node, ss.sup AS cls FROM q JOIN sub0 ss ON ss.sub = q.o WHERE q.p = 'rdf:type')
SELECT regime, cls, CASE regime
    WHEN 'none' THEN (SELECT count(DISTINCT s) FROM q WHERE p = 'rdf:type' AND o = k.cls)
    WHEN 'rdfs++' THEN (SELECT count(*) FROM plain WHERE plain.cls = k.cls)
    ELSE (SELECT count(*) FROM types WHERE types.cls = k.cls) END AS n
FROM (VALUES ('none'), ('rdfs++'), ('restriction')) AS r(regime),
     (VALUES ('c:Click'), ('c:Conversion'), ('c:Buyer')) AS k(cls)""",
    "instances_of": f"{EVENT_TYPES} SELECT node AS s FROM types WHERE cls = 'c:Buyer'",
    "instances_of_trade": f"{TRADE_TYPES} SELECT cls, node AS s FROM types WHERE cls IN ('Employee', 'Customer', 'Organization')",
    "subclass_closure": PART_EDGES,
    "transitive_closure_prop": WITHIN,
    "path_class": f"""{WITHIN.replace("SELECT s, 'within' AS p, o FROM reach", "")}
SELECT DISTINCT s FROM reach WHERE o IN (SELECT 'r:' || r_regionkey FROM region WHERE r_name = 'ASIA')""",
    "path_leaves": f"""{WITHIN.replace("SELECT s, 'within' AS p, o FROM reach", "").rstrip()},
asia AS (SELECT 'r:' || r_regionkey AS r FROM region WHERE r_name = 'ASIA'),
a AS (SELECT DISTINCT s FROM reach JOIN asia ON o = r),
met AS (SELECT s, s AS n FROM a UNION SELECT s, o FROM reach JOIN a USING (s))
SELECT met.s, e.s AS leaf_s, 'within' AS leaf_p, e.o AS leaf_o,
  CAST(CASE split_part(e.s, ':', 1) WHEN 'or' THEN 0 WHEN 'cu' THEN 1 WHEN 'n' THEN 2 ELSE 3 END AS BIGINT) AS graph_no
FROM met JOIN edge e ON e.s = met.n WHERE e.o IN (SELECT r FROM asia) OR e.o IN (SELECT s FROM a)
UNION ALL SELECT s, r, 'rdf:type', 'AsianRegion', CAST(3 AS BIGINT) FROM a, asia""",
    "type_propagation": f"{EVENTS} SELECT DISTINCT s AS node, sup AS cls FROM q JOIN sub ON sub.sub = q.o WHERE p = 'rdf:type'",
    "subproperty_propagation": f"""WITH {EV} SELECT DISTINCT s, p, o, o_kind FROM (
  SELECT s, p, o, o_kind FROM ev UNION ALL SELECT s, 'p:performed', o, o_kind FROM ev WHERE p = 'p:purchased')""",
    "inverse_props": f"""WITH {TRADE} SELECT DISTINCT s, p, o, o_kind FROM (SELECT * FROM tq
  UNION ALL SELECT o, 'member', s, 'iri' FROM tq WHERE p = 'memberOf')""",
    "domain_types": f"""WITH {EV} SELECT DISTINCT s AS node, CASE p WHEN 'p:cents' THEN 'c:Event' ELSE 'c:User' END AS cls
FROM ev WHERE p IN ('p:cents', 'p:performed')""",
    "range_types": f"WITH {EV} SELECT DISTINCT o AS node, 'c:Event' AS cls FROM ev WHERE p = 'p:performed'",
    "restriction_types": f"{TRADE_TYPES} SELECT node, cls FROM types_r",
    "existential_subsumption": "SELECT DISTINCT 'u:' || user_id AS s FROM events WHERE event_type = 'error'",
    "assign_graphs": f"""WITH {EV} SELECT pos, s, p, o, CAST((row_number() OVER (ORDER BY ts, pos) - 1) // {N} AS BIGINT) AS graph_no FROM ev""",
    "assign_graphs_keyed": f"""WITH {EV}, r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, pos) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT user_id, pos, s, p, o, CAST(i // 10 AS BIGINT) AS graph_no FROM r WHERE i // 10 < n // 10""",
    "assign_ttl": f"""WITH {quads()} SELECT graph_no, CAST(0 AS BIGINT) AS use_count, max(ts) AS arrival_ts,
  max(ts) + to_seconds(1 + (graph_no * 7919) % 25000) AS expire_ts FROM q GROUP BY graph_no""",
    "window_fill": f"""{USERS}, held AS (SELECT * FROM entries WHERE graph_no < 3 AND use_count > 0),
n AS (SELECT user_id, count(*) AS c FROM held GROUP BY user_id)
SELECT user_id, graph_no, use_count, arrival_ts, expire_ts FROM held UNION ALL
SELECT e.user_id, graph_no, use_count, arrival_ts, expire_ts FROM entries e LEFT JOIN n USING (user_id)
WHERE graph_no >= 3 AND graph_no < 3 + {SIZE} - coalesce(c, 0)""",
    "expire": f"{USERS} SELECT user_id, graph_no, CASE WHEN expire_ts < now THEN 'expired' ELSE 'live' END AS state FROM timed",
    "window_trace": f"""WITH {quads()}, {ENTRIES} SELECT 'events' AS config_id, 0 AS epoch, *,
  expire_ts < (SELECT max(arrival_ts) FROM entries) AS expired FROM entries""",
    "evict_fefo": evicted("expire_ts"),
    "evict_lru": evicted("arrival_ts"),
    "evict_lfu": evicted("use_count"),
    "evict_net_of_expired": f"""{USERS}, clocked AS (
  SELECT *, graph_no // {SIZE} AS w, max(arrival_ts) OVER (PARTITION BY user_id, graph_no // {SIZE}) AS clock FROM entries),
counts AS (SELECT user_id, w, count(*) FILTER (expire_ts < clock) AS gone, count(*) FILTER (expire_ts >= clock) AS held FROM clocked GROUP BY user_id, w),
filled AS (SELECT user_id, w, graph_no, expire_ts FROM clocked WHERE expire_ts >= clock UNION ALL
  SELECT e.user_id, c.w, e.graph_no, e.expire_ts FROM entries e JOIN counts c USING (user_id)
  WHERE e.graph_no >= (c.w + 1) * {SIZE} AND e.graph_no < (c.w + 2) * {SIZE} - c.held),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, w ORDER BY expire_ts, graph_no) AS rn FROM filled)
SELECT user_id, w AS "window", graph_no FROM ranked JOIN counts USING (user_id, w) WHERE rn <= 5 - gone""",
    "evict_all": f"""WITH {quads()} SELECT graph_no // {SIZE} AS epoch, count(DISTINCT graph_no) AS n_graphs, count(*) AS n_triples
FROM q GROUP BY 1""",
    "drop_graphs": f"""WITH {quads()}, {ENTRIES} SELECT graph_no, s, p, o FROM q WHERE graph_no IN (
  SELECT graph_no FROM entries WHERE expire_ts >= (SELECT max(arrival_ts) FROM entries))""",
    "explain_leaves": f"""{EVENT_TYPES}, buyer AS (SELECT node AS s FROM types WHERE cls = 'c:Buyer'),
did AS (SELECT * FROM q WHERE p IN ('p:performed', 'p:purchased') AND s IN (SELECT s FROM buyer)),
sold AS (SELECT * FROM q WHERE p = 'rdf:type' AND o = 'c:Purchase')
SELECT s, s AS leaf_s, p AS leaf_p, o AS leaf_o, graph_no FROM did
UNION SELECT d.s, t.s, t.p, t.o, t.graph_no FROM did d JOIN sold t ON t.s = d.o""",
    "graph_usage": f"{USAGE} SELECT graph_no, usage FROM used",
    "touch_lru": f"""{USAGE} SELECT e.graph_no, use_count,
  CASE WHEN usage >= {N // 3} THEN (SELECT max(arrival_ts) FROM entries) ELSE arrival_ts END AS arrival_ts, expire_ts
FROM entries e LEFT JOIN used USING (graph_no)""",
    "bump_lfu": f"""{USAGE} SELECT e.graph_no, CAST(use_count + coalesce(usage, 0) AS BIGINT) AS use_count, arrival_ts, expire_ts
FROM entries e LEFT JOIN used USING (graph_no)""",
    "truth_hits": f"""{EVENT_TYPES} SELECT node AS s FROM types WHERE cls = 'c:ActiveUser'
INTERSECT SELECT node FROM types WHERE cls = 'c:Buyer'""",
    "window_quality": f"{TUMBLING} SELECT * FROM quality_one",
    "run_average": f"{AVERAGED} SELECT * EXCLUDE (n), n AS n_triples FROM averaged",
    "policy_pivot": f"""{AVERAGED}, shares AS (SELECT * FROM {values(sorted({(size, evict, share) for _, _, _, size, evict, _, share in PUBLISHED}))} AS t(size, evict, evict_pct))
SELECT size, evict_pct, {", ".join(f"max(fmeasure) FILTER (policy = '{p}' AND n = {n}) AS {p}_{n}" for p in POLICIES for n in LENGTHS)}
FROM averaged JOIN shares USING (size, evict) GROUP BY size, evict_pct""",
    "window_replay": replay_sql([("run", "LFU", 1, SIZE, SIZE // 2, None)], REPLAY_STEPS).replace(
        "policy, n,", f"policy, (SELECT (count(*) + {SEGMENTS - 1}) // {SEGMENTS} FROM ev) AS n,", 1),
    "policy_sweep": replay_sql(SWEEP, SWEEP_STEPS),
    "semantic_window_stream": replay_sql([("run", *STREAM)], STREAM_STEPS, "* EXCLUDE (config_id)"),
    "keyed_policy_window": keyed_sql(6, 3),
    "nt_scan": f"{NT}, CASE WHEN i = 0 THEN '{BASE}/event/' || event_id ELSE props END AS o, "
               "CASE WHEN i = 0 THEN 'iri' ELSE 'lit' END AS o_kind FROM events, (VALUES (0), (1)) AS two(i)",
    "nt_scan_compat": f"""{NT}, CASE WHEN i = 0 THEN '{BASE}/event/' || event_id ELSE
  substring(split_part(replace('"' || replace(props, '"', '\\"') || '"', '>', ''), ' ', 1), 2,
            length(split_part('"' || replace(props, '"', '\\"') || '"', ' ', 1)) - 2) END AS o,
  CASE WHEN i = 0 THEN 'iri' ELSE 'lit' END AS o_kind FROM events, (VALUES (0), (1)) AS two(i)""",
    "ontology_axioms": f"""WITH p AS (SELECT '{BASE}/parts#Part' || p_partkey AS a, '{BASE}/parts#' || replace(p_brand, '#', '') AS b,
  '{BASE}/parts#' || p_type AS t FROM part)
SELECT 'subclass' AS kind, a, b, CAST(NULL AS VARCHAR) AS c, CAST(NULL AS VARCHAR) AS d FROM p
UNION SELECT 'equiv_some', a, '{BASE}/parts#Product', '{BASE}/parts#madeAs', t FROM p""",
    "ground_truth_scan": "SELECT DISTINCT 'u:' || user_id AS s FROM events WHERE event_type = 'purchase'",
    "metrics_sink": f"""{TUMBLING}, kinds AS (SELECT 'window' AS kind, precision, recall, fmeasure FROM quality_one
  UNION ALL SELECT 'average', avg(precision), avg(recall), avg(fmeasure) FROM quality_one)
SELECT kind, 'spark' AS store, 'FEFO' AS policy, 'mem' AS storage, {N} AS n_triples, {SIZE} AS size, {SIZE} AS evict, CAST(0 AS DOUBLE) AS explain,
  round(precision, 9) AS precision, round(recall, 9) AS recall, round(fmeasure, 9) AS fmeasure FROM kinds""",
    "bench_results_scan": """SELECT store, policy, 'mem' AS storage, n_triples, 100 AS size, 25 AS evict,
  CAST(count(*) AS DOUBLE) AS sparql, CAST(1 AS DOUBLE) AS precision, CAST(0.5 AS DOUBLE) AS recall, CAST(0.25 AS DOUBLE) AS fmeasure,
  CAST(explain AS DOUBLE) AS explain, CAST(min(event_id) AS DOUBLE) AS evict_ms, CAST(max(event_id) AS DOUBLE) AS memory
FROM events JOIN (VALUES ('click', 'FEFO', 10), ('purchase', 'LRU', 10), ('view', 'LFU', 10), ('error', 'FEFO', 100), ('signup', 'LRU', 100))
       AS k(event_type, policy, n_triples) USING (event_type),
     (VALUES ('one', 7), ('two', NULL)) AS s(store, explain) GROUP BY store, policy, n_triples, explain""",
    "quad_store_scan": f"WITH {quads()} SELECT graph_no, s, o FROM q WHERE p = 'p:purchased'",
}
