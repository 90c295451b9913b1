"""Queries of the graph and measurement operators over facts derived from the data tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamark.frames import cut, table
from seamark.functions import texts
from seamark.operators import dataflow, facts, graph, knowledge, ledger, measure
from seamark.sources import facts_io

_EDGE_TEXT = " || ".join(f"length({c}) || ':' || {c}" for c in ("id", "source", "target"))
_DIGEST = "sha256(count(*) || ':' || " + " || ':' || ".join(f"CAST(CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS HUGEINT) AS VARCHAR)" for i in range(4)) + ")"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return keep


def _arm(i: int, kind: str, source: str, target: str, rest: str) -> str:
    return f"SELECT list_extract({list(facts.KINDS)!r}, CAST((({kind}) + {i}) % {len(facts.KINDS)} AS INT) + 1) AS type, {source} AS source, {target} AS target FROM {rest}"


def _name(kind: str, key: str, mod: int) -> str:
    return f"'{kind}' || CAST({key} % {mod} AS VARCHAR) || '.' || CAST({key} AS VARCHAR)"


_ARMS = " UNION ALL ".join(
    (
        _arm(0, "n_nationkey", _name("nation", "n_nationkey", 5), "'region0.' || CAST(n_regionkey AS VARCHAR)", "nation"),
        _arm(1, "c_custkey", _name("customer", "c_custkey", 10), _name("nation", "c_nationkey", 5), "customer"),
        _arm(2, "s_suppkey", _name("supplier", "s_suppkey", 3), _name("nation", "s_nationkey", 5), "supplier"),
        _arm(3, "o_orderkey", _name("orders", "o_orderkey", 30), _name("customer", "o_custkey", 10), "orders"),
        _arm(4, "k", _name("part", "l_partkey", 20), _name("supplier", "l_suppkey", 3), "(SELECT l_partkey, l_suppkey, min(l_orderkey) AS k FROM lineitem GROUP BY 1, 2)"),
    )
)
_REL = "split_part({}, '.', 1)"
_GRAPH = f"""raw AS ({_ARMS}),
g AS (SELECT DISTINCT type || '|' || source || '|' || CASE WHEN type IN ('FILTERS', 'OPAQUE') THEN {_REL.format("target")} ELSE target END AS id, type, source,
  CASE WHEN type IN ('FILTERS', 'OPAQUE') THEN {_REL.format("target")} ELSE target END AS target FROM raw)"""


def _walk_sql(start: str, up: bool, depth: int, types: str) -> str:
    """Nodes by hop, then each edge at the first hop that reaches it."""
    if up:
        on = f"(e.type IN ({types}) AND e.target = w.node) OR (e.type IN ('FILTERS', 'MENTIONS_COL', 'OPAQUE') AND e.target = {_REL.format('w.node')})"
        ahead, kept = "e.source", "true"
    else:
        on = f"(e.type IN ('FILTERS', {types}) AND e.source = w.node) OR (e.type = 'OPAQUE' AND e.source = {_REL.format('w.node')})"
        ahead, kept = "e.target", "e.type <> 'FILTERS'"
    return f"""WITH RECURSIVE {_GRAPH},
    w(node, depth) AS (SELECT node, 0 FROM ({start}) UNION SELECT {ahead}, w.depth + 1 FROM w JOIN g e ON {on} WHERE {kept} AND w.depth < {depth - 1}),
    first AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1),
    hops AS (SELECT e.type, e.source, e.target, e.id, min(w.depth) + 1 AS depth FROM first w JOIN g e ON {on} GROUP BY ALL)"""


_WALKED = "'FEEDS', 'INFLUENCES', 'MENTIONS_COL'"


@query(_walk_sql("SELECT 'region0.' || r_regionkey AS node FROM region", True, 3, _WALKED) + " SELECT depth, type, source, target, id, type IN ('MENTIONS_COL', 'OPAQUE') AS unverified FROM hops")
def graph_upstream(spark, sf_dir):
    start = table(spark, sf_dir, "region").select(F.concat(F.lit("region0."), "r_regionkey").alias("node"))
    return graph.upstream(facts.graph(spark, sf_dir), start, 3, unique=True)


@query(_walk_sql("SELECT 'region0.' || r_regionkey AS node FROM region", True, 3, _WALKED) + " SELECT depth, type, source, target, id, type IN ('MENTIONS_COL', 'OPAQUE') AS unverified FROM hops")
def graph_upstream_all(spark, sf_dir):
    """graph_upstream, which starts from every region too; the name stays for its users."""
    return graph_upstream(spark, sf_dir)


@query(_walk_sql("SELECT 'orders' || o_orderkey % 30 || '.' || o_orderkey AS node FROM orders", False, 5, _WALKED + ", 'KEYS'") + " SELECT depth, type, source, target, id, type IN ('MENTIONS_COL', 'OPAQUE') AS unverified FROM hops")
def graph_downstream(spark, sf_dir):
    start = table(spark, sf_dir, "orders").select(facts.name("orders", F.col("o_orderkey") % 30, F.col("o_orderkey")).alias("node"))
    return graph.downstream(facts.graph(spark, sf_dir), start, 5, join_keys=True, unique=True)


@query(_walk_sql("SELECT 'orders' || o_orderkey % 30 || '.' || o_orderkey AS node FROM orders", False, 5, _WALKED + ", 'KEYS'") + " SELECT depth, type, source, target, id, type IN ('MENTIONS_COL', 'OPAQUE') AS unverified FROM hops")
def graph_downstream_all(spark, sf_dir):
    """graph_downstream, which starts from every order too; the name stays for its users."""
    return graph_downstream(spark, sf_dir)


@query(
    _walk_sql("SELECT 'customer' || min(c_custkey) % 10 || '.' || min(c_custkey) AS node FROM customer", False, 15, _WALKED + ", 'KEYS'")
    + " SELECT target, min(depth) AS depth, string_agg(DISTINCT type, ',' ORDER BY type) AS flows, min(depth) = 1 AS direct FROM hops GROUP BY 1"
)
def graph_impact(spark, sf_dir):
    key = table(spark, sf_dir, "customer").agg(F.min("c_custkey")).first()[0]
    return graph.impact(facts.graph(spark, sf_dir), f"customer{key % 10}.{key}")


@query(f"""WITH RECURSIVE {_GRAPH},
p AS (SELECT DISTINCT source, target FROM g WHERE type IN ('FEEDS', 'INFLUENCES', 'KEYS')),
s(node, path, hops) AS (SELECT source, source, 0 FROM (SELECT min(source) AS source FROM p WHERE source LIKE 'part%')
  UNION ALL SELECT p.target, s.path || ' > ' || p.target, s.hops + 1 FROM s JOIN p ON p.source = s.node WHERE s.hops < 8),
t AS (SELECT * FROM s WHERE node = 'region0.1') SELECT hops, path FROM t WHERE hops = (SELECT min(hops) FROM t)""")
def graph_shortest_paths(spark, sf_dir):
    g = cut(facts.graph(spark, sf_dir), "graph")
    source = g.filter("type IN ('FEEDS', 'INFLUENCES', 'KEYS') AND source LIKE 'part%'").agg(F.min("source")).first()[0]
    return graph.shortest_paths(g, source, "region0.1", 8)


@query(f"""WITH {_GRAPH}, n AS (SELECT source AS node FROM g UNION SELECT target FROM g),
r AS (SELECT node, CASE WHEN lower(node) = 'nation1' THEN 0 WHEN lower(node) LIKE '%.nation1' THEN 1 ELSE 2 END AS rank FROM n WHERE contains(lower(node), 'nation1')),
t AS (SELECT * FROM r ORDER BY rank, length(node), node LIMIT 10) SELECT rank, node FROM t WHERE rank = (SELECT min(rank) FROM t)""")
def graph_find(spark, sf_dir):
    g = facts.graph(spark, sf_dir)
    return graph.find(g.select(F.col("source").alias("node")).unionByName(g.select(F.col("target").alias("node"))), "Nation1")


_COVERAGE = f"""known AS (SELECT 'part' || p_partkey % 20 || '.' || p_partkey AS node FROM part UNION SELECT 'part' || p_partkey % 20 || '.c' || p_partkey FROM part UNION SELECT 'empty' || s_suppkey % 9 || '.' || s_suppkey FROM supplier),
n AS (SELECT source AS node FROM g UNION SELECT target FROM g UNION SELECT node FROM known),
wr AS (SELECT DISTINCT 'st' || l_orderkey AS statement, 'part' || l_partkey % 20 AS "table" FROM lineitem WHERE l_returnflag = 'R'),
r AS (SELECT {_REL.format("node")} AS relation, count(*) FILTER (contains(node, '.')) AS n_columns, count(*) FILTER (contains(node, '.') AND node IN (SELECT target FROM g WHERE type IN ('FEEDS', 'INFLUENCES'))) AS n_fed FROM n GROUP BY 1),
i AS (SELECT {_REL.format("target")} AS relation, count(*) FILTER (type = 'FILTERS') AS x, count(*) FILTER (type IN ('MENTIONS_COL', 'OPAQUE')) AS o FROM g GROUP BY 1),
w AS (SELECT "table" AS relation, count(DISTINCT statement) AS n FROM wr GROUP BY 1)"""


@query(f"""WITH {_GRAPH}, {_COVERAGE} SELECT relation, n_columns, n_fed, n_columns - n_fed AS n_unfed, coalesce(n, 0) AS n_writers, coalesce(x, 0) AS n_filters, coalesce(o, 0) AS n_weak FROM r LEFT JOIN i USING (relation) LEFT JOIN w USING (relation)""")
def graph_coverage(spark, sf_dir):
    p, s, li = (table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    k = F.col("p_partkey")
    columns = p.select(facts.name("part", k % 20, k).alias("node")).unionByName(p.select(F.concat(F.lit("part"), k % 20, F.lit(".c"), k).alias("node")))
    columns = columns.unionByName(s.select(facts.name("empty", F.col("s_suppkey") % 9, F.col("s_suppkey")).alias("node")))
    writes = li.filter("l_returnflag = 'R'").select(_of("st").alias("statement"), _part_table())
    return graph.coverage(cut(facts.graph(spark, sf_dir), "graph"), columns, writes)


@query(f"""WITH {_GRAPH} SELECT {_REL.format("source")} AS source, {_REL.format("target")} AS target, string_agg(DISTINCT type, ',' ORDER BY type) AS flows, count(*) AS n_edges
FROM g WHERE {_REL.format("source")} <> {_REL.format("target")} GROUP BY 1, 2""")
def graph_table_level(spark, sf_dir):
    return graph.table_level(facts.graph(spark, sf_dir))


_HIDDEN = "('supplier0', 'supplier1', 'supplier2', 'customer3', 'nation2')"
_LOST = "('orders0', 'orders7', 'supplier0', 'nation2')"
_P = f"list_position({list(graph.PRECEDENCE)!r}, {{}})"


def _ways(hidden: str) -> str:
    return f"""WITH RECURSIVE {_GRAPH}, e AS (SELECT DISTINCT source, target, {_P.format("type")} AS p, CASE WHEN type = 'FEEDS' THEN length(source) % 4 ELSE 0 END AS r,
{_REL.format("source")} IN {hidden} AS hs, {_REL.format("target")} IN {hidden} AS ht FROM g),
k AS (SELECT source AS via, target, p, r, ht FROM e WHERE hs UNION SELECT {_REL.format("source")}, target, p, r, ht FROM e WHERE hs),
w(source, node, p, r, ht, q) AS (SELECT source, target, p, r, ht, p FROM e WHERE ht AND NOT hs
UNION SELECT w.source, k.target, least(w.p, k.p), CASE WHEN least(w.p, k.p) = 6 THEN greatest(w.r, k.r) ELSE 0 END, k.ht, k.p FROM w JOIN k ON k.via = w.node WHERE w.ht)"""


_LADDER = "['identity', 'derived', 'conditional', 'aggregated']"


def _hidden(spark, names):
    return spark.sql(f"SELECT relation FROM VALUES {names.replace(', ', '), (').replace('((', '(').replace('))', ')')} t(relation)")


def _ranked(spark, sf_dir):
    rank = F.element_at(F.array(*map(F.lit, texts.TRANSFORMS)), (F.length("source") % 4 + 1).cast("int"))
    return facts.graph(spark, sf_dir).withColumn("transform", rank)


@query(f"""{_ways(_HIDDEN)}, j AS (SELECT source, CASE WHEN p = 3 AND q <> 3 THEN {_REL.format("node")} ELSE node END AS target, p, max(r) AS r, true AS joined FROM w WHERE NOT ht GROUP BY 1, 2, 3
UNION ALL SELECT source, target, p, r, false FROM e WHERE NOT hs AND NOT ht)
SELECT source, target, list_extract({list(graph.PRECEDENCE)!r}, CAST(p AS INT)) AS type, list_extract({_LADDER}, CAST(r AS INT) + 1) AS transform, joined FROM j""")
def graph_collapse(spark, sf_dir):
    return graph.collapse(_ranked(spark, sf_dir), _hidden(spark, _HIDDEN))


@query(f"""{_ways(_LOST)} SELECT {_REL.format("target")} AS card, list_extract({list(graph.PRECEDENCE)!r}, CAST(p AS INT)) AS type, {_REL.format("source")} AS hidden,
string_agg(DISTINCT split_part(source, '.', 2), ',' ORDER BY split_part(source, '.', 2)) AS columns FROM e WHERE hs AND NOT ht AND source NOT IN (SELECT node FROM w WHERE ht) GROUP BY 1, 2, 3""")
def graph_collapse_notes(spark, sf_dir):
    return graph.collapse_notes(_ranked(spark, sf_dir), _hidden(spark, _LOST))


_COMPONENTS = """WITH RECURSIVE e AS (SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders UNION SELECT 'o' || o_orderkey, 'p' || o_orderpriority || o_orderkey % 60 FROM orders),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(node, r) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM d GROUP BY a
UNION SELECT d.b, min(w.r) FROM w JOIN d ON d.a = w.node JOIN recurring.w AS o ON o.node = d.b WHERE w.r < o.r GROUP BY d.b) SELECT node, r AS component FROM w"""


@query(_COMPONENTS)
def graph_components(spark, sf_dir):
    return graph.components(_order_edges(table(spark, sf_dir, "orders")))


def _order_edges(o: DataFrame) -> DataFrame:
    s = F.concat(F.lit("o"), "o_orderkey").alias("source")
    return o.select(s, F.concat(F.lit("c"), "o_custkey").alias("target")).unionByName(o.select(s, F.concat(F.lit("p"), "o_orderpriority", F.col("o_orderkey") % 60).alias("target")))


@query(_COMPONENTS)
def graph_components_all(spark, sf_dir):
    """graph_components, which takes every order too; the name stays for its users."""
    return graph_components(spark, sf_dir)


# ---- measurement ----

_TRUTH = """truth AS (SELECT DISTINCT 'p' || l_partkey % 500 AS source, 's' || l_suppkey AS target, list_extract(['value', 'filter', 'influence'], CAST(l_partkey % 3 AS INT) + 1) AS flow,
CASE WHEN l_linenumber % 2 = 0 THEN 'identity' ELSE 'derived' END AS transform, CASE WHEN l_partkey % 3 = 1 THEN 'pre' END AS phase, CASE WHEN l_linenumber > 3 THEN 'g' || l_linenumber % 3 END AS guard,
CAST(l_suppkey % 3 AS INT) AS band, CAST(l_partkey % 500 AS INT) AS n FROM lineitem),
predicted AS (SELECT DISTINCT source, target, flow, transform, phase, CASE WHEN n % 11 = 0 THEN 'other' ELSE guard END AS guard, CASE WHEN n % 13 = 0 THEN (band + 1) % 3 ELSE band END AS band FROM truth WHERE n % 7 <> 0)"""


@query(f"""WITH {_TRUTH}, t AS (SELECT *, row_number() OVER (PARTITION BY source, target, flow, transform, phase, guard ORDER BY band) AS n1 FROM (SELECT DISTINCT * EXCLUDE (n) FROM truth)),
p AS (SELECT *, row_number() OVER (PARTITION BY source, target, flow, transform, phase, guard ORDER BY band) AS n1 FROM predicted),
x AS (SELECT t.source AS ts, p.source AS ps, coalesce(t.source, p.source) AS source, coalesce(t.target, p.target) AS target, coalesce(t.flow, p.flow) AS flow, coalesce(t.transform, p.transform) AS transform, coalesce(t.phase, p.phase) AS phase,
coalesce(t.guard, p.guard) AS guard, t.band AS tb, p.band AS pb FROM t FULL JOIN p ON t.source = p.source AND t.target = p.target AND t.flow = p.flow AND t.transform = p.transform AND t.phase IS NOT DISTINCT FROM p.phase AND t.guard IS NOT DISTINCT FROM p.guard AND t.n1 = p.n1),
a AS (SELECT *, row_number() OVER (PARTITION BY source, target, flow, transform, phase ORDER BY tb, coalesce('=' || guard, '-')) AS n2 FROM x WHERE ps IS NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY source, target, flow, transform, phase ORDER BY pb, coalesce('=' || guard, '-')) AS n2 FROM x WHERE ts IS NULL),
y AS (SELECT flow, tb, pb FROM x WHERE ts IS NOT NULL AND ps IS NOT NULL UNION ALL SELECT coalesce(a.flow, b.flow), a.tb, b.pb FROM a FULL JOIN b ON a.source = b.source AND a.target = b.target AND a.flow = b.flow AND a.transform = b.transform AND a.phase IS NOT DISTINCT FROM b.phase AND a.n2 = b.n2),
z AS (SELECT coalesce(tb, pb) AS band, flow, count(*) FILTER (tb IS NOT NULL AND pb IS NOT NULL) AS tp, count(*) FILTER (tb IS NULL) AS fp, count(*) FILTER (pb IS NULL) AS fn FROM y GROUP BY 1, 2)
SELECT band, flow, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM z""")
def measure_score(spark, sf_dir):
    return measure.score(facts.truth(spark, sf_dir), facts.predictions(spark, sf_dir))


@query(f"""WITH {_TRUTH} SELECT source, target, flow, transform FROM predicted WHERE source = 'p' || substr(target, 2) OR (flow = 'filter' AND transform = 'derived' AND source = 'p' || (CAST(substr(target, 2) AS INT) + 1))""")
def measure_forbidden(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    target, same, after = F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("p"), "s_suppkey"), F.concat(F.lit("p"), F.col("s_suppkey") + 1)
    rules = s.select(same.alias("source"), target.alias("target"), F.explode(F.array(F.lit("value"), F.lit("filter"), F.lit("influence"))).alias("flow"), F.lit(None).cast("string").alias("transform"))
    rules = rules.unionByName(s.select(after.alias("source"), target.alias("target"), F.lit("filter").alias("flow"), F.lit("derived").alias("transform")))
    return measure.forbidden(facts.predictions(spark, sf_dir).distinct(), rules).select("source", "target", "flow", "transform")


@query("""SELECT source, target, flow, unit, line FROM (SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, 'value' AS flow, l_returnflag AS unit, l_linenumber AS line FROM lineitem)
WHERE target IN ('s1', 's2', 's3') AND NOT (unit IN ('A', 'R') AND line <= 3)""")
def measure_origins(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    e = li.select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"), F.lit("value").alias("flow"), F.col("l_returnflag").alias("unit"), F.col("l_linenumber").alias("line"))
    pairs = e.filter("target IN ('s1', 's2', 's3')").select("source", "target", "flow").distinct()
    spots = spark.sql("SELECT unit, line FROM VALUES ('A'), ('R') u(unit), VALUES (1), (2), (3) l(line)")
    allowed = pairs.join(spots, F.lit(True)).withColumn("line", F.col("line").cast("int"))  # six spots for each pair
    return measure.origin_violations(e, allowed).select("source", "target", "flow", "unit", "line")


@query("""WITH em AS (SELECT 'u' || p_size AS unit, p_name AS fragment FROM part) SELECT fragment, min(unit) AS unit FROM em GROUP BY 1 HAVING count(DISTINCT unit) = 1""")
def measure_fragments(spark, sf_dir):
    return measure.discriminating_fragments(table(spark, sf_dir, "part").select(F.concat(F.lit("u"), "p_size").alias("unit"), F.col("p_name").alias("fragment")))


_LOG = """log AS (SELECT event_id AS sql_id, CASE WHEN event_id % 3 = 0 THEN upper(event_type) END AS action, 'shape' || user_id % 50 AS shape FROM events),
em AS (SELECT DISTINCT 'unit_' || event_type AS unit, event_type AS action, 'shape' || CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS shape FROM events WHERE event_type < 's'),
a AS (SELECT upper(action) AS k, min(unit) AS ua FROM em GROUP BY 1), s AS (SELECT shape AS k, count(DISTINCT unit) AS n FROM em GROUP BY 1),
att AS (SELECT sql_id, ua AS unit, CASE WHEN ua IS NOT NULL THEN 'action' WHEN n IS NOT NULL THEN 'shape' ELSE 'none' END AS signal,
CASE WHEN ua IS NOT NULL THEN 1 ELSE coalesce(n, 0) END AS n_candidates FROM log LEFT JOIN a ON a.k = upper(action) LEFT JOIN s ON s.k = shape)"""


def _attributed(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    log = ev.select(F.col("event_id").alias("sql_id"), F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).alias("action"), F.concat(F.lit("shape"), F.col("user_id") % 50).alias("shape"))
    no = F.when(F.col("event_type") == "click", "1").when(F.col("event_type") == "view", "2").otherwise("3")
    em = ev.filter("event_type < 's'").select(F.concat(F.lit("unit_"), "event_type").alias("unit"), F.col("event_type").alias("action"), F.concat(F.lit("shape"), no).alias("shape")).distinct()
    return measure.attribute_log(log, em)


@query(f"""WITH {_LOG}, c AS (SELECT shape AS k, string_agg(DISTINCT unit, ',' ORDER BY unit) AS units FROM em GROUP BY 1)
SELECT sql_id, ua AS unit, CASE WHEN ua IS NOT NULL THEN 'action' WHEN n IS NOT NULL THEN 'shape' ELSE 'none' END AS signal, CASE WHEN ua IS NOT NULL THEN 1 ELSE coalesce(n, 0) END AS n_candidates,
coalesce(ua, units, '') AS candidates FROM log LEFT JOIN a ON a.k = upper(action) LEFT JOIN s ON s.k = shape LEFT JOIN c ON c.k = shape""")
def measure_log_attribution(spark, sf_dir):
    return _attributed(spark, sf_dir).withColumn("candidates", F.array_join("candidates", ","))


@query(f"WITH {_LOG} SELECT signal, count(*) AS n, count(unit) AS n_exact, (SELECT count(*) FILTER (signal = 'action') / count(*) FROM att) AS rate FROM att GROUP BY 1")
def measure_recovery(spark, sf_dir):
    return measure.recovery_report(_attributed(spark, sf_dir))


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN EXISTS (SELECT 1 FROM labels WHERE doc_id = l_partkey AND quality = 1) THEN false WHEN l_linenumber = 7 THEN NULL ELSE true END AS unexercised FROM lineitem""")
def measure_witness(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    e = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("unit"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("line"))
    units = li.select(F.col("l_suppkey").alias("unit")).filter("unit % 4 <> 0")
    seen = li.join(table(spark, sf_dir, "labels").filter("quality = 1"), F.col("l_partkey") == F.col("doc_id"), "left_semi").select(F.col("l_suppkey").alias("unit"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("line"))
    hidden = li.filter("l_linenumber = 7").select(F.col("l_suppkey").alias("unit"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("line"))
    return measure.witness(e, units, seen, hidden)


@query("""WITH r AS (SELECT DISTINCT o_custkey AS name FROM orders), w AS (SELECT DISTINCT user_id AS name FROM events), t AS (SELECT c_custkey AS name FROM customer WHERE c_custkey % 2 = 0)
SELECT 'orphan_upstream' AS kind, name FROM ((SELECT * FROM r EXCEPT SELECT * FROM w) INTERSECT SELECT * FROM t) UNION ALL SELECT 'untouched', name FROM (SELECT * FROM t EXCEPT SELECT * FROM r EXCEPT SELECT * FROM w)
UNION ALL SELECT 'dangling', name FROM ((SELECT * FROM r UNION SELECT * FROM w) EXCEPT SELECT * FROM t)""")
def measure_coverage_statement(spark, sf_dir):
    o, ev, c = (table(spark, sf_dir, t) for t in ("orders", "events", "customer"))
    return measure.coverage_statement(o.select(F.col("o_custkey").alias("name")), ev.select(F.col("user_id").alias("name")), c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("name")))


@query("""WITH b AS (SELECT 'status' AS c, o_orderstatus AS v FROM orders UNION ALL SELECT 'customer', CAST(o_custkey AS VARCHAR) FROM orders),
a AS (SELECT 'status' AS c, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders UNION ALL SELECT 'customer', CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS VARCHAR) FROM orders),
u AS (SELECT c, v, -1 AS s FROM b WHERE v IS NOT NULL UNION ALL SELECT c, v, 1 FROM a WHERE v IS NOT NULL), p AS (SELECT c, v, sum(s) AS d, count(*) FILTER (s < 0) AS nb, count(*) FILTER (s > 0) AS na FROM u GROUP BY 1, 2)
SELECT c AS "column", CAST(sum(nb) AS BIGINT) AS n_before, CAST(sum(na) AS BIGINT) AS n_after, CAST(sum(abs(d)) AS BIGINT) AS n_changed FROM p GROUP BY 1""")
def evidence_changed_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    before = o.select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    after = o.select(F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("customer"))
    return measure.changed_columns(before, after, ["status", "customer"])


_COLUMNS = {"orders.o_custkey": ("orders", "o_custkey"), "customer.c_custkey": ("customer", "c_custkey"), "lineitem.l_suppkey": ("lineitem", "l_suppkey"), "supplier.s_suppkey": ("supplier", "s_suppkey"),
            "lineitem.l_partkey": ("lineitem", "l_partkey"), "part.p_partkey": ("part", "p_partkey"), "customer.c_nationkey": ("customer", "c_nationkey"), "nation.n_nationkey": ("nation", "n_nationkey")}
_INCLUDED = " UNION ALL ".join(
    f"SELECT '{a}' AS dependent, '{b}' AS referenced WHERE NOT EXISTS (SELECT 1 FROM {ta} WHERE {ca} IS NOT NULL AND {ca} NOT IN (SELECT {cb} FROM {tb} WHERE {cb} IS NOT NULL))" for a, (ta, ca) in _COLUMNS.items() for b, (tb, cb) in _COLUMNS.items() if a != b
)


@query(_INCLUDED)
def evidence_inclusion(spark, sf_dir):
    return measure.inclusion_dependencies({name: table(spark, sf_dir, t).select(c) for name, (t, c) in _COLUMNS.items()})


@query("""WITH e AS (SELECT DISTINCT o_custkey AS question, o_orderpriority AS citation FROM orders WHERE o_orderkey % 3 > 0), g AS (SELECT DISTINCT o_custkey AS question, o_orderpriority AS citation FROM orders WHERE o_orderkey % 3 < 2)
SELECT coalesce(e.question, g.question) AS question, count(*) FILTER (g.citation IS NULL) AS missing, count(*) FILTER (e.citation IS NULL) AS extra, count(*) FILTER (g.citation IS NULL) = 0 AND count(*) FILTER (e.citation IS NULL) = 0 AS correct
FROM e FULL JOIN g ON e.question = g.question AND e.citation = g.citation GROUP BY 1""")
def measure_answers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question"), F.col("o_orderpriority").alias("citation"), "o_orderkey")
    return measure.answer_score(o.filter("o_orderkey % 3 > 0").drop("o_orderkey"), o.filter("o_orderkey % 3 < 2").drop("o_orderkey"))


@query("""WITH f AS (SELECT l_partkey AS grp, l_returnflag AS relation, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS s FROM lineitem GROUP BY 1, 2)
SELECT grp, count(*) AS n_relations, count(DISTINCT s) = 1 AS agrees FROM f GROUP BY 1""")
def measure_metamorphic(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return measure.metamorphic(li.select(F.col("l_partkey").alias("grp"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("fact")))


@query("""SELECT doc_id AS name, sha256(text) AS sha256, len(string_split(text, chr(10))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*(--|#)'))) AS n_comment FROM documents""")
def evidence_manifest(spark, sf_dir):
    return measure.manifest(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), "text"))


# ---- ledgers and dataflow ----


@query("""WITH f AS (SELECT event_id AS id, user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events)
SELECT id, user_id, event_type FROM f WHERE valid_from <= TIMESTAMP '2024-01-20' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-20')""")
def ledger_as_of(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.col("ts").alias("valid_from"))
    return ledger.as_of(ledger.supersede(ev, ["user_id"]), F.lit("2024-01-20").cast("timestamp_ntz")).select("id", "user_id", "event_type")


@query("""WITH f AS (SELECT l_partkey AS source, l_suppkey AS target, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE CASE WHEN l_linestatus = 'F' THEN 2 ELSE 3 END END AS r FROM lineitem)
SELECT source, target, list_extract(['identity', 'derived', 'conditional', 'aggregated'], max(r) + 1) AS transform FROM f GROUP BY 1, 2""")
def ledger_hardest(spark, sf_dir):
    hard = F.when(F.col("l_linestatus") == "F", "conditional").otherwise("aggregated")
    kind = F.when(F.col("l_returnflag") == "A", "identity").when(F.col("l_returnflag") == "N", "derived").otherwise(hard)
    return ledger.hardest(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), kind.alias("transform")), ["source", "target"])


@query("""WITH s AS (SELECT o_orderstatus AS unit, o_orderkey * 10 AS line, o_orderkey * 10 + 4 AS end_line, o_orderpriority <> '5-LOW' AS valid FROM orders),
e AS (SELECT unit, s.line, count(*) AS n FROM s JOIN lineitem ON l_orderkey * 10 + l_linenumber BETWEEN s.line AND end_line AND l_orderkey * 10 = s.line WHERE l_returnflag = 'R' GROUP BY 1, 2),
r AS (SELECT DISTINCT unit, line FROM s JOIN lineitem ON l_orderkey * 10 + l_linenumber BETWEEN s.line AND end_line AND l_orderkey * 10 = s.line WHERE l_quantity > 45),
b AS (SELECT DISTINCT unit, line FROM s JOIN lineitem ON l_orderkey * 10 + l_linenumber BETWEEN s.line AND end_line AND l_orderkey * 10 = s.line WHERE l_tax = 0)
SELECT s.unit, s.line, CASE WHEN NOT valid THEN 'not_valid' WHEN e.n > 0 AND r.line IS NOT NULL THEN 'partial' WHEN e.n > 0 THEN 'column_level' WHEN r.line IS NOT NULL THEN 'refused' WHEN b.line IS NOT NULL THEN 'declared' ELSE 'nothing_to_trace' END AS status,
coalesce(e.n, 0) AS n_edges FROM s LEFT JOIN e USING (unit, line) LEFT JOIN r USING (unit, line) LEFT JOIN b USING (unit, line)""")
def ledger_statements(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    st = o.select(F.col("o_orderstatus").alias("unit"), (F.col("o_orderkey") * 10).alias("line"), (F.col("o_orderkey") * 10 + 4).alias("end_line"), (F.col("o_orderpriority") != "5-LOW").alias("valid"))
    li = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    at = lambda p: li.filter(p).select(F.col("o_orderstatus").alias("unit"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return ledger.statement_status(st, at("l_returnflag = 'R'"), at("l_quantity > 45"), at("l_tax = 0"))


@query("""WITH w AS (SELECT DISTINCT l_partkey AS relation, l_suppkey AS unit FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT DISTINCT l_partkey AS relation, l_suppkey AS unit FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity < 20)
SELECT relation, nw AS n_writers, nr AS n_readers FROM (SELECT relation, count(*) AS nw FROM w GROUP BY 1) JOIN (SELECT relation, count(*) AS nr, count(*) FILTER ((relation, unit) NOT IN (SELECT (relation, unit) FROM w)) AS nf FROM r GROUP BY 1) USING (relation) WHERE nw >= 2 OR nf > 0""")
def ledger_fusion_hazards(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pair = lambda p: li.filter(p).select(F.col("l_partkey").alias("relation"), F.col("l_suppkey").alias("unit"))
    return ledger.fusion_hazards(pair("l_returnflag = 'R'"), pair("l_returnflag <> 'R' AND l_quantity < 20"))


@query("""WITH RECURSIVE n AS (SELECT o_custkey AS unit, o_orderkey AS node, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS succ, o_orderpriority AS var FROM orders),
f AS (SELECT unit, node, succ FROM n WHERE succ IS NOT NULL UNION SELECT unit, max(node), min(node) FROM n WHERE unit % 3 = 0 GROUP BY unit), g AS (SELECT unit, node, var FROM n),
r(unit, node, var, def_node) AS (SELECT f.unit, f.succ, g.var, g.node FROM g JOIN f USING (unit, node)
UNION SELECT r.unit, f.succ, r.var, r.def_node FROM r JOIN f ON f.unit = r.unit AND f.node = r.node WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.unit = r.unit AND g.node = r.node AND g.var = r.var))
SELECT unit, node, var, def_node, true AS converged FROM r""")
def dataflow_reaching(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("var"))
    ahead = o.select("unit", "node", F.lead("node").over(Window.partitionBy("unit").orderBy("node")).alias("succ")).filter("succ IS NOT NULL")
    back = o.filter("unit % 3 = 0").groupBy("unit").agg(F.max("node").alias("node"), F.min("node").alias("succ"))
    return dataflow.reaching_definitions(ahead.unionByName(back), o)


@query("""WITH RECURSIVE s AS (SELECT a AS source, b AS target, min(r) AS rank FROM (SELECT 'n' || c_nationkey AS a, 'c' || c_custkey % 7 AS b, CAST(c_custkey % 4 AS INT) AS r FROM customer UNION ALL
SELECT 'c' || c_custkey % 7, 's' || c_nationkey % 5, CAST((c_custkey + 1) % 4 AS INT) FROM customer UNION ALL SELECT 's' || c_nationkey % 5, 'z' || c_custkey % 3, CAST(c_custkey % 3 AS INT) FROM customer) GROUP BY 1, 2),
p(source, target, rank) AS (SELECT source, target, rank FROM s UNION SELECT p.source, s.target, greatest(p.rank, s.rank) FROM p JOIN s ON s.source = p.target) SELECT source, target, min(rank) AS rank FROM p GROUP BY 1, 2""")
def dataflow_call_transforms(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    arm = lambda a, b, r: c.select(a.alias("source"), b.alias("target"), r.cast("int").alias("rank"))
    at = lambda x, key: F.concat(F.lit(x), key)
    steps = arm(at("n", n), at("c", k % 7), k % 4).unionByName(arm(at("c", k % 7), at("s", n % 5), (k + 1) % 4)).unionByName(arm(at("s", n % 5), at("z", k % 3), k % 3))
    return dataflow.call_transforms(steps)


@query(f"""WITH {_GRAPH}, u AS (SELECT source AS id, 0 AS i, 1 AS o FROM g UNION ALL SELECT target, 1, 0 FROM g)
SELECT id, CASE WHEN contains(id, '.') THEN 'Column' ELSE 'Relation' END AS label, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM u GROUP BY 1""")
def graph_nodes(spark, sf_dir):
    return facts_io.nodes(facts.graph(spark, sf_dir))


@query("""SELECT event_id, 'SELECT A FROM T WHERE K = ? AND TYPE = ? AND VALUE > ?' AS shape, CASE WHEN length(event_type) >= 8 THEN upper(event_type) END AS fragment FROM events""")
def text_shapes(spark, sf_dir):
    sql = F.format_string("select a -- event %d\nfrom t where k = %d and type = '%s' /* x */ and value > 1.5;", F.col("event_id"), F.col("user_id"), F.col("event_type"))
    df = table(spark, sf_dir, "events").select("event_id", sql.alias("sql"))
    return df.select("event_id", texts.statement_shape(F.col("sql")).alias("shape"), F.get(texts.literal_fragments(F.col("sql")), 0).alias("fragment"))


# ---- statements and where knowledge stops ----

_KNOWN = f"""st AS (SELECT 'st' || o_orderkey AS id, 'f' || o_custkey % 40 AS file, CAST(o_orderkey % 5 + 1 AS INT) AS line, CAST(o_orderkey % 5 + 3 AS INT) AS end_line, o_orderpriority AS kind,
list_extract(['column_level', 'no_lineage', 'refused', 'partial', 'effect', NULL], CAST(o_orderkey % 6 AS INT) + 1) AS status, 'why' || o_orderkey % 3 AS reason, o_orderkey AS k FROM orders),
touches AS (SELECT DISTINCT 'st' || l_orderkey AS statement, 'part' || l_partkey % 20 AS "table", CASE WHEN l_returnflag = 'R' THEN 'WRITES' ELSE 'READS' END AS mode FROM lineitem WHERE l_linenumber < 3 AND l_quantity < 40),
acts AS (SELECT 'act' || l_orderkey || '-' || l_linenumber AS id, list_extract(['RESETS', 'DROPS', 'ALTERS'], CAST(l_partkey % 3 AS INT) + 1) AS type, 'part' || l_partkey % 20 AS "table", l_linestatus AS detail,
'st' || l_orderkey AS statement FROM lineitem WHERE l_quantity > 49),
refused AS (SELECT 'rf' || k AS id, 'E' || k % 4 AS code, file, line, reason, id AS statement FROM st WHERE status = 'refused'),
mentions AS (SELECT DISTINCT 'rf' || l_orderkey AS refusal, 'st' || l_orderkey AS statement, 'part' || l_partkey % 20 AS "table" FROM lineitem WHERE l_quantity > 47),
files AS (SELECT 'f' || c_custkey AS file, 'select a' || chr(10) || 'from part' || c_custkey || ' -- qty' || chr(10) || 'where Qty > 1;' || chr(10) || 'update t set x = "qty" + my_qty' || chr(10) || 'where qty = 3; ' || chr(10) || 'delete from u' AS text FROM customer WHERE c_custkey < 40),
ed AS (SELECT g.*, 'st' || (length(source) * 7 + length(target)) AS statement, 'f' || length(source) % 40 AS file, CAST(length(target) % 5 + 1 AS INT) AS line FROM g)"""


def _statements(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.get(F.array(*(F.lit(x) for x in ("column_level", "no_lineage", "refused", "partial", "effect", None))), (k % 6).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("st"), k).alias("id"), F.concat(F.lit("f"), F.col("o_custkey") % 40).alias("file"), (k % 5 + 1).cast("int").alias("line"), (k % 5 + 3).cast("int").alias("end_line"),
        F.col("o_orderpriority").alias("kind"), status.alias("status"), F.concat(F.lit("why"), k % 3).alias("reason"), k.alias("k"),
    )


def _part_table():
    return F.concat(F.lit("part"), F.col("l_partkey") % 20).alias("table")


def _of(prefix: str):
    return F.concat(F.lit(prefix), "l_orderkey")


def _touches(spark, sf_dir):
    mode = F.when(F.col("l_returnflag") == "R", "WRITES").otherwise("READS")
    return table(spark, sf_dir, "lineitem").filter("l_linenumber < 3 AND l_quantity < 40").select(_of("st").alias("statement"), _part_table(), mode.alias("mode")).distinct()


def _acts(spark, sf_dir):
    kind = F.get(F.array(F.lit("RESETS"), F.lit("DROPS"), F.lit("ALTERS")), (F.col("l_partkey") % 3).cast("int"))
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 49")
    return li.select(F.concat(F.lit("act"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"), kind.alias("type"), _part_table(), F.col("l_linestatus").alias("detail"), _of("st").alias("statement"))


def _refused(spark, sf_dir):
    st = _statements(spark, sf_dir).filter("status = 'refused'")
    return st.select(F.concat(F.lit("rf"), "k").alias("id"), F.concat(F.lit("E"), F.col("k") % 4).alias("code"), "file", "line", "reason", F.col("id").alias("statement"))


def _mentions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_quantity > 47").select(_of("rf").alias("refusal"), _of("st").alias("statement"), _part_table()).distinct()


def _files(spark, sf_dir):
    text = F.concat(F.lit("select a\nfrom part"), "c_custkey", F.lit(' -- qty\nwhere Qty > 1;\nupdate t set x = "qty" + my_qty\nwhere qty = 3; \ndelete from u'))
    return table(spark, sf_dir, "customer").filter("c_custkey < 40").select(F.concat(F.lit("f"), "c_custkey").alias("file"), text.alias("text"))


def _stated(spark, sf_dir):
    n, m = F.length("source"), F.length("target")
    return facts.graph(spark, sf_dir).withColumns({"statement": F.concat(F.lit("st"), n * 7 + m), "file": F.concat(F.lit("f"), n % 40), "line": (m % 5 + 1).cast("int")})


def _names(spark, column, *values):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


@query(f"""WITH {_GRAPH}, {_KNOWN} SELECT id, type, "table", detail, statement FROM acts WHERE "table" IN ('part1', 'part7')""")
def graph_effects(spark, sf_dir):
    return knowledge.effects(_acts(spark, sf_dir), _names(spark, "table", "part1", "part7")).select("id", "type", "table", "detail", "statement")


_LOUD = """SELECT id, file, line, end_line, kind, status, reason FROM st WHERE status NOT IN ('column_level', 'no_lineage') AND file IN {files} AND (
id IN (SELECT statement FROM (SELECT statement, "table" FROM touches UNION ALL SELECT statement, "table" FROM acts UNION ALL SELECT statement, "table" FROM mentions) WHERE "table" IN {tables})
OR id NOT IN (SELECT statement FROM touches UNION ALL SELECT statement FROM acts))"""
_REFUSED = """SELECT id, code, file, line, reason, coalesce(tables, '') AS tables FROM refused LEFT JOIN
(SELECT refusal, string_agg("table", ',' ORDER BY "table") AS tables, count(*) FILTER ("table" IN {tables}) AS n FROM mentions GROUP BY 1) ON refusal = id WHERE file IN {files} AND (n > 0 OR tables IS NULL)"""


@query(f"WITH {_GRAPH}, {_KNOWN} " + _LOUD.format(files="('f1', 'f2', 'f3', 'f4')", tables="('part1', 'part7')"))
def graph_statements(spark, sf_dir):
    files, tables = _names(spark, "file", "f1", "f2", "f3", "f4"), _names(spark, "table", "part1", "part7")
    return knowledge.statements(_statements(spark, sf_dir), _touches(spark, sf_dir), _acts(spark, sf_dir), _mentions(spark, sf_dir), files, tables)


@query(f"WITH {_GRAPH}, {_KNOWN} " + _REFUSED.format(files="('f1', 'f2', 'f3', 'f4')", tables="('part1', 'part7')"))
def graph_refusals(spark, sf_dir):
    files, tables = _names(spark, "file", "f1", "f2", "f3", "f4"), _names(spark, "table", "part1", "part7")
    return knowledge.refusals(_refused(spark, sf_dir), _mentions(spark, sf_dir), files, tables)


@query(f"""WITH {_GRAPH}, {_KNOWN} SELECT id, type, source, target, ed.file, line, CASE WHEN text IS NOT NULL THEN array_to_string(list_slice(string_split(text, chr(10)), line, CASE WHEN line <= 3 THEN 3 WHEN line <= 5 THEN 5 ELSE 6 END), chr(10)) END AS sql
FROM ed LEFT JOIN files ON files.file = ed.file WHERE type = 'FEEDS'""")
def graph_explain_edge(spark, sf_dir):
    e = cut(_stated(spark, sf_dir), "graph-stated")
    return knowledge.explain_edges(e, _files(spark, sf_dir), e.filter("type = 'FEEDS'").select("id"))


_CHANGED = "nation1.1"


@query(f"""WITH {_GRAPH}, {_KNOWN}, ch AS (SELECT '{_CHANGED}' AS node), f AS (
SELECT statement, 'reads' AS why FROM ed WHERE type IN ('FEEDS', 'INFLUENCES', 'FILTERS') AND source IN (SELECT node FROM ch) UNION SELECT statement, 'writes' FROM ed WHERE type IN ('FEEDS', 'INFLUENCES') AND target IN (SELECT node FROM ch)
UNION SELECT statement, 'keys' FROM ed WHERE type = 'KEYS' AND source IN (SELECT node FROM ch) UNION SELECT statement, 'mentions' FROM ed WHERE type = 'MENTIONS_COL' AND source IN (SELECT node FROM ch) UNION SELECT statement, 'touches' FROM touches WHERE "table" = 'part1'),
p AS (SELECT statement, max(why = 'reads') AS a, max(why = 'writes') AS b, max(why = 'keys') AS c, max(why = 'mentions') AS d FROM f GROUP BY 1),
sh AS (SELECT statement, string_agg(DISTINCT "table", ',' ORDER BY "table") AS tables FROM touches WHERE mode = 'READS' AND "table" IN ('part3', 'part4') GROUP BY 1),
x AS (SELECT p.*, st.file, st.line, CASE WHEN text IS NULL THEN '' WHEN st.line <= 3 THEN '3' ELSE CASE st.line WHEN 4 THEN '4,5' ELSE '5' END END AS lines, tables FROM p JOIN st ON st.id = p.statement LEFT JOIN files ON files.file = st.file LEFT JOIN sh ON sh.statement = p.statement),
y AS (SELECT *, concat_ws(', ', CASE WHEN a THEN 'reads it' END, CASE WHEN b THEN 'writes it' END, CASE WHEN c THEN 'joins on it' END) AS told FROM x)
SELECT statement, file, line, CASE WHEN told <> '' THEN told WHEN d THEN 'mentioned by refused SQL' ELSE 'names it, without lineage' || coalesce('; the name is also a column of ' || tables, '') END AS reason, told = '' AS possible, lines
FROM y WHERE told <> '' OR d OR lines <> ''""")
def graph_edit_list(spark, sf_dir):
    changed = spark.createDataFrame([(_CHANGED, "qty")], "node string, name string")
    columns = spark.createDataFrame([("part1", "qty"), ("part3", "QTY"), ("part4", "qty"), ("part5", "other")], "table string, name string")
    return knowledge.edit_list(cut(_stated(spark, sf_dir), "graph-stated"), _touches(spark, sf_dir), columns, _statements(spark, sf_dir), _files(spark, sf_dir), changed, "part1")


@query(f"""WITH {_GRAPH}, {_KNOWN} SELECT statement, string_agg(DISTINCT "table", ',' ORDER BY "table") AS tables FROM touches WHERE mode = 'READS' AND "table" IN ('part3', 'part4') GROUP BY 1""")
def graph_shared_names(spark, sf_dir):
    columns = spark.createDataFrame([("part1", "qty"), ("part3", "QTY"), ("part4", "qty"), ("part5", "other")], "table string, name string")
    return knowledge.shared_names(_touches(spark, sf_dir), columns, _names(spark, "name", "Qty"), "part1")


_BOUNDS = """bounds AS (SELECT 'b' || n_nationkey AS id, 'remote' AS kind, n_name AS subject, 'st' || (n_nationkey * 11 + 100) AS statement, 'nation' || n_nationkey % 5 || '.' || n_nationkey AS node FROM nation)"""


@query(
    _walk_sql("SELECT 'region0.1' AS node", True, 15, _WALKED)
    + f""", {_KNOWN}, {_BOUNDS}, own AS (SELECT h.*, 'st' || (length(h.source) * 7 + length(h.target)) AS statement, 'f' || length(h.source) % 40 AS file FROM hops h),
nodes AS (SELECT 'region0.1' AS node UNION SELECT source FROM own), tables AS (SELECT DISTINCT {_REL.format("node")} AS t FROM (SELECT node FROM nodes UNION SELECT target FROM own))
SELECT 'boundary' AS what, id, statement AS about FROM bounds WHERE statement IN (SELECT statement FROM own) UNION SELECT 'boundary', id, NULL FROM bounds WHERE node IN (SELECT node FROM nodes)
UNION SELECT 'unverified', id, target FROM own WHERE type IN ('MENTIONS_COL', 'OPAQUE') UNION SELECT 'effect', id, "table" FROM acts WHERE "table" IN (SELECT t FROM tables)
UNION SELECT 'refusal', id, file FROM ("""
    + _REFUSED.format(files="(SELECT file FROM own)", tables="(SELECT t FROM tables)")
    + ") UNION SELECT 'statement', id, status FROM ("
    + _LOUD.format(files="(SELECT file FROM own)", tables="(SELECT t FROM tables)")
    + ")"
)
def graph_gaps(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    bounds = n.select(F.concat(F.lit("b"), k).alias("id"), F.lit("remote").alias("kind"), F.col("n_name").alias("subject"), F.concat(F.lit("st"), k * 11 + 100).alias("statement"), facts.name("nation", k % 5, k).alias("node"))
    mentions = _mentions(spark, sf_dir)
    return knowledge.gaps(cut(_stated(spark, sf_dir), "graph-stated"), "region0.1", bounds, _refused(spark, sf_dir), mentions, _acts(spark, sf_dir), _statements(spark, sf_dir), _touches(spark, sf_dir), mentions)


# ---- more measurement ----


@query("""WITH e AS (SELECT DISTINCT p_brand AS kind, upper(p_type) AS s FROM part WHERE p_size < 30), d AS (SELECT DISTINCT p_brand AS kind, upper(p_type) AS s FROM part WHERE p_size > 20)
SELECT coalesce(e.kind, d.kind) AS kind, count(*) FILTER (e.s IS NOT NULL AND d.s IS NOT NULL) AS declared_n, count(*) FILTER (d.s IS NULL) AS missing, count(*) FILTER (e.s IS NULL) AS unexpected FROM e FULL JOIN d ON e.kind = d.kind AND e.s = d.s GROUP BY 1""")
def measure_boundaries(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return measure.boundary_score(p.filter("p_size < 30").select(F.col("p_brand").alias("kind"), F.lower("p_type").alias("subject")), p.filter("p_size > 20").select(F.col("p_brand").alias("kind"), F.col("p_type").alias("subject")))


@query("""WITH m AS (SELECT 'value precision' AS c, count(*) FILTER (l_discount < 0.1) / count(*) AS v FROM lineitem UNION ALL SELECT 'value recall', count(*) FILTER (l_tax > 0) / count(*) FROM lineitem UNION ALL SELECT 'weak evidence', count(*) FILTER (l_returnflag = 'R') / count(*) FROM lineitem UNION ALL SELECT 'dynamic statements', count(*) FILTER (l_linenumber = 1) / count(*) FROM lineitem UNION ALL SELECT 'edges from refused statements', count(*) FILTER (l_quantity > 1e6) FROM lineitem)
SELECT g.c AS criterion, m.v AS value, CASE WHEN m.v IS NULL THEN 'PENDING' WHEN (g.least AND m.v >= g.b) OR (NOT g.least AND m.v <= g.b) THEN 'PASS' ELSE 'TRIGGERED' END AS verdict
FROM (VALUES ('value precision', true, 0.95), ('value recall', true, 0.85), ('parse coverage', true, 0.7), ('edges from refused statements', false, 0), ('weak evidence', false, 0.7), ('dynamic statements', false, 0.3), ('summaries without end', false, 0)) g(c, least, b) LEFT JOIN m ON m.c = g.c""")
def measure_kill_criteria(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    share = lambda name, p: li.agg((F.count(F.when(F.expr(p), 1)) / F.count("*")).alias("value")).select(F.lit(name).alias("criterion"), "value")
    none = li.agg(F.count(F.when(F.col("l_quantity") > 1e6, 1)).cast("double").alias("value")).select(F.lit("edges from refused statements").alias("criterion"), "value")
    return measure.kill_criteria(share("value precision", "l_discount < 0.1").unionByName(share("value recall", "l_tax > 0")).unionByName(share("weak evidence", "l_returnflag = 'R'")).unionByName(share("dynamic statements", "l_linenumber = 1")).unionByName(none), (*measure.GATES, *measure.MORE_GATES))


@query("""WITH s AS (SELECT o_orderstatus AS unit, o_orderkey * 10 AS first FROM orders), f AS (SELECT o_orderstatus AS unit, l_orderkey * 10 AS first, l_linenumber AS n, l_returnflag AS r, l_quantity AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <= 4)
SELECT unit, first, count(*) FILTER (r = 'A') AS n_missed, count(*) FILTER (r = 'R') AS n_spurious, count(*) FILTER (q > 45) AS n_forbidden FROM s JOIN f USING (unit, first) WHERE r IN ('A', 'R') OR q > 45 GROUP BY 1, 2""")
def measure_triage(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    spans = o.select(F.col("o_orderstatus").alias("unit"), (F.col("o_orderkey") * 10).alias("first"), (F.col("o_orderkey") * 10 + 4).alias("last"))
    li = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    at = lambda p: li.filter(p).select(F.col("o_orderstatus").alias("unit"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return measure.triage(spans, at("l_returnflag = 'A'"), at("l_returnflag = 'R'"), at("l_quantity > 45"))


@query("""WITH e AS (SELECT DISTINCT lower(l_returnflag) AS heading, l_partkey AS t, l_suppkey AS s FROM lineitem), r AS (SELECT DISTINCT l_partkey AS t, l_suppkey AS s FROM lineitem WHERE l_linestatus = 'F')
SELECT heading, count(*) AS n, count(r.t) AS n_found, count(r.t) / count(*) AS recall FROM e LEFT JOIN r ON e.t = r.t AND e.s = r.s GROUP BY 1""")
def measure_holdout(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    t, s = F.concat(F.lit("T.p"), "l_partkey").alias("target"), F.concat(F.lit("s"), "l_suppkey").alias("source")
    return measure.holdout_recall(li.select(t, s, F.lower("l_returnflag").alias("heading")), li.filter("l_linestatus = 'F'").select(F.lower(t).alias("target"), F.upper(s).alias("source")))


@query("""SELECT DISTINCT o_custkey AS question, o_orderpriority AS id FROM orders WHERE (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderstatus = 'F')""")
def measure_ungrounded(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question"), F.col("o_orderpriority").alias("id"), "o_orderstatus")
    return measure.ungrounded(o.drop("o_orderstatus"), o.filter("o_orderstatus = 'F'"))


@query("""WITH n AS (SELECT DISTINCT 't' || p_size || '.' || p_type AS node, p_type AS name FROM part WHERE NOT contains(p_type, '.')) SELECT name, count(*) AS n, string_agg(node, ',' ORDER BY node) AS nodes FROM n GROUP BY 1 HAVING count(*) > 1""")
def measure_ambiguous(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter(~F.contains("p_type", F.lit(".")))
    return measure.ambiguous(p.select(F.col("p_type").alias("name")), p.select(F.concat(F.lit("t"), "p_size", F.lit("."), "p_type").alias("node")))


@query("""SELECT o_custkey AS question, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS statements FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000) GROUP BY 1""")
def measure_coverage_gate(spark, sf_dir):
    cited = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("id"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").cast("string").alias("statement"))
    return measure.coverage_gate(cited, edges, table(spark, sf_dir, "supplier").filter("s_acctbal < 1000").select(F.col("s_suppkey").cast("string").alias("statement")))


_FLOW = """n AS (SELECT o_custkey AS unit, o_orderkey AS node, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS succ, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS skip, o_orderpriority AS var, o_orderstatus AS st FROM orders),
f AS (SELECT unit, node, succ FROM n WHERE succ IS NOT NULL UNION SELECT unit, node, skip FROM n WHERE skip IS NOT NULL AND node % 4 = 0), g AS (SELECT unit, node, var FROM n WHERE st <> 'O'),
u(unit, node, var) AS (SELECT unit, e, var FROM g JOIN (SELECT unit, min(node) AS e FROM n GROUP BY 1) USING (unit)
UNION SELECT u.unit, f.succ, u.var FROM u JOIN f ON f.unit = u.unit AND f.node = u.node WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.unit = u.unit AND g.node = u.node AND g.var = u.var))"""


def _flow(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("var"), "o_orderstatus")
    by = Window.partitionBy("unit").orderBy("node")
    flow = o.select("unit", "node", F.lead("node").over(by).alias("succ"), F.lead("node", 2).over(by).alias("skip"))
    flow = flow.filter("succ IS NOT NULL").select("unit", "node", "succ").unionByName(flow.filter("skip IS NOT NULL AND node % 4 = 0").select("unit", "node", F.col("skip").alias("succ"))).distinct()
    return o, cut(flow, "flow"), o.groupBy("unit").agg(F.min("node").alias("node")), o.filter("o_orderstatus <> 'O'").select("unit", "node", "var")


@query(f"WITH RECURSIVE {_FLOW} SELECT * FROM u")
def dataflow_maybe_unassigned(spark, sf_dir):
    _, flow, entry, gen = _flow(spark, sf_dir)
    return dataflow.maybe_unassigned(flow, entry, gen)


@query(f"""WITH RECURSIVE {_FLOW}, r(unit, node, var, d) AS (SELECT f.unit, f.succ, g.var, g.node FROM g JOIN f USING (unit, node)
UNION SELECT r.unit, f.succ, r.var, r.d FROM r JOIN f ON f.unit = r.unit AND f.node = r.node WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.unit = r.unit AND g.node = r.node AND g.var = r.var)),
x AS (SELECT unit, node, var, (unit, node, var) IN (SELECT (unit, node, var) FROM r) AS found, (unit, node, var) IN (SELECT (unit, node, var) FROM u) AS open FROM n WHERE var <> '5-LOW')
SELECT unit, node, var, found AS partial FROM x WHERE NOT found OR open""")
def dataflow_uninitialised(spark, sf_dir):
    o, flow, entry, gen = _flow(spark, sf_dir)
    parameters = o.select("unit").distinct().withColumn("var", F.lit("5-LOW"))
    return dataflow.uninitialised_uses(flow, entry, gen, o.select("unit", "node", "var"), parameters)


@query(f"""WITH RECURSIVE {_GRAPH}, p AS (SELECT DISTINCT source FROM g WHERE type = 'FEEDS' AND source LIKE 'customer%'), q AS (SELECT p.source, 'region0.' || r_regionkey AS target FROM p, region),
w(source, node, hops) AS (SELECT source, source, 0 FROM p UNION SELECT w.source, g.target, w.hops + 1 FROM w JOIN g ON g.source = w.node AND g.type IN ('FEEDS', 'INFLUENCES') WHERE w.hops < 20)
SELECT q.source, q.target, min(w.hops) AS hops FROM q LEFT JOIN w ON w.source = q.source AND w.node = q.target GROUP BY 1, 2""")
def graph_reachable(spark, sf_dir):
    g = cut(facts.graph(spark, sf_dir), "graph")
    ends = table(spark, sf_dir, "region").select(F.concat(F.lit("region0."), "r_regionkey").alias("target"))
    pairs = g.filter("type = 'FEEDS' AND source LIKE 'customer%'").select("source").distinct().join(F.broadcast(ends), F.lit(True))  # each customer to the regions
    return graph.reachable(g, pairs)


@query(f"""WITH {_GRAPH}, n(o, w) AS (VALUES ('supplier0', 'vendor'), ('nation2', 'country.x')), r AS (SELECT type,
CASE WHEN a.w IS NOT NULL THEN a.w || substr(source, length(a.o) + 1) ELSE source END AS source, CASE WHEN b.w IS NOT NULL THEN b.w || substr(target, length(b.o) + 1) ELSE target END AS target
FROM g LEFT JOIN n a ON a.o = {_REL.format("source")} LEFT JOIN n b ON b.o = {_REL.format("target")}) SELECT * FROM r""")
def graph_renamed(spark, sf_dir):
    names = spark.createDataFrame([("supplier0", "vendor"), ("nation2", "country.x")], "old string, new string")
    return graph.renamed(facts.graph(spark, sf_dir), names).select("type", "source", "target")


@query(f"WITH {_GRAPH} SELECT type, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets, min(id) AS first, max(id) AS last, {_DIGEST} AS digest FROM (SELECT *, md5({_EDGE_TEXT}) AS h FROM g) GROUP BY 1")
def graph_snapshot(spark, sf_dir):
    return graph.snapshot(facts.graph(spark, sf_dir))


@query(f"""WITH {_GRAPH}, {_KNOWN} SELECT id, type, source, target FROM ed WHERE file IN ('f3', 'f12')""")
def graph_file_edges(spark, sf_dir):
    return _stated(spark, sf_dir).join(_names(spark, "file", "f3", "f12"), "file", "left_semi").select("id", "type", "source", "target")


@query(f"""WITH {_GRAPH}, {_KNOWN} SELECT statement, coalesce(string_agg(DISTINCT "table", ',' ORDER BY "table") FILTER (mode = 'READS'), '') AS reads, coalesce(string_agg(DISTINCT "table", ',' ORDER BY "table") FILTER (mode = 'WRITES'), '') AS writes FROM touches GROUP BY 1""")
def graph_statement_tables(spark, sf_dir):
    return knowledge.statement_tables(_touches(spark, sf_dir))


@query(f"""WITH {_GRAPH}, {_KNOWN} SELECT id, CAST(greatest(line - 1, 1) AS INT) AS first, array_to_string(list_slice(string_split(text, chr(10)), greatest(line - 1, 1), line + 1), chr(10)) AS lines FROM ed JOIN files ON files.file = ed.file""")
def graph_edge_context(spark, sf_dir):
    return knowledge.edge_context(_stated(spark, sf_dir), _files(spark, sf_dir))


@query(f"""WITH {_GRAPH}, {_KNOWN}, p AS (SELECT file, coalesce(status, 'unclassified') AS status, count(*) AS n FROM st GROUP BY 1, 2) SELECT *, n / sum(n) OVER (PARTITION BY file) AS share FROM p""")
def ledger_summary(spark, sf_dir):
    return ledger.summary(_statements(spark, sf_dir))


@query("""WITH s AS (SELECT CAST(o_orderkey % 3 AS INT) AS band, o_orderstatus AS flow, avg(CASE WHEN o_totalprice > 20000 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN o_custkey % 10 > 0 THEN 1.0 ELSE 0.0 END) AS r FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
t(band, flow) AS (SELECT * FROM (VALUES (0), (1), (2)), (VALUES ('F'), ('O'), ('P')))
SELECT t.band, t.flow, s.p >= 0.9 AND s.r >= 0.91 AS met FROM t LEFT JOIN s ON s.band = t.band AND s.flow = t.flow""")
def measure_targets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    s = o.groupBy((F.col("o_orderkey") % 3).cast("int").alias("band"), F.col("o_orderstatus").alias("flow")).agg(share(F.col("o_totalprice") > 20000).alias("precision"), share(F.col("o_custkey") % 10 > 0).alias("recall"))
    t = spark.createDataFrame([(b, f, 0.9, 0.91) for b in range(3) for f in "FOP"], "band int, flow string, precision double, recall double")
    return measure.met_targets(s, t)


@query("""SELECT 'SELECT * FROM ' || upper(event_type) || ' WHERE K = ?' AS shape, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE length('SELECT * FROM ' || event_type || ' WHERE K = ?') >= 24 GROUP BY event_type HAVING count(*) > 1""")
def measure_spellings(spark, sf_dir):
    sql = F.format_string("select *  from %s -- %d\nwhere k = %d;", F.col("event_type"), F.col("event_id"), F.col("user_id"))
    return measure.equal_spellings(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), sql.alias("text")), texts.statement_shape)
