"""Rows that steps make as groups and starts grow, and results at the edges of groups."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from seamark.operators import builds, calls, control_flow, dataflow, facts, graph, hierarchy, intervals, measure, relational, search, views


def kept(monkeypatch, module, prefixes):
    """The rows of all tables that a module writes under these names, counted as they are written."""
    counts, cut = dict.fromkeys(prefixes, 0), module.cut

    def counting(df, name, *more):
        out = cut(df, name, *more)
        if name in counts:
            counts[name] += out.count()
        return out

    monkeypatch.setattr(module, "cut", counting)
    return counts


def hub(spark, starts, columns):
    """Starts that filter a hidden table of so many columns, all of which feed one visible column."""
    e = [(f"f{i}", "FILTERS", f"s.{i}", "h", "f", 1) for i in range(starts)] + [(f"o{i}", "FEEDS", f"h.{i}", "t.x", "f", 2) for i in range(columns)]
    return spark.createDataFrame(e, "id string, type string, source string, target string, file string, line int"), spark.createDataFrame([("h",)], "relation string")


def test_collapse_walks_once_for_all_starts(spark, monkeypatch):
    counts = kept(monkeypatch, graph, ["collapse-steps", "collapse-round"])
    edges, hidden = hub(spark, 40, 30)
    got = {tuple(r) for r in graph.collapse(edges, hidden).collect()}
    assert got == {(f"s.{i}", "t", "FILTERS", "identity", True) for i in range(40)}
    # One step for each column and one for the table; one entry, one end.
    assert counts == {"collapse-steps": 31, "collapse-round": 1}
    assert [r["columns"].count(",") for r in graph.collapse_notes(edges, hidden).collect()] == [29]


def test_collapse_passed_walks_once_for_all_starts(spark, monkeypatch):
    counts = kept(monkeypatch, graph, ["passed-steps", "passed-items"])
    got = {tuple(r) for r in graph.collapse_passed(*hub(spark, 40, 30)).collect()}
    assert got == {(f"s.{i}", "t", "FILTERS", *x) for i in range(40) for x in (("via", "h"), ("where", "f:1"), ("where", "f:2"))}
    assert counts == {"passed-steps": 31, "passed-items": 2}


def test_collapse_passed_makes_rows_of_equal_entries_distinct_once(spark, monkeypatch):
    """Starts that enter the same relations share their rows; what a start passes by a column too is told once, repeated edges as well."""
    counts = kept(monkeypatch, graph, ["passed-shared", "passed-sets"])
    edges, hidden = hub(spark, 40, 30)
    more = [("x1", "FEEDS", "s.1", "h.1", "f", 1), ("x2", "FEEDS", "s.1", "h.1", "f", 1), ("x3", "FILTERS", "h.1", "t.x", "f", 2), ("x4", "FEEDS", "z.1", "h.2", "f", 9), ("x5", "KEYS", "z.1", None, "f", 9)]
    edges = edges.unionByName(spark.createDataFrame(more, edges.schema)).unionByName(edges.limit(20))
    rows = [tuple(r) for r in graph.collapse_passed(edges, hidden).collect()]
    want = {(f"s.{i}", to, "FILTERS", *x) for i in range(40) for to in ("t", "t.x") for x in (("via", "h"), ("where", "f:1"), ("where", "f:2"))}
    want |= {("s.1", "t.x", "FILTERS", "via", "h.1"), ("s.1", "t.x", "FEEDS", "via", "h.1"), ("z.1", "t.x", "FEEDS", "via", "h.2")}
    want |= {("s.1", "t.x", "FEEDS", "where", w) for w in ("f:1", "f:2")} | {("z.1", "t.x", "FEEDS", "where", w) for w in ("f:2", "f:9")}
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert counts == {"passed-shared": 6, "passed-sets": 40}


def test_null_aware_anti_is_a_plain_join(spark):
    def run(parts, lines):
        t = SimpleNamespace(spark=spark, part=spark.createDataFrame([(p,) for p in parts], "p_partkey int"), lineitem=spark.createDataFrame(lines, "l_quantity int, l_partkey int"))
        df = relational.join_null_aware_anti(t)
        assert "LeftAnti, BuildRight, true" not in df._jdf.queryExecution().executedPlan().toString()
        return sorted((r.p_partkey for r in df.collect()), key=repr)

    assert run([1, 2, None], [(11, 1), (5, 9)]) == [2]
    assert run([1, 2, None], [(11, 1), (11, None)]) == []
    assert run([1, 2, None], [(5, None)]) == [1, 2]
    assert run([1, 2, None], []) == [1, 2, None]


def test_a_unit_that_calls_itself_between_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3), (3, 4), (4, 6), (6, 5), (5, 6)], "source int, target int")
    assert sorted(map(tuple, calls.recursive_groups(e).collect())) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (5, 5, 2), (6, 5, 2)]


def test_log_attribution_tells_the_candidates_of_a_shape(spark):
    log = spark.createDataFrame([(1, "JOB", "s1"), (2, None, "s1"), (3, None, "s2"), (4, None, "s9")], "sql_id int, action string, shape string")
    em = spark.createDataFrame([("b", "job", "s1"), ("a", None, "s1"), ("c", None, "s2")], "unit string, action string, shape string")
    got = sorted((r.sql_id, r.unit, r.signal, r.candidates) for r in measure.attribute_log(log, em).collect())
    assert got == [(1, "b", "action", ["b"]), (2, None, "shape", ["a", "b"]), (3, None, "shape", ["c"]), (4, None, "none", [])]


def test_recursions_send_no_table_to_the_driver(spark, monkeypatch):
    plans, add, cut = [], hierarchy.Grown.add, views.cut
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(hierarchy.Grown, "add", lambda self, df: (plan(df), add(self, df))[1])
    k = spark.range(1, 9).select("id")
    assert hierarchy.traverse(k.filter("id > 1").selectExpr("id AS parent", "id DIV 2 AS child"), k).count() == 21
    monkeypatch.setattr(views, "cut", lambda df, name: (plan(df), cut(df, name))[1])
    assert views.bases(k.selectExpr("concat('v.', id) AS name", "concat('v.', id + 1) AS base")).filter("hops = 8").count() == 1
    assert len(plans) > 6 and not any("Broadcast" in p for p in plans)


def test_dataflow_rounds_move_only_what_is_new(spark, monkeypatch):
    """Along nodes with one way in, a round reads the last part and the two tables laid out once; a definition without a name ends in a loop."""
    leaves, add = [], dataflow.Grown.add

    def told(self, df):
        found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        leaves.append(sorted(found.apply(i).getClass().getSimpleName() for i in range(found.size())))
        return add(self, df)

    monkeypatch.setattr(dataflow.Grown, "add", told)
    flow = spark.createDataFrame([("u", i, (i + 1) % 6) for i in range(6)], "unit string, node int, succ int")
    gen = spark.createDataFrame([("u", 0, "x"), ("u", 3, "y")], "unit string, node int, var string")
    assert dataflow.reaching_definitions(flow, gen).count() == 12
    assert len(leaves) == 7 and all(x == ["InMemoryRelation", "InMemoryRelation", "LogicalRelation"] for x in leaves[1:])
    assert dataflow.reaching_definitions(flow, gen.selectExpr("unit", "node", "nullif(var, 'y') AS var")).count() == 12


def test_score_deals_facts_once(spark):
    """No side is joined to the other: facts are dealt by their match key, and pairs form inside a key, equal guards first."""
    cols = "source string, target string, flow string, transform string, phase string, guard string, band int"
    t = spark.createDataFrame([("a", "b", "value", "identity", None, g, n) for g, n in ((None, 0), ("x", 1), ("y", 2), ("y", 0))] + [("a", None, "value", None, None, None, 1)], cols)
    p = spark.createDataFrame([("a", "b", "value", "identity", None, g, n) for g, n in (("y", 1), ("z", 0), ("z", 0), ("x", 1))] + [("a", None, "value", None, None, None, 2), ("c", "b", "value", "identity", "pre", None, 2)], cols)
    df = measure.score(t, p)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    # y at 0 and x at 1 pair by guard, as does the fact without a target; of what is left, 0 pairs in order, 2 is missed.
    assert sorted(tuple(r)[:5] for r in df.collect()) == [(0, "value", 2, 0, 0), (1, "value", 2, 0, 0), (2, "value", 0, 1, 1)]


def test_join_using_counts_before_it_joins(spark):
    t = SimpleNamespace(customer=spark.createDataFrame([(x,) for x in (1, 1, 1, 2, None)], "c_nationkey int"), supplier=spark.createDataFrame([(x,) for x in (1, 1, 3, None)], "s_nationkey int"))
    df = relational.join_using(t)
    assert df.collect() == [(1, 6)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate") and plan.count("Aggregate") == 2


def test_index_of_the_terms_asked(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (2, "c a"), (3, None)], "doc_id int, text string")
    asked = spark.createDataFrame([("a",), ("a",), ("z",)], "term string")
    got = sorted(map(tuple, search.index(docs, only=asked).collect()))
    assert got == [("a", 1, [0, 2], 3), ("a", 2, [1], 2)] == sorted(tuple(r) for r in search.index(docs).filter("term = 'a'").collect())


def test_components_keep_hubs_where_they_lie(spark, monkeypatch):
    """Rows of a node with many neighbours are joined without an exchange by that node."""
    plans, cut = [], graph.cut
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(graph, "cut", lambda df, name, *more: (plans.append(plan(df)) if name == "components-large" else None, cut(df, name, *more))[1])
    monkeypatch.setattr(graph, "HUB", 8, raising=False)
    e = spark.createDataFrame([(f"n{i:02}", f"h{i % 3}") for i in range(60)] + [("h0", "h1"), ("x", "y"), ("y", "z"), ("z", "z"), ("w", "w")], "source string, target string")
    got = {r.node: r.component for r in graph.components(e).collect()}
    assert got == {**{f"n{i:02}": "h0" if i % 3 < 2 else "h2" for i in range(60)}, "h0": "h0", "h1": "h0", "h2": "h2", "x": "x", "y": "x", "z": "x", "w": "w"}
    assert plans and all("strategy=broadcast" in p and "LeftAnti" in p for p in plans)


def test_graph_is_made_distinct_as_numbers(spark, tmp_path):
    """No name goes through an exchange; a null key has no type and no name."""
    def write(name, columns, rows):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")

    write("nation", "n_nationkey int, n_regionkey int", [(1, 0), (1, 0)])
    write("customer", "c_custkey long, c_nationkey int", [(2, 6), (2, 1), (3, 7), (3, 7), (None, 8), (None, 8)])
    write("supplier", "s_suppkey long, s_nationkey int", [(None, 8)])
    write("orders", "o_orderkey long, o_custkey long", [(31, 12)])
    write("lineitem", "l_orderkey long, l_partkey long, l_suppkey long", [(1, 21, 4), (9, 21, 4)])
    g = facts.graph(spark, str(tmp_path))
    assert sorted((tuple(r) for r in g.collect()), key=repr) == sorted([
        ("INFLUENCES|nation1.1|region0.0", "INFLUENCES", "nation1.1", "region0.0"),
        ("FILTERS|customer2.2|nation1", "FILTERS", "customer2.2", "nation1"),
        ("FEEDS|customer3.3|nation2.7", "FEEDS", "customer3.3", "nation2.7"),
        ("nation3.8", None, None, "nation3.8"),
        ("OPAQUE|orders1.31|customer2", "OPAQUE", "orders1.31", "customer2"),
        ("MENTIONS_COL|part1.21|supplier1.4", "MENTIONS_COL", "part1.21", "supplier1.4"),
    ], key=repr)
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert "concat" not in plan[plan.index("Union") :]


def test_walk_moves_hashes_to_tell_edges_of_one_id(spark, monkeypatch):
    """Edges that are there once are neither grouped ahead of a walk nor after it."""
    plans, cut = [], graph.cut
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(graph, "cut", lambda df, name: (plans.append(plan(df)), cut(df, name))[1])
    rows = [(f"e{i}", "FEEDS", f"a.{i}", f"a.{i + 1}") for i in range(5)] + [("f", "FILTERS", "a.2", "b"), ("o", "OPAQUE", "a", "b.1"), ("m", "MENTIONS_COL", "a.9", "a")]
    e, start = spark.createDataFrame(rows, "id string, type string, source string, target string"), spark.createDataFrame([("a.0",)], "node string")
    got = {r.id: r.depth for r in graph.walk(e, start, False, 9).collect()}
    assert got == {"e0": 1, "o": 1, "e1": 2, "e2": 3, "f": 3, "e3": 4, "e4": 5}
    assert not any("first(" in p for p in plans) and len(plans) == 2
    back = spark.createDataFrame([("a.5",)], "node string")
    one = {r.id: r.depth for r in graph.walk(e, back, True, 9).collect()}
    assert one == {"e4": 1, "m": 1, "e3": 2, "e2": 3, "e1": 4, "e0": 5}
    twice = graph.walk(e.unionByName(e), back, True, 9)
    assert twice.count() == 6 and {r.id: r.depth for r in twice.collect()} == one


def test_few_spans_of_a_group_are_not_taken_apart(spark, monkeypatch):
    """Only a group of many spans meets its points by blocks; pairs are those of a plain loop."""
    counts = kept(monkeypatch, intervals, ["span-blocks"])
    spans = [(i, u, i % 5, i % 5 + n) for i, (u, n) in enumerate([("a", 1_000_000), ("a", 0), ("a", -1), (None, 3), *[("b", i % 3) for i in range(17)]])] + [(99, "a", 1, None), (98, "c", None, 4)]
    points = [(i, u, n) for i, (u, n) in enumerate((u, n) for u in ("a", "b", "c", None) for n in (*range(7), 700_000, None))]
    s = spark.createDataFrame(spans, "id int, unit string, line long, end_line long")
    got = intervals.holding(spark.createDataFrame(points, "id int, unit string, line long"), s).select("point.id", F.col("span.id").alias("span")).collect()
    hold = lambda p, s: None not in (p[2], s[2], s[3]) and p[1] == s[1] and s[2] <= p[2] <= s[3]
    assert sorted(map(tuple, got)) == sorted((p[0], s[0]) for p in points for s in spans if hold(p, s))
    assert 0 < counts["span-blocks"] <= 34


def test_diff_sums_only_keys_that_occur_again(spark):
    cols = "id string, x int, y string"
    old = spark.createDataFrame([("a", 1, None), ("b", 1, "u"), ("c", None, "u"), ("d", 4, "v")], cols)
    new = spark.createDataFrame([("a", 1, None), ("b", 2, "w"), ("c", 0, "u"), ("e", 4, "v"), (None, 1, "z")], cols)
    told = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    df = builds.diff(old, new)
    want = [("b", "changed", ["x", "y"]), ("c", "changed", ["x"]), ("d", "gone", []), ("e", "added", []), (None, "added", [])]
    assert told(df) == sorted(want, key=repr) and "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
    more = spark.createDataFrame([("m", 1, "p"), ("m", 1, "p"), ("m", 2, "q"), ("n", 1, "p"), (None, 1, "z"), (None, 1, "z")], cols)
    less = spark.createDataFrame([("m", 2, "q"), ("m", 1, "p"), ("m", 1, "p"), ("n", 1, "p"), ("n", 1, "p"), (None, 1, "z")], cols)
    want = [*want[:4], ("n", "changed", []), (None, "changed", [])]
    assert told(builds.diff(old.unionByName(more), new.filter("id IS NOT NULL").unionByName(less))) == sorted(want, key=repr)


def test_rounds_of_guards_move_no_edges_again(spark, monkeypatch):
    """Each round joins the edges, and the labels that may go, as they were laid out, and not by an exchange of their own."""
    plans, add = [], control_flow.Grown.add

    def adding(self, df):
        if self.parts and "first" not in self.path:
            plans.append((self.path, df._jdf.queryExecution().executedPlan().toString()))
        return add(self, df)

    monkeypatch.setattr(control_flow.Grown, "add", adding)
    # A way of seven steps under one condition, and a longer way past it to the third node.
    flow = [(1, i, i + 1, "a" if i == 0 else None) for i in range(7)] + [(1, a, b, None) for a, b in ((0, 10), (10, 11), (11, 12), (12, 2))]
    got = control_flow.guards(spark.createDataFrame(flow, "unit int, node int, succ int, label string"), spark.createDataFrame([(1, 0)], "unit int, node int"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a")]
    assert {p.rsplit("/", 1)[1][:12] for p, _ in plans} == {"guards-reach", "guards-gone-"}
    assert all("InMemoryTableScan" in plan for _, plan in plans)


def test_walk_tells_edges_at_a_table_once(spark, monkeypatch):
    """Later nodes of a table that was met tell none of its edges again; edges of unique ids are written as they come."""
    names, rows, cut, add = [], [], graph.cut, graph.Grown.add
    monkeypatch.setattr(graph, "cut", lambda df, name: (names.append(name), cut(df, name))[1])

    def adding(self, df):
        part = add(self, df)
        if "walk-edges" in self.path:
            rows.extend(r.id for r in part.collect())
        return part

    monkeypatch.setattr(graph.Grown, "add", adding)
    edges = [(f"e{i}", "FEEDS", f"a.{i}", f"a.{i + 1}") for i in range(4)] + [("f", "FILTERS", "x.1", "a"), ("o", "OPAQUE", "x.2", "a"), ("p", "OPAQUE", "a", "y.1")]
    e = spark.createDataFrame(edges, "id string, type string, source string, target string")
    up = graph.upstream(e, spark.createDataFrame([("a.4",)], "node string"), 9, unique=True)
    assert {r.id: r.depth for r in up.collect()} == {"e3": 1, "f": 1, "o": 1, "e2": 2, "e1": 3, "e0": 4}
    down = graph.downstream(e, spark.createDataFrame([("a.0",)], "node string"), 9, unique=True)
    assert {r.id: r.depth for r in down.collect()} == {"e0": 1, "p": 1, "e1": 2, "e2": 3, "e3": 4}
    assert sorted(rows) == sorted(["e0", "e1", "e2", "e3"] * 2 + ["f", "o", "p"]) and names == ["walk-graph"] * 2
