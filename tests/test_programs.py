"""Guards, recursive groups, summaries and views against brute force."""

import itertools
import random

import pytest

from seamark.operators import calls, control_flow, dataflow, views


def random_graph(r, n, m):
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


def ways(flow, start, most):
    """Every way from the start that takes no edge more than twice, as (node, labels on it)."""
    out, open_ = [(start, frozenset())], [(start, frozenset(), ())]
    while open_:
        node, labels, used = open_.pop()
        for e in flow:
            if e[0] == node and used.count(e) < 1:
                more = labels | ({e[2]} if e[2] else set())
                out.append((e[1], more))
                open_.append((e[1], more, (*used, e)))
        assert len(out) < most
    return out


@pytest.mark.parametrize("seed", range(3))
def test_guards_equal_ways(spark, seed):
    r = random.Random(seed)
    flows, want = [], set()
    for u in range(6):
        flow = sorted({(a, b, r.choice(["p", "q", "NOT p", None])) for a, b in [(i, i + 1) for i in range(4)] + random_graph(r, 6, 5)}, key=repr)
        flows += [(u, *e) for e in flow]
        met = {}
        for node, labels in ways(flow, 0, 400_000):
            met[node] = met.get(node, labels) & labels
        want |= {(u, n, x) for n, labels in met.items() for x in labels}
    df = spark.createDataFrame(flows, "unit int, node int, succ int, label string")
    got = control_flow.guards(df.unionByName(df.limit(3)), spark.createDataFrame([(u, 0) for u in range(6)], "unit int, node int"))
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)


def test_guards_by_cases(spark):
    # if a: (while b: ...) ; join; and what no entry reaches
    flow = [("u", 1, 2, "a"), ("u", 1, 5, "NOT a"), ("u", 2, 3, "b"), ("u", 3, 2, None), ("u", 2, 4, "NOT b"), ("u", 4, 6, None), ("u", 5, 6, None), ("u", 8, 9, "x"), ("v", 1, 1, "c"), (None, 1, 2, "a")]
    df, entry = spark.createDataFrame(flow, "unit string, node int, succ int, label string"), spark.createDataFrame([("u", 1), ("u", 1), ("v", 1), (None, 1)], "unit string, node int")
    assert {tuple(x) for x in control_flow.guards(df, entry).collect()} == {("u", 2, "a"), ("u", 3, "a"), ("u", 3, "b"), ("u", 4, "a"), ("u", 4, "NOT b"), ("u", 5, "NOT a")}
    assert control_flow.guards(df.limit(0), entry).collect() == [] and control_flow.guards(df, entry.limit(0)).collect() == []


def reach(edges, n):
    r = [[False] * n for _ in range(n)]
    for a, b in edges:
        r[a][b] = True
    for k, i, j in itertools.product(range(n), repeat=3):
        r[i][j] = r[i][j] or (r[i][k] and r[k][j])
    return r


@pytest.mark.parametrize("seed,n,m", [(1, 12, 14), (2, 20, 26), (3, 15, 40), (4, 16, 14)])
def test_groups_levels_and_summaries(spark, seed, n, m):
    r = random.Random(seed)
    edges = random_graph(r, n, m)
    re = reach(edges, n)
    component = {i: min(j for j in range(n) if re[i][j] and re[j][i]) for i in range(n) if re[i][i]}
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "source int, target int")
    groups = calls.recursive_groups(df)
    got = {x.node: (x.component, x.size) for x in groups.collect()}
    assert got == {i: (c, sum(x == c for x in component.values())) for i, c in component.items()}
    of = {i: component.get(i, i) for e in edges for i in e}
    depth = {}

    def level(c):
        if c not in depth:
            depth[c] = max((level(of[b]) + 1 for a, b in edges if of[a] == c and of[b] != c), default=0)
        return depth[c]

    assert {x.node: (x.component, x.level) for x in calls.levels(df, groups).collect()} == {i: (c, level(c)) for i, c in of.items()}
    rank = {e: r.randrange(4) for e in edges}
    own = [(i, f"c{r.randrange(5)}", r.randrange(4)) for i in range(n)]
    cap = 4
    best = {}
    for i, c, k in own:
        best[i, c] = min(k, best.get((i, c), 9))
    front = dict(best)
    for _ in range(cap - 1):
        more = {}
        for (i, c), k in front.items():
            for a, b in edges:
                if b == i:
                    more[a, c] = min(more.get((a, c), 9), max(k, rank[a, b]))
        front = more
        for key, k in more.items():
            best[key] = min(k, best.get(key, 9))
    c = spark.createDataFrame([(a, b, k) for (a, b), k in rank.items()] + [(3, 99, 0)], "caller int, callee int, rank int")
    o = spark.createDataFrame([*own, (None, "c", 1), (1, None, 1)], "unit int, column string, rank int")
    assert {(x.unit, x.column): x["rank"] for x in calls.summaries(o, c, cap).collect()} == best
    walk = {i: {i} for i in range(n)}
    short = {3}
    for k in range(cap):
        walk = {i: {b for a in walk[i] for x, b in edges if x == a} for i in walk}
        short |= {i for i in walk if k < cap - 1 and 3 in walk[i]}
    told = {x.unit: (x.truncated, x.component) for x in calls.told(spark.createDataFrame([(i,) for i in range(n)], "unit int"), c, cap).collect()}
    assert told == {i: (bool(walk[i]) or i in short, component.get(i)) for i in range(n)}


def test_calls_of_nothing(spark):
    e = spark.createDataFrame([], "source int, target int")
    assert calls.recursive_groups(e).collect() == [] and calls.levels(e, calls.recursive_groups(e)).collect() == []
    c = spark.createDataFrame([], "caller int, callee int, rank int")
    assert [tuple(x) for x in calls.told(spark.createDataFrame([(1,)], "unit int"), c).collect()] == [(1, False, None, None, 0)]


def test_views(spark):
    d = [("v1.a", "t.x"), ("v2.a", "v1.a"), ("v3.a", "v2.a"), ("v3.b", "u.y"), ("v4.a", None), ("v5.a", "v4.a"), ("c1.a", "c2.a"), ("c2.a", "c1.a"), ("c3.a", "c1.a"), ("s.a", "s.a"), (None, "t.x"), ("v1.a", "t.x")]
    d += [(f"k{i}.a", f"k{i + 1}.a") for i in range(12)] + [("k12.a", "t.z"), ("sch.w.a", "sch.t.q")]
    df = spark.createDataFrame(d, "name string, base string")
    got = {x.name: (x.base, x.hops, x.state) for x in views.bases(df).collect()}
    want = {"v1.a": ("t.x", 1, "base"), "v2.a": ("t.x", 2, "base"), "v3.a": ("t.x", 3, "base"), "v3.b": ("u.y", 1, "base"), "v4.a": (None, 1, "unknown"), "v5.a": (None, 2, "unknown"), "c1.a": (None, None, "cycle"), "c2.a": (None, None, "cycle"), "c3.a": (None, None, "cycle"), "s.a": (None, None, "cycle"), "sch.w.a": ("sch.t.q", 1, "base")}
    want |= {f"k{i}.a": ("t.z", 13 - i, "base") if 13 - i <= 10 else (None, 13 - i, "deep") for i in range(13)}
    assert got == want
    edges = [(1, "FEEDS", "v2.a", "m.c"), (2, "FILTERS", "v2.a", "v2"), (3, "FILTERS", "z.q", "v3"), (4, "FILTERS", "z.q", "v1"), (5, "FEEDS", "c1.a", "v4.a"), (6, "FEEDS", "t.x", None), (7, "FILTERS", "v3.b", "v3"), (7, "FILTERS", "v3.b", "v3")]
    out, left = views.rewritten(spark.createDataFrame(edges, "id int, type string, source string, target string"), df)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "FEEDS", "t.x", "m.c"), (2, "FILTERS", "t.x", "t"), (3, "FILTERS", "z.q", "v3"), (4, "FILTERS", "z.q", "t"), (5, "FEEDS", "c1.a", "v4.a"), (6, "FEEDS", "t.x", None), (7, "FILTERS", "u.y", "u"), (7, "FILTERS", "u.y", "u")], key=repr)
    assert sorted(map(tuple, left.collect())) == [(3, "target", "v3", "several bases"), (5, "source", "c1.a", "cycle"), (5, "target", "v4.a", "unknown")]
    assert views.bases(df.limit(0)).collect() == []
    again, _ = views.rewritten(out, df)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out.collect()))


def test_reaching_has_no_cap(spark):
    flow = spark.createDataFrame([("u", i, i + 1) for i in range(60)], "unit string, node int, succ int")
    got = dataflow.reaching_definitions(flow, spark.createDataFrame([("u", 0, "x")], "unit string, node int, var string"))
    assert got.filter("converged").count() == 60
