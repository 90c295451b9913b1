import random

import pytest
from pyspark.sql import functions as F

from seamark.functions import texts
from seamark.operators import dataflow, graph, ledger, measure
from seamark.sources import facts_io
from seamark.streaming import logs

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_guards_and_shapes(spark):
    cases = [("b = a and  c > 1", "A = B AND C > 1"), ("NOT (y = x)", "X <> Y"), ("z >= 2", "Z >= 2"), (None, None), ("", "")]
    cases += [("a = 1 AND 1 = a and b=2", "1 = A AND 2 = B"), ("(x = 1 and z = 2 and y = 3) or c = 1", "(X = 1 AND Z = 2 AND Y = 3) OR C = 1")]
    cases += [("c = 1 and (b and (a and d)) and f(x) = 2", "(B AND (A AND D)) AND 1 = C AND 2 = F(X)"), ("not (a = b) and c", "A <> B AND C")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "g string")
    assert [r[0] for r in df.select(texts.normal_guard(F.col("g"))).collect()] == [b for _, b in cases]
    sql = "select  a /* x */ from t -- c\n where n = 12 and s = 'it''s' ;"
    df = spark.createDataFrame([(sql,), ("short",), (None,), ("x = 'Long enough' or y = 'no'",)], "s string")
    code = [("x := 'a' || col_name || 'b'", []), ("'UPDATE dim\n  SET ' || p || ' where it''s so ' || 'update dim set'", ["UPDATE DIM SET", "WHERE IT'S SO"]), (None, None), ("''", []), ("'" + "y" * 100_000 + "'", ["Y" * 100_000])]
    found = spark.createDataFrame([(a,) for a, _ in code], "s string").select(texts.literal_fragments(F.col("s"))).collect()
    assert [r[0] for r in found] == [b for _, b in code]
    got = df.select(texts.statement_shape(F.col("s")), texts.literal_fragments(F.col("s"))).collect()
    assert got[0][0] == "SELECT A FROM T WHERE N = ? AND S = ?" and got[1][0] is None and got[2][0] is None and got[3][1] == ["LONG ENOUGH"]


def test_ledger(spark):
    f = spark.createDataFrame([(1, "k", 1), (2, "k", 5), (3, "j", 2), (4, "k", 5)], "id int, key string, valid_from int")
    s = ledger.supersede(f, ["key"])
    assert [r.id for r in ledger.as_of(s, F.lit(4)).orderBy("id").collect()] == [1, 3]
    assert [r.id for r in ledger.as_of(s, F.lit(5)).orderBy("id").collect()] == [3, 4]
    assert [r.id for r in ledger.current(s).orderBy("id").collect()] == [3, 4]
    h = spark.createDataFrame([("a", "identity"), ("a", "conditional"), ("b", "derived"), ("c", "?")], "k string, transform string")
    assert rows(ledger.hardest(h, ["k"])) == sorted(["('a', 'conditional')", "('b', 'derived')", "('c', None)"])


def test_statement_status(spark):
    st = spark.createDataFrame([("u", 1, 3, True), ("u", 4, None, True), ("u", 5, 5, True), ("u", 6, 9, False), ("u", 10, 12, True), ("v", 1, 2, True)], "unit string, line int, end_line int, valid boolean")
    at = lambda *x: spark.createDataFrame(list(x), "unit string, line int")
    got = {(r.unit, r.line): (r.status, r.n_edges) for r in ledger.statement_status(st, at(("u", 2), ("u", 3), ("u", 11)), at(("u", 4), ("u", 12)), at(("u", 5),)).collect()}
    assert got == {("u", 1): ("column_level", 2), ("u", 4): ("refused", 0), ("u", 5): ("declared", 0), ("u", 6): ("not_valid", 0), ("u", 10): ("partial", 1), ("v", 1): ("nothing_to_trace", 0)}
    w = spark.createDataFrame([("t", "a"), ("t", "b"), ("s", "a"), ("r", "a"), ("q", "a")], "relation string, unit string")
    r = spark.createDataFrame([("t", "a"), ("s", "a"), ("r", "c")], "relation string, unit string")
    assert rows(ledger.fusion_hazards(w, r)) == ["('r', 1, 1)", "('t', 2, 1)"]


def test_dataflow(spark):
    flow = spark.createDataFrame([("u", 1, 2), ("u", 2, 3), ("u", 3, 2), ("u", 3, 4), ("v", 1, 2)], "unit string, node int, succ int")
    gen = spark.createDataFrame([("u", 1, "x"), ("u", 3, "x"), ("u", 1, "y"), ("v", 1, "x")], "unit string, node int, var string")
    got = dataflow.reaching_definitions(flow, gen)
    assert rows(got) == sorted(map(repr, [("u", 2, "x", 1, True), ("u", 2, "x", 3, True), ("u", 2, "y", 1, True), ("u", 3, "x", 1, True), ("u", 3, "x", 3, True), ("u", 3, "y", 1, True), ("u", 4, "x", 3, True), ("u", 4, "y", 1, True), ("v", 2, "x", 1, True)]))
    assert dataflow.reaching_definitions(flow, gen, cap=1).filter("converged").count() == 0
    steps = spark.createDataFrame([("a", "b", 0), ("b", "c", 3), ("a", "d", 1), ("d", "c", 2), ("c", "a", 0)], "source string, target string, rank int")
    best = {(r.source, r.target): r["rank"] for r in dataflow.call_transforms(steps).collect()}
    assert best["a", "c"] == 2 and best["a", "b"] == 0 and best["b", "c"] == 3 and best["b", "a"] == 3


def test_facts_io(spark, tmp_path):
    e = spark.createDataFrame([("1", "FEEDS", "a.x", "b.y", None, None, 0, None, "u", 3), ("2", "FILTERS", "a.x", "b", "identity", "pre", 1, "G", "u", 4)], facts_io.EDGES)
    facts_io.write_json(e, f"{tmp_path}/edges")
    assert rows(facts_io.read_json(spark, f"{tmp_path}/edges")) == rows(e)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text('{"id": 1, "band": "no number"}\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        facts_io.read_json(spark, f"{tmp_path}/bad").collect()
    (tmp_path / "sql/sub").mkdir(parents=True)
    (tmp_path / "sql/a.sql").write_text("select 1;\nselect 2")
    (tmp_path / "sql/sub/b.sql").write_text("")
    (tmp_path / "sql/c.txt").write_text("no")
    assert {(r.name, r.n_lines) for r in facts_io.read_texts(spark, f"{tmp_path}/sql").collect()} == {("a.sql", 2)}  # an empty file has no row
    new = e.filter("id = '2'").withColumn("band", F.lit(7)).unionByName(e.filter("id = '1'").withColumn("id", F.lit("3")))
    assert {(r.id, r.band) for r in facts_io.upsert(e, new).collect()} == {("1", 0), ("2", 7), ("3", 0)}
    assert {tuple(r) for r in facts_io.nodes(e).collect()} == {("a.x", "Column", 0, 2), ("b.y", "Column", 1, 0), ("b", "Relation", 1, 0)}


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    ev = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in")
    got = drained(logs.counts(stream(), "event_type"), "seamark_counts", "complete")
    assert rows(got.select("start", "event_type", "n")) == rows(logs.counts(ev, "event_type").select("start", "event_type", "n"))
    em = spark.createDataFrame([("u1", "click"), ("u0", "click")], "unit string, action string")
    log = stream().withColumnRenamed("event_type", "action")
    got = drained(logs.attributed(log, em), "seamark_units")
    assert got.filter("unit = 'u0'").count() == ev.filter("event_type = 'click'").count() and got.count() == ev.count()
    got = drained(logs.once_each(stream(), "user_id", "3650 days"), "seamark_once")
    assert got.count() == ev.select("user_id").distinct().count()
    batch = logs.sessions(ev, "user_id", "6 hours")
    assert batch.agg(F.sum("n")).first()[0] == ev.count()


def test_statement_texts(spark):
    text = "select a\nfrom t -- qty\nwhere Qty > 1;\nselect \"qty\", my_qty;\nlast"
    df = spark.createDataFrame([(text, 1, ["qty"]), (text, 4, ["qty"]), (text, 5, ["a.b"]), (text, 9, ["qty"]), (None, 1, ["a"]), (text, 1, []), ("", 1, ["a"]), (text, None, ["a"])], "t string, l int, n array<string>")
    got = [tuple(r) for r in df.select(texts.snippet(F.col("t"), F.col("l")), texts.mention_lines(F.col("t"), F.col("l"), F.col("n"))).collect()]
    assert got[:3] == [("select a\nfrom t -- qty\nwhere Qty > 1;", [3]), ('select "qty", my_qty;', [4]), ("last", [])]
    assert got[4] == (None, None) and got[5][1] is None and got[6] == (None, None) and got[7][0] is None
    long = spark.createDataFrame([("x\n" * 500 + "y;", 2)], "t string, l int").select(texts.snippet(F.col("t"), F.col("l"))).first()[0]
    assert long.split("\n")[-1] == "-- ... 300 more lines of this statement" and long.count("\n") == 200


def table_of(node):
    return node.rsplit(".", 1)[0] if "." in node else node


def plain_walk(edges, start, up, depth, types):
    seen, frontier, told = set(start), set(start), {}
    for hop in range(1, depth + 1):
        rels = {table_of(n) for n in frontier}
        found = []
        for i, k, s, t in edges:
            if up and ((k in types and t in frontier) or (k in ("FILTERS", "MENTIONS_COL", "OPAQUE") and t in rels)):
                found.append((i, k, s))
            if not up and ((k in ("FILTERS", *types) and s in frontier) or (k == "OPAQUE" and s in rels)):
                found.append((i, k, t))
        for i, _, _ in found:
            told.setdefault(i, hop)
        frontier = {n for _, k, n in found if up or k != "FILTERS"} - seen
        seen |= frontier
    return told


def plain_collapse(edges, hidden):
    """All states by a stack, each walked on from once."""
    order = list(graph.PRECEDENCE)
    ladder = list(texts.TRANSFORMS)
    hide = lambda n: table_of(n) in hidden
    out = {(s, t, k, x if k == "FEEDS" else "identity", False) for _, k, s, t, x in edges if not hide(s) and not hide(t)}
    best, seen = {}, set()
    stack = [(s, t, k, ladder.index(x) if k == "FEEDS" else 0) for _, k, s, t, x in edges if not hide(s) and hide(t)]
    while stack:
        state = stack.pop()
        if state in seen:
            continue
        seen.add(state)
        start, node, kind, r = state
        for _, k2, s2, t2, x2 in edges:
            if hide(s2) and (s2 == node or ("." not in node and table_of(s2) == node)):
                k = min(kind, k2, key=order.index)
                r2 = max(r, ladder.index(x2)) if k == "FEEDS" else 0
                if hide(t2):
                    stack.append((start, t2, k, r2))
                else:
                    end = table_of(t2) if k == "FILTERS" and k2 != "FILTERS" else t2
                    best[start, end, k] = max(best.get((start, end, k), 0), r2)
    lost = {}
    reached = {node for _, node, _, _ in seen}
    for _, k, s, t, _ in edges:
        if hide(s) and not hide(t) and s not in reached:
            lost.setdefault((table_of(t), k, table_of(s)), set()).add(s.rsplit(".", 1)[-1])
    return out | {(s, t, k, ladder[r], True) for (s, t, k), r in best.items()}, {(*key, ",".join(sorted(v))) for key, v in lost.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_and_collapse_equal_plain_loops(spark, seed):
    """Random graphs with cycles, self-loops, repeated edges and edges that end in relations."""
    rnd = random.Random(seed)
    node = lambda: f"t{rnd.randrange(6)}.c{rnd.randrange(3)}"
    edges = []
    for i in range(45):
        k = rnd.choice(("FEEDS", "FEEDS", "FEEDS", "INFLUENCES", "KEYS", "FILTERS", "OPAQUE", "MENTIONS_COL"))
        s, t = node(), node()
        if k in ("FILTERS", "OPAQUE") or (k == "MENTIONS_COL" and rnd.random() < 0.5):
            t = table_of(t)
        if k == "OPAQUE":
            s = table_of(s)
        edges.append((f"e{i}", k, s, t, rnd.choice(texts.TRANSFORMS)))
    rows = [*edges, edges[0], ("bad", "FEEDS", None, "t1.c1", "identity")]
    df = spark.createDataFrame(rows, "id string, type string, source string, target string, transform string")
    starts = ["t0.c0", "t1.c1", "nowhere.x"]
    start = spark.createDataFrame([(x,) for x in [*starts, None, "t0.c0"]], "node string")
    types = ("FEEDS", "INFLUENCES", "KEYS", "MENTIONS_COL")
    four = [e[:4] for e in edges]
    for up in (True, False):
        got = {r.id: r.depth for r in graph.walk(df, start, up, 5, join_keys=True).collect()}
        assert got == plain_walk(four, starts, up, 5, types)
    hidden = spark.createDataFrame([("t2",), ("t3",), ("t3",), ("none",)], "relation string")
    want, lost = plain_collapse(edges, {"t2", "t3"})
    assert {tuple(r) for r in graph.collapse(df.dropna(), hidden).collect()} == want
    assert {tuple(r) for r in graph.collapse_notes(df.dropna(), hidden).collect()} == lost
    none = df.limit(0)
    assert graph.walk(none, start, True, 3).count() == graph.collapse(none, hidden).count() == graph.components(none).count() == 0
    assert graph.collapse(df.dropna(), hidden.limit(0)).filter("joined").count() == 0


def test_collapse_through_a_filtered_table(spark):
    edges = [("1", "FILTERS", "a.x", "h", "identity"), ("2", "FEEDS", "h.c", "z.c", "derived"), ("3", "FEEDS", "a.y", "h.c", "conditional"), ("4", "FEEDS", "h.d", "z.d", "identity")]
    df = spark.createDataFrame(edges, "id string, type string, source string, target string, transform string")
    got = {tuple(r) for r in graph.collapse(df, spark.createDataFrame([("h",)], "relation string")).collect()}
    assert got == {("a.x", "z", "FILTERS", "identity", True), ("a.y", "z.c", "FEEDS", "conditional", True)}
    notes = [tuple(r) for r in graph.collapse_notes(df, spark.createDataFrame([("h",)], "relation string")).collect()]
    assert notes == [("z", "FEEDS", "h", "d")]


def test_measures_on_odd_rows(spark):
    e = spark.createDataFrame([("k", "A"), ("k", "a"), ("k", "b"), (None, "x")], "kind string, subject string")
    d = spark.createDataFrame([("k", "a"), ("k", "c")], "kind string, subject string")
    assert {tuple(r) for r in measure.boundary_score(e, d).collect()} == {("k", 1, 1, 1), (None, 0, 1, 0)}
    m = spark.createDataFrame([("value precision", 0.96), ("value precision", 0.9), ("value recall", None), ("edges from refused statements", 0.0)], "criterion string, value double")
    got = {r.criterion: r.verdict for r in measure.kill_criteria(m).collect()}
    assert got == {"value precision": "TRIGGERED", "value recall": "PENDING", "parse coverage": "PENDING", "edges from refused statements": "PASS"}
    t = spark.createDataFrame([("a", "b", "value", "identity", None, None, 0)] * 2 + [("a", "c", "value", "identity", None, "g", 1)], "source string, target string, flow string, transform string, phase string, guard string, band int")
    assert {tuple(r) for r in measure.score(t, t.limit(0)).collect()} == {(0, "value", 0, 0, 1, None, 0.0), (1, "value", 0, 0, 1, None, 0.0)}
    assert {tuple(r)[:5] for r in measure.score(t, t.withColumn("guard", F.lit("other"))).collect()} == {(0, "value", 1, 0, 0), (1, "value", 1, 0, 0)}
    assert measure.score(t.limit(0), t.limit(0)).count() == measure.witness(spark.createDataFrame([], "id int, unit string, line int"), *(spark.createDataFrame([], "unit string, line int"),) * 3).count() == 0
    assert measure.emitters(spark.createDataFrame([("u", "'long enough' 'long enough'"), ("v", None)], "unit string, text string"), texts.literal_fragments).collect() == [("u", "LONG ENOUGH")]


def test_labels_and_reports(spark, tmp_path):
    import hashlib
    import json

    rows = [{"package": p, "source_sha256": hashlib.sha256(t.encode()).hexdigest(), "source": "a", "target": "b"} for p, t in (("p.sql", "select 1"), ("q.sql", "old"), ("gone.sql", "x"))]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/x.json").write_text("\n".join(map(json.dumps, rows)))
    now = spark.createDataFrame([("p.sql", "select 1"), ("q.sql", "new")], "name string, text string")
    assert {r.package: r.pinned for r in facts_io.read_labels(spark, f"{tmp_path}/labels", now).collect()} == {"p.sql": True, "q.sql": False, "gone.sql": False}
    df = spark.createDataFrame([(1, "a|b\nc", ["x"]), (2, None, None)], "n int, t string, xs array<string>").coalesce(1)
    facts_io.write_csv(df, f"{tmp_path}/csv")
    back = spark.read.option("header", "true").option("multiLine", "true").csv(f"{tmp_path}/csv").collect()
    assert [tuple(r) for r in back] == [("1", "a|b\nc", '["x"]'), ("2", None, None)]
    facts_io.write_markdown(df.drop("xs"), f"{tmp_path}/md")
    assert [r.value for r in spark.read.text(f"{tmp_path}/md").collect()] == ["| n | t |", "|---|---|", "| 1 | a\\|b<br>c |", "| 2 |  |"]


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace as N

    from seamark import frames

    conf = N(get=lambda name, default=None: default)
    session = lambda master: N(conf=conf, sparkContext=N(getConf=lambda: N(get=lambda name: None), master=master, applicationId="x"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        frames.shared_dir(session("spark://host:7077"))
