"""Ways through hidden tables, impact reports, evidence off the path, spellings and exchanged partitions, by cases."""

from seamark.operators import graph, knowledge, measure
from seamark.sources import facts_io


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


EDGE = "id string, type string, source string, target string, transform string, file string, line int"


def test_collapse_tells_what_it_passed(spark):
    e = [("1", "FEEDS", "a.x", "h.x", "derived", "f", 1), ("2", "FEEDS", "h.x", "h2.y", None, "f", 2), ("3", "FEEDS", "h2.y", "z.q", None, "g", 3), ("4", "FILTERS", "b.x", "h", None, "g", 4), ("5", "FEEDS", "h2.y", "h.x", None, "g", 5), ("6", "FEEDS", "a.x", "z.q", None, "g", 6)]
    df, hide = spark.createDataFrame(e, EDGE), spark.createDataFrame([("h",), ("h2",), ("none",)], "relation string")
    got = {}
    for r in graph.collapse_passed(df, hide).collect():
        got.setdefault((r.source, r.target, r.type), {}).setdefault(r.what, set()).add(r.item)
    assert got == {
        ("a.x", "z.q", "FEEDS"): {"via": {"h.x", "h2.y"}, "where": {"f:1", "f:2", "g:3", "g:5"}},
        ("b.x", "z", "FILTERS"): {"via": {"h", "h2.y", "h.x"}, "where": {"g:4", "f:2", "g:3", "g:5"}},
    }
    joined = {(r.source, r.target, r.type) for r in graph.collapse(df, hide).filter("joined").collect()}
    assert joined == set(got)
    assert graph.collapse_passed(df, hide.filter("relation = 'none'")).collect() == [] and graph.collapse_passed(df.limit(0), hide).collect() == []


def test_off_path(spark):
    ev = [(1, "FEEDS", "t.a", "u.b"), (1, "FEEDS", "u.b", "v.c"), (1, "FEEDS", "x.a", "y.b"), (1, "FILTERS", "x.z", "t"), (2, "FEEDS", "x.a", "y.b"), (3, "FEEDS", "x.a", "y.b"), (3, "FEEDS", "p.a", "q.b")]
    an = [(1, "v.c"), (1, None), (2, "t"), (3, "y"), (9, "x.a")]
    got = graph.off_path(spark.createDataFrame(ev + ev[:1], "question int, type string, source string, target string"), spark.createDataFrame(an, "question int, anchor string"))
    # x.z filters t, which isn't t.a: its group is off question 1, as t isn't the table of the anchor v.c.
    assert rows(got) == sorted(map(repr, [(1, "FEEDS", "x.a", "y.b"), (1, "FILTERS", "x.z", "t"), (2, "FEEDS", "x.a", "y.b"), (3, "FEEDS", "p.a", "q.b")]))
    on = graph.off_path(spark.createDataFrame(ev[:4], "question int, type string, source string, target string"), spark.createDataFrame([(1, "t.a")], "question int, anchor string"))
    assert rows(on) == [repr((1, "FEEDS", "x.a", "y.b"))]
    none = spark.createDataFrame([], "question int, anchor string")
    assert graph.off_path(spark.createDataFrame(ev, "question int, type string, source string, target string"), none).count() == 7


def test_spelling_pairs(spark):
    m = [("p1", "A", 1), ("p1", "B", 2), ("p2", "A", 1), ("p2", "B", 3), ("p3", "A", 1), ("p4", "A", 8), ("p4", "B", 9), ("p5", "B", 2), ("p5", "A", 8), (None, "A", 1), ("p1", "C", 3)]
    f = [(1, "x"), (1, "y"), (2, "y"), (2, "x"), (2, "x"), (3, "x"), (3, "z"), (1, None)]
    got = measure.spelling_pairs(spark.createDataFrame(m, "pair string, side string, statement int"), spark.createDataFrame(f, "statement int, fact string"))
    assert rows(got) == sorted(map(repr, [("p1", "EQUAL", 2, 2, 0, 0), ("p2", "DIFFER", 2, 2, 1, 1), ("p3", "incomplete", None, None, None, None), ("p4", "EQUAL", 0, 0, 0, 0), ("p5", "DIFFER", 0, 2, 0, 2)]))


def test_exchange_of_partitions(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "k int, part string").write.partitionBy("part").parquet(a)
    spark.createDataFrame([(7, "x"), (8, "z")], "k int, part string").write.partitionBy("part").parquet(b)
    read = lambda p: sorted(map(tuple, spark.read.schema("k int, part string").parquet(p).collect()))
    facts_io.exchange_partition(spark, a, b, "part", "x")
    assert read(a) == [(3, "y"), (7, "x")] and read(b) == [(1, "x"), (2, "x"), (8, "z")]
    facts_io.exchange_partition(spark, a, b, "part", "z")  # one side has none
    assert read(a) == [(3, "y"), (7, "x"), (8, "z")] and read(b) == [(1, "x"), (2, "x")]


def test_impact_of_a_column_on_no_edge(spark):
    e = spark.createDataFrame([("1", "FEEDS", "t.a", "u.b", "f", "s1"), ("2", "INFLUENCES", "t.a", "u.b", "f", "s1"), ("3", "OPAQUE", "u", "w", "f", "s2")], "id string, type string, source string, target string, file string, statement string")
    empty = lambda s: spark.createDataFrame([], s)
    st = spark.createDataFrame([("s1", "f", 1, 2, "INSERT", "column_level", None), ("s2", "f", 3, 4, "INSERT", "refused", "why")], "id string, file string, line int, end_line int, kind string, status string, reason string")
    touches = spark.createDataFrame([("s1", "t", "READS"), ("s2", "u", "READS")], "statement string, table string, mode string")
    args = [touches, empty("table string, name string"), st, empty("file string, text string"), empty("id string, kind string, subject string, statement string, node string"), empty("id string, code string, file string, line int, reason string, statement string"), empty("refusal string, statement string, table string"), empty("id string, type string, table string, detail string, statement string")]
    of = lambda node, name: {(r.section, r.item, r.about, r.depth) for r in knowledge.impact_report(e, spark.createDataFrame([(node, name)], "node string, name string"), "t", *args).collect()}
    assert of("t.a", "a") == {("affected", "u.b", "FEEDS,INFLUENCES", 1), ("affected", "w", "OPAQUE", 2), ("edit", "s1", "reads it", None), ("unverified", "w", "OPAQUE", None), ("statement", "s2", "refused", None), *(("summary", s, n, None) for s, n in (("affected", "2"), ("edit", "1"), ("unverified", "1"), ("statement", "1")))}
    assert ("note", "t.k", "in no lineage edge: only SQL that names it can break", None) in of("t.k", "k")
