"""Spans, range sets and ordered scans against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from seamark.operators import intervals, scans


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def given():
    r = random.Random(3)
    spans = [(i, r.choice(["u", "v", None]), (a := r.randint(-50, 3000)), a + r.choice([0, 1, 5, 77, 1500, 1_000_000])) for i in range(120)]
    spans += [(900, "u", 10, 20), (901, "u", 10, 20), (902, "u", 20, 30), (903, "u", 5, 1), (904, "u", None, 4), (905, "u", 4, None), (906, "w", 0, 5)]
    points = [(i, r.choice(["u", "v", None]), r.randint(-60, 6000)) for i in range(300)] + [(800, "u", None), (801, "u", 20), (801, "u", 20), (802, "x", 1)]
    return spans, points


def test_spans_hold_points(spark, given):
    spans, points = given
    s = spark.createDataFrame(spans, "id int, unit string, line long, end_line long")
    p = spark.createDataFrame(points, "id int, unit string, line long")
    want = sorted((i, j) for i, u, x in points for j, v, a, b in spans if None not in (x, a, b) and u == v and a <= x <= b)
    got = intervals.holding(p, s).select("point.id", F.col("span.id").alias("j")).collect()
    assert sorted(map(tuple, got)) == want
    n = {j: [x for i, u, x in points if x is not None and u == v and a <= x <= (a if b is None else b)] for j, v, a, b in spans if a is not None}
    con = {r.refusal: r.n_edges for r in intervals.contradictions(s, p).collect()}
    assert con == {j: len(x) for j, x in n.items() if x}  # a span without an end is its line


def test_long_spans_take_few_rows(spark):
    df = spark.createDataFrame([(0, 999_999), (1, 1_000_000), (7, 2**40), (5, 5), (-9, 8), (3, 2)], "a long, b long")
    for r in df.select("a", "b", intervals.blocks(F.col("a"), F.col("b")).alias("x")).collect():
        covered = sorted((x.no << x.level, (x.no + 1 << x.level) - 1) for x in r.x)
        assert len(covered) <= 82 and sum(b - a + 1 for a, b in covered) == max(0, r.b - r.a + 1)
        assert not covered or (covered[0][0] == r.a and covered[-1][1] == r.b and all(x[1] + 1 == y[0] for x, y in zip(covered, covered[1:])))


@pytest.mark.parametrize("width", [4, 64, 1024])
def test_innermost(spark, given, width):
    spans, points = given
    s = spark.createDataFrame(spans, "id int, unit string, start long, stop long")
    p = spark.createDataFrame(points, "id int, unit string, line long")
    want = []
    for i, u, x in points:
        held = [(-a, b, j) for j, v, a, b in spans if None not in (x, a, b) and u == v and a <= x <= b]
        best = min(held, default=None)
        want.append((i, u, x, *((-best[0], best[1], best[2], sum(h[:2] == best[:2] for h in held)) if best else (None,) * 4)))
    assert rows(intervals.innermost(p, s, width=width)) == sorted(map(repr, want))


def test_nested_and_empty(spark):
    s = spark.createDataFrame([(1, "u", 1, 100), (2, "u", 10, 50), (3, "u", 20, 20), (4, "u", 51, 60)], "id int, unit string, start long, stop long")
    p = spark.createDataFrame([("u", x) for x in (0, 1, 10, 20, 21, 50, 51, 60, 61, 100, 101)], "unit string, line long")
    got = {r.line: r.span for r in intervals.innermost(p, s, width=8).collect()}
    assert got == {0: None, 1: 1, 10: 2, 20: 3, 21: 2, 50: 2, 51: 4, 60: 4, 61: 1, 100: 1, 101: None}
    assert intervals.innermost(p.limit(0), s).collect() == [] and intervals.innermost(p, s.limit(0)).filter("span IS NULL").count() == 11
    assert intervals.holding(p.limit(0), s.withColumnsRenamed({"start": "line", "stop": "end_line"})).collect() == []
    assert intervals.holding(p, s.withColumnsRenamed({"start": "line", "stop": "end_line"}).limit(0)).collect() == []


RANGE = "id int, lo int, hi int, lo_in boolean, hi_in boolean"


def grid(ranges, x):
    """Whether a set holds x, a multiple of a quarter."""
    return any((a is None or a < x or (a == x and ai)) and (b is None or x < b or (b == x and bi)) for a, b, ai, bi in ranges)


def test_range_sets(spark):
    r = random.Random(11)
    end = lambda: r.choice([None, *range(12)])
    sets = [[(r.randrange(6), end(), end(), r.random() < 0.5, r.random() < 0.5) for _ in range(40)] for _ in range(2)]
    sets[0] += [(7, 1, 2, True, False), (7, 2, 3, True, True), (8, 1, 2, True, False), (8, 2, 3, False, True), (9, 1, 1, True, False), (10, 1, 1, True, True), (11, None, None, True, True), (None, 1, 2, True, True)]
    a, b = (spark.createDataFrame(s, RANGE) for s in sets)
    cases = [(intervals.coalesced(a, parts=3), lambda x, y: x), (intervals.intersected(a, b), lambda x, y: x and y), (intervals.subtracted(a, b, parts=5), lambda x, y: x and not y)]
    points = [x / 4 for x in range(-8, 60)]
    for df, holds in cases:
        got = {}
        for i, *rest in df.collect():
            got.setdefault(i, []).append(tuple(rest))
        for i in [*range(12), None]:
            of = [[(lo, hi, li, hi_) for j, lo, hi, li, hi_ in s if j == i] for s in sets]
            assert [grid(got.get(i, []), x) for x in points] == [bool(holds(grid(of[0], x), grid(of[1], x))) for x in points], i
    got = {(x.id, x.lo, x.hi, x.lo_in, x.hi_in) for x in intervals.coalesced(a).collect()}
    assert {x for x in got if x[0] == 7} == {(7, 1, 3, True, True)} and len([x for x in got if x[0] == 8]) == 2 and not [x for x in got if x[0] == 9]
    assert (10, 1, 1, True, True) in got and (11, None, None, False, False) in got
    assert intervals.coalesced(a.limit(0)).collect() == [] and rows(intervals.subtracted(a, b.limit(0))) == rows(intervals.coalesced(a))


def test_scan_over_a_hot_group(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"g{i % 7}", i, i % 5) for i in range(500)], "g string, i int, v int")
    got = {(r.g, r.i): (r.total, r.nxt) for r in scans.scan(df, ["g"], ["i"], totals={"total": F.col("v")}, after={"nxt": F.col("i")}, parts=7).collect()}
    want, groups = {}, {}
    for g, i, v in map(tuple, df.collect()):
        groups.setdefault(g, []).append((i, v))
    for g, x in groups.items():
        for n, (i, _) in enumerate(x):
            want[g, i] = sum(v for _, v in x[: n + 1]), x[n + 1][0] if n + 1 < len(x) else None
    assert got == want
