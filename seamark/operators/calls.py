"""Summaries along call graphs: recursive groups, levels of what is left, and what each unit takes from below."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.frames import Grown, cut


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges on ways between cycles: ends without an edge in or out go, until none is left."""
    n = edges.count()
    while n:
        ends_in, ends_out = edges.select(F.col("target").alias("source")).distinct(), edges.select(F.col("source").alias("target")).distinct()
        edges = cut(edges.join(ends_in, "source", "left_semi").join(ends_out, "target", "left_semi").select("source", "target"), "strong-edges")
        n, was = edges.count(), n
        if n == was:
            break
    return edges


def recursive_groups(edges: DataFrame) -> DataFrame:
    """edges(source, target) -> (node, component, size): nodes on cycles, by strongly connected component, named by its smallest node.

    Nodes on no cycle, which are most, go first. Then each node takes the smallest name that reaches it as its colour, and of a
    colour those that lead back to the node of that name are its component; what is left is trimmed and coloured again. A node
    that calls itself alone is a component of size 1. Null ends count for nothing.
    """
    edges = cut(edges.select("source", "target").dropna().distinct(), "strong-edges")
    found = Grown(edges.sparkSession, "strong-found")
    found.add(edges.filter("source = target").select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0))
    rest = _trimmed(cut(edges.filter("source <> target"), "strong-edges"))
    while not rest.isEmpty():
        colour = rest.select(F.col("source").alias("node")).unionByName(rest.select(F.col("target").alias("node"))).distinct().withColumn("colour", F.col("node"))
        changed = colour = cut(colour, "strong-colours")
        while not changed.isEmpty():
            told = changed.join(rest, F.col("node") == F.col("source")).groupBy("target").agg(F.min("colour").alias("new"))
            both = cut(colour.join(told, F.col("node") == F.col("target"), "left").select("node", F.least("colour", "new").alias("colour"), (F.col("new") < F.col("colour")).alias("less")), "strong-colours")
            colour, changed = both.select("node", "colour"), both.filter("less").select("node", "colour")
        within = rest.join(colour.select(F.col("node").alias("source"), F.col("colour").alias("a")), "source").join(colour.select(F.col("node").alias("target"), F.col("colour").alias("b")), "target").filter("a = b")
        within = cut(within.select("source", "target", F.col("a").alias("component")), "strong-within")
        back = Grown(edges.sparkSession, "strong-back")
        new = back.add(colour.filter("node = colour").select("node", F.col("colour").alias("component")))
        while not new.isEmpty():
            ahead = new.join(within.select(F.col("target").alias("node"), "component", "source"), ["node", "component"]).select(F.col("source").alias("node"), "component").distinct()
            new = back.add(ahead.join(back.all(), ["node", "component"], "left_anti"))
        found.add(back.all())
        gone = back.all().select("node")
        rest = _trimmed(cut(rest.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target"), "strong-edges"))
    sized = found.all()
    sized = sized.join(sized.groupBy("component").agg(F.count("*").alias("size")), "component")
    loops = edges.filter("source = target").select(F.col("source").alias("node"))
    # Trimming leaves what lies between cycles; colouring makes of such a node a component of its own, which is none unless it calls itself.
    sized = sized.filter("size > 1")
    alone = loops.join(sized, "node", "left_anti").select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"))
    return sized.select("node", "component", "size").unionByName(alone)


def levels(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """edges(source, target), groups as recursive_groups() gives them -> (node, component, level): how many calls lie below, at most.

    Groups count as one node. Level 0 calls nothing outside of its group; a level is peeled off in each round.
    """
    edges = edges.select("source", "target").dropna().distinct()
    nodes = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    of = cut(nodes.join(groups.select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "levels-of")
    a, b = (of.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("source", "a"), ("target", "b")))
    rest = cut(edges.join(a, "source").join(b, "target").filter("a <> b").select("a", "b").distinct(), "levels-edges")
    left, out, level = of.select("component").distinct(), Grown(edges.sparkSession, "levels"), 0
    left = cut(left, "levels-left")
    while not left.isEmpty():
        done = out.add(left.join(rest.select(F.col("a").alias("component")).distinct(), "component", "left_anti").withColumn("level", F.lit(level)))
        left = cut(left.join(done.select("component"), "component", "left_anti"), "levels-left")
        rest = cut(rest.join(done.select(F.col("component").alias("b")), "b", "left_anti").select("a", "b"), "levels-edges")
        level += 1
    return of.join(out.all(), "component").select("node", "component", "level") if level else of.withColumn("level", F.lit(0))


def summaries(own: DataFrame, calls: DataFrame, cap: int = 6) -> DataFrame:
    """own(unit, column, rank), calls(caller, callee, rank) -> (unit, column, rank): columns a unit's result comes from, at most cap units deep.

    Along a way the hardest rank counts, of all ways the mildest. Only pairs that a round made milder go on to the callers, and
    there are cap - 1 rounds, so recursion ends too. Null units, columns and ranks count for nothing.
    """
    calls = cut(calls.select("caller", "callee", F.col("rank").alias("r")).dropna().groupBy("caller", "callee").agg(F.min("r").alias("r")), "summary-calls")
    best = new = cut(own.select("unit", "column", "rank").dropna().groupBy("unit", "column").agg(F.min("rank").alias("rank")), "summary-best")
    for _ in range(cap - 1):
        up = new.join(calls, F.col("unit") == F.col("callee")).groupBy(F.col("caller").alias("unit"), "column").agg(F.min(F.greatest("rank", "r")).alias("new"))
        both = best.join(up, ["unit", "column"], "full").select("unit", "column", F.least("rank", "new").alias("rank"), (F.col("new").isNotNull() & (F.col("rank").isNull() | (F.col("new") < F.col("rank")))).alias("milder"))
        both = cut(both, "summary-best")
        best, new = both.select("unit", "column", "rank"), both.filter("milder").select("unit", "column", "rank")
        if new.isEmpty():
            break
    return best


def told(units: DataFrame, calls: DataFrame, cap: int = 6) -> DataFrame:
    """units(unit), calls(caller, callee) -> (unit, truncated, component, size, level) for each unit.

    truncated: the summary is not all, as a way of cap calls goes down from the unit (recursion always gives one), or one of fewer
    calls to a unit that isn't known. component and size tell the recursive group, null where there is none; level as in levels(),
    0 for units that neither call nor are called.
    """
    units = cut(units.select("unit").dropna().distinct(), "told-units")
    calls = cut(calls.select("caller", "callee").dropna().distinct(), "told-calls")
    known = units.select(F.col("unit").alias("callee"))
    unknown = calls.join(known, "callee", "left_anti").select("callee").distinct()
    deep, lost = units, cut(unknown.select(F.col("callee").alias("unit")), "told-lost")
    up = lambda df: cut(df.join(calls, F.col("unit") == F.col("callee")).select(F.col("caller").alias("unit")).distinct(), "told-up")
    over = None
    for _ in range(cap):
        deep, lost = up(deep), up(lost)
        over = lost if over is None else over.unionByName(lost)
    short = (deep.unionByName(over) if over is not None else deep).distinct().withColumn("t", F.lit(True))
    edges = calls.select(F.col("caller").alias("source"), F.col("callee").alias("target"))
    groups = cut(recursive_groups(edges), "told-groups")
    at = levels(edges, groups).select(F.col("node").alias("unit"), "level")
    df = units.join(short, "unit", "left").join(groups.withColumnRenamed("node", "unit"), "unit", "left").join(at, "unit", "left")
    return df.select("unit", F.coalesce("t", F.lit(False)).alias("truncated"), "component", "size", F.coalesce("level", F.lit(0)).alias("level"))
