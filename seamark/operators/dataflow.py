"""Fixpoints over program graphs held as DataFrames: reaching definitions, and transforms along and across call paths."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.frames import Grown, cut

_AT = ["unit", "node"]


def _flooded(flow: DataFrame, gen: DataFrame, start: DataFrame, name: str, cap: int | None = None, entries: bool = False) -> tuple[DataFrame, bool]:
    """start(unit, node, var, ...), distinct, carried along flow until a node defines the variable: (all rows met, whether the rounds ended).

    Steps and definitions are laid out once, so a round moves only what the last one found new. A row can come twice only to a node
    with several ways in, or to an entry: other rows are neither made distinct nor held against those seen. Rows without a variable,
    which no node stops, always are.
    """
    spark, keys = flow.sparkSession, start.columns
    flow, gen, start = cut(flow.distinct(), f"{name}-flow"), cut(gen.select(*_AT, "var").distinct(), f"{name}-gen"), cut(start, f"{name}-start")
    meets = flow.groupBy("unit", F.col("succ").alias("node")).agg(F.count("*").alias("n")).filter("n > 1").select(*_AT)
    meets = cut((meets.unionByName(start.select(*_AT)) if entries else meets).distinct(), f"{name}-meets").select(F.col("unit").alias("u"), F.col("node").alias("m"), F.lit(True).alias("meets"))
    flag = lambda df, end: df.join(meets, (F.col("unit") == F.col("u")) & (F.col(end) == F.col("m")), "left").withColumn("meets", F.col("meets").isNotNull() | F.col(end).isNull()).drop("u", "m")
    steps = cut(flag(flow.select(*_AT, "succ"), "succ"), f"{name}-steps")
    reached = Grown(spark, f"{name}-reached")
    new = reached.add(flag(start, "node").withColumn("meets", F.col("meets") | F.col("var").isNull()))
    once = steps.filter("meets").isEmpty() and new.filter("meets").isEmpty()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = [df.repartition(n, *by).sortWithinPartitions(*by).persist() for df, by in ((steps.withColumnRenamed("meets", "at"), _AT), (gen, [*_AT, "var"]))]
    try:
        for _ in itertools.count() if cap is None else range(cap):
            ahead = new.drop("meets").join(laid[1], [*_AT, "var"], "left_anti").join(laid[0], _AT)
            ahead = ahead.select("unit", F.col("succ").alias("node"), *keys[2:], (F.col("at") | F.col("var").isNull()).alias("meets"))
            if not once:
                old = reached.all().filter("meets").select(*(F.col(k).alias(f"old_{k}") for k in keys))
                met = ahead.filter("meets").distinct()
                met = met.join(old, [F.col(k).eqNullSafe(F.col(f"old_{k}")) for k in keys], "left_anti")
                ahead = ahead.filter("NOT meets").unionByName(met)
            new = reached.add(ahead)
            if new.isEmpty():
                return reached.all().drop("meets"), True
        return reached.all().drop("meets"), False
    finally:
        for df in laid:
            df.unpersist()


def _left(flow: DataFrame, gen: DataFrame) -> DataFrame:
    """(unit, node, var, def_node): definitions where the first step takes them."""
    first = gen.select(*_AT, "var", F.col("node").alias("def_node")).distinct()
    return first.join(flow, _AT).select("unit", F.col("succ").alias("node"), "var", "def_node").distinct()


def reaching_definitions(flow: DataFrame, gen: DataFrame, cap: int | None = None) -> DataFrame:
    """flow(unit, node, succ), gen(unit, node, var) -> (unit, node, var, def_node, converged): what reaches each node's entry.

    A definition leaves its node and goes on until a node defines the variable again. Each round moves only what the last
    one found new, and is written out. With a cap, converged is false where that many rounds weren't enough.
    """
    reached, ended = _flooded(flow, gen, _left(flow, gen), "dataflow-reaching", cap)
    return reached.withColumn("converged", F.lit(ended))


def call_transforms(steps: DataFrame) -> DataFrame:
    """steps(source, target, rank) -> (source, target, rank) over paths: the hardest step along a path, the mildest of all paths.

    Ranks only fall as rounds go on, so a pair changes a few times at most; the loop ends when no pair changes. A round joins
    the best pairs to each other, so paths of twice the length are found in each.
    """
    best = cut(steps.groupBy("source", "target").agg(F.min("rank").alias("rank")), "calls-steps")
    told = lambda df: tuple(df.agg(F.count("*"), F.sum("rank")).first())
    state = told(best)
    while True:
        longer = best.alias("a").join(best.alias("b"), F.col("a.target") == F.col("b.source")).select("a.source", "b.target", F.greatest("a.rank", "b.rank").alias("rank"))
        best = cut(best.unionByName(longer).groupBy("source", "target").agg(F.min("rank").alias("rank")), "calls-best")
        was, state = state, told(best)
        if state == was:
            return best


def maybe_unassigned(flow: DataFrame, entry: DataFrame, gen: DataFrame) -> DataFrame:
    """flow(unit, node, succ), entry(unit, node), gen(unit, node, var) -> (unit, node, var): variables that some way from the entry
    to the node leaves unassigned. What isn't there is assigned on every way (or the node isn't reached at all).
    """
    start = entry.join(gen.select("unit", "var").distinct(), "unit").select("unit", "node", "var").distinct()
    return _flooded(flow, gen, start, "dataflow-unassigned", entries=True)[0]


def uninitialised_uses(flow: DataFrame, entry: DataFrame, gen: DataFrame, uses: DataFrame, parameters: DataFrame) -> DataFrame:
    """uses(unit, node, var), parameters(unit, var) -> (unit, node, var, partial): reads that no definition reaches, or, partial,
    that some way reaches without one. Parameters are assigned by the caller.
    """
    # Whether any definition reaches a node is asked, not which.
    reaching = _flooded(flow, gen, _left(flow, gen).select("unit", "node", "var").distinct(), "dataflow-assigned")[0]
    open_ = maybe_unassigned(flow, entry, gen)
    uses = uses.distinct().join(parameters, ["unit", "var"], "left_anti").select("unit", "node", "var")
    some = uses.join(reaching, ["unit", "node", "var"], "left_semi").join(open_, ["unit", "node", "var"], "left_semi").withColumn("partial", F.lit(True))
    return uses.join(reaching, ["unit", "node", "var"], "left_anti").withColumn("partial", F.lit(False)).unionByName(some)
