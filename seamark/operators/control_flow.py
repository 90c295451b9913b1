"""Conditions that guard the nodes of control-flow graphs held as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.frames import Grown, cut

_AT = ["unit", "node"]


def guards(flow: DataFrame, entry: DataFrame) -> DataFrame:
    """flow(unit, node, succ, label), entry(unit, node) -> (unit, node, label): the labels that lie on every way from the entry to the node.

    A label is the condition that holds where its edge is taken, or null. The guards of a node are among the labels of any one
    way to it, so those of a shortest way are where it starts: a walk from the entries gives each node the labels of its
    first predecessor and its own edge's. Then labels go: one goes where an edge comes in that doesn't bear it from a node that
    hasn't it, and only what went last is looked at again. What is left holds on all ways, also through loops, and no set ever
    grows beyond one way's labels. Rounds follow the depth of the graph; each is written.

    Edges are laid out by their node once, and first labels by theirs, so a round moves only what the last one found new, and what
    was seen at nodes that may be met again: those with several edges coming in, and entries.

    Nodes that no way reaches have no guards, nor have entries. Repeated edges and nulls in unit or node, which join to nothing,
    change nothing.
    """
    spark = flow.sparkSession
    flow = cut(flow.select("unit", "node", "succ", "label").dropna(subset=["unit", "node", "succ"]).distinct(), "guards-flow")
    entry = cut(entry.select(*_AT).dropna().distinct(), "guards-entry")
    meets = flow.select("unit", F.col("succ").alias("node")).groupBy(*_AT).agg(F.count("*").alias("n")).filter("n > 1").select(*_AT)
    meets = meets.unionByName(entry).distinct().select(F.col("unit").alias("u"), F.col("node").alias("m"), F.lit(True).alias("meets"))
    steps = flow.withColumnRenamed("label", "own").join(meets.hint("merge"), (F.col("unit") == F.col("u")) & (F.col("succ") == F.col("m")), "left")
    steps = cut(steps.select(*_AT, "succ", "own", F.col("meets").isNotNull().alias("meets")), "guards-steps")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lay = lambda df, *by: df.repartition(n, *by).sortWithinPartitions(*by).persist()
    laid = [lay(steps, *_AT)]
    try:
        reached, first, gone = Grown(spark, "guards-reached"), Grown(spark, "guards-first"), Grown(spark, "guards-gone")
        types = {f.name: f.dataType for f in flow.schema}
        none = lambda c: F.lit(None).cast(types[c])
        front = reached.add(entry.select(*_AT, none("node").alias("from"), none("label").alias("own"), F.lit(True).alias("meets")))
        held = first.add(front.select(*_AT, F.col("own").alias("label")).limit(0))
        while True:
            ahead = laid[0].join(front.select(*_AT).hint("merge"), _AT).groupBy("unit", "succ").agg(F.min(F.struct("node", "own")).alias("by"), F.max("meets").alias("meets"))
            ahead = ahead.select("unit", F.col("succ").alias("node"), F.col("by.node").alias("from"), F.col("by.own").alias("own"), "meets")
            front = reached.add(ahead.join(reached.all().filter("meets").select(*_AT).hint("merge"), _AT, "left_anti"))
            if front.isEmpty():
                break
            along = held.withColumnRenamed("node", "from").join(front.select(*_AT, "from", "own").hint("merge"), ["unit", "from"]).filter(~F.col("own").eqNullSafe(F.col("label")))
            held = first.add(along.select(*_AT, "label").unionByName(front.filter("own IS NOT NULL").select(*_AT, F.col("own").alias("label"))))
        held, key = first.all(), [*_AT, "label"]
        laid.append(lay(held, *key))
        # An edge into a node that may take a label from it: from a node that is reached, not bearing the label itself. Where one edge
        # comes in, the labels came along it.
        edges = steps.filter("meets").join(reached.all().select(*_AT).hint("merge"), _AT, "left_semi").select("unit", F.col("node").alias("from"), F.col("succ").alias("node"), "own")
        bare = held.join(edges.hint("merge"), _AT).filter(~F.col("own").eqNullSafe(F.col("label"))).select("unit", "node", "label", "from")
        kept = laid[1].withColumnRenamed("node", "from")
        lost = bare.join(kept.hint("merge"), ["unit", "from", "label"], "left_anti").select(*key).distinct()
        lost = gone.add(lost.withColumn("meets", F.lit(True)))
        while not lost.isEmpty():
            on = laid[0].join(lost.select(*key).hint("merge"), _AT).filter(~F.col("own").eqNullSafe(F.col("label")))
            on = on.groupBy("unit", F.col("succ").alias("node"), "label").agg(F.max("meets").alias("meets")).join(laid[1].hint("merge"), key, "left_semi")
            lost = gone.add(on.join(gone.all().filter("meets").select(*key).hint("merge"), key, "left_anti"))
        return held.join(gone.all().select(*key), key, "left_anti").select(*key)
    finally:
        for df in laid:
            df.unpersist()
