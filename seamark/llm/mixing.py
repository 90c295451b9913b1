"""Mixing sources to target weights by capped water-filling, then a seeded choice of whole repetitions.

A null source is a source of its own, last in order; a null text has size 0. Repeated rows are chosen one by one.
Ties in the seeded order fall to doc_id, then size: rows equal in all three are alike. Documents of size 0 take nothing. Very
long texts count whole, and one that is longer than its source's target is taken if that is nearer to it than nothing. An empty
table gives no rows. The sources are summed to a table of one row each before any window without partition sees them: that table
has to fit one task, so there may be millions of sources, but not one for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.llm.common import cut, whole, words, wrapped

#: Weights by the order of the sources, repeating; most repetitions of a source; seed of the order of documents.
WEIGHTS, MAX_EPOCHS, SEED = (1, 2, 3), 3, 20240607
#: Slices of the seeded order in each source; only the slice that holds the limit is sorted.
SLICES = 65_536
#: What the mix adds to documents.
ADDED = ("size", "source_size", "target", "copies", "taken")


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words(whole(text))).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target): one row per source.

    Sources fill at a common level in proportion to their weight; one whose cap lies below the level stays at its cap.
    In the order of cap / weight the capped ones come first, so running sums give every possible level, and the level is
    the first that no later source's cap lies below. The windows are over the table of sources, never over documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = F.row_number().over(by_name) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(every).cast("double"))
    per = per.withColumn("free", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    per = per.withColumn("level", F.col("free") / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    per = per.withColumn("at", level)
    return per.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("at")).alias("target"))


def plan(sized: DataFrame, weights: tuple = WEIGHTS, max_epochs: float = MAX_EPOCHS, slices: int = SLICES) -> DataFrame:
    """sized(source, size, slice) -> one row per source: s0, source_size, target, whole, rest, edge, edge_before.

    edge is the slice of the seeded order in which the rest of the target runs out (one past the last if it never does).
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    goal = targets(sized, weights, max_epochs).withColumnRenamed("source", "s0")
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    per = sized.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    at = per.join(goal.select("s0", "rest"), same("source", "s0")).filter(F.col("before") + F.col("words") > F.col("rest"))
    edge = at.groupBy("s0").agg(F.min(F.struct("slice", "before")).alias("edge")).withColumnRenamed("s0", "s1")
    out = goal.join(edge, same("s0", "s1"), "left")
    return out.select("s0", "source_size", "target", "whole", "rest", F.coalesce("edge.slice", F.lit(slices)).alias("edge"), F.coalesce("edge.before", F.lit(0)).alias("edge_before"))


def keyed(df: DataFrame, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """df(doc_id, size, ...) with __key, its place in the seeded order, and slice, the part of the order it lies in."""
    df = df.withColumn("__key", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")))
    return df.withColumn("slice", F.pmod(F.shiftright("__key", 20), F.lit(slices)).cast("int"))


def copies(df: DataFrame, planned: DataFrame) -> DataFrame:
    """keyed df with source_size, target, copies and taken.

    Every document is taken floor(target / source_size) times. The rest of the target goes to the first documents in the
    seeded order. Slices before the edge are taken and those after it aren't; only the edge slice is sorted, so a source with
    a third of all rows costs no large window. The last document is taken when that brings the source nearer to its target.
    """
    df = df.join(planned, F.col("source").eqNullSafe(F.col("s0")))
    plain = df.filter("slice <> edge").withColumn("extra", (F.col("slice") < F.col("edge")).cast("int"))
    run = Window.partitionBy("source").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = df.filter("slice = edge").withColumn("__at", F.col("edge_before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    last = last.withColumn("extra", (F.col("__at") + F.col("size") / 2 <= F.col("rest")).cast("int")).drop("__at")
    df = plain.unionByName(last)
    df = df.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(F.col("whole")))
    return df.withColumn("taken", F.col("copies") * F.col("size")).drop("s0", "whole", "rest", "edge", "edge_before", "slice", "extra", "__key")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sized = cut(keyed(sizes(docs), seed, slices), "mix-sizes")
    return copies(sized, cut(plan(sized, weights, max_epochs, slices), "mix-plan"))


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """The documents that the mix takes, with all their columns, and the mix's size, source_size, target, copies and taken.

    A column of the input with one of these five names is called own_<name>.
    """
    planned = cut(plan(keyed(sizes(docs), seed, slices), weights, max_epochs, slices), "mix-plan")
    df = wrapped(docs, "doc_id", "source", F.size(words(whole("text"))).cast("long").alias("size"))
    df = copies(keyed(df, seed, slices), planned).filter("copies > 0")
    own = (F.col("doc").getField(c).alias(f"own_{c}" if c in ADDED else c) for c in docs.columns)
    return df.select(*own, *ADDED)
