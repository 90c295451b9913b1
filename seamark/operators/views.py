"""Edges through views: every view column is a pointer, and pointers are doubled until they reach a base column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.frames import cut

#: Views of views are followed so far.
CAP = 10


def relation(name: Column) -> Column:
    """What stands before the last dot; the name itself where there is none."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)


def bases(definitions: DataFrame, cap: int = CAP) -> DataFrame:
    """definitions(name, base), a view's column and the column it shows -> (name, base, hops, state).

    state: base, with the base column and the number of views passed; unknown, where a way ends in a null (an expression, or a
    text that can't be had); deep, where it is longer than cap; cycle, where it never ends. Only base has a base.

    Every round joins the pointers that still point at a view to what that one points at, so rounds are the logarithm of the
    longest way; what points at a view when ways of all names' number are passed goes round in a cycle. Of several definitions
    of a column, the first by name counts. Null names count for nothing. Joins are by merge, as both sides grow with the names,
    whose files look small enough to be broadcast through the driver.
    """
    p = definitions.filter("name IS NOT NULL").groupBy("name").agg(F.min("base").alias("to")).withColumn("hops", F.lit(1).cast("long"))
    p = cut(p, "views-pointers")
    n, passed = p.count(), 1
    while passed <= n:
        ahead = p.select(F.col("name").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"), F.lit(True).alias("open"))
        p = cut(p.select("name", "to", "hops").join(ahead.hint("merge"), "to", "left").select("name", F.when(F.col("open"), F.col("next")).otherwise(F.col("to")).alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("open", F.lit(False)).alias("open")), "views-pointers")
        passed *= 2
        if p.filter("open").isEmpty():
            break
    p = p.select("name", "to", "hops").join(p.select(F.col("name").alias("to"), F.lit(True).alias("round")).hint("merge"), "to", "left")
    state = F.when(F.col("round"), "cycle").when(F.col("hops") > cap, "deep").when(F.col("to").isNull(), "unknown").otherwise("base")
    return p.select("name", F.when(state == "base", F.col("to")).alias("base"), F.when(state != "cycle", F.col("hops")).alias("hops"), state.alias("state"))


def rewritten(edges: DataFrame, definitions: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """edges(id, type, source, target) -> the same edges on base names, and (id, side, name, reason) of the ends that stay a view's.

    A view's column becomes its base column. A view as a relation becomes the relation of the other end's base column where that end
    is a column of the same view, else the one base relation of all its columns; with none or several it stays, and is told.
    """
    found = cut(bases(definitions, cap), "views-bases")
    view = found.groupBy(relation(F.col("name")).alias("view")).agg(F.min(relation(F.col("base"))).alias("only"), F.max(relation(F.col("base"))).alias("last"))
    view = cut(view.select("view", F.when(F.col("only") == F.col("last"), F.col("only")).alias("only"), F.when(F.col("only").isNull(), "no base").otherwise("several bases").alias("why")), "views-relations")
    df = edges.select("id", "type", "source", "target")
    for side in ("source", "target"):
        of = found.select(F.col("name").alias(side), F.col("base").alias(f"{side}_base"), F.col("state").alias(f"{side}_state"))
        rel = view.select(F.col("view").alias(side), F.col("only").alias(f"{side}_only"), F.col("why").alias(f"{side}_why"))
        df = df.join(of.hint("merge"), side, "left").join(rel, side, "left")
    for side, other in (("source", "target"), ("target", "source")):
        same = (F.col(f"{other}_state") == "base") & (relation(F.col(other)) == F.col(side))
        to = F.when(F.col(f"{side}_state") == "base", F.col(f"{side}_base")).when(F.col(f"{side}_why").isNotNull() & same, relation(F.col(f"{other}_base"))).when(F.col(f"{side}_why").isNotNull(), F.col(f"{side}_only"))
        why = F.when(F.col(f"{side}_state").isNotNull() & (F.col(f"{side}_state") != "base"), F.col(f"{side}_state")).when(F.col(f"{side}_why").isNotNull() & to.isNull(), F.col(f"{side}_why"))
        df = df.withColumns({f"{side}_to": F.coalesce(to, F.col(side)), f"{side}_left": why})
    df = cut(df, "views-edges")
    out = df.select("id", "type", F.col("source_to").alias("source"), F.col("target_to").alias("target"))
    left = [df.filter(f"{s}_left IS NOT NULL").select("id", F.lit(s).alias("side"), F.col(s).alias("name"), F.col(f"{s}_left").alias("reason")) for s in ("source", "target")]
    return out, left[0].unionByName(left[1])
