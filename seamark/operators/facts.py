"""Lineage facts derived from the data tables: graphs, labels, logs and sightings that the graph and measurement queries run on.

The entities of the order tables serve as columns of relations: an order feeds its lines' parts, a part its supplier, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.frames import table

#: Types by the remainder of a key (fixed values).
KINDS = ("FEEDS", "INFLUENCES", "KEYS", "FILTERS", "FEEDS", "MENTIONS_COL", "OPAQUE")


def name(kind: str, relation: Column, key: Column) -> Column:
    """kind<relation>.<key>"""
    return F.concat(F.lit(kind), relation.cast("string"), F.lit("."), key.cast("string"))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(id, type, source, target): customers feed nations, nations regions, suppliers nations, orders customers, parts suppliers.

    Each id of an edge without nulls occurs once.
    """
    c, n, s = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = lambda c: F.col(c).cast("long")
    lines = li.groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("k"))
    # Table, key that tells the type, key of the source and of the target, with the relations' kinds and numbers of relations.
    arms = [
        (n, "n_nationkey", ("nation", 5, "n_nationkey"), ("region", 1, "n_regionkey")),
        (c, "c_custkey", ("customer", 10, "c_custkey"), ("nation", 5, "c_nationkey")),
        (s, "s_suppkey", ("supplier", 3, "s_suppkey"), ("nation", 5, "s_nationkey")),
        (o, "o_orderkey", ("orders", 30, "o_orderkey"), ("customer", 10, "o_custkey")),
        (lines, "k", ("part", 20, "l_partkey"), ("supplier", 3, "l_suppkey")),
    ]
    # Edges are made distinct as numbers, ahead of their names.
    out, kinds = None, ("nation", "region", "customer", "supplier", "orders", "part")
    for i, (df, k, (of, m, source), (to, r, target)) in enumerate(arms):
        kind = F.pmod(key(k) + i, F.lit(len(KINDS)))
        whole = F.coalesce(kind.isin([j for j, x in enumerate(KINDS) if x in ("FILTERS", "OPAQUE")]), F.lit(False))
        code = lambda c, x: F.when(F.col(c).isNotNull(), F.lit(kinds.index(x)))
        df = df.select(
            F.get(F.array(*(F.lit(KINDS.index(x)) for x in KINDS)), kind.cast("int")).alias("kind"), code(source, of).alias("of"), F.pmod(key(source), F.lit(m)).alias("of_no"), key(source).alias("source"),
            code(target, to).alias("to"), F.pmod(key(target), F.lit(r)).alias("to_no"), F.when(~whole, key(target)).alias("target"),
        )
        out = df if out is None else out.unionByName(df)
    text = lambda names, c: F.get(F.array(*map(F.lit, names)), F.col(c))  # null for a null, which element_at() of plain values isn't
    whole = F.concat(text(kinds, "to"), F.col("to_no").cast("string"))
    target = F.when(F.col("target").isNull(), whole).otherwise(F.concat(whole, F.lit("."), F.col("target").cast("string")))
    source = F.concat(text(kinds, "of"), F.col("of_no").cast("string"), F.lit("."), F.col("source").cast("string"))
    out = out.distinct().select(text(KINDS, "kind").alias("type"), source.alias("source"), target.alias("target"))
    return out.select(F.concat_ws("|", "type", "source", "target").alias("id"), "type", "source", "target")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled facts, one per order line: (source, target, flow, transform, phase, guard, band)."""
    li = table(spark, sf_dir, "lineitem")
    flow = F.element_at(F.array(*map(F.lit, ("value", "filter", "influence"))), (F.pmod("l_partkey", F.lit(3)) + 1).cast("int"))
    return li.select(
        F.concat(F.lit("p"), F.pmod("l_partkey", F.lit(500))).alias("source"),
        F.concat(F.lit("s"), "l_suppkey").alias("target"),
        flow.alias("flow"),
        F.when(F.col("l_linenumber") % 2 == 0, "identity").otherwise("derived").alias("transform"),
        F.when(flow == "filter", "pre").alias("phase"),
        F.when(F.col("l_linenumber") > 3, F.concat(F.lit("g"), F.col("l_linenumber") % 3)).alias("guard"),
        F.pmod("l_suppkey", F.lit(3)).cast("int").alias("band"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth with every seventh part left out, every eleventh guard lost and every thirteenth band off by one."""
    li = truth(spark, sf_dir).withColumn("n", F.substring("source", 2, 9).cast("int")).filter("n % 7 <> 0")
    return li.withColumns({"guard": F.when(F.col("n") % 11 == 0, F.lit("other")).otherwise(F.col("guard")), "band": F.when(F.col("n") % 13 == 0, (F.col("band") + 1) % 3).otherwise(F.col("band"))}).drop("n")
