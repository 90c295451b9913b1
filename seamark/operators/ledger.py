"""Ledgers: facts with valid time that supersede each other, and what became of each statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.functions.texts import transform_name, transform_rank


def supersede(facts: DataFrame, key: list[str], at: str = "valid_from", tie: str = "id") -> DataFrame:
    """facts with valid_to: the start of the next fact of the same key, or null for the current one. Ties follow `tie`."""
    return facts.withColumn("valid_to", F.lead(at).over(Window.partitionBy(*key).orderBy(at, tie)))


def current(facts: DataFrame) -> DataFrame:
    return facts.filter("valid_to IS NULL")


def as_of(facts: DataFrame, when: Column) -> DataFrame:
    """Facts valid at a time: begun, and not yet ended. One that ends when it begins was never valid."""
    return facts.filter((F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when)))


def hardest(facts: DataFrame, key: list[str]) -> DataFrame:
    """One fact per key with the hardest of its transforms."""
    return facts.groupBy(*key).agg(F.max(transform_rank(F.col("transform"))).alias("r")).select(*key, transform_name(F.col("r")).alias("transform"))


def statement_status(statements: DataFrame, edges: DataFrame, refusals: DataFrame, boundaries: DataFrame) -> DataFrame:
    """statements(unit, line, end_line, valid) -> (unit, line, status, n_edges).

    edges, refusals, boundaries(unit, line): a fact belongs to the statement whose lines hold it. Lines are spread over the
    statement's span, so the join is on (unit, line) and not on a range. Never silent: the last status is nothing_to_trace.
    """
    spread = statements.select("unit", F.col("line").alias("first"), F.explode(F.sequence("line", F.greatest("line", F.coalesce("end_line", "line")))).alias("line"))

    def counted(facts: DataFrame, name: str) -> DataFrame:
        per = facts.groupBy("unit", "line").agg(F.count("*").alias("n"))
        return spread.join(per, ["unit", "line"]).groupBy("unit", F.col("first").alias("line")).agg(F.sum("n").alias(name))

    df = statements.select("unit", "line", "valid")
    for facts, name in ((edges, "n_edges"), (refusals, "n_refusals"), (boundaries, "n_boundaries")):
        df = df.join(counted(facts, name), ["unit", "line"], "left")
    df = df.fillna(0, ["n_edges", "n_refusals", "n_boundaries"])
    has = lambda c: F.col(c) > 0
    status = F.when(~F.col("valid"), "not_valid").when(has("n_edges") & has("n_refusals"), "partial").when(has("n_edges"), "column_level").when(has("n_refusals"), "refused").when(has("n_boundaries"), "declared")
    return df.select("unit", "line", status.otherwise("nothing_to_trace").alias("status"), "n_edges")


def fusion_hazards(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """writes, reads(relation, unit) -> (relation, n_writers, n_readers) of relations that carry one unit's data into another.

    A relation is one if it is read and two units write it, or a unit reads it that doesn't write it.
    """
    w, r = writes.distinct(), reads.distinct()
    foreign = r.join(w, ["relation", "unit"], "left_anti").groupBy("relation").agg(F.count("*").alias("n_foreign"))
    df = w.groupBy("relation").agg(F.count("*").alias("n_writers")).join(r.groupBy("relation").agg(F.count("*").alias("n_readers")), "relation")
    df = df.join(foreign, "relation", "left").filter("n_writers >= 2 OR n_foreign > 0")
    return df.select("relation", "n_writers", "n_readers")


def summary(ledger: DataFrame) -> DataFrame:
    """ledger(file, status) -> (file, status, n, share): statements of each status, a null one as unclassified, and their share of the file."""
    per = ledger.groupBy("file", F.coalesce("status", F.lit("unclassified")).alias("status")).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("file")))
