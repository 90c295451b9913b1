"""Running totals and neighbours in order, for groups of any size: range partitions, and what each carries over to the next.

A window over a group sorts the group in one task. Here rows are dealt by ranges of (group, order), so that a group which holds a
third of all rows takes a third of the tasks; windows run within a range, and a table of one row for each group and range, which is
no longer than groups and ranges together, says what goes before it and what comes after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.frames import cut

#: Names that the functions here use for their own columns.
RANGE = "__range"


def ranges(df: DataFrame, group: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df written in ranges of (group, order), with the number of the range. Rows that are equal there stay together."""
    by = [*group, *order]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return cut(dealt.withColumn(RANGE, F.spark_partition_id()), "ranges")


def scan(df: DataFrame, group: list[str], order: list[str], totals: dict[str, Column] | None = None, after: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """df with running totals and with values of the row after.

    totals: name -> a number that is summed over the group's rows up to and with this one. after: name -> a value of the next
    row of the group, null at its end. Group and order have to name each row uniquely; nulls in a group are a value.
    """
    totals, after = totals or {}, after or {}
    df = ranges(df.withColumns({f"__t_{n}": c for n, c in totals.items()} | {f"__a_{n}": F.struct(c.alias("v")) for n, c in after.items()}), group, order, parts)
    inside = Window.partitionBy(RANGE, *group).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"__s_{n}": F.sum(f"__t_{n}").over(so_far) for n in totals} | {f"__n_{n}": F.lead(f"__a_{n}").over(inside) for n in after})
    place = F.struct(*order) if order else F.lit(0)
    per = df.groupBy(RANGE, *group).agg(*(F.sum(f"__t_{n}").alias(f"__t_{n}") for n in totals), *(F.min_by(f"__a_{n}", place).alias(f"__a_{n}") for n in after), F.lit(1).alias("__one"))
    by_range = Window.partitionBy(*group).orderBy(RANGE)
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        F.col(RANGE).alias("__r"),
        *(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)),
        *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in totals),
        *(F.lead(f"__a_{n}").over(by_range).alias(f"__f_{n}") for n in after),
    )
    same = F.col(RANGE) == F.col("__r")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = out.join(per, same)
    out = out.withColumns({n: F.col(f"__s_{n}") + F.col(f"__c_{n}") for n in totals} | {n: F.coalesce(F.col(f"__n_{n}"), F.col(f"__f_{n}"))["v"] for n in after})
    return out.drop(*(f"__{k}_{n}" for n in totals for k in "tsc"), *(f"__{k}_{n}" for n in after for k in "anf"), *(f"__g{i}" for i in range(len(group))), "__r", RANGE)
