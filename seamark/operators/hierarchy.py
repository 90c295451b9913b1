"""Recursive traversal of a hierarchy held as rows, with search order and cycle marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.frames import Grown, cut


def traverse(links: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """links(parent, child), roots(id) -> (id, level, path, is_cycle, breadth, depth): every way from a root, a row for each node on it.

    path holds the ids from the root to the row's own. A row whose id is on its path before is_cycle and isn't followed further,
    so every traversal ends; `most` bounds the levels besides. breadth and depth are keys to order by, as SEARCH BREADTH FIRST and
    DEPTH FIRST BY id do: breadth has the level first, depth is the path, under which a parent comes right before its children.

    A round joins the last level's rows to the links and is written. Ways that meet again stay rows each, as for UNION ALL.
    Repeated links and roots give their rows again, a null root is a row without children, null ends join to nothing, and a link to
    itself gives one row that is_cycle.
    """
    links = cut(links.select(F.col("parent").alias("__p"), F.col("child").alias("__c")), "hierarchy-links")
    found = Grown(links.sparkSession, "hierarchy")
    front = found.add(roots.select("id", F.lit(0).alias("level"), F.array("id").alias("path"), F.lit(False).alias("is_cycle")))
    level = 0
    while (most is None or level < most) and not front.isEmpty():
        level += 1
        # Files of small keys look small, so links would be sent to the driver and broadcast in each round.
        ahead = front.filter("NOT is_cycle").join(links.hint("merge"), F.col("id") == F.col("__p"))
        front = found.add(ahead.filter("__c IS NOT NULL").select(F.col("__c").alias("id"), F.lit(level).alias("level"), F.array_append("path", F.col("__c")).alias("path"), F.array_contains("path", F.col("__c")).alias("is_cycle")))
    return found.all().withColumns({"breadth": F.struct("level", "id"), "depth": F.col("path")})


def rolled_up(rows: DataFrame, value: Column) -> DataFrame:
    """Rows of traverse() with a value -> (id, total): what lies at and below each node, each way counted, cycles once.

    Every row says its value to all ids on its path, so it takes one aggregation and no walk back.
    """
    said = rows.filter("NOT is_cycle").select(F.explode("path").alias("id"), value.alias("v"))
    return said.groupBy("id").agg(F.sum("v").alias("total"))
