"""Window frames over peer groups: GROUPS BETWEEN with all forms of EXCLUDE.

Peers are the rows of a partition with one value of the order. They are aggregated first, in part before the exchange; frames of
groups are then frames of rows over that smaller table; and each row gets its frame's values with its group's, from which what is
excluded is taken away: a row or a group from sums, and for the extremes the group's two outermost values tell what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXCLUDE = ("NO OTHERS", "CURRENT ROW", "GROUP", "TIES")


def over_groups(df: DataFrame, partition: list[str], order: str, value: str, before: int | None, after: int | None, exclude: str = "NO OTHERS", descending: bool = False, prefix: str = "") -> DataFrame:
    """df with n, total, mean, least and most (with prefix) of value over GROUPS BETWEEN before PRECEDING AND after FOLLOWING.

    before and after are numbers of groups, negative ones on the other side, None without bound. Null values aren't counted; sums
    of none are null, as in SQL. A null order value is a group, the first; null partitions are one. An empty frame gives n = 0.
    """
    if exclude not in EXCLUDE:
        raise ValueError(f"exclude has to be one of {EXCLUDE}")
    lo, hi = Window.unboundedPreceding if before is None else -before, Window.unboundedFollowing if after is None else after
    v = F.col(value)
    # The two outermost values of a group, equal ones told apart, say what is left when one row goes.
    ends = {"a": F.min(v), "b": F.max(v)}
    groups = df.groupBy(*partition, order).agg(F.count(v).alias("__n"), F.sum(v).alias("__t"), *(c.alias(f"__{k}1") for k, c in ends.items()))
    outer = df.join(groups.select(*(F.col(c).alias(f"__p{i}") for i, c in enumerate(partition)), F.col(order).alias("__o"), "__a1", "__b1"), _same(partition, order), "inner")
    second = outer.groupBy(*partition, order).agg(
        F.count_if(v == F.col("__a1")).alias("__an"), F.count_if(v == F.col("__b1")).alias("__bn"), F.min(F.when(v > F.col("__a1"), v)).alias("__a2"), F.max(F.when(v < F.col("__b1"), v)).alias("__b2")
    )
    groups = groups.join(second.select(*(F.col(c).alias(f"__p{i}") for i, c in enumerate(partition)), F.col(order).alias("__o"), "__an", "__bn", "__a2", "__b2"), _same(partition, order)).drop(*(f"__p{i}" for i in range(len(partition))), "__o")
    by = Window.partitionBy(*partition).orderBy(F.desc_nulls_first(order) if descending else F.asc_nulls_first(order))
    framed = lambda x, y: by.rowsBetween(x, y)
    own = (lo <= 0 <= hi) if lo <= hi else False
    whole = framed(lo, hi) if lo <= hi else None
    get = lambda f, c, w: f(c).over(w) if w is not None else F.lit(None).cast(groups.schema[c].dataType)
    left, right = (framed(lo, -1) if own and lo < 0 else None), (framed(1, hi) if own and hi > 0 else None)
    groups = groups.withColumns({
        "__fn": F.coalesce(get(F.sum, "__n", whole), F.lit(0)), "__ft": get(F.sum, "__t", whole), "__fa": get(F.min, "__a1", whole), "__fb": get(F.max, "__b1", whole),
        # Without the own group.
        "__oa": F.least(get(F.min, "__a1", left), get(F.min, "__a1", right)), "__ob": F.greatest(get(F.max, "__b1", left), get(F.max, "__b1", right)),
    })
    kept = groups.select(*(F.col(c).alias(f"__p{i}") for i, c in enumerate(partition)), F.col(order).alias("__o"), *(c for c in groups.columns if c.startswith("__")))
    out = df.join(kept, _same(partition, order))
    one, mine = F.when(v.isNotNull(), 1).otherwise(0), F.coalesce(v, F.lit(0))
    none = F.lit(0)
    if not own or exclude == "NO OTHERS":
        less_n, less_t = none, none
    elif exclude == "CURRENT ROW":
        less_n, less_t = one, mine
    elif exclude == "GROUP":
        less_n, less_t = F.col("__n"), F.coalesce("__t", none)
    else:
        less_n, less_t = F.col("__n") - one, F.coalesce("__t", none) - mine
    n = (F.col("__fn") - less_n).cast("long")
    total = F.when(n > 0, F.col("__ft") - less_t)

    def extreme(k: str, pick) -> F.Column:
        """The frame's least or most value when what is excluded is gone."""
        if not own or exclude == "NO OTHERS":
            return F.col(f"__f{k}")
        if exclude == "GROUP":
            return F.col(f"__o{k}")
        if exclude == "TIES":
            return pick(F.col(f"__o{k}"), v)
        rest = F.when((v == F.col(f"__{k}1")) & (F.col(f"__{k}n") == 1), F.col(f"__{k}2")).otherwise(F.col(f"__{k}1"))
        return pick(F.col(f"__o{k}"), rest)

    names = {"n": n, "total": total, "mean": total / n, "least": extreme("a", F.least), "most": extreme("b", F.greatest)}
    return out.select(*df.columns, *(F.when(n > 0, c).alias(f"{prefix}{k}") if k in ("least", "most", "mean") else c.alias(f"{prefix}{k}") for k, c in names.items()))


def _same(partition: list[str], order: str):
    on = F.col(order).eqNullSafe(F.col("__o"))
    for i, c in enumerate(partition):
        on &= F.col(c).eqNullSafe(F.col(f"__p{i}"))
    return on
