"""Joins and sets of intervals: spans that hold points, the innermost span of a site, and the algebra of range sets.

Positions are whole numbers. A span [start, stop], both included, is taken apart into at most two pieces for each power of two: the
aligned blocks of that length which make it up. A point lies in one block of each length. So spans and points are joined by equal
blocks, a span of a million lines takes at most forty rows, and each pair is found once.

Spans with a null end or stop < start hold nothing; points without position lie in nothing; a null group is a group of its own
and meets only itself. Equal spans and points are rows each.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.frames import cut
from seamark.operators import scans

#: Positions of a block of the sweep.
WIDTH = 1024
#: Spans of a group up to which its points are held against each of them: about as many as a point has blocks.
FEW = 16


def blocks(start: Column, stop: Column) -> Column:
    """array<struct<level, no>>: the aligned blocks of 2^level positions that make up [start, stop]."""

    def step(acc: Column, level: Column) -> Column:
        # What is left is [a, b) in blocks of this level: an odd end goes off, the rest doubles.
        a, b = acc["a"], acc["b"]
        left, right = (a < b) & (a.bitwiseAND(1) == 1), (a < b) & (b.bitwiseAND(1) == 1)
        out = F.concat(acc["out"], F.when(left, F.array(_block(level, a))).otherwise(_none()))
        out = F.concat(out, F.when(right & (b - 1 >= a + left.cast("long")), F.array(_block(level, b - 1))).otherwise(_none()))
        a, b = a + left.cast("long"), b - right.cast("long")
        return F.struct(F.shiftright(a, 1).alias("a"), F.shiftright(F.greatest(a, b), 1).alias("b"), out.alias("out"))

    init = F.struct(start.cast("long").alias("a"), (stop.cast("long") + 1).alias("b"), _none().alias("out"))
    # As many levels as the length has bits.
    levels = F.sequence(F.lit(0), F.length(F.bin(F.greatest(stop - start + 1, F.lit(1)).cast("long"))))
    return F.when(start <= stop, F.aggregate(levels, init, step, lambda acc: acc["out"])).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<level:int,no:bigint>>")


def _block(level: Column, no: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), no.cast("long").alias("no"))


def holding(points: DataFrame, spans: DataFrame, group: str = "unit", at: str = "line", start: str = "line", stop: str = "end_line") -> DataFrame:
    """points(group, at, ...), spans(group, start, stop, ...) -> (point, span) as structs: each pair where the span holds the point.

    In a group of FEW spans or fewer a point is held against each of them; elsewhere points and spans meet by blocks.
    """
    of = lambda df, name, *more: df.select(F.struct(*df.columns).alias(name), F.struct(F.col(group).alias("g")).alias("g"), *more)
    s = cut(of(spans.filter(F.col(start) <= F.col(stop)), "span", F.col(start).alias("from"), F.col(stop).alias("to")), "spans")
    p = of(points.filter(F.col(at).isNotNull()), "point", F.col(at).cast("long").alias("at"))
    crowded = cut(s.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > FEW).select(F.col("g").alias("c")), "crowded-groups")
    meets = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    s1 = s.join(crowded, meets("g", "c"), "left_anti").withColumnRenamed("g", "sg")
    near = p.join(s1, meets("g", "sg") & F.col("at").between(F.col("from"), F.col("to"))).select("point", "span")
    if crowded.isEmpty():
        return near
    s2 = s.join(crowded, meets("g", "c"), "left_semi").select("span", F.col("g").alias("sg"), F.explode(blocks(F.col("from"), F.col("to"))).alias("b"))
    s2 = cut(s2.select("span", "sg", "b.level", "b.no"), "span-blocks")
    levels = [r.level for r in s2.select("level").distinct().collect()]  # 64 at most
    p2 = p.join(crowded, meets("g", "c"), "left_semi").select("point", F.col("g").alias("pg"), F.explode(F.array(*(_block(F.lit(x), F.shiftright("at", x)) for x in levels))).alias("b"))
    p2 = p2.select("point", "pg", F.col("b.level").alias("pl"), F.col("b.no").alias("pn"))
    return near.unionByName(p2.join(s2, (F.col("pl") == F.col("level")) & (F.col("pn") == F.col("no")) & meets("pg", "sg")).select("point", "span"))


def contradictions(refused: DataFrame, edges: DataFrame) -> DataFrame:
    """refused(id, unit, line, end_line), edges(id, unit, line) -> (refusal, n_edges, first): refused spans that still have edges.

    A span without end_line is its line alone. Units are compared as they are written. first is the smallest edge id.
    """
    spans = refused.select("id", "unit", F.col("line").cast("long").alias("line"), F.coalesce("end_line", "line").cast("long").alias("end_line"))
    pairs = holding(edges.select("id", "unit", F.col("line").cast("long").alias("line")), spans)
    return pairs.groupBy(F.col("span.id").alias("refusal")).agg(F.count("*").alias("n_edges"), F.min("point.id").alias("first"))


def innermost(sites: DataFrame, spans: DataFrame, group: str = "unit", at: str = "line", width: int = WIDTH) -> DataFrame:
    """sites(group, at), spans(id, group, start, stop) -> sites with start, stop, span (the id) and n_equal: the innermost span of each.

    The innermost span is the one that starts last; of several the shortest; of equal ones the smallest id, and n_equal says how
    many there are. For nested spans that is the usual sense; spans may also cross, touch or repeat. Sites outside of all keep nulls.

    Positions are cut into blocks of `width`. A block is swept with those spans that begin or end in it; of spans that begin there and
    go on, each start keeps its shortest, of those that come from before, each stop keeps the one that starts last, so a block's
    work is bounded by its width. Of the spans that cover a block whole only the last start counts: spans say it at the blocks
    of powers of two that they cover, and a block asks those it lies in.
    """
    sites = sites.withColumn("__at", F.col(at).cast("long"))
    given = spans.filter("start <= stop").groupBy(group, F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).agg(F.min("id").alias("span"), F.count("*").alias("n_equal"))
    given = cut(given, "innermost-spans")
    no = lambda c: F.floor(c / F.lit(width)).cast("long")
    of = given.withColumns({"b0": no(F.col("start")), "b1": no(F.col("stop"))})
    here = of.filter("b0 = b1").select(group, F.col("b0").alias("block"), "start", "stop")
    goes = of.filter("b0 < b1").groupBy(group, F.col("b0").alias("block"), "start").agg(F.min("stop").alias("stop"))
    comes = of.filter("b0 < b1").groupBy(group, F.col("b1").alias("block"), "stop").agg(F.max("start").alias("start"))
    near = here.unionByName(goes).unionByName(comes)
    asked = sites.filter("__at IS NOT NULL").select(group, "__at").distinct().withColumn("block", no(F.col("__at")))
    # Blocks that a span covers whole; of spans with one start the shortest counts, of all the last start.
    best = F.max_by(F.struct("start", "stop"), F.struct("start", -F.col("stop")))
    covers = of.filter("b1 - b0 > 1").select(group, "start", "stop", F.explode(blocks(F.col("b0") + 1, F.col("b1") - 1)).alias("b")).select(group, "start", "stop", "b.level", "b.no")
    covers = cut(covers.groupBy(group, "level", "no").agg(best.alias("s")), "innermost-covers")
    levels = [r.level for r in covers.select("level").distinct().collect()]  # 64 at most
    mine = asked.select(group, "block").distinct()
    if levels:
        up = mine.select(F.col(group).alias("__ug"), F.col("block").alias("__ub"), F.explode(F.array(*(_block(F.lit(x), F.shiftright("block", x)) for x in levels))).alias("u"))
        on = F.col("__ug").eqNullSafe(F.col(group)) & (F.col("u.level") == F.col("level")) & (F.col("u.no") == F.col("no"))
        over = up.join(covers, on).groupBy(F.col("__ug").alias(group), F.col("__ub").alias("block")).agg(F.max_by("s", F.struct("s.start", -F.col("s.stop"))).alias("s"))
        near = near.unionByName(over.select(group, "block", "s.start", "s.stop"))
    kind = given.schema[group].dataType.simpleString()
    # Block by block, in the order of positions, a span's start ahead of a site there.
    at_start = near.select(F.col(group).alias("g"), "block", F.col("start").alias("pos"), F.lit(0).alias("site"), "stop")
    events = at_start.unionByName(asked.select(F.col(group).alias("g"), "block", F.col("__at").alias("pos"), F.lit(1).alias("site"), F.lit(None).cast("long").alias("stop")))
    events = events.repartition("g", "block").sortWithinPartitions("g", "block", "pos", "site")
    swept = events.mapInArrow(_swept, f"__h {kind}, __x long, start long, stop long")
    named = swept.join(given.withColumnsRenamed({group: "__g", "start": "__a", "stop": "__b"}), F.col("__h").eqNullSafe(F.col("__g")) & (F.col("start") == F.col("__a")) & (F.col("stop") == F.col("__b")))
    named = named.select("__h", "__x", "start", "stop", "span", "n_equal")
    return sites.join(named, F.col(group).eqNullSafe(F.col("__h")) & (F.col("__at") == F.col("__x")), "left").drop("__h", "__x", "__at")


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events in order -> each site that some open span holds, with the span. What is open is carried from batch to batch."""
    block, open_ = None, []
    for batch in batches:
        out: list[tuple] = []
        for g, no, pos, site, stop in zip(*(batch.column(c).to_pylist() for c in ("g", "block", "pos", "site", "stop")), strict=True):
            if (g, no) != block:
                block, open_ = (g, no), []
            if not site:
                heappush(open_, (-pos, stop))
                continue
            # The last start is on top; a span that has ended is gone for all sites to come.
            while open_ and open_[0][1] < pos:
                heappop(open_)
            if open_:
                out.append((g, pos, -open_[0][0], open_[0][1]))
        kinds = (batch.schema.field("g").type, *[pa.int64()] * 3)
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["__h", "__x", "start", "stop"])


# ---- range sets ----


def lower(value: Column, included: Column) -> Column:
    """The place where a range begins: null is unbounded. Places are ordered; just before a value comes ahead of just after it."""
    return F.struct(F.when(value.isNull(), -1).otherwise(0).alias("far"), value.alias("v"), F.when(value.isNull() | included, 0).otherwise(1).alias("past"))


def upper(value: Column, included: Column) -> Column:
    """The place where a range ends."""
    return F.struct(F.when(value.isNull(), 1).otherwise(0).alias("far"), value.alias("v"), F.when(value.isNotNull() & included, 1).otherwise(0).alias("past"))


def _combined(sets: list[DataFrame], holds, group: str, parts: int | None) -> DataFrame:
    """The ranges where holds(number of open ranges of each set) is true, as few as possible."""
    events = None
    for i, df in enumerate(sets):
        places = df.select(F.struct(F.col(group).alias("g")).alias("k"), lower(F.col("lo"), F.col("lo_in")).alias("a"), upper(F.col("hi"), F.col("hi_in")).alias("b")).filter("a < b")
        end = lambda c, n, i=i: places.select("k", F.col(c).alias("at"), *(F.lit(n if i == j else 0).cast("long").alias(f"d{j}") for j in range(len(sets))))  # noqa: B023, E731
        both = end("a", 1).unionByName(end("b", -1))
        events = both if events is None else events.unionByName(both)
    deltas = [f"d{j}" for j in range(len(sets))]
    events = events.groupBy("k", "at").agg(*(F.sum(d).alias(d) for d in deltas))
    swept = scans.scan(events, ["k"], ["at"], totals={f"n{j}": F.col(d) for j, d in enumerate(deltas)}, parts=parts)
    state = holds(*(F.col(f"n{j}") > 0 for j in range(len(sets))))
    was = holds(*(F.col(f"n{j}") - F.col(d) > 0 for j, d in enumerate(deltas)))
    # Places where it turns; they alternate, so a turn to true ends at the next one.
    turns = scans.scan(swept.filter(state != was).select("k", "at", state.alias("holds")), ["k"], ["at"], after={"end": F.col("at")}, parts=parts)
    return turns.filter("holds").select(
        F.col("k.g").alias(group), F.col("at.v").alias("lo"), F.col("end.v").alias("hi"),
        ((F.col("at.far") == 0) & (F.col("at.past") == 0)).alias("lo_in"), ((F.col("end.far") == 0) & (F.col("end.past") == 1)).alias("hi_in"),
    )


def coalesced(ranges: DataFrame, group: str = "id", parts: int | None = None) -> DataFrame:
    """ranges(group, lo, hi, lo_in, hi_in) -> the same set in as few ranges as possible, (group, lo, hi, lo_in, hi_in).

    A null end is unbounded (and never included); ranges that are empty, as [x, x) or (x, x), add nothing; ranges that touch, as
    [1, 2) and [2, 3], become one, while [1, 2) and (2, 3] don't. A null in lo_in or hi_in counts as not included.
    """
    return _combined([_plain(ranges, group)], lambda a: a, group, parts)


def intersected(a: DataFrame, b: DataFrame, group: str = "id", parts: int | None = None) -> DataFrame:
    """What both sets of a group hold, coalesced."""
    return _combined([_plain(a, group), _plain(b, group)], lambda x, y: x & y, group, parts)


def subtracted(a: DataFrame, b: DataFrame, group: str = "id", parts: int | None = None) -> DataFrame:
    """What the sets a hold and b don't, coalesced."""
    return _combined([_plain(a, group), _plain(b, group)], lambda x, y: x & ~y, group, parts)


def _plain(ranges: DataFrame, group: str) -> DataFrame:
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return ranges.select(group, "lo", "hi", yes("lo_in"), yes("hi_in"))
