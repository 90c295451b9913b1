"""Hard negatives: for each anchor and positive, the best rows of other labels whose score is close below the positive's.

Every row is scored against every anchor; the anchors are a stated query set. Rows and anchors are packed into blocks of a bounded
number of rows and bytes, and each pair of blocks meets in one task. There an anchor's scores are sorted in full, by score and
then by id (blocks are kept in the order of ids, so a stable sort of the scores does both); each positive's upper limit is found
by binary search among the rows of other labels, and the first k above its lower limit are read. A first pass over the blocks
finds the positives, a second one the negatives; of each, a block hands on k rows for an anchor or a positive, and windows over
those keep the best k. So no task holds more than two blocks, and no row is left out.

Scores are integer inner products of the components floor(256 * x). They are worked out in doubles where these are exact, else
in Python's whole numbers; one beyond 64 bits counts as the nearest number of 64 bits.

Rows without label or vector, or with a null or non-finite component, take no part. Vectors of different lengths have no score
and don't meet; empty vectors score 0 among themselves. Rows are told apart by their place, not by their id: a repeated row is
another row, to its twin as well, and a repeated anchor gives its rows again. A null id is no anchor and comes last in ties; rows
that tie in the id as well give the same result whichever comes first. Further columns change nothing; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.llm.common import cut

#: Positives of an anchor and negatives of a positive; limits of a negative's score in percent of the positive's.
K, LOWER, UPPER, SCALE = 5, 80, 100, 256
#: Rows of a block, anchors of a block, and numbers in either, whatever the length of the vectors.
BLOCK, GROUP, NUMBERS = 8192, 2048, 1 << 21
#: Scores that are worked out at once.
AT_ONCE = 1 << 20
EXACT = 2.0**53
LEAST, MOST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max

_BLOCKS = "block int, dim int, ids binary, no_id binary, labels binary, places binary, anchors binary, vectors binary"


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, x) of the rows that take part; x has floor(scale * component) as doubles."""
    # floor() gives a long, which large numbers would overflow; doubles from 2^52 on are whole.
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    df = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    df = df.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return df.withColumn("x", F.transform("x", lambda x: whole(x * scale)))


def _pack(most: int):
    """Packs each partition's rows (id, label, x, anchor, and place where they have one) into blocks, by length of the vectors."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, given, rests = TaskContext.get().partitionId(), 0, {}

        def packed(df: pd.DataFrame) -> pd.DataFrame:
            dim = len(df["x"].iloc[0])
            no_id = df["id"].isna().to_numpy()
            columns = {"ids": df["id"].fillna(0).to_numpy(dtype=np.int64), "no_id": no_id, "labels": df["label"].to_numpy(dtype=np.int64), "places": df["place"].to_numpy(dtype=np.int64), "anchors": df["anchor"].to_numpy(dtype=bool)}
            columns["vectors"] = np.stack(df["x"].to_list()).astype(np.float64)
            at = np.lexsort([columns["ids"], no_id])
            return pd.DataFrame([{"block": block, "dim": dim} | {k: v[at].tobytes() for k, v in columns.items()}])

        for batch in batches:
            if "place" not in batch:
                batch["place"] = (block << 40) + given + np.arange(len(batch))
                given += len(batch)
            for dim, part in batch.groupby(batch["x"].map(len)):
                size = max(1, min(most, NUMBERS // max(dim, 1)))
                rest = pd.concat([rests.pop(dim, part.iloc[:0]), part], ignore_index=True)
                for i in range(0, len(rest) - size + 1, size):
                    yield packed(rest.iloc[i : i + size])
                if len(rest) % size:
                    rests[dim] = rest.iloc[len(rest) - len(rest) % size :]
        yield from map(packed, rests.values())

    return each


class Block:
    """A packed block as arrays."""

    def __init__(self, r):
        self.ids, self.labels, self.places = (np.frombuffer(r[c], dtype=np.int64) for c in ("ids", "labels", "places"))
        self.no_id, self.anchors = (np.frombuffer(r[c], dtype=bool) for c in ("no_id", "anchors"))
        self.dim = r["dim"]
        self.x = np.frombuffer(r["vectors"], dtype=np.float64).reshape(len(self.ids), self.dim)

    def id(self, i: int) -> int | None:
        return None if self.no_id[i] else int(self.ids[i])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, kept within 64 bits."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(whole(a).dot(whole(b).T), LEAST, MOST).astype(np.int64)


def _met(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[Block, int, Block, np.ndarray]]:
    """Each anchor of the blocks a with each block of b of its length: its block and place there, the other block, the scores."""
    theirs = [Block(r) for _, r in b.iterrows()]
    for own in (Block(r) for _, r in a.iterrows()):
        for other in (t for t in theirs if t.dim == own.dim):
            step = max(1, AT_ONCE // len(other.ids))
            for i in range(0, len(own.ids), step):
                for q, s in enumerate(scores(own.x[i : i + step], other.x), i):
                    yield own, q, other, s


def _positives(k: int):
    def each(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, q, other, s in _met(a, b):
            same = np.flatnonzero((other.labels == own.labels[q]) & (other.places != own.places[q]))
            for p in same[np.argsort(-s[same], kind="stable")[:k]]:
                out.append((own.places[q], other.places[p], other.id(p), s[p]))
        return pd.DataFrame(out, columns=["anchor", "place", "positive_id", "positive_score"]).astype({"positive_id": "Int64"})

    return each


def negatives_of(down: np.ndarray, positive: int, k: int, lower: int, upper: int) -> slice:
    """Where, among negated scores in ascending order, the first k lie that are within the limits of a positive's score."""
    most, least = (positive * upper) // 100, -((-positive * lower) // 100)
    most, least = (min(max(v, LEAST), MOST) for v in (most, least))
    low, high = np.searchsorted(down, -most, "left"), np.searchsorted(down, -least, "right")
    return slice(low, max(low, min(high, low + k)))


def _negatives(k: int, lower: int, upper: int):
    def each(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        limits: dict[int, list] = {}
        for x in a["limits"].iloc[0] if len(a) else ():
            limits.setdefault(x["anchor"], []).append((x["place"], int(x["positive_score"])))
        for own, q, other, s in _met(a, b):
            if not (asked := limits.get(int(own.places[q]))):
                continue
            order = np.argsort(-s, kind="stable")
            order = order[other.labels[order] != own.labels[q]]
            down = -s[order]
            for place, score in asked:
                for p in order[negatives_of(down, score, k, lower, upper)]:
                    out.append((own.places[q], place, other.places[p], other.id(p), s[p]))
        return pd.DataFrame(out, columns=["anchor", "place", "other", "negative_id", "negative_score"]).astype({"negative_id": "Int64"})

    return each


def mine(rows: DataFrame, anchor: Column, k: int = K, lower: int = LOWER, upper: int = UPPER, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """rows(id, label, x) as usable() gives them; anchor: a condition on them.

    Gives (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first k rows of the anchor's label as
    its positives, and for each the first k rows of other labels with lower <= 100 * score / positive_score <= upper.
    """
    rows = cut(rows.select("id", "label", "x", F.coalesce(anchor, F.lit(False)).alias("anchor")), "negatives-rows")
    n = rows.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).first()
    n_blocks, n_groups = max(1, -(-n.rows // block)), max(1, -(-n.anchors // group))
    packed = cut(rows.repartition(n_blocks).mapInPandas(_pack(block), _BLOCKS), "negatives-blocks")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in (Block(r) for _, r in batch.iterrows()):
                if not len(at := np.flatnonzero(b.anchors)):
                    continue
                yield pd.DataFrame({"place": b.places[at], "id": b.ids[at], "label": b.labels[at], "x": list(b.x[at]), "anchor": True})

    asked = packed.mapInPandas(unpack, "place long, id long, label long, x array<double>, anchor boolean")
    asked = cut(asked.repartition(n_groups).mapInPandas(_pack(group), _BLOCKS), "negatives-anchors")
    # Every block of anchors is told the numbers of the blocks of rows and the other way round, so each pair meets under one key.
    spread = lambda df, own, other, n: df.withColumnRenamed("block", own).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    theirs = spread(packed, "b", "g", n_groups).groupBy("g", "b")
    found = spread(asked, "g", "b", n_blocks).groupBy("g", "b").cogroup(theirs).applyInPandas(_positives(k), "anchor long, place long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "place")
    found = cut(found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k).drop("n"), "negatives-positives")

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, r in batch.iterrows():
                b = Block(r)
                yield pd.DataFrame({"block": r["block"], "anchor": b.places, "anchor_id": b.ids})

    names = cut(asked.mapInPandas(names, "block int, anchor long, anchor_id long"), "negatives-names")
    # k positives for each anchor of a block of anchors: as bounded as the block.
    limits = found.join(names, "anchor").groupBy("block").agg(F.collect_list(F.struct("anchor", "place", "positive_score")).alias("limits"))
    near = spread(asked.join(limits, "block"), "g", "b", n_blocks).groupBy("g", "b").cogroup(theirs)
    near = near.applyInPandas(_negatives(k, lower, upper), "anchor long, place long, other long, negative_id long, negative_score long")
    first = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "other")
    near = near.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    near = near.join(found, ["anchor", "place"]).join(names.drop("block"), "anchor")
    return near.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
