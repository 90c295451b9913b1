"""SimHash near-duplicates with a pigeonring filter.

Fingerprints are taken text by text. Equal ones collapse first, so copies cost one row each from there on. Two fingerprints
with at most 3 differing bits, cut into m segments in a ring, have a segment from which every chain of l segments differs in
at most l * 3 / m bits (the pigeonring principle). With m = 5 the chain's first segment is equal, and so is the second or the
third: ten keys of two segments find every pair, and the rest of the chain is checked before the full distance.

A key shared by more than `crowd` fingerprints is not compared pair by pair: its members get finer keys, with m = 8 (chains
begin with two equal segments, and two of the next three), then with all choices of 13 among 16 segments. The last leave 12
bits free, so no group there exceeds 4096 fingerprints, whatever the input. Groups yield the edges of a forest, not pairs. LEVELS
has the segments of each budget; tests hold them against all pairs.

near_duplicates() links by one fingerprint of three-word shingles and 3 bits. representatives(), for a corpus, is to find texts
of which five-word shingles agree to 0.8 or more. Such texts differ in about one word of 45, so in about 6 of 64 bits where
the shingles are pairs of words, and in 10 where they are fives: a budget that finds most of them in one fingerprint would have
keys too short for any index. So it takes PRINTS independent fingerprints of the set of word pairs, linked at PAIR_BITS bits, and
texts are linked if any of their fingerprints are. Each edge of the forest is then held against the texts: it stays where their sets
of five-word shingles agree to AGREE, exactly counted. That is below 0.8, as two copies that both agree to 0.8 with a third
need only agree to 0.6 with each other, and a forest may have the edge between those two. What the first kind of fingerprints
loses so, the others may link by another edge. Recall and what else is taken are measured in the README.

Null and empty texts have fingerprint zero and are linked like any other. Repeated ids and rows keep a row each; a component's
name is its smallest doc_id, a null id counting only where there is no other. An empty table gives no rows.
Texts are read whole, however long; further columns change nothing in report() and stay in representatives().
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamark.llm.common import cut, unwrapped, wrapped
from seamark.operators.graph import connected

SHINGLE, SEED, MOST_BITS = 3, 42, 3
CROWD, HELD = 512, 1 << 20
#: Fingerprints of word pairs for a corpus, and the bits in which linked ones may differ.
PRINTS, PAIR_WORDS, PAIR_BITS = 8, 2, 4
#: Words of the shingles whose sets must agree to this part (Jaccard) at the ends of an edge.
AGREE_WORDS, AGREE = 5, 0.6
#: For each budget of bits, by level: segments; those, from the first of a chain, that must be equal; how many must be of which others.
LEVELS = {
    3: ((5, (0,), 1, (1, 2)), (8, (0, 1), 2, (2, 3, 4)), (16, (), 13, tuple(range(16)))),
    4: ((7, (0,), 1, (1, 2)), (12, (0, 1), 4, (2, 3, 4, 5, 6, 7)), (16, (), 12, tuple(range(16)))),
}


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is set if it is in over half of the hashes of the 3-word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def pair_prints(text: str | None, n: int = PRINTS, k: int = PAIR_WORDS) -> np.ndarray:
    """n fingerprints of the set of a text's k-word shingles, each bit set if it is in over half of their hashes; no words: zeros."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(n, dtype=np.uint64)
    k = min(k, len(words))
    shingles = {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}
    h = xxhash.xxh128_digest
    ones = np.zeros((n + n % 2) * 64, dtype=np.int64)
    part: list[bytes] = []
    for i, x in enumerate(shingles, 1):
        part += [h(x, SEED + s) for s in range((n + 1) // 2)]
        if len(part) > 1 << 16 or i == len(shingles):
            ones += np.unpackbits(np.frombuffer(b"".join(part), dtype=np.uint8).reshape(-1, len(ones) // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            part.clear()
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)[:n]


def shingle_set(text: str | None, k: int = AGREE_WORDS) -> np.ndarray:
    """32-bit hashes of the distinct k-word shingles of a text (fewer words: the whole sequence; none: nothing)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.int32)
    k = min(k, len(words))
    h = xxhash.xxh32_intdigest
    return np.unique(np.fromiter((h(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)), dtype=np.uint32)).view(np.int32)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp), fp as a signed 64-bit integer; text_hash with the id tells rows apart that share the id."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "fp": fp.view(np.int64)})

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInPandas(each, f"doc_id {kind}, text_hash long, fp long")


# ---- keys: (level, segments that must be equal) ----


def _cuts(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m segments of 64 bits."""
    at = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _masks(level: int, bits: int = MOST_BITS) -> list[int]:
    """The bits that a pair must share, for each key of a level."""
    m, first, n, others = LEVELS[bits][level]
    whole = [((1 << w) - 1) << s for s, w in _cuts(m)]
    starts = range(m) if first else (0,)
    kept = [(*(i + d for d in first), *(i + d for d in some)) for i in starts for some in itertools.combinations(others, n)]
    return [sum(whole[i % m] for i in segments) for segments in kept]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(prints: DataFrame, level: int, bits: int) -> DataFrame:
    """(no, key, fp, known): a row for each key of each fingerprint; no counts the keys of all kinds of fingerprints."""
    masks = F.array(*(F.lit(_signed(m)).cast("long") for m in _masks(level, bits)))
    each = prints.select("kind", "fp", "known", F.posexplode(masks).alias("no", "mask"))
    return each.select((F.col("kind") * len(_masks(level, bits)) + F.col("no")).alias("no"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "known")


# ---- groups ----


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _chained(diff: np.ndarray, no: int, level: int, bits: int) -> np.ndarray:
    """Whether the pairs keep to the pigeonring's budgets along the chain of their key, then to the full distance."""
    ok = np.ones(diff.shape, dtype=bool)
    m, first, n, others = LEVELS[bits][level]
    if first:
        per = math.comb(len(others), n)
        start, total = no % (m * per) // per, np.zeros(diff.shape, dtype=np.int64)
        cuts = _cuts(m)
        for i in range(1, m + 1):
            s, w = cuts[(start + i - 1) % m]
            total += _bits((diff >> np.uint64(s)) & np.uint64((1 << w) - 1))
            ok &= total <= i * bits // m
        return ok
    return _bits(diff) <= bits


def _forest(fps: np.ndarray, known: np.ndarray, no: int, level: int, bits: int) -> list[tuple[int, int]]:
    """Edges that join the fingerprints of one group as far as they are linked: one fewer than members at most.

    Members with one known group, other than 0, are joined already.
    """
    n = len(fps)
    label = np.arange(n)
    if known.any():
        _, first, at = np.unique(known, return_index=True, return_inverse=True)
        label = np.where(known != 0, first[at], label)
    edges = []
    for i in range(1, n):
        near = np.flatnonzero(_chained(fps[:i] ^ fps[i], no, level, bits))
        roots = np.unique(label[near])
        roots = roots[roots != label[i]]
        for root in roots:
            edges.append((i, int(near[np.argmax(label[near] == root)])))
        if len(roots):
            label[np.isin(label, roots)] = label[i]
    return edges


def _edges(keyed: DataFrame, level: int, crowd: int, bits: int) -> DataFrame:
    """(kind, a, b): links inside the groups of one key; b is null for the members of a crowd, which are to be keyed anew.

    Rows arrive sorted by key, so a group is a run of rows, which may go on in the next batch. A crowd is told apart as it
    passes and never gathered; one whose members are of one known group says nothing, if it has at most HELD of them.
    """

    per_kind = len(_masks(level, bits))

    def told(no, a, b) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.asarray(no, dtype=np.int32) // per_kind, "a": a, "b": b})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None  # (no, key)
        run: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        one: int | None = None  # the known group of all members so far, 0 if there is none such

        def close() -> list[np.ndarray]:
            if held is None or size < 2 or not run or one:
                return []
            fps, groups = (np.concatenate(x) for x in zip(*run, strict=True))
            found = np.array([(held[0], fps[i], fps[j]) for i, j in _forest(fps.view(np.uint64), groups, held[0], level, bits)], dtype=np.int64)
            return [found.reshape(-1, 3)]

        for b in batches:
            if not len(b):
                continue
            no, key, fp, known = (b[c].to_numpy() for c in ("no", "key", "fp", "known"))
            starts = np.flatnonzero(np.concatenate(([True], (no[1:] != no[:-1]) | (key[1:] != key[:-1]))))
            ends = np.append(starts[1:], len(b))
            first = held == (no[0], key[0])
            pairs, members = [], []
            # Runs that begin here and end before the batch does, of two: most groups, all at once.
            twos = starts[(ends - starts == 2) & (ends < len(b)) & ((starts > 0) | (not first))]
            for n in np.unique(no[twos]):
                at = twos[no[twos] == n]
                ok = _chained(fp[at].view(np.uint64) ^ fp[at + 1].view(np.uint64), int(n), level, bits) & ((known[at] == 0) | (known[at] != known[at + 1]))
                pairs.append(np.column_stack((np.full(int(ok.sum()), n), fp[at][ok], fp[at + 1][ok])))
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                last = e == len(b)
                if not (s == 0 and first):
                    if not last and e - s <= 2:
                        if s == 0 or held is not None:
                            pairs += close()
                        held, run, size, one = None, [], 0, None
                        continue
                    pairs += close()
                    held, run, size, one = (no[s], key[s]), [], 0, None
                size += e - s
                run.append((fp[s:e], known[s:e]))
                one = int(known[s]) if one in (None, known[s]) and (known[s:e] == known[s]).all() else 0
                if crowd and size > crowd and (not one or size > HELD):  # hand on what is held and all that follows
                    members += [(held[0], r) for r, _ in run]
                    run, one = [], 0
                if not last:
                    pairs += close()
                    held, run, size, one = None, [], 0, None
            for p in pairs:
                if len(p):
                    yield told(p[:, 0], p[:, 1], pd.array(p[:, 2], dtype="Int64"))
            for n, m in members:
                yield told(np.full(len(m), n), m, pd.array([None] * len(m), dtype="Int64"))
        for p in close():
            if len(p):
                yield told(p[:, 0], p[:, 1], pd.array(p[:, 2], dtype="Int64"))

    n = keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return keyed.repartition(int(n), "no", "key").sortWithinPartitions("no", "key", "fp").mapInPandas(each, "kind int, a long, b long")


def links(prints: DataFrame, crowd: int = CROWD, bits: int = MOST_BITS) -> DataFrame:
    """prints(kind, fp, known), distinct -> (kind, a, b): enough links between fingerprints of a kind to connect all that are linked.

    Fingerprints with one known group, other than 0, count as connected.
    """
    out, every = None, prints
    for level in range(3):
        found = cut(_edges(_keyed(prints, level, bits), level, crowd if level < 2 else 0, bits), f"simhash-links-{level}")
        own = found.filter("b IS NOT NULL")
        out = own if out is None else out.unionByName(own)
        crowds = found.filter("b IS NULL").select("kind", F.col("a").alias("fp")).distinct()
        prints = every.join(crowds, ["kind", "fp"], "left_semi")
        if crowds.isEmpty():
            break
    return out


def _components(docs: DataFrame, doc_id: str, text: str, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of each row; (fp, owner, root) of each fingerprint, root naming its component of fingerprints."""
    prints = cut(fingerprints(docs, doc_id, text), "simhash-prints")
    owners = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("owner")), "simhash-owners")
    found = connected(links(owners.select(F.lit(0).alias("kind"), "fp", F.lit(0).cast("long").alias("known")), crowd))
    return prints, owners.join(found, owners["fp"] == found["id"], "left").select("fp", "owner", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id."""
    prints, named = _components(docs, doc_id, text, crowd)
    least = named.groupBy("root").agg(F.min("owner").alias("component_id"))
    of_fp = named.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(of_fp, prints["fp"] == of_fp["of"]).select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    df = near_duplicates(docs)
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def agreeing(docs: DataFrame, rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Of found(a, b), distinct edges between nodes, those whose texts agree. A node is spoken for by one text of its smallest unit.

    The texts of nodes on an edge alone become sets, one for each text, and a set travels to the edges that ask for it.
    """
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    best = rows.groupBy("unit").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"))
    one = nodes.join(ends, "node", "left_semi").groupBy("node").agg(F.min("unit").alias("unit"))
    one = cut(one.join(best, "unit").select("node", F.col("best.doc_id").alias("id"), F.col("best.text_hash").alias("h")), "pair-ends")
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    wanted = one.select("id", "h").distinct()
    texts = own.join(wanted, own["doc_id"].eqNullSafe(wanted["id"]) & (own["own"] == wanted["h"])).groupBy("h").agg(F.first("text").alias("text"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "fives": [shingle_set(t) for t in b["text"]]})

    sets = cut(texts.mapInPandas(each, "h long, fives array<int>"), "pair-sets")
    edges = found
    for end in ("a", "b"):
        edges = edges.join(one.select(F.col("node").alias(end), F.col("h").alias(f"h{end}")), end)
    for end in ("a", "b"):
        edges = edges.join(sets.select(F.col("h").alias(f"h{end}"), F.col("fives").alias(f"s{end}")), f"h{end}")
    both = F.size(F.array_intersect("sa", "sb"))
    return cut(edges.filter(both >= AGREE * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "pair-agreeing")


def pair_groups(docs: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> (rows(doc_id, text_hash, unit), groups(unit, root)): unit stands for all fingerprints of a row.

    Units and fingerprints are the nodes of one graph: a fingerprint is tied to those it is linked to, a unit to those of its
    fingerprints that are linked or that other units have too (equal ones aren't held against texts). Units on no edge are groups of their own and not in groups.
    """
    fps = [f"f{i}" for i in range(PRINTS)]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = np.array([pair_prints(t) for t in b["text"]], dtype=np.uint64).reshape(-1, PRINTS).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], **{c: found[:, i] for i, c in enumerate(fps)}})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = rows.mapInPandas(each, f"doc_id {kind}, text_hash long, {', '.join(f'{c} long' for c in fps)}")
    rows = cut(rows.withColumn("unit", F.xxhash64(F.lit("unit"), *fps)), "pair-prints")
    units = rows.groupBy("unit").agg(*(F.first(c).alias(c) for c in fps))
    nodes = units.select("unit", F.posexplode(F.array(*fps)).alias("kind", "fp"))
    nodes = cut(nodes.withColumn("node", F.xxhash64("kind", "fp")), "pair-nodes")

    def linked(prints: DataFrame) -> DataFrame:
        found = links(prints, crowd, PAIR_BITS).select(F.xxhash64("kind", "a").alias("a"), F.xxhash64("kind", "b").alias("b"))
        # Two fingerprints meet under several keys, in a group of near copies under most of them: an edge is told once from here on.
        return agreeing(docs, rows, nodes, cut(found.distinct(), "pair-links"))

    def grouped(found: DataFrame, own: DataFrame) -> DataFrame:
        """(unit, root) by the links of fingerprints and what units share of own."""
        ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node")))
        shared = own.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node")
        ties = own.join(ends.unionByName(shared).distinct(), "node", "left_semi").select(F.col("unit").alias("a"), F.col("node").alias("b"))
        return connected(found.unionByName(ties)).withColumnRenamed("id", "unit")

    # The first kind alone joins most of a large group of copies, which then says nothing under the keys of the others.
    first = linked(nodes.filter("kind = 0").select("kind", "fp", F.lit(0).cast("long").alias("known")).distinct())
    roots = grouped(first, nodes.filter("kind = 0"))
    known = nodes.filter("kind > 0").join(roots, "unit", "left").groupBy("kind", "fp").agg(F.coalesce(F.min("root"), F.lit(0).cast("long")).alias("known"))
    found = first.unionByName(linked(cut(known, "pair-known")))
    return rows, grouped(found, nodes).join(units.select("unit"), "unit", "left_semi")


def representatives(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the smallest doc_id, a row without id only where no
    other is. Rows of a group that share that id go by a hash of the text; of rows equal in both, one stays, by a hash of all columns.

    Texts without words are one group. An empty table gives no rows.
    """
    rows, groups = pair_groups(docs, crowd)
    # The best row of each unit first: then texts that a third of all rows share are one row in the join.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))).alias("best")
    per = rows.groupBy("unit").agg(best)
    kept = per.join(groups, "unit", "left").groupBy(F.coalesce("root", "unit").alias("root")).agg(F.min("best").alias("best"))
    kept = kept.select(F.col("best.id").alias("__id"), F.col("best.h").alias("__h"))
    often = rows.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).agg(F.count("*").alias("__n"))
    kept = kept.join(often, kept["__id"].eqNullSafe(often["id"]) & (kept["__h"] == often["h"])).select("__id", "__h", "__n")
    # Written once, so that Spark sends the documents through an exchange only where the kept ids are too many to broadcast.
    kept = cut(kept, "representatives")
    own = wrapped(docs, "doc_id", "text").withColumn("own", F.xxhash64("text"))
    own = own.join(kept, own["doc_id"].eqNullSafe(kept["__id"]) & (own["own"] == kept["__h"]))
    # Only rows with an id and a text that others have too are sorted.
    first = Window.partitionBy("doc_id", "own").orderBy(F.xxhash64("doc"))
    some = own.filter("__n > 1").withColumn("row", F.row_number().over(first)).filter("row = 1")
    return unwrapped(own.filter("__n = 1"), docs.columns).unionByName(unwrapped(some, docs.columns))
