"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are words, word pairs, the words' shapes (runs of lower, upper, digit or another mark, collapsed), pairs of shapes, and
whether a word repeats the one before; each is hashed to one of 2^BITS weights and weighs its share of the text's n-grams of
its kind. A score is the logistic of the bias and a sparse dot product.

Training reads at most MAX_TRAIN labels, the first in a seeded order, and at most MAX_TRAIN / SHARDS rows in each of SHARDS
parts whose weights are averaged, also where an id is repeated: the bound is a parameter, and all of what training sends to the
driver is SHARDS * 2^BITS weights. Scoring reads every text whole.

Null and empty texts score the bias. Labels without id or quality, or whose id no document has, are not used; rows that
repeat an id are used, and scored, each. Without labels every score is 0.5. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamark.llm.hashing import M1, SPACES, mixed
from seamark.llm.hashing import U as _U

BITS, MAX_TRAIN, SHARDS, EPOCHS, SEED, FOLDS = 18, 20_000, 4, 3, 7, 5
#: Learning rate and its offset, L1 and L2 weights of the leader; scale of the features.
ALPHA, BETA, L1, L2, SCALE = 0.3, 1.0, 0.002, 0.002, 12.0
CUT = 0.3
#: Bytes of text that are hashed at once.
AT_ONCE = 1_000_000

_R = _U(0x9E3779B97F4A7C15)
_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1] = _KIND[128:] = ord("a")
_KIND[ord("A") : ord("Z") + 1] = ord("A")
_KIND[ord("0") : ord("9") + 1] = ord("0")


def _hashed(value: np.ndarray, kept: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Polynomial hash of the kept bytes of each word; first marks where words begin."""
    starts = np.flatnonzero(first)
    place = np.cumsum(kept)
    place -= np.repeat(place[starts], np.diff(np.append(starts, len(value)))) if len(starts) else 0
    powers = np.cumprod(np.concatenate(([_U(1)], np.full(max(int(place.max()), 0) + 1, _R))), dtype=_U)
    out = (value.astype(_U) + _U(1)) * powers[np.maximum(place, 0)]
    out[~kept] = 0
    return mixed(np.add.reduceat(out, starts))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, weight number, value) of each n-gram of each text; a document's values of one kind sum to SCALE."""
    raw = [(t or "").encode() for t in texts]
    buf = np.frombuffer(b" " + b" ".join([*raw, b""]), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    word = ~SPACES[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return none
    kind = _KIND[buf]
    turn = word.copy()
    turn[1:] &= (kind[1:] != kind[:-1]) | first[1:]
    # From the first word on, so that every byte belongs to a word or to the space after it.
    a = starts[0]
    with np.errstate(over="ignore"):
        words = _hashed(buf[a:], word[a:], first[a:])
        shapes = _hashed(kind[a:], turn[a:], first[a:])
        doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]) + 1, starts, side="right")
        after = doc[1:] == doc[:-1]
        pair = lambda h: mixed(h[:-1] * _R + h[1:])[after]
        again = (words[1:] == words[:-1])[after].astype(_U)
        groups = [(doc, words), (doc[1:][after], pair(words)), (doc, shapes), (doc[1:][after], pair(shapes)), (doc[1:][after], again)]
        hashed = [mixed(h + _U(n) * M1) >> _U(64 - BITS) for n, (_, h) in enumerate(groups)]
    values = []
    for d, _ in groups:
        n = np.bincount(d, minlength=len(raw))
        values.append(SCALE / n[d])
    return np.concatenate([d for d, _ in groups]), np.concatenate(hashed).astype(np.int64), np.concatenate(values)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about AT_ONCE characters."""
    a = n = 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= AT_ONCE:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def train(texts: list[str | None], y: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) after EPOCHS passes in the given order."""
    size = 1 << BITS
    rows = []
    for a, b in _slices(texts):
        doc, at, value = features(texts[a:b])
        by = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[by], np.arange(b - a + 1))
        for i in range(b - a):
            j = by[cuts[i] : cuts[i + 1]]
            where, inverse = np.unique(at[j], return_inverse=True)
            rows.append((np.append(where, size), np.append(np.bincount(inverse, weights=value[j]), 1.0)))
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    weights = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(EPOCHS):
        for (at, x), label in zip(rows, y, strict=True):
            w = weights(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(z, n)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> np.ndarray:
    """docs(doc_id, text), labels(doc_id, quality) -> weights."""
    known = labels.select("doc_id", "quality").dropna()
    order = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("quality"))
    # At most max_train ids: bounded, so it may be broadcast.
    sample = known.withColumn("o", order).orderBy("o", "doc_id", "quality").limit(max_train)
    rows = docs.join(F.broadcast(sample), "doc_id").select("text", "quality", "o", F.pmod("o", F.lit(SHARDS)).alias("shard"))
    # Ids may be repeated, so the bound holds for joined rows too; each map task keeps no more than that before the exchange.
    first = Window.partitionBy("shard").orderBy("o", F.xxhash64("text"))
    rows = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= -(-max_train // SHARDS)).drop("n")

    def each(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["o", "text"])
        return pd.DataFrame({"n": [len(g)], "w": [train(g["text"].tolist(), g["quality"].to_numpy(dtype=float)).astype(np.float32).tobytes()]})

    found = rows.groupBy("shard").applyInPandas(each, "n long, w binary").collect()
    if not found:
        return np.zeros((1 << BITS) + 1, dtype=np.float32)
    return np.average([np.frombuffer(r.w, dtype=np.float32) for r in found], axis=0, weights=[r.n for r in found]).astype(np.float32)


def predict(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2^BITS + 1 numbers, whatever the input

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for batch in batches:
            texts, out = batch["text"].tolist(), []
            for a, b in _slices(texts):
                doc, at, value = features(texts[a:b])
                out.append(np.bincount(doc, weights=w[at] * value, minlength=b - a) + w[-1])
            logit = np.concatenate(out) if out else np.zeros(0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))})

    return docs.select("doc_id", "text").mapInPandas(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a row's id falls in the fold that no label is learned from. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, having learned from the labels that aren't held out."""
    docs = docs.select("doc_id", "text")
    weights = fit(docs, labels.filter(~held_out()))
    df = predict(docs, weights)
    return df.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
