"""Stupid-backoff scores from n-gram count tables partitioned by hash.

Documents are dealt to chunks by a hash. A chunk explodes its distinct n-grams, each once with its count, into the ranges of
hash of the count table; a range adds the counts of all chunks up and joins them back to the chunks that asked; a chunk then sums
the scores of its documents. With `least` 1, the default, every n-gram that occurs counts and all orders go in one round. With
a higher one, single words and pairs go first, then longer n-grams order by order, and only those of which both parts (without
the first word, without the last) were found `least` times: no other can have been found so often itself.

The n-grams that a chunk sends to one range travel in one row, as packed arrays: 8 bytes and a plain row's header for each would
be several times the input. A row holds one n-gram at least, so rows never outnumber the exploded n-grams; while chunks and
ranges are few, there are fewer. A frequent n-gram costs a range one entry for each chunk.

score(w | context) = count(context w) / count(context) where that n-gram was found at least `least` times, else alpha times the
score under the context without its first word; a single word scores its share of all words. Contexts don't cross documents.

Words are runs of anything but ASCII white space, as written. Null and empty texts have no words, score 0 and mean null.
Repeated rows count, and are scored, each time; they are dealt apart by where they are read, so docs should be read from files.
Very long texts are a chunk of their own kind: a chunk holds whole texts. An empty table gives no rows. Columns but the two are
left away. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.hashing import SPACES, mixed
from seamark.llm.hashing import U as _U

ORDER, ALPHA, LEAST = 3, 0.4, 1
#: Bytes of text in a chunk, about; the number of chunks, and of buckets, follows the input.
CHUNK_BYTES = 8_000_000

_R1, _R2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_NONE = np.zeros(1, dtype=_U)


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document of each word, 64-bit hash of each word), words of UTF-8 texts in order."""
    buf = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    if not len(buf):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
    space = SPACES[buf]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
    word = np.cumsum(first) - 1
    place = np.arange(len(buf)) - starts[np.maximum(word, 0)]
    place[space] = 0
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate(([_U(1)], np.full(int(place.max()) + 1, _R1))), dtype=_U)
        value = (buf.astype(_U) + _U(1)) * powers[place]
        value[space] = 0
        hashes = mixed(np.add.reduceat(value, starts))
    ends = np.cumsum([len(r) + 1 for r in raw])
    return np.searchsorted(ends, starts, side="right"), hashes


def grams(raw: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(document, place in it, hashes of the n-grams that end there for n = 1, 2, ...) of each word. Short ones hash as 0."""
    doc, h = word_hashes(raw)
    place = np.arange(len(doc))
    if len(doc):
        new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        place = place - np.repeat(new, np.diff(np.append(new, len(doc))))
    out = [h]
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            g = np.zeros(len(h), dtype=_U)
            g[1:] = mixed((out[-1][:-1] * _R2) ^ (h[1:] + _U(n)))
            g[place < n - 1] = 0
            out.append(g)
    return doc, place, out


def _distinct(hashes: list[np.ndarray], buckets: int, words: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, hash, count) of the distinct n-grams in the order of hashes, of which each bucket has a range; 0 stands for all words."""
    every = np.concatenate([*([] if words is None else [_NONE]), *(g[g != 0] for g in hashes)])
    keys, counts = np.unique(every, return_counts=True)
    if words is not None:
        counts[0] = words
    return ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64), keys, counts


def pack(values: np.ndarray) -> bytes:
    """Whole numbers with all their first bytes, then all their second bytes, and so on: small ones compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, dtype=int)
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(x)], strict=True))


def looked_up(keys: np.ndarray, total: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The counts of hashes in the sorted keys; 0 of those that aren't there."""
    if not len(keys):
        return np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, total[at], 0).astype(float)


def promising(hashes: list[np.ndarray], place: np.ndarray, keys: np.ndarray, total: np.ndarray, n: int, least: int) -> np.ndarray:
    """Hashes of the n-grams of which both (n-1)-grams were found `least` times; 0 for the others."""
    ok = (looked_up(keys, total, hashes[n - 2]) >= least) & (place >= n - 2)
    both = ok & (place >= n - 1)
    both[1:] &= ok[:-1]
    return np.where(both, hashes[n - 1], _U(0))


def doc_scores(hashes: list[np.ndarray], place: np.ndarray, total: np.ndarray, keys: np.ndarray, alpha: float, least: int) -> np.ndarray:
    """Log score of each word; keys are sorted, total their counts over the corpus."""
    found = [looked_up(keys, total, g) for g in hashes]
    out = np.log(found[0]) - math.log(max(total[0], 1))  # keys[0] is 0: all words
    used = np.ones(len(place), dtype=int)
    for n in range(2, len(hashes) + 1):
        at = np.flatnonzero((place >= n - 1) & (found[n - 1] >= least))
        out[at] = np.log(found[n - 1][at]) - np.log(found[n - 2][at - 1])
        used[at] = n
    return out + (np.minimum(place + 1, len(hashes)) - used) * math.log(alpha)


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, least: int = LEAST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, log_score (summed over its words), mean_log_score (null without words)."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n, least = max(1, math.ceil(size / chunk_bytes)), max(least, 1)
    together = order if least == 1 else min(2, order)  # orders of the first round
    df = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    df = df.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n)).cast("int"))

    def zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = [zlib.compress((t or "").encode(), 6) for t in b["text"]]
            yield b

    def unzipped(g: pd.DataFrame) -> list[bytes]:
        return [zlib.decompress(t) for t in g["text"]]

    kind = df.schema["doc_id"].dataType.simpleString()
    df = df.mapInPandas(zipped, f"doc_id {kind}, text binary, chunk int")

    def message(chunk: int, bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        rows = [(int(bucket[a]), pack(np.diff(keys[a:b], prepend=_U(0))), zlib.compress(pack(counts[a:b]), 1)) for a, b in _runs(bucket)]
        return pd.DataFrame({"bucket": [r[0] for r in rows], "chunk": chunk, "keys": [r[1] for r in rows], "counts": [r[2] for r in rows]})

    def told(g: pd.DataFrame, answers: pd.DataFrame, upto: int) -> tuple:
        """What a chunk knows after the answers on orders up to `upto`: documents, places, hashes, and the counts of its n-grams."""
        doc, place, hashes = grams(unzipped(g), order)
        keys, total = np.zeros(0, dtype=_U), np.zeros(0, dtype=_U)
        for last in range(together, upto + 1):
            asked = hashes[:last] if last == together else [promising(hashes, place, keys, total, last, least)]
            _, more, _ = _distinct(asked, n, len(doc) if last == together else None)
            own = answers[answers["last"] == last].sort_values("bucket")["totals"]
            counts = np.concatenate([np.zeros(0, dtype=_U), *(unpack(zlib.decompress(t)) for t in own)])
            keys, total = np.concatenate([keys, more]), np.concatenate([total, counts])
            by = np.argsort(keys, kind="stable")
            keys, total = keys[by], total[by]
        return doc, place, hashes, keys, total

    def first(g: pd.DataFrame) -> pd.DataFrame:
        _, _, hashes = grams(unzipped(g), together)
        return message(g["chunk"].iloc[0], *_distinct(hashes, n, len(hashes[0])))

    def further(last: int):
        def ask(g: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            _, place, hashes, keys, total = told(g, answers, last - 1)
            return message(g["chunk"].iloc[0], *_distinct([promising(hashes, place, keys, total, last, least)], n))

        return ask

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.cumsum(unpack(k), dtype=_U) for k in g["keys"]])
        counts = np.concatenate([unpack(zlib.decompress(c)) for c in g["counts"]])
        _, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, weights=counts).astype(np.uint64)[at]
        ends = np.cumsum([len(k) // 8 for k in g["keys"]])
        return pd.DataFrame({"chunk": g["chunk"], "bucket": g["bucket"], "totals": [zlib.compress(pack(t), 1) for t in np.split(total, ends[:-1])]})

    def tell(g: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        doc, place, hashes, keys, total = told(g, answers, order)
        each = doc_scores(hashes, place, total, keys, alpha, least)
        words = np.bincount(doc, minlength=len(g))
        logs = np.bincount(doc, weights=each, minlength=len(g))
        mean = [float(s / w) if w else None for s, w in zip(logs, words, strict=True)]
        return pd.DataFrame({"doc_id": g["doc_id"], "n_words": words, "log_score": logs, "mean_log_score": pd.array(mean, dtype="Float64")})

    asked_kind = "bucket int, chunk int, keys binary, counts binary"
    found: list[DataFrame] = []
    chunks = df.groupBy("chunk")
    known = lambda: reduce(DataFrame.unionByName, found).groupBy("chunk")
    for last in range(together, order + 1):
        asked = chunks.cogroup(known()).applyInPandas(further(last), asked_kind) if found else chunks.applyInPandas(first, asked_kind)
        found.append(asked.groupBy("bucket").applyInPandas(answer, "chunk int, bucket int, totals binary").withColumn("last", F.lit(last)))
    return chunks.cogroup(known()).applyInPandas(tell, f"doc_id {kind}, n_words long, log_score double, mean_log_score double")
