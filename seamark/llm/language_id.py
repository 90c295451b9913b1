"""Language identification by rank-order profiles.

A text's n-grams are the runs of one to three letters within its words, in lower case, a word standing between two blanks ("_an",
"and", "nd_"). A language's profile is its K most frequent n-grams by rank, counted over all documents of the language that
learning may use. A text's own profile, of its K most frequent ones, is compared to each: an n-gram adds the difference of its two
ranks, or K where the language's profile lacks it, and the language with the least sum, the out-of-place distance, is the answer.

Counting is exact: tasks count their texts, and Spark adds the counts up by language and n-gram. Of equally frequent n-grams
the longer rank first, then those of smaller code points, and of languages at equal distance the first by name is taken. The score is 1 less the distance's share of the largest possible.
The profiles, K n-grams a language and MAX_LANGUAGES languages at most, are what goes to the driver and to all tasks; of more
languages those with the most documents are learned (ISO 639-3 has fewer).

A text that is null or has no letter is `und`, with score 0, and so is every text when nothing was learned. Rows without language or
without letters teach nothing; repeated rows and ids count each and get a row each. Texts are read whole, in slices of a bounded
number of characters that end where words do (a word of over a million letters counts as several). Further columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamark.llm.common import cut

K, MAX_LANGUAGES, FOLDS, HELD_OUT = 400, 8192, 4, 2
UNKNOWN = "und"
#: Characters that are counted at once.
AT_ONCE = 1 << 21
#: A code point takes so many bits of an n-gram's number; a blank is 0 there.
BITS = np.int64(21)
_LOW = (np.int64(1) << BITS) - 1


@functools.cache
def _letters() -> np.ndarray:
    """By code point: 0 for what isn't in words, 1 for letters, 2 for marks, which go with letters."""
    return np.frombuffer(bytes({"L": 1, "M": 2}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), dtype=np.uint8)


def _points(text: str) -> np.ndarray:
    """The code points of a text in lower case, with one 0 before, between and after words; empty if there is no letter."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _letters()[p]
    if not (kind == 1).any():
        return np.zeros(0, dtype=np.int64)
    p = np.concatenate(([0], np.where(kind > 0, p, 0), [0, 0])).astype(np.int64)
    kept = p > 0
    kept[1:] |= p[:-1] > 0  # the first blank after each word
    kept[0] = True
    return p[kept]


def _slices(text: str) -> Iterator[str]:
    """Parts of a text that end where a word does, unless a word is as long as a part."""
    a = 0
    while len(text) - a > AT_ONCE:
        b = next((i for i in range(a + AT_ONCE, a + AT_ONCE // 2, -1) if not text[i].isalpha() and not unicodedata.category(text[i]).startswith("M")), a + AT_ONCE)
        yield text[a:b]
        a = b
    yield text[a:]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key; the keys are sorted."""
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of _points() as numbers, sorted, and how often each occurs.

    Every place begins a run of three; shorter n-grams are their beginnings, so the places are sorted only once.
    """
    if len(points) < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    p = np.concatenate((points, [0, 0]))
    three, n = np.unique((p[:-2] << (2 * BITS)) | (p[1:-1] << BITS) | p[2:], return_counts=True)
    a, b = three >> (2 * BITS), (three >> BITS) & _LOW
    # No blank alone, none in the middle. The numbers of one, two and three letters are told apart by their highest bits.
    one, n1 = _summed(a[a > 0], n[a > 0])
    pair = (a > 0) | (b > 0)
    two, n2 = _summed((three >> BITS)[pair], n[pair])
    keys = np.concatenate((one | (np.int64(1) << 42), two | (np.int64(1) << 43), three[b > 0] | (np.int64(-1) << 63)))
    counts = np.concatenate((n1, n2, n[b > 0]))
    at = np.argsort(keys)
    return keys[at], counts[at]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text, sorted, and their counts."""
    parts = [grams(_points(s)) for s in _slices(text or "")]
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([k for k, _ in parts])
    at = np.argsort(keys, kind="stable")
    return _summed(keys[at], np.concatenate([n for _, n in parts])[at])


def ranked(keys: np.ndarray, counts: np.ndarray, k: int = K) -> np.ndarray:
    """The k most frequent n-grams, the most frequent first, equally frequent ones in order."""
    if len(keys) > k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.argsort(-counts, kind="stable")[:k]]


def held_out(doc_id: str = "doc_id"):
    """Whether a row's id falls in the fold that nothing is learned from. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, k: int = K, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """docs(lang, text) -> the profiles: (lang, gram, rank from 0), k rows a language at most."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                open_, size = [], 0
                for text in texts:
                    for part in _slices(text):
                        open_.append(part)
                        size += len(part)
                        if size >= AT_ONCE:
                            yield told(lang, open_)
                            open_, size = [], 0
                if open_:
                    yield told(lang, open_)

    def told(lang: str, texts: list[str]) -> pd.DataFrame:
        found, counts = grams(_points("\n".join(texts)))
        return pd.DataFrame({"lang": lang, "gram": found, "n": counts})

    known = docs.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    languages = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).select("lang")
    counts = known.mapInPandas(each, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(first) - 1).filter(F.col("rank") < k).select("lang", "gram", "rank")
    return cut(top.join(languages, "lang", "left_semi"), "language-profiles")


def predict(docs: DataFrame, profiles: DataFrame, k: int = K) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score."""
    rows = profiles.orderBy("lang", "rank").toPandas()  # k rows a language
    names = sorted(rows["lang"].unique())
    number = {n: i for i, n in enumerate(names)}
    vocabulary = np.unique(rows["gram"].to_numpy(dtype=np.int64))
    # A row for each n-gram of any profile and one for all others; where a profile lacks it, the rank is 2k: k from any rank.
    table = np.full((len(vocabulary) + 1, len(names)), 2 * k, dtype=np.int32)
    table[np.searchsorted(vocabulary, rows["gram"].to_numpy(dtype=np.int64)), rows["lang"].map(number).to_numpy(dtype=np.int64)] = rows["rank"]
    shared = docs.sparkSession.sparkContext.broadcast((names, vocabulary, table))

    def one(text: str | None, names: list[str], vocabulary: np.ndarray, table: np.ndarray) -> tuple[str, float]:
        own = ranked(*counted(text), k)
        if not len(own) or not names:
            return UNKNOWN, 0.0
        at = np.searchsorted(vocabulary, own)
        at[vocabulary[np.minimum(at, len(vocabulary) - 1)] != own] = len(vocabulary)
        away = np.abs(table[at] - np.arange(len(own), dtype=np.int32)[:, None])
        away[table[at] == 2 * k] = k
        total = away.sum(axis=0)
        best = int(np.argmin(total))
        return names[best], 1 - float(total[best]) / (k * len(own))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(t, *shared.value) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [a for a, _ in found], "score": [b for _, b in found]})

    return docs.select("doc_id", "text").mapInPandas(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, having learned from the documents that aren't held out."""
    profiles = fit(docs.filter(~held_out()).select("lang", "text"))
    df = predict(docs.select("doc_id", "text"), profiles)
    return df.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
