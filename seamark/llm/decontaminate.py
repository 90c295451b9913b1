"""Benchmark decontamination: a prefix-filtered set join on item-sized windows.

Words are runs of anything but ASCII characters that aren't letters or digits, with A-Z lower-cased. A window is `size`
consecutive words of an item (a shorter item is one window). Its tokens are its shingles of three words (of all its words, if it
has fewer). To contain a window a document must contain its rarest shingle, so one shingle is the whole prefix that an exact
containment needs; rarity is the count over all documents. A prefix at position p of a document and offset o of a window fixes
where the window would start; that start and its end must lie inside the document, and the words there are compared one by one.

Which shingles leave the scan is told by a table of SLOTS bits, one for each remainder of the shingles' hashes: it has one size
for any benchmark, and a shingle that only shares its remainder with a prefix finds no window in the join. Windows, items and
hits are plain rows, joined by number; only what belongs to one document is ever gathered.

Null and empty texts have no words. Rows are told apart by where they are read and written out once with that number, so repeated
ids and rows keep a result each; items with equal texts all count, and a repeated item_id once, a null one not at all. Ties in
rarity fall to the smaller hash, then to the first offset, and change no result. An empty benchmark leaves every document clean,
an empty table of documents gives no rows. Texts are read whole, however long. Further columns are left away (report) or kept
(clean), whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import ascii_lower, cut, whole, words

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SIZE, SHINGLE = 10, 3
#: Size of the table of remainders in the plan, in bits (a multiple of 64).
SLOTS = 1 << 20


def tokens(text: Column | str) -> Column:
    """The words, before lower-casing (which changes no boundary)."""
    return words(whole(text), BETWEEN)


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(win, item_id): the distinct windows of each item, as arrays of lower-cased words."""
    w = F.col("w")
    df = items.select(F.col(item_id).cast("string").alias("item_id"), F.transform(tokens(text), ascii_lower).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
    return df.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(w, i, F.lit(size)))).alias("win")).distinct()


def shingles(w: Column, k: int) -> Column:
    """The hash of the k words from each position of w, words in lower() form."""
    n = F.size(w) - k + 1
    each = F.transform(F.slice(w, F.lit(1), F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(F.lit(k), x, *(F.get(w, i + d) for d in range(1, k))))
    return F.when(n > 0, each).otherwise(F.array().cast("array<bigint>"))


def _slot(h: Column) -> Column:
    return F.pmod(h, F.lit(SLOTS)).cast("int")


def _table(hashes: DataFrame, column: str) -> Column:
    """A bit for each remainder, 1 where some hash has it, as an array of 64-bit numbers; SLOTS remainders at most come to the driver."""
    out = np.zeros(SLOTS, dtype=np.uint8)
    out[[r[0] for r in hashes.select(_slot(F.col(column))).distinct().collect()]] = 1
    numbers = np.packbits(out, bitorder="little").view("<i8").tolist()
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")  # folded to one literal


def _listed(table: Column, h: Column) -> Column:
    slot = _slot(h)
    word = F.get(table, F.shiftright(slot, 6))
    return F.call_function("getbit", word, slot.bitwiseAND(F.lit(63))) == 1


def prefixes(docs: DataFrame, wins: DataFrame, text: str = "text") -> tuple[DataFrame, list[int]]:
    """wins(win_id, win) -> (win_id, win, k, sh, offset), sh being the rarest shingle, of k words; and all k there are."""
    low = F.transform("win", F.lower)
    k = F.least(F.size("win"), F.lit(SHINGLE))
    own = F.when(k == 1, shingles(low, 1)).when(k == 2, shingles(low, 2)).otherwise(shingles(low, SHINGLE))
    each = cut(wins.select("win_id", k.alias("k"), F.posexplode(own).alias("offset", "sh")), "window-shingles")
    sizes = sorted(r.k for r in each.select("k").distinct().collect())
    if sizes:
        table = _table(each, "sh")
        df = docs.select(words(F.lower(whole(text)), BETWEEN).alias("w"))
        seen = df.select(F.explode(F.concat(*(F.filter(shingles(F.col("w"), n), lambda h: _listed(table, h)) for n in sizes))).alias("sh"))
        # A table of its own: it is broadcast if small, and else a plain exchange, so that a shingle of very many windows is split.
        counts = cut(seen.groupBy("sh").agg(F.count("*").alias("n")).join(each.select("sh").distinct(), "sh", "left_semi"), "shingle-counts")
        each = each.join(counts, "sh", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        each = each.withColumn("n", F.lit(0).cast("long"))
    chosen = each.groupBy("win_id", "k").agg(F.min(F.struct("n", "sh", "offset")).alias("b")).select("win_id", "k", "b.sh", "b.offset")
    # Written once: the counts over all documents aren't taken again, and Spark knows the size of what it joins.
    return cut(wins.join(chosen, "win_id"), "prefixes"), sizes


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items (sorted array of item ids as strings), places (hit positions), text_hash."""
    every = cut(windows(items, size=size), "windows")
    wins = cut(every.select("win").distinct().withColumn("win_id", F.monotonically_increasing_id()), "window-ids")
    anchors, sizes = prefixes(docs, wins, text)
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.xxhash64(text).alias("text_hash"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), words(F.lower(whole(text)), BETWEEN).alias("low"))
    spots = F.array().cast("array<struct<pos:int,sh:bigint>>")
    if sizes:
        table = _table(anchors, "sh")
        at = lambda h, i: F.struct(i.alias("pos"), h.alias("sh"))
        spots = F.concat(*(F.filter(F.transform(shingles(F.col("low"), n), at), lambda x: _listed(table, x["sh"])) for n in sizes))
    # The words from size - 1 before the shingle's first to size - 1 after it.
    first = lambda x: F.greatest(x["pos"] - (size - 1), F.lit(0))
    around = lambda x: F.struct(x["pos"].alias("pos"), x["sh"].alias("sh"), first(x).alias("from"), F.transform(F.slice("w", first(x) + 1, x["pos"] - first(x) + size), ascii_lower).alias("ctx"))
    # Most texts have no spot, and aren't split a second time for their words as written.
    base = base.withColumn("spots", spots).withColumn("w", F.when(F.size("spots") > 0, tokens("text")))
    found = base.select("rid", "text_hash", "doc_id", F.size("low").cast("long").alias("n_words"), F.posexplode_outer(F.transform("spots", around)).alias("no", "s"))
    found = cut(found, "spots")
    base = found.filter("no IS NULL OR no = 0").select("rid", "text_hash", "doc_id", "n_words")
    near = found.filter("no IS NOT NULL").select("rid", "s.*").join(anchors, "sh")
    start = F.col("pos") - F.col("from") - F.col("offset")
    inside = (start >= 0) & (start + F.size("win") <= F.size("ctx"))
    near = near.filter(inside & (F.slice("ctx", F.greatest(start, F.lit(0)) + 1, F.size("win")) == F.col("win")))
    hits = cut(near.select("rid", (F.col("pos") - F.col("offset")).alias("at"), F.size("win").alias("n"), "win_id").distinct(), "hits")
    spans = hits.select("rid", "at", "n").distinct().groupBy("rid").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    places = F.array_distinct(F.flatten(F.transform("spans", lambda h: F.sequence(h["at"], h["at"] + h["n"] - 1))))
    of_win = every.filter("item_id IS NOT NULL").join(wins, "win").select("win_id", "item_id")
    told = hits.select("rid", "win_id").distinct().join(of_win, "win_id").select("rid", "item_id").distinct()
    told = told.groupBy("rid").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    out = base.join(spans.select("rid", places.alias("places")), "rid", "left").join(told, "rid", "left")
    none = F.coalesce("places", F.array().cast("array<int>"))
    return out.select("doc_id", "n_words", F.size(none).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), none.alias("places"), "text_hash")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    hit = overlaps(docs, items).filter("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")).distinct()
    # Written once, so that Spark sends the documents through an exchange only if the hit ones are too many to broadcast.
    hit = cut(hit, "contaminated")
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["__id"]) & (F.xxhash64(docs["text"]) == hit["__h"]), "left_anti")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    df = overlaps(docs, items)
    return df.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
