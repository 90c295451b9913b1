"""Ranked text search over a positional inverted index held as a table.

The index has a row for each term and document, with the term's positions there; a common term is many rows, never one list. A
query's terms are joined to it, so what is read is the rows of its terms; documents are then judged one by one, as the
matching positions of a document and a query are never more than the document has words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a query's terms bind: all of them, any of them, or all in a row.
KINDS = ("all", "any", "phrase")
#: What lies between terms; terms are in lower case.
BETWEEN = r"[^\p{L}\p{M}\p{N}]+"


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BETWEEN, -1), "")


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """docs -> (term, doc_id, positions, n_terms): positions from 0, and the number of terms of the whole document.

    only(term): the terms that will be asked for, if they are known; whole texts are read, and of other terms no rows are shuffled. Texts that are null or without a term have no rows. Repeated ids count as one document with the texts' positions together.
    """
    words = docs.select(F.col(doc_id).alias("doc_id"), terms(F.col(text)).alias("w")).withColumn("n_terms", F.size("w").cast("long"))
    each = words.select("doc_id", "n_terms", F.posexplode("w").alias("at", "term"))
    if only is not None:
        each = each.join(only.select("term").distinct(), "term", "left_semi")
    return each.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("at")).alias("positions"), F.max("n_terms").alias("n_terms"))


def queries(texts: DataFrame) -> DataFrame:
    """texts(query, kind, words, without) -> (query, kind, n, no, term, role): a row for each distinct term, and for a phrase for each place.

    without: terms that no result may have, or null. A query without terms finds nothing.
    """
    w = terms(F.col("words"))
    w = F.when(F.col("kind") == "phrase", w).otherwise(F.array_distinct(w))
    df = texts.select("query", "kind", w.alias("w"), F.array_distinct(terms(F.coalesce("without", F.lit("")))).alias("x"))
    want = df.select("query", "kind", F.size("w").alias("n"), F.posexplode("w").alias("no", "term")).withColumn("role", F.lit("want"))
    no = df.select("query", "kind", F.size("w").alias("n"), F.posexplode("x").alias("no", "term")).withColumn("role", F.lit("without"))
    return want.unionByName(no)


def _cover(hits: Column, n: Column) -> Column:
    """The fewest places in a row that hold all n terms: over hits(at, no) in order, the last place of each term is kept."""
    start = F.struct(F.array_repeat(F.lit(None).cast("int"), n).alias("last"), F.lit(None).cast("int").alias("best"))

    def step(acc: Column, h: Column) -> Column:
        last = F.transform(acc["last"], lambda x, i: F.when(i == h["no"], h["at"]).otherwise(x))
        span = F.when(~F.exists(last, lambda x: x.isNull()), h["at"] - F.array_min(last) + 1)
        return F.struct(last.alias("last"), F.least(acc["best"], span).alias("best"))

    return F.aggregate(hits, start, step, lambda acc: acc["best"])


def search(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """index() and queries() -> (query, doc_id, n_found, n_hits, cover, rank) of the documents that match.

    all: every term occurs; any: one does; phrase: they occur in a row, and n_hits counts the places where they do. n_found counts
    distinct terms, n_hits places; cover is the length of the shortest stretch with all terms, null for any. The rank is the sum
    over terms of 1 + ln(places), divided by 1 + ln(terms of the document); for all it is divided by cover / terms besides, so terms that
    stand together rank higher. For a phrase it is 1 + ln(n_hits), divided in the same way.
    """
    met = asked.join(postings, "term")
    one = F.struct("no", "positions")
    per = met.groupBy("query", "kind", "n", "doc_id").agg(F.max("n_terms").alias("n_terms"), F.collect_list(F.when(F.col("role") == "want", one)).alias("t"), F.count_if(F.col("role") == "without").alias("bad"))
    per = per.filter((F.col("bad") == 0) & (F.size("t") > 0) & ((F.col("kind") == "any") | (F.size("t") == F.col("n"))))
    # Where a phrase may begin: each term's places less its own; places that all terms name are those where it stands.
    starts = F.transform("t", lambda x: F.transform(x["positions"], lambda p: p - x["no"]))
    phrase = F.size(F.aggregate(starts, F.get(starts, 0), lambda acc, x: F.array_intersect(acc, x)))
    hits = F.array_sort(F.flatten(F.transform("t", lambda x: F.transform(x["positions"], lambda p: F.struct(p.alias("at"), x["no"].alias("no"))))))
    per = per.withColumns({
        "phrase": F.when(F.col("kind") == "phrase", phrase),
        "cover": F.when(F.col("kind") == "all", _cover(hits, F.col("n"))).when(F.col("kind") == "phrase", F.col("n")),
        "places": F.aggregate("t", F.lit(0), lambda acc, x: acc + F.size(x["positions"])),
        "weight": F.aggregate(F.array_sort(F.transform("t", lambda x: F.size(x["positions"]))), F.lit(0.0), lambda acc, x: acc + 1 + F.ln(x)),
    }).filter("phrase IS NULL OR phrase > 0")
    length = 1 + F.ln("n_terms")
    rank = F.when(F.col("kind") == "phrase", (1 + F.ln("phrase")) / length).when(F.col("kind") == "all", F.col("weight") / length / (F.col("cover") / F.col("n"))).otherwise(F.col("weight") / length)
    n_found = F.when(F.col("kind") == "phrase", F.col("n")).otherwise(F.size("t"))
    return per.select("query", "doc_id", n_found.cast("long").alias("n_found"), F.coalesce("phrase", "places").cast("long").alias("n_hits"), F.col("cover").cast("long").alias("cover"), rank.alias("rank"))
