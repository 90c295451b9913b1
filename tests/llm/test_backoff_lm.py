import math
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from seamark.llm import backoff_lm

SMALL = "/root/testdata/sf0.001"


def brute_scores(rows, order, alpha, least):
    counts = Counter()
    for _, t in rows:
        w = brute.WORD.findall(t or "")
        counts.update(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)

    def log(context, w):
        if not context:
            return math.log(counts[(w,)] / total)
        if counts[(*context, w)] >= least:
            return math.log(counts[(*context, w)] / counts[context])
        return math.log(alpha) + log(context[1:], w)

    out = []
    for i, t in rows:
        w = brute.WORD.findall(t or "")
        out.append((i, len(w), round(sum(log(tuple(w[max(0, k - order + 1) : k]), w[k]) for k in range(len(w))) + 0.0, 6)))
    return out


@pytest.mark.parametrize("order,least,chunk", [(2, 2, 8_000_000), (3, 1, 20_000), (1, 2, 50_000), (3, 2, 100_000), (4, 2, 200_000)])
def test_equal_brute_force(spark, order, least, chunk):
    odd = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (None, "one two é\U0001f600 two"), (9005, "a a a a"), (9005, "a a a a"), (9006, "w" * 5000)]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("chunk", F.lit("x"))
    got = [(r.doc_id, r.n_words, round(r.log_score, 6)) for r in backoff_lm.scores(docs, order=order, least=least, chunk_bytes=chunk).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_scores([(r.doc_id, r.text) for r in docs.collect()], order, 0.4, least)))
    assert backoff_lm.scores(docs.limit(0)).count() == 0
