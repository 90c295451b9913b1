import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.llm import quality_model as q

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute_features(text):
    """{(kind, n-gram): value}: n-grams as written, not hashed."""
    w = (text or "").encode().split()

    def shape(x):
        out = []
        for c in x:
            k = chr(q._KIND[c])
            if not out or out[-1] != k:
                out.append(k)
        return "".join(out)

    s = [shape(x) for x in w]
    out = {}
    for kind, grams in enumerate((w, list(zip(w, w[1:], strict=False)), s, list(zip(s, s[1:], strict=False)), [a == b for a, b in zip(w, w[1:], strict=False)])):
        for g in grams:
            out[kind, g] = out.get((kind, g), 0) + q.SCALE / len(grams)
    return out


def test_features_equal_brute_force():
    texts = [None, "", "  ", "One two two  three*** É4x", "a", " lead and tail \n", "same same"]
    doc, at, value = q.features(texts)
    for i, t in enumerate(texts):
        want = sorted(np.round(list(brute_features(t).values()), 9))
        mine = {}
        for a, v in zip(at[doc == i], value[doc == i], strict=True):
            mine[a] = mine.get(a, 0) + v
        assert sorted(np.round(list(mine.values()), 9)) == pytest.approx(want)
    again = q.features(["x", *texts])
    assert sorted(again[1][again[0] == 4]) == sorted(at[doc == 3])


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = q.report(docs, labels)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == docs.count()
    truth = [(r.quality, rows[r.doc_id]) for r in labels.collect()]
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in rows.items())
    held = [(y, x.predicted) for y, x in truth if x.held_out]
    assert sum(y == p for y, p in held) / len(held) >= 0.93
    assert all(p == 1 for y, p in held if y == 1)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x y z"), (3, "w " * 300000)], "doc_id long, text string").withColumns({"score": F.lit("clash"), "quality": F.lit("clash")})
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    out = q.report(docs, none).collect()
    assert len(out) == 5 and {r.score for r in out} == {0.5} and not any(r.held_out for r in out if r.doc_id is None)
    some = spark.createDataFrame([(3, 1), (3, 1), (1, 0), (99, 0)], "doc_id long, quality int")
    got = q.report(docs, some).collect()
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert q.report(docs.limit(0), some).count() == 0


def test_the_bound_holds_for_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    seen = docs.sparkSession.sparkContext.accumulator(0)
    plain = q.train

    def counted(texts, y):
        seen.add(len(texts))
        return plain(texts, y)

    monkeypatch.setattr(q, "train", counted)
    q.fit(docs, labels, max_train=40)
    assert 0 < seen.value <= 40


def test_training_and_scores_equal_plain_loops(spark):
    """FTRL as its paper writes it, one weight at a time in dictionaries, and scores as sums over a text's n-grams."""
    import math

    rows = [(i, ("good words here now " if i % 2 else "BUY!! buy buy *** ") * (i % 3 + 1) + f"own{i}") for i in range(30)]
    texts, y = [t for _, t in rows], np.array([i % 2 for i, _ in rows], dtype=float)

    def sparse(text):
        _, at, value = q.features([text])
        x = {q_: 0.0 for q_ in at.tolist()}
        for a, v in zip(at.tolist(), value.tolist(), strict=True):
            x[a] += v
        return x | {1 << q.BITS: 1.0}

    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= q.L1:
            return 0.0
        return -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    for _ in range(q.EPOCHS):
        for t, label in zip(texts, y, strict=True):
            x = sparse(t)
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / q.ALPHA
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = q.train(texts, y)
    for i in z:
        assert got[i] == pytest.approx(weight(i), abs=1e-9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r.doc_id: r.score for r in q.predict(df, got).collect()}
    for i, t in rows:
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-sum(weight(k) * v for k, v in sparse(t).items()))), abs=1e-6)
