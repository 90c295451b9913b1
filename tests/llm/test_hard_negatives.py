import math

import numpy as np
import pytest
from oracle import both
from pyspark.sql import functions as F

from seamark.llm import hard_negatives as hn
from seamark.llm import registry, sql

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    """Sorted result rows, from the definition alone."""
    v = []
    for i, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v.append((i, label, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for n, (i, label, x) in enumerate(v):
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(x, y, strict=True)), j, own) for m, (j, own, y) in enumerate(v) if m != n and len(y) == len(x)]
        for score, p, _ in sorted((s for s in scored if s[2] == label), key=order)[:k]:
            near = sorted((s for s in scored if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score), key=order)[:k]
            out += [(i, p, r, q, score, s) for r, (s, q, _) in enumerate(near, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(0)).withColumn("x", F.lit("clash")).withColumn("place", F.lit(1))
    return sorted((tuple(r) for r in hn.mine(hn.usable(df), F.col("id") % 100 == 0, **sizes).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = [(i, [float(x) for x in rng.normal(size=4)], int(rng.integers(0, 3))) for i in range(400)]
    out += [(1000, [0.5] * 4, 1)] * 3 + [(1001, [0.5] * 4, 1)] * 40 + [(1002, [0.5] * 4, 2)] * 40  # ties, and repeated rows
    out += [(None, [0.5] * 4, 1), (None, [0.5] * 4, 2), (1100, None, 1), (1200, [0.1] * 4, None), (1300, [float("nan")] * 4, 1), (1400, [float("inf"), 0.0, 0.0, 0.0], 1), (1500, [None, 1.0, 1.0, 1.0], 1)]
    out += [(1600, [], 1), (1601, [], 1), (1602, [], 2), (1700, [1.0, 2.0], 1), (1701, [1.0, 2.0], 1), (1702, [1.0, 1.5], 2)]
    return out + [(-100, [-1.0, 0.5, 0.5, 0.0], -1), (-101, [-1.0, 0.5, 0.5, 0.1], -1)]


@pytest.mark.parametrize("sizes", [{}, {"block": 7, "group": 2}])
def test_equals_brute_force(spark, rows, sizes):
    assert mined(spark, rows, **sizes) == brute(rows)


def test_large_components(spark):
    rows = [(100, [3e6, 1.0], 1), (101, [3e6, 2.0], 1), (102, [3e6, 0.5], 2), (103, [2.9e6, 1e6], 2), (104, [1.0, 1.0], 2)]
    assert mined(spark, rows) == brute(rows)
    got = mined(spark, [(100, [1e30], 1), (101, [1e30], 1), (102, [2e30], 2)])
    assert got == [(100, 101, 1, 102, hn.MOST, hn.MOST)]  # beyond 64 bits all count as the largest number


def test_all_negative_scores_have_no_window(spark):
    rows = [(100, [1.0], 1), (101, [-1.0], 1), (102, [-0.9], 2)]
    assert mined(spark, rows) == brute(rows) == []


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == []


def test_query_equals_sql_on_odd_rows(spark, rows, tmp_path):
    spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    import shutil

    for t in ("region nation customer supplier part orders lineitem events documents pages benchmark labels conversations").split():
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    parts = tmp_path / "one.parquet"
    spark.read.parquet(str(tmp_path / "embeddings.parquet")).toPandas().to_parquet(parts)
    shutil.rmtree(tmp_path / "embeddings.parquet")
    parts.rename(tmp_path / "embeddings.parquet")
    got, want = both(spark, str(tmp_path), registry.queries()["op11_hard_negatives"], sql.ORACLE["op11_hard_negatives"])
    assert got == want and got
