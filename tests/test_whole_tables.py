"""Queries over all rows of their tables, against brute force too."""

import __spark_entry__ as e
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_components_of_all_orders(spark):
    rows = spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority").collect()
    own = {}

    def root(x):
        while own.setdefault(x, x) != x:
            own[x] = own[own[x]]
            x = own[x]
        return x

    for r in rows:
        for other in (f"c{r.o_custkey}", f"p{r.o_orderpriority}{r.o_orderkey % 60}"):
            a, b = sorted((root(f"o{r.o_orderkey}"), root(other)))
            own[b] = a
    got = {r.node: r.component for r in e.queries()["graph_components_all"](spark, SMALL).collect()}
    assert got == {x: root(x) for x in own}
    assert sum(x.startswith("o") for x in got) == len(rows)


def test_components_of_small_groups(spark):
    from seamark.plans import lineage_queries

    orders = [(i, i // 3, str(i // 3)) for i in range(60)]  # o_orderkey % 60 keeps them apart
    df = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string")
    got = lineage_queries.graph.components(lineage_queries._order_edges(df)).filter(F.col("node").startswith("o")).collect()
    want = {f"o{i}": f"c{i // 3}" for i, _, _ in orders}
    assert {r.node: r.component for r in got} == want


def test_walks_from_all_starts(spark):
    up = {r.target for r in e.queries()["graph_upstream_all"](spark, SMALL).filter("depth = 1").collect()}
    regions = {f"region0.{r.r_regionkey}" for r in spark.read.parquet(f"{SMALL}/region.parquet").collect()}
    assert len(regions) == 5 and regions <= up
    down = {r.source for r in e.queries()["graph_downstream_all"](spark, SMALL).filter("depth = 1").collect()}
    keys = [r.o_orderkey for r in spark.read.parquet(f"{SMALL}/orders.parquet").collect()]
    assert {x for x in down if x.startswith("orders") and "." in x} == {f"orders{k % 30}.{k}" for k in keys if (k + 3) % 7 != 6}


def test_words_of_any_length(spark):
    from collections import Counter

    n, docs = Counter(), Counter()
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        words = r.text.split(" ") if r.text is not None else []
        n.update(words)
        docs.update(set(words))
    got = {r.w: (r.n, r.docs) for r in e.queries()["explode_words_all"](spark, SMALL).collect()}
    assert got == {w: (n[w], docs[w]) for w in n} and any(len(w) < 4 for w in got)
