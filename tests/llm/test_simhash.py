import random

import brute
import pytest
from pyspark.sql import functions as F

from seamark.llm import simhash

SMALL = "/root/testdata/sf0.001"


def test_fingerprints(spark):
    rows = [(1, None), (2, ""), (3, "One"), (4, "one two"), (5, "Élan\x0bB C d e"), (6, "a b c a b c a b c"), (7, "w " * 200000)]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(df).collect()}
    assert got == {i: brute.fingerprint(t) for i, t in rows}


@pytest.mark.parametrize("crowd,bits", [(2, 3), (512, 3), (2, 4), (8, 4), (512, 4)])
def test_components_of_crowds(spark, crowd, bits):
    """Two kinds of fingerprints at once, in crowds that reach each level of keys; links never cross kinds."""
    rnd = random.Random(crowd * 10 + bits)
    prints = [(0, 0), (1, 0)]
    for kind in (0, 1):
        for _ in range(3):
            base = rnd.getrandbits(64)
            for _ in range(16):
                prints.append((kind, base ^ sum(1 << b for b in set(rnd.choices(range(64), k=rnd.randint(0, 7))))))
    prints = sorted(set(prints))
    byid = {kind: {i: fp for i, (k, fp) in enumerate(prints) if k == kind} for kind in (0, 1)}
    want = brute.components(byid[0], bits) | brute.components(byid[1], bits)
    ids = {p: i for i, p in enumerate(prints)}
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(k, signed(p), 0) for k, p in prints], "kind int, fp long, known long")
    own = {i: i for i in want}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for r in simhash.links(df, crowd, bits).collect():
        a, b = r.a & (2**64 - 1), r.b & (2**64 - 1)
        assert (a ^ b).bit_count() <= bits
        x, y = sorted((root(ids[r.kind, a]), root(ids[r.kind, b])))
        own[y] = x
    assert {i: root(i) for i in want} == want
    assert len(set(want.values())) < len(want)
    # With half of the fingerprints known to be of their group, the links still connect all, and are fewer.
    known = {i: want[i] + 1 if rnd.random() < 0.5 else 0 for i in want}
    half = spark.createDataFrame([(k, signed(p), known[i]) for i, (k, p) in enumerate(prints)], "kind int, fp long, known long")
    own = {i: i for i in want}
    joined = {}
    for i, g in known.items():
        if g:
            own[root(i)] = root(joined.setdefault(g, i))
    rows = simhash.links(half, crowd, bits).collect()
    for r in rows:
        x, y = sorted((root(ids[r.kind, r.a & (2**64 - 1)]), root(ids[r.kind, r.b & (2**64 - 1)])))
        own[y] = x
    same = {}
    for i, g in want.items():
        same.setdefault(g, set()).add(root(i))
    assert all(len(x) == 1 for x in same.values()) and len({root(i) for i in want}) == len(set(want.values()))


@pytest.mark.parametrize("bits", [3, 4])
def test_every_pair_in_the_budget_shares_a_key(bits):
    rnd = random.Random(1)
    for level in range(3):
        masks = simhash._masks(level, bits)
        for _ in range(3000):
            diff = sum(1 << b for b in rnd.sample(range(64), bits))
            assert any(diff & m == 0 for m in masks)


def test_pair_prints():
    texts = [None, "", " \t", "One", "one two", "Élan\x0bB C d e", "a b c a b c a b c", "w " * 50_000, " ".join(f"v{i}" for i in range(40_000))]
    assert [tuple(int(x) for x in simhash.pair_prints(t)) for t in texts[:-1]] == [brute.pair_prints(t) for t in texts[:-1]]
    assert tuple(int(x) for x in simhash.pair_prints(texts[-1])) == brute.pair_prints(texts[-1])


def test_near_copies_of_a_corpus(spark):
    """Texts with a word in 60 changed are one group, also through each other; texts of other words, and reordered ones, aren't."""
    rnd = random.Random(2)
    rows, groups = [], {}
    for g in range(12):
        base = [f"w{rnd.randrange(3000)}" for _ in range(240)]
        for c in range(5):
            w = list(base)
            for at in rnd.sample(range(240), 2):
                w[at] = f"x{g}y{c}z{at}"
            rows.append((100 * g + c, " ".join(w)))
            groups[100 * g + c] = 100 * g
        w = list(base)
        rnd.shuffle(w)
        rows.append((100 * g + 50, " ".join(w)))
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.text_groups(dict(rows))
    assert kept == set(want.values())
    assert all(100 * g + 50 in kept for g in range(12)) and sum(want[i] == g for i, g in groups.items()) >= 0.9 * len(groups)


def test_sets_of_fives():
    texts = [None, "", " \t", "One", "one two three four", "a b c d e a b c d e", "É\x0bb C d e f", " ".join(f"v{i}" for i in range(60_000))]
    assert [len(simhash.shingle_set(t)) for t in texts] == [len(brute.fives(t)) for t in texts[:-1]] + [len(set(simhash.shingle_set(texts[-1]).tolist()))]
    assert simhash.shingle_set("A b").tolist() == simhash.shingle_set(" a\nb").tolist() != simhash.shingle_set("a c").tolist()


def test_edges_are_held_against_the_texts(spark):
    """Fingerprints may be as near as they like: an edge stays only where the texts agree; no words agree with no words alone."""
    words = [f"w{i}" for i in range(100)]
    texts = {1: " ".join(words), 2: " ".join([*words[:99], "other"]), 3: " ".join(reversed(words)), 4: None, 5: "a b", 6: "A  b"}
    docs = spark.createDataFrame([*texts.items(), (6, "A  b")], "doc_id long, text string")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), (F.col("doc_id") + 10).alias("unit"))
    nodes = docs.select((F.col("doc_id") + 10).alias("unit"), (F.col("doc_id") + 20).alias("node"))
    found = spark.createDataFrame([(20 + a, 20 + b) for a in texts for b in texts if a < b], "a long, b long")
    kept = {(r.a - 20, r.b - 20) for r in simhash.agreeing(docs, rows, nodes, found.unionByName(found)).collect()}
    assert kept == {(1, 2), (5, 6)}
    assert simhash.agreeing(docs, rows, nodes, found.limit(0)).count() == simhash.agreeing(docs.limit(0), rows.limit(0), nodes.limit(0), found).count() == 0


def test_connected(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)]
    own = {}
    find = lambda x: x if own.setdefault(x, x) == x else find(own[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            own[y] = x
    got = {r.id: r.root for r in simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in own}
    assert simhash.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(150)
    odd = [(9001, None), (9002, ""), (None, None), (9003, "same words here"), (9003, "same words here"), (None, "only me and no other id at all")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("fp", F.lit("clash"))
    rows = df.collect()
    prints = {r.doc_id: brute.fingerprint(r.text) for r in rows if r.doc_id is not None}
    want = brute.components(prints)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.report(df).collect()]
    exp = [(r.doc_id, f"{brute.fingerprint(r.text):016x}", want[r.doc_id] if r.doc_id is not None else 9001 if r.text is None else None) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, exp))
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    groups = brute.text_groups({r.doc_id: r.text for r in rows if r.doc_id is not None}, simhash.PAIR_BITS)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(i) for i in set(groups.values())] + ["None"])
    again = simhash.representatives(df.unionByName(df), crowd=2)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, kept.collect()))
    assert simhash.report(df.limit(0)).count() == simhash.representatives(df.limit(0)).count() == 0


def test_an_edge_is_told_once(spark, monkeypatch):
    """Near copies meet under several keys; each pair is held against the texts once."""
    handed, agreeing = [], simhash.agreeing

    def told(docs, rows, nodes, found):
        handed.append(sorted(map(tuple, found.collect())))
        return agreeing(docs, rows, nodes, found)

    monkeypatch.setattr(simhash, "agreeing", told)
    rnd = random.Random(1)
    words = [f"w{rnd.randrange(500)}" for _ in range(300)]
    near = [" ".join(words[:i] + ["other"] + words[i + 1 :]) for i in range(0, 300, 20)]
    simhash.pair_groups(spark.createDataFrame(list(enumerate(near)), "doc_id long, text string"))
    assert len(handed) == 2 and len(handed[0]) > 1
    assert all(len(found) == len(set(found)) for found in handed)
