import unicodedata
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seamark.llm import language_id as li
from seamark.llm import registry


def brute_grams(text):
    """Counts of n-grams as strings, from the definition alone."""
    low = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    if not any(unicodedata.category(c)[0] == "L" for c in low):
        return Counter()
    out = Counter()
    for w in low.split(" "):
        if w:
            w = f"_{w}_"
            out += Counter(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != "_")
    return out


def number(gram):
    p = [0 if c == "_" else ord(c) for c in gram]
    return p[0] | 1 << 42 if len(p) == 1 else p[0] << 21 | p[1] | 1 << 43 if len(p) == 2 else (p[0] << 42 | p[1] << 21 | p[2]) - (1 << 63)


def brute_rank(counts, k):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))[:k]]


ODD = ["", "a", "I", "?! 12", "ab a b", "Übung macht\tden MEISTER, ja!", "हिन्दी में लिखो", "日本語の文章です。", "x" * 50, "é ́", "𝒜𝒷 don't re-do", "İstanbul", "  lead  and trail  "]


@pytest.mark.parametrize("text", ODD)
def test_counts_equal_brute_force(text):
    keys, counts = li.counted(text)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {number(g): n for g, n in brute_grams(text).items()}
    assert (keys[1:] > keys[:-1]).all()


def test_long_text_in_slices(monkeypatch):
    text = " ".join(f"wort{'abcdefg'[i % 7]} né" for i in range(500))
    want = li.counted(text)
    monkeypatch.setattr(li, "AT_ONCE", 64)
    got = li.counted(text)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_predictions_equal_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    docs += [{"doc_id": 9000 + i, "text": t, "lang": "zz" if i % 2 else None} for i, t in enumerate([*ODD, None])] + docs[:3] + [{"doc_id": None, "text": "the and of", "lang": "en"}]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"gram": F.lit(1), "rank": F.lit("clash"), "source": F.lit(None).cast("string")})
    got = [tuple(r) for r in li.report(df).collect()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts = {}
    for d in docs:
        if not out(d["doc_id"]) and d["lang"] and d["text"] and brute_grams(d["text"]):
            counts.setdefault(d["lang"], Counter()).update(brute_grams(d["text"]))
    profiles = {lang: {g: r for r, g in enumerate(brute_rank(c, li.K))} for lang, c in counts.items()}
    want = []
    for d in docs:
        own = brute_rank(brute_grams(d["text"] or ""), li.K)
        if not own:
            want.append((d["doc_id"], out(d["doc_id"]), "und", 0.0))
            continue
        away = {lang: sum(abs(p[g] - r) if g in p else li.K for r, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        want.append((d["doc_id"], out(d["doc_id"]), best, 1 - away[best] / (li.K * len(own))))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_held_out_accuracy(spark):
    got = registry.op12_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 200 and sum(r.lang_pred == r.lang for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_learned_and_empty(spark):
    schema = "doc_id long, text string, lang string"
    assert li.report(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(1, "some words", None), (2, None, "en"), (3, "12", "en")], schema)
    assert sorted(tuple(r)[2:] for r in li.report(df).collect()) == [("und", 0.0)] * 3


def test_bound_on_languages(spark):
    df = spark.createDataFrame([("aa", "one"), ("aa", "two"), ("bb", "drei"), ("cc", "four")], "lang string, text string")
    assert {r.lang for r in li.fit(df, max_languages=2).collect()} == {"aa", "bb"}
