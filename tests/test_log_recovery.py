"""Containment joins, log attribution and witnesses against brute force and by cases; the stream against the batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from seamark.operators import log_recovery as lr
from seamark.streaming import witness


def test_contained_equals_brute_force(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("ab c\n") for _ in range(n))
    texts = [(i, word(r.choice([0, 5, 40, 700, 1500]))) for i in range(60)] + [(61, None), (None, "abab"), (1, "abcabcabc"), (62, "x" * 511 + "BOUNDARY WORD" + "y" * 600), (63, "a" * 3000), (64, "𝒜" * 600 + "end")]
    patterns = [word(n) for n in (1, 2, 3, 7, 8, 9, 10, 12, 20, 30)] + [t[a : a + 9] for i, t in texts[:30] if t for a in (0, len(t) // 2, max(0, len(t) - 9))]
    patterns += ["BOUNDARY WORD", "xBOUNDARY", "y" * 599, "a" * 2999, "a" * 3001, "𝒜end", "", None, "nowhere in there", "nowhere in there"]
    got = lr.contained(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    want = {(i, p) for i, t in texts if t is not None and i is not None for p in patterns if p and p in t}
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_spaced_patterns_list_words_alone(spark, monkeypatch):
    """A pattern with a space far from its end is found without a run at each character; digests stand for texts."""
    monkeypatch.setattr(lr, "_runs", lambda *a: 1 / 0)
    texts = [(1, "x" * 700 + " MANY WORDS BEFORE THE END"), (2, " ÜBER𝒜 WORDS\n"), (3, "MANY  WORDS BEFORE THE END"), (4, "MANY WORDS BEFORE"), (5, "")]
    patterns = ["MANY WORDS BEFORE THE END", "x MANY WO", " ÜBER𝒜 W", "S BEFORE", "MANY WORDS BEFORE", "xx MANY WORDS BEFORE THE END "]
    got = lr.contained(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in patterns if p.find(" ") + 8 <= len(p)], "pattern string"))
    want = {(i, p) for i, t in texts for p in patterns if p in t and p.find(" ") + 8 <= len(p)}
    assert {tuple(x) for x in got.collect()} == want and len(want) == 5


def test_contained_of_nothing(spark):
    t, p = spark.createDataFrame([(1, "text")], "id int, text string"), spark.createDataFrame([("text",)], "pattern string")
    assert lr.contained(t.limit(0), p).collect() == [] and lr.contained(t, p.limit(0)).collect() == [] and len(lr.contained(t, p).collect()) == 1


EMITTERS = [
    (1, "a", "Job_A", ["UPDATE DIM_CUSTOMER SET", "SHARED FRAGMENT HERE"]),
    (2, "b", None, ["INSERT INTO FACT_SALES VALUES", "SHARED FRAGMENT HERE", "SELECT ONE FROM T WHERE K = 'X'"]),
    (3, "c", "job_a", ["DELETE FROM STAGE_ROWS", "WHERE LOADED < SYSDATE"]),
    (4, "d", None, ["MERGE INTO DIM_ONE"]),
    (5, "e", None, ["MERGE INTO DIM_TWO"]),
]


def test_attribution(spark):
    t0 = dt.datetime(2026, 1, 1, 12)
    log = [
        (1, "update  dim_customer\nset x = 1", "JOB_a", t0),  # an action in another case; of two units the first
        (2, "update dim_customer set region = 5", "other", t0),  # a fragment: a lead, no unit, and no timing either
        (3, "shared fragment here", None, None),  # tells nothing
        (4, "delete from stage_rows where loaded < sysdate; insert into fact_sales values (1)", None, t0),  # two fragments of c lead
        (5, "merge into dim_one; merge into dim_two", None, t0),  # a tie, told as one
        (6, "select one from t where k = 'other'", None, t0),  # of b's shape
        (7, "commit", None, t0),  # within two windows: the one that began last
        (8, "commit", None, t0 + dt.timedelta(days=9)),
        (9, None, None, None),
        (9, None, None, None),
        (10, "insert into fact_sa", None, t0 + dt.timedelta(days=9)),  # cut off within the fragment
    ]
    windows = [("w1", t0 - dt.timedelta(hours=1), t0 + dt.timedelta(hours=1)), ("w2", t0 - dt.timedelta(minutes=1), t0), ("w3", t0 + dt.timedelta(days=1), None)]
    df = spark.createDataFrame(log, "sql_id int, sql_text string, action string, first_load_time timestamp")
    em = spark.createDataFrame(EMITTERS, "no int, unit string, action string, fragments array<string>")
    out = lr.attributed(df, em, spark.createDataFrame(windows, "unit string, start timestamp, stop timestamp"))
    got = sorted(((r.sql_id, r.unit, r.signal, tuple(r.candidates), r.lead) for r in out.collect()), key=repr)
    want = [(1, "a", "action", (), None), (2, None, "fragment", ("a",), "a"), (3, None, "none", (), None), (4, None, "fragment", ("c", "b"), "c"), (5, None, "fragment", ("d", "e"), None)]
    want += [(6, None, "shape", ("b",), None), (7, "w2", "timing", (), None), (8, None, "none", (), None), (9, None, "none", (), None), (9, None, "none", (), None), (10, None, "none", (), None)]
    assert got == sorted(want, key=repr)
    report = {r.signal: (r.n, r.high_confidence, r.rate) for r in lr.recovery(out).collect()}
    assert report == {"action": (1, 1, 1 / 11), "fragment": (3, 1, 1 / 11), "shape": (1, 1, 1 / 11), "timing": (1, 1, 1 / 11), "none": (5, 1, 1 / 11)}
    assert lr.attributed(df.limit(0), em).collect() == [] and lr.recovery(out.limit(0)).collect() == []
    assert {r.signal for r in lr.attributed(df, em.limit(0)).collect()} == {"none"}


STATEMENTS = [("Load", 3, "update dim_customer set region = 'x' where id = 5"), ("load", 9, "delete from stage_rows where loaded < 7"), ("load", 12, "alter table facts exchange partition p1"), ("load", 20, "commit"), ("other", 1, "update dim_customer set region = 'x' where id = 5"), ("gone", 1, "delete from stage_rows where loaded < 7"), ("load", 30, None)]


def test_witness(spark):
    st = spark.createDataFrame(STATEMENTS, "unit string, line long, text string")
    log = spark.createDataFrame([("LOAD", "UPDATE dim_customer SET region='y' WHERE id = 99".replace("='", " = '")), ("gone", "update dim_customer set region = 'x' where id = 5"), (None, "delete from stage_rows where loaded < 7"), ("other", None)], "action string, sql_text string")
    got = {(r.unit, r.line): r.verdict for r in lr.witness(log, st).collect()}
    # Of `gone` and `other` nothing was sighted, so nothing is said about them.
    assert got == {("LOAD", 3): "exercised", ("LOAD", 9): "unexercised", ("LOAD", 12): "unobservable", ("LOAD", 20): "unobservable", ("LOAD", 30): "unobservable"}
    assert lr.witness(log.limit(0), st).collect() == [] and lr.witness(log, st.limit(0)).collect() == []


def _replayed(spark, tmp_path, files, quiet):
    """The rows that the stream gives for files of (minute, action, sql_text), read one after another."""
    src = tmp_path / "in"
    t0 = dt.datetime(2026, 1, 1)
    schema = "ts timestamp, action string, sql_text string"
    shapes = lr.known_shapes(spark.createDataFrame(STATEMENTS, "unit string, line long, text string"))
    for n, rows in enumerate(files):
        df = spark.createDataFrame([(t0 + dt.timedelta(minutes=m), a, s) for m, a, s in rows], schema)
        df.coalesce(1).write.mode("append").json(str(src))
        import os
        import time

        for f in src.glob("part-*"):
            if f.stem not in getattr(_replayed, "seen", set()):
                os.utime(f, (time.time() + n, time.time() + n))
                _replayed.seen = getattr(_replayed, "seen", set()) | {f.stem}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    out = str(tmp_path / "out")
    q = witness.last_seen(stream, shapes, late="10 minutes", quiet=quiet).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination(240)
    everything = spark.read.schema(schema).json(str(src))
    return spark.read.parquet(out).collect(), {(r.unit, r.line): (r.first_seen, r.last_seen, r.n) for r in witness.last_seen_batch(everything, shapes).collect()}


UPDATE, DELETE = "update dim_customer set region = 'q' where id = 1", "delete from stage_rows where loaded < 1"


def test_stream_equals_batch_with_late_rows(spark, tmp_path):
    files = [[(0, "load", UPDATE), (5, "other", UPDATE)], [(20, "load", DELETE), (12, "load", UPDATE)], [(25, "load", UPDATE), (14, "load", DELETE), (13, "other", "short")]]
    told, batch = _replayed(spark, tmp_path, files, "1 day")
    last = {}
    for r in sorted(told, key=lambda r: r.n):
        assert r.event == "seen"
        last[r.unit, r.line] = r.first_seen, r.last_seen, r.n
    assert last == batch and batch["LOAD", 3][2] == 3


def test_stream_drops_too_late_rows_and_tells_quiet_ones(spark, tmp_path):
    files = [[(0, "load", UPDATE)], [(300, "load", DELETE)], [(301, "load", DELETE)], [(302, "load", DELETE), (1, "load", DELETE)]]
    told, batch = _replayed(spark, tmp_path, files, "60 minutes")
    quiet = [(r.unit, r.line, r.n) for r in told if r.event == "quiet"]
    assert quiet == [("LOAD", 3, 1)]
    n = max(r.n for r in told if r.line == 9)
    assert n == 3 and batch["LOAD", 9][2] == 4  # the row of minute 1 came after the watermark had passed it


def test_patterns_meet_words_and_not_texts(spark, monkeypatch):
    """Patterns of several words need no runs of characters; those of one word list the runs of the distinct words alone."""
    runs, asked = lr._runs, []
    monkeypatch.setattr(lr, "_runs", lambda words, sizes: asked.append(words.count()) or runs(words, sizes))
    texts = [(i, f"SOME{i % 2} WORDS BEFORE  THE ÄND " * 50 + "x" * 9) for i in range(30)] + [(40, " "), (41, "AB CD"), (42, "xAB CDx\nEF")]
    df = spark.createDataFrame(texts, "id int, text string")
    told = lambda patterns: {tuple(r) for r in lr.contained(df, spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()}
    want = lambda patterns: {(i, p) for i, t in texts for p in patterns if p in t}
    several = ["S BEFORE", "AB CD", "B C", " ", "  ", "  T", "E0 WOR", "D ", "AB  CD", "BEFORE  THE ÄND SOME1", "A B"]
    assert told(several) == want(several) and not asked
    one = ["xxxx", "ORD", "ÄND", "CDx\nEF", "BEFORE", "nowhere", "S"]
    assert told(one + several) == want(one + several) and asked == [11]


def test_shapes_of_quotes_and_blanks(spark):
    long = "select '" + "ab " * 40_000 + "' from a_table_of_mine"
    said = [long, "select 'it''s' ,'x from a_table_of_mine", "select  1.5;\t; x2 3 from\n\na_table_of_mine ; ", "select a -- b\n/* c */ from a_table_of_mine", "short", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(said)), "i int, s string").orderBy("i").select(lr.normal.statement_shape(F.col("s"))).collect()]
    assert got == ["SELECT ? FROM A_TABLE_OF_MINE", "SELECT ? ,'X FROM A_TABLE_OF_MINE", "SELECT ? X2 ? FROM A_TABLE_OF_MINE", "SELECT A FROM A_TABLE_OF_MINE", None, None]
