from test_backoff_lm import SMALL, brute_scores

from seamark.llm import registry


def test_registered_query_scores_trigrams(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_words, round(r.log_score, 6)) for r in registry.op9_backoff_lm(spark, SMALL).collect()]
    want = brute_scores(rows, 3, 0.4, 1)
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and brute_scores(rows, 2, 0.4, 1) != want != brute_scores(rows, 3, 0.4, 2)
