import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from seamark.llm import line_rules, registry
from seamark.llm.common import cut

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = [(90001, "token = " + "k9" * 12 + " " + " ".join(f"one{i}" for i in range(80))), (90002, "junk"), (90003, None), (None, "Nobody " + " ".join(f"two{i}" for i in range(80)))]
    extra += [(90010 + i, " ".join(f"near{j}" for j in range(120)) + (" tail" if i == 2 else "")) for i in range(3)]
    extra += [(90020, " ".join(f"lead{j}" for j in range(60)) + " " + spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text)]
    more = spark.createDataFrame([(i, t, "en", f"src{(i or 1) % 3}", len(t or "")) for i, t in extra], docs.schema)
    out = [cut(docs.unionByName(more), "t")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SMALL), "t"))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "benchmark decontamination", "secret scans", "mixing sources"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[5].columns == [*stages[0].columns, "size", "source_size", "target", "copies", "taken"]


def test_quality_stage(stages):
    kept = {(r.doc_id, r.clean_text) for r in line_rules.quality_rules(stages[0]).filter("kept").collect()}
    assert {(r.doc_id, r.text) for r in stages[1].collect()} == kept
    assert {r.doc_id for r in stages[1].collect()} >= {None, 90001, 90010, 90020} and 90002 not in {i for i, _ in kept}
    assert all(r.n_chars == len(r.text) for r in stages[1].collect())


def test_dedup_stage(stages):
    texts = {r.doc_id: r.text for r in stages[1].collect() if r.doc_id is not None}
    assert {r.doc_id for r in stages[2].collect()} == {*brute.text_groups(texts).values(), None}
    assert 90010 in texts and not {90011, 90012} & {r.doc_id for r in stages[2].collect()}


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in stages[2].collect() if not brute.overlaps(r.text, items)[-1]}
    assert {r.doc_id for r in stages[3].collect()} == clean and 90020 not in clean


def test_secret_stage(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert set(before) == set(after)
    for i, r in after.items():
        assert sum(brute.secrets(r.text)[0][:3]) == 0 and r.n_chars == len(r.text)
        if not sum(brute.secrets(before[i].text)[0][:3]):
            assert r == before[i]
    assert "[SECRET]" in after[90001].text


def test_mixing_stage(stages):
    docs = {r.doc_id: r for r in stages[4].collect()}
    rows = stages[5].collect()
    assert all(r.copies >= 1 and r.taken == r.copies * r["size"] and r.text == docs[r.doc_id].text for r in rows)
    per = stages[4].groupBy("source").agg(F.max(F.size(F.split("text", r"\s+")))).collect()
    for source, most in per:
        own = [r for r in rows if r.source == source]
        if own:
            assert abs(sum(r.taken for r in own) - own[0].target) <= most


def test_run(spark):
    out = registry.queries()["pipeline"](spark, SMALL)
    assert out.count() > 20 and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_empty_tables_clashing_columns_and_repeats(spark, stages):
    few = stages[0].limit(30)
    odd = few.unionByName(few).withColumns({"size": F.lit("own"), "__n": F.lit("own"), "__own": F.lit(1), "win": F.lit(None).cast("string"), "unit": F.lit("own"), "doc": F.lit("own"), "found": F.lit("own"), "q_kept": F.lit("own")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, stages[0].limit(0), SMALL).count() == 0, name
        out = stage(spark, odd, SMALL)
        own = [("own_size" if c == "size" and name == "mixing sources" else c) for c in odd.columns]
        assert out.columns[: len(own)] == own
        plain = stage(spark, few.unionByName(few), SMALL)
        assert out.count() == plain.count() > 0, name
        assert all(r["__n"] == r.unit == r.doc == r.found == r.q_kept == "own" for r in out.collect())
