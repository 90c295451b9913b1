"""Queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark.llm import backoff_lm, chat, decontaminate, hard_negatives, html_extract, language_id, licenses, line_rules, mixing, quality_model, secrets, simhash, token_alignment
from seamark.llm.common import table
from seamark.llm.sql import ORACLE


def op1_html_extract(spark, sf_dir):
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_secret_scan(spark, sf_dir):
    """Secrets in every document."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_quality_model(spark, sf_dir):
    """Quality scores of every document, learned from labels of four folds of five."""
    return quality_model.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark, sf_dir):
    """Licences that documents are or name."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_chat_format(spark, sf_dir):
    """All conversations formatted, and a conversation -1 whose texts hold control strings."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = said.unionByName(own)
    return chat.report(rows.select("conv_id", "turn", "role", chat.text_part(F.coalesce("text", F.lit(""))).alias("parts")))


def op6_simhash(spark, sf_dir):
    """Fingerprints and components of every document."""
    return simhash.report(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    """Words of every document inside windows of benchmark items."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark, sf_dir):
    """Counts and verdicts of the line rules on every document."""
    out = line_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_backoff_lm(spark, sf_dir):
    """Stupid-backoff scores of every document."""
    return backoff_lm.scores(table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    """Words that the mix takes of every document."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth id, with the labels of every seventh moved on by one."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    df = df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(hard_negatives.usable(df), F.col("id") % 100 == 0)


def op12_language_id(spark, sf_dir):
    """Languages of every document, learned from three folds of four."""
    return language_id.report(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark, sf_dir):
    """Alignment of two tokenizers' tokens in every document."""
    return token_alignment.align(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {"pipeline": pipeline} | {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql():
    return dict(ORACLE)
