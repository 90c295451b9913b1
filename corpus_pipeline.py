"""Training-data pipeline over documents: STAGES, each (name, function of (spark, docs, sf_dir)), and run().

Every stage takes all that the one before kept. Clean documents pass all filters. What holds for all stages: a null text is the
empty one; rows are judged one by one, also with null or repeated ids, but that near-dedup keeps one row of a group; texts are
read whole, however long; an empty table gives an empty one; columns of any name are kept as they are, but for text and n_chars
where a stage changes the text, and own_<name> where the mix has a column of that name itself. Ties are told by each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamark.llm import decontaminate, line_rules, mixing, secrets, simhash
from seamark.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go, then documents that the rules reject."""
    return line_rules.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id's, a null id only where there is no other."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; all rows of one id and text, or none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; no document goes, and a null text stays null."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of copies."""
    return mixing.mixture(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources", mix),
]

#: Fingerprints can't be had in DuckDB's SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
