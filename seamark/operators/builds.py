"""Digests of builds and what changed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.frames import cut

#: A row's hash of 128 bits is summed in parts of 32, so that sums of any number of rows that a table can have stay whole.
PARTS = 4


def row_text(columns: list[str]) -> Column:
    """A row as text that no other row of these columns has: nulls differ from every value, and values can't run together."""
    one = lambda c: F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat(*map(one, sorted(columns)))


def digest(facts: DataFrame, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """(by, n, digest): a digest of the multiset of rows, the same in any order and partitioning, and with it the number of rows.

    Each row's MD5 is added up in parts of 32 bits, and the sums are hashed. A row more, or one twice, changes it. columns: those
    that count, by default all but `by`; their order doesn't matter. Without by, one row, also for an empty table.
    """
    by = by or []
    h = F.md5(row_text(columns or [c for c in facts.columns if c not in by]))
    rows = facts.select(*by, *(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)").alias(f"h{i}") for i in range(PARTS)))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"h{i}"), F.lit(0)).cast("string").alias(f"h{i}") for i in range(PARTS)))
    return out.select(*by, "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *(f"h{i}" for i in range(PARTS))), 256).alias("digest"))


def diff(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(key, change, columns): added, gone, and changed facts with the columns that differ, in order; facts that are as they were aren't told.

    Columns are those that both builds have. Of a key that one build has several times only how often each row occurs counts:
    it is changed, with no columns named, if the rows differ as a multiset. Null keys are a key.

    Keys are counted by their hashes; where a build has none twice, rows are compared as they are, and only the others are summed up.
    """
    names = [c for c in old.columns if c in new.columns and c != key]
    h = F.md5(row_text(names)) if names else F.lit("")
    parts = [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)") for i in range(PARTS)]

    def per(df: DataFrame, side: str) -> DataFrame:
        first = [F.first(c).alias(f"{side}_{i}") for i, c in enumerate(names)]
        return df.groupBy(F.struct(key).alias(f"{side}_k")).agg(F.count("*").alias(f"{side}_n"), F.array(*(F.sum(p) for p in parts)).alias(f"{side}_h"), *first)

    def one(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.struct(key).alias(f"{side}_k"), F.lit(1).alias(f"{side}_n"), *(F.col(c).alias(f"{side}_{i}") for i, c in enumerate(names)))

    text = lambda side: row_text([f"{side}_{i}" for i in range(len(names))]) if names else F.lit("")
    rows_differ, sums_differ = text("a") != text("b"), F.col("a_h") != F.col("b_h")
    # Keys of other kinds may be equal and yet have several spellings.
    if old.schema[key].dataType != new.schema[key].dataType or old.schema[key].dataType.simpleString() not in ("string", "int", "bigint"):
        return _changes(per(old, "a"), per(new, "b"), names, key, sums_differ)
    at = F.xxhash64(key)
    count = lambda df, a, b: df.select(at.alias("__h"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    again = count(old, 1, 0).unionByName(count(new, 0, 1)).groupBy("__h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    again = cut(again.filter("a > 1 OR b > 1").select("__h"), "diff-again")
    if again.isEmpty():
        return _changes(one(old, "a"), one(new, "b"), names, key, rows_differ)
    part = lambda df, how: df.join(again, at == F.col("__h"), how)
    single = _changes(one(part(old, "left_anti"), "a"), one(part(new, "left_anti"), "b"), names, key, rows_differ)
    return single.unionByName(_changes(per(part(old, "left_semi"), "a"), per(part(new, "left_semi"), "b"), names, key, sums_differ))


def _changes(old: DataFrame, new: DataFrame, names: list[str], key: str, differ: Column) -> DataFrame:
    """Both sides with a row for each key -> what diff() tells of them."""
    both = old.join(new, F.col("a_k") == F.col("b_k"), "full")
    single = (F.col("a_n") == 1) & (F.col("b_n") == 1)
    differs = F.filter(F.array(*(F.when(~F.col(f"a_{i}").eqNullSafe(F.col(f"b_{i}")), F.lit(c)) for i, c in sorted(enumerate(names), key=lambda x: x[1])), F.lit(None).cast("string")), lambda x: x.isNotNull())
    change = F.when(F.col("a_n").isNull(), "added").when(F.col("b_n").isNull(), "gone").when((F.col("a_n") != F.col("b_n")) | differ, "changed")
    out = both.withColumn("change", change).filter("change IS NOT NULL")
    return out.select(F.coalesce(F.col("a_k"), F.col("b_k"))[key].alias(key), "change", F.when((F.col("change") == "changed") & single, differs).otherwise(F.array().cast("array<string>")).alias("columns"))


def replayed(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """recorded, now(call, digest) -> (call, verdict): same, differs, or lost, for each recorded call.

    A call of which now is not known is lost; repeated calls count once for each digest they had.
    """
    n = now.select(F.struct("call").alias("k"), F.col("digest").alias("d")).groupBy("k").agg(F.collect_set("d").alias("d"))
    r = recorded.select(F.struct("call").alias("k"), "call", "digest").distinct()
    verdict = F.when(F.col("d").isNull(), "lost").when(F.array_contains("d", F.coalesce("digest", F.lit(""))), "same").otherwise("differs")
    return r.join(n, "k", "left").select("call", verdict.alias("verdict"))


def reproduced(verdicts: DataFrame) -> DataFrame:
    """(n_calls, n_mismatches, reproduced) of replayed()."""
    bad = F.count_if(F.col("verdict") != "same")
    return verdicts.agg(F.count("*").alias("n_calls"), bad.alias("n_mismatches"), (bad == 0).alias("reproduced"))
