"""Sources and sinks of facts: explicit schemas, failing on what doesn't fit; text folders; upserts by id."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamark.frames import shared_dir

EDGES = "id STRING, type STRING, source STRING, target STRING, transform STRING, phase STRING, band INT, guard STRING, unit STRING, line INT"
LOG = "sql_id STRING, sql_text STRING, module STRING, action STRING, executions INT, first_load_time TIMESTAMP, parsing_schema STRING"
SIGHTINGS = "unit STRING, line INT"
#: A log row's text is cut off at so many characters.
LOG_TEXT = 1000


def read_json(spark: SparkSession, path: str, schema: str = EDGES) -> DataFrame:
    """JSON lines of facts; a malformed row is an error, not a null."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json(facts: DataFrame, path: str, schema: str = EDGES) -> None:
    """The schema's columns, nulls included, so that reading gives the same rows back."""
    names = [c.split()[0] for c in schema.split(", ")]
    facts.select(*names).write.option("ignoreNullFields", "false").json(path)


def read_texts(spark: SparkSession, folder: str, suffix: str = ".sql") -> DataFrame:
    """(name, text, n_lines) of each file under the folder, whole; the name is the file's."""
    df = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
    path = F.col("_metadata.file_path")
    return df.select(F.regexp_extract(path, r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"), F.size(F.split("value", "\n", -1)).alias("n_lines"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Query-log rows with truncated: whether the text may have been cut."""
    return read_json(spark, path, LOG).withColumn("truncated", F.coalesce(F.char_length("sql_text") >= LOG_TEXT, F.lit(False)))


def upsert(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The stored rows with those of the same key replaced; of several new ones, the first in the order of all columns."""
    first = Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key])
    new = new.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    return stored.join(new, key, "left_anti").unionByName(new.select(*stored.columns))


def exchange_partition(spark: SparkSession, table: str, staging: str, column: str, value: str) -> None:
    """Exchanges the partition column = value of two folders of Parquet that are partitioned by it; all other partitions stay as they are.

    The table's rows of the partition are written aside first and read back, as a folder can't be overwritten while it is read.
    A side without the partition gives none, and then the other side's goes.
    """
    aside = f"{shared_dir(spark)}/exchange-{uuid.uuid4().hex}"
    rows = lambda path: spark.read.parquet(path).filter(F.col(column).cast("string") == value)
    kinds = {path: spark.read.parquet(path).schema for path in (table, staging)}
    for n, path in enumerate((table, staging)):
        rows(path).write.parquet(f"{aside}/{n}")
    for n, path in ((1, table), (0, staging)):
        new = spark.read.schema(kinds[staging if n else table]).parquet(f"{aside}/{n}")
        if new.isEmpty():  # nothing to overwrite with: the partition is left without a file
            root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
            root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
        else:
            new.write.partitionBy(column).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def nodes(edges: DataFrame) -> DataFrame:
    """(id, label, n_in, n_out) of the ends of edges: a name with a dot is a Column, any other a Relation."""
    ends = edges.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    label = F.when(F.contains("id", F.lit(".")), "Column").otherwise("Relation")
    return ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out")).select("id", label.alias("label"), "n_in", "n_out")


LABELS = "package STRING, source_sha256 STRING, source STRING, target STRING, flow STRING, transform STRING, phase STRING, band INT, guard STRING, unit STRING, line INT"


def read_labels(spark: SparkSession, path: str, texts: DataFrame) -> DataFrame:
    """Labels with pinned: whether texts(name, text) still has the package's text of the digest that they were made for."""
    now = texts.select(F.col("name").alias("package"), F.sha2("text", 256).alias("now"))
    df = read_json(spark, path, LABELS).join(now, "package", "left")
    return df.withColumn("pinned", F.coalesce(F.col("source_sha256") == F.col("now"), F.lit(False))).drop("now")


def write_csv(facts: DataFrame, path: str) -> None:
    """A report with a header; arrays and maps as JSON, as CSV has no such values."""
    plain = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in facts.schema.fields]
    facts.select(*plain).write.option("header", "true").option("nullValue", "").csv(path)


def write_markdown(facts: DataFrame, path: str) -> None:
    """A report as rows of a Markdown table, bars and line feeds inside values escaped; each part file repeats the head."""
    names = facts.columns
    head = f"| {' | '.join(names)} |\n|{'---|' * len(names)}\n"
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in names)), F.lit(" |"))
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    facts.select(F.when(first, F.concat(F.lit(head), row)).otherwise(row).alias("value")).write.text(path)
