"""Reading tables and cutting lineage, shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without: it gets an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/seamark-shared-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later jobs start from files that outlive an executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Grown:
    """A table in the shared folder that grows part by part; what was added is read as one table, whatever the number of parts."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.parts, self.schema = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Writes df as the next part and returns that part."""
        self.schema, self.parts = df.schema, self.parts + 1
        part = f"{self.path}/part{self.parts}"
        df.write.parquet(part)
        return self.spark.read.schema(self.schema).parquet(part)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
