"""Versioned Parquet tables: a new version is written beside the old and then named current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.operators.linkage import upsert


def to_text(rows: DataFrame) -> DataFrame:
    """One JSON text a row, nulls left out; `from_text` with the same schema gives the rows again."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def from_text(texts: DataFrame, schema: T.StructType) -> DataFrame:
    return texts.select(F.from_json("json", schema).alias("row")).select("row.*")


class Store:
    """entities, identity index and bridge alerts under one folder, on any file system Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self, table: str) -> list[int]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        fs = at.getFileSystem(conf)
        if not fs.exists(at):
            return []
        done = [s.getPath() for s in fs.listStatus(at)]
        return sorted(int(p.getName()[2:]) for p in done if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, table: str) -> DataFrame | None:
        """The last version that was written to its end; None before the first."""
        found = self.versions(table)
        return self.spark.read.parquet(f"{self.path}/{table}/v={found[-1]}") if found else None

    def write(self, table: str, rows: DataFrame) -> None:
        found = self.versions(table)
        rows.write.parquet(f"{self.path}/{table}/v={found[-1] + 1 if found else 0}", mode="overwrite")

    def upsert(self, table: str, rows: DataFrame, key: list[str], order: str) -> None:
        old = self.read(table)
        self.write(table, upsert(rows.limit(0) if old is None else old, rows, key, order))

    def append(self, table: str, rows: DataFrame) -> None:
        old = self.read(table)
        self.write(table, rows if old is None else old.unionByName(rows))

    def candidates(self, min_confidence: float | None = None) -> DataFrame | None:
        rows = self.read("entities")
        return rows if rows is None or min_confidence is None else rows.filter(F.col("overall_confidence") >= min_confidence)

    def candidate(self, candidate_id: str) -> DataFrame | None:
        rows = self.read("entities")
        return None if rows is None else rows.filter(F.col("candidate_id") == candidate_id)
