"""Tables that grow by numbered commits, and tolerate commits that break off or come twice.

A commit writes its rows to a folder that no reader knows and then lists that folder in
the manifest, one small entry for each batch number. Readers take listed folders only:
what a killed writer left is never seen, and a batch that is committed already is not
written again. A streaming query's batch numbers outlive restarts, so with
``foreachBatch`` every row is in the table exactly once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

_ENTRY = "batch long, folder string, high timestamp"


class CommitTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path = spark, path
        empty = spark.createDataFrame([], schema)
        self.schema = StructType(empty.schema.fields).add("batch", LongType())
        spark.createDataFrame([], _ENTRY).write.mode("ignore").parquet(f"{path}/manifest/entry=none")

    def entries(self) -> DataFrame:
        return self.spark.read.schema(_ENTRY).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifest")

    def has(self, batch: int) -> bool:
        return not self.entries().where(F.col("batch") == batch).isEmpty()

    def commit(self, rows: DataFrame, batch: int, high: str | None = None) -> bool:
        """Adds ``rows`` as ``batch``; False and no change if it is there. ``high`` names a time whose maximum is kept beside it."""
        if self.has(batch):
            return False
        folder = f"{self.path}/data/{batch}-{uuid.uuid4().hex}"
        columns = [f.name for f in self.schema if f.name != "batch"]
        rows.select(*columns).withColumn("batch", F.lit(batch).cast("long")).write.parquet(folder)
        written = self.spark.read.schema(self.schema).parquet(folder)
        entry = written.agg(F.lit(batch).cast("long").alias("batch"), F.lit(folder).alias("folder"), (F.max(high) if high else F.lit(None)).cast("timestamp").alias("high"))
        entry.coalesce(1).write.parquet(f"{self.path}/manifest/entry={batch}")
        return True

    def read(self, before: int | None = None) -> DataFrame:
        """The rows of all commits, or of those numbered below ``before``, with their ``batch``."""
        listed = self.entries() if before is None else self.entries().where(F.col("batch") < before)
        folders = [r["folder"] for r in listed.select("folder").collect()]  # one for each batch
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def high(self, before: int):
        """The greatest time of the commits numbered below ``before``, or None."""
        return self.entries().where(F.col("batch") < before).agg(F.max("high")).first()[0]


def newest_of(rows: DataFrame, *key: str) -> DataFrame:
    """Delete-then-insert by key over commits: of each key the rows of its newest batch."""
    last = rows.groupBy(*key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*key, "batch"])
