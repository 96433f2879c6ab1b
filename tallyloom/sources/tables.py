"""Reading source tables, and the idempotent writes that the reconciliation layers need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statement_rows(df: DataFrame, statement_id: str) -> DataFrame:
    """Scan with an equality filter; tables partitioned by statement prune to one folder."""
    return df.where(F.col("statement_id") == statement_id)


def require_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` cut to ``schema``; a missing or differently typed column is an error at plan time."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {wrong}")
    return df.select(*schema.names)


def replace_statements(df: DataFrame, path: str, partition: str = "statement_id") -> None:
    """Delete-then-insert by statement: only the partitions present in ``df`` are overwritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Keyed upsert over a batch: the row with the highest ``order`` of each key stays."""
    newest = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return df.withColumn("_newest", F.row_number().over(newest)).where("_newest = 1").drop("_newest")


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """``current`` with the rows of ``changes`` put in by key; within ``changes`` the last wins."""
    changes = last_wins(changes, key, order)
    return current.join(changes, key, "left_anti").unionByName(changes)


def copy_rows(spark: SparkSession, source: str, target: str, order: str, columns: list[str]) -> None:
    """Copies ``columns`` into a store that must not exist yet; its files follow each other by ``order`` and are sorted within."""
    rows = spark.read.parquet(source).select(*columns)
    rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).write.parquet(target)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that several uses compute it once and a lost executor costs a re-read.

    The table stays until ``forget`` or until the folder is cleared, as results that have not been read yet may need it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written.append((path, out))
    return out


#: Settled tables that have not been removed, with the frames that ``settle`` returned for them.
_written: list[tuple[str, DataFrame]] = []


def settled() -> list[DataFrame]:
    """Frames of the settled tables that are still there."""
    return [frame for _, frame in _written]


def forget(*tables: DataFrame) -> None:
    """Removes settled ``tables`` that nothing reads any more; frames that ``settle`` did not return stay as they are."""
    for path, frame in [x for x in _written if any(x[1] is t for t in tables)]:
        spark = frame.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
        _written[:] = [x for x in _written if x[0] != path]
