"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words everywhere in this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without that setting (tests, a laptop) gets a temporary
    folder of its own; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settle(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so that a result used several times is computed once and a lost
    executor costs only a re-read. The table stays until ``forget`` or until the folder
    is cleared, as results that have not been read yet may need it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    _written.append((path, out))
    return out


#: Settled tables that have not been removed, with the frames that ``settle`` returned for them.
_written: list[tuple[str, DataFrame]] = []


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


def forget(*tables: DataFrame) -> None:
    """Remove settled ``tables`` that nothing reads any more; frames that ``settle`` did not return stay as they are."""
    for path, frame in [x for x in _written if any(x[1] is t for t in tables)]:
        _remove(frame.sparkSession, path)
        _written[:] = [x for x in _written if x[0] != path]


def settled() -> list[DataFrame]:
    """Frames of the settled tables that are still there."""
    return [frame for _, frame in _written]


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
