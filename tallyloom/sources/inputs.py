"""Inputs that may be broken, and tables whose files are of different age.

What cannot be read is not lost: it goes to a quarantine beside what can, with a
reason, and both together are all that came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.operators.extraction import DOCUMENT_SCHEMA
from tallyloom.sources.tables import require_schema

#: Name of the column that holds a text which is no such document.
CORRUPT = "_corrupt_record"
_PDF_HEAD, _PDF_END = "%PDF-", "%%EOF"


def parse_documents(documents: DataFrame, schema: str = DOCUMENT_SCHEMA) -> DataFrame:
    """``documents`` (value and more) with the parsed ``document`` and the ``reason`` why there is none."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = documents.withColumn("document", F.from_json("value", f"{schema}, {CORRUPT} string", options))
    blank = F.coalesce(F.trim("value"), F.lit("")) == ""
    reason = F.when(blank, "EMPTY").when(F.col(f"document.{CORRUPT}").isNotNull(), "MALFORMED").when(F.get_json_object("value", "$.invoices").isNull(), "NO_INVOICES")
    return parsed.withColumn("reason", reason).withColumn("document", F.when(F.col("reason").isNull(), F.col("document").dropFields(CORRUPT)))


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files below ``path`` as rows (path, modificationTime, length, content). Spark's file readers pass over files of no bytes, which are no rows."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def inspect_files(files: DataFrame) -> DataFrame:
    """``files`` with the ``reason`` why a file is no whole PDF, or null, and its ``page_count``; ``files``: path, content."""
    text = F.decode("content", "ISO-8859-1")
    looked = files.withColumn("_text", text)
    reason = (
        F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "EMPTY").when(~F.col("_text").startswith(_PDF_HEAD), "NOT_PDF")
        .when(~F.right("_text", F.lit(1024)).contains(_PDF_END), "TRUNCATED")
    )
    pages = F.when(F.col("reason").isNull(), F.regexp_count("_text", F.lit(r"/Type\s*/Page\b(?!s)")))
    return looked.withColumn("reason", reason).withColumn("page_count", pages).drop("_text")


def divide(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What can be read, and the quarantine."""
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def read_versions(spark: SparkSession, paths: list[str], versions: list[StructType]) -> DataFrame:
    """Files written under any of ``versions`` (oldest first; each adds columns to the one before), read as the newest.

    A file that fits no version is an error when the plan is made. Columns that came later are null in older files.
    """
    newest = versions[-1]
    for older, newer in zip(versions, versions[1:], strict=False):
        if newer.fields[: len(older.fields)] != older.fields:
            raise ValueError("a version must keep the columns of the one before it, in order")
    frames = []
    for path in paths:
        df = spark.read.parquet(path)
        fitting = next((v for v in versions if set(v.names) == set(df.columns)), None)
        if fitting is None:
            raise ValueError(f"{path} has the columns of no version: {df.columns}")
        frames.append(require_schema(df, fitting).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in newest.fields[len(fitting.fields) :]]))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def shop_of(shop: Column, entities: Column) -> Column:
    """The line's shop, or else the first entity that the document names."""
    return F.coalesce(F.nullif(shop, F.lit("")), F.get(entities, F.lit(0)))
