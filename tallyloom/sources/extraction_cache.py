"""What has been extracted from which document, kept by content for every statement.

The cache is a commit table: writers add entries and never change one, so two of them
cannot undo each other's work and a replayed batch leaves the table as it is. The entry
of a document and statement is the one of its newest batch, and within a batch the one
of the latest time; at equal times the greatest source, method and row count counts.
Entries without a document hash or statement are not kept, as nothing could find them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.commits import CommitTable, newest_of

KEY = ["document_hash", "statement_id"]
_VALUES = ["ingestion_timestamp", "source_file", "extraction_method", "row_count"]
_ENTRY = "document_hash string, statement_id string, ingestion_timestamp timestamp, source_file string, extraction_method string, row_count long"


def open_cache(spark: SparkSession, path: str) -> CommitTable:
    return CommitTable(spark, path, _ENTRY)


def write_entries(cache: CommitTable, entries: DataFrame, batch: int) -> bool:
    """One entry for each document and statement of ``entries``; False and no change if the batch is there."""
    whole = entries.where(" and ".join(f"{c} is not null" for c in KEY))
    last = whole.groupBy(*KEY).agg(F.max(F.struct(*_VALUES)).alias("e")).select(*KEY, "e.*")
    return cache.commit(last.withColumn("row_count", F.col("row_count").cast("long")), batch)


def entries(cache: CommitTable) -> DataFrame:
    """The entry of every document and statement, with its batch."""
    return newest_of(cache.read(), *KEY)
