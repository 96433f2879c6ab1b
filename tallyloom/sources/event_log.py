"""Append-only log of intake, audit and skip events; an event that is there already is not added again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.commits import CommitTable

EVENT = "kind string, statement_id string, source_file string, detail string, ts timestamp"
#: What makes an event the same one: all but its time.
KEY = ["kind", "statement_id", "source_file", "detail"]


def open_log(spark: SparkSession, path: str) -> CommitTable:
    return CommitTable(spark, path, f"event_id string, {EVENT}")


def append(log: CommitTable, events: DataFrame) -> int:
    """Adds the events that the log does not hold, each once; the number of the commit."""
    keyed = events.withColumn("event_id", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("\x00")) for c in KEY]), 256))
    fresh = keyed.groupBy("event_id").agg(F.min_by(F.struct(*KEY, "ts"), "ts").alias("e")).select("event_id", "e.*")
    fresh = fresh.join(log.read().select("event_id"), "event_id", "left_anti")
    batch = (log.entries().agg(F.max("batch")).first()[0] or 0) + 1
    log.commit(fresh, batch)
    return batch


def intake_events(documents: DataFrame) -> DataFrame:
    """One event a document; ``documents``: statement_id, source_file, route, n_rows, ts."""
    return documents.select(F.lit("INTAKE").alias("kind"), "statement_id", "source_file", F.concat_ws(":", "route", "n_rows").alias("detail"), "ts")


def skip_events(rows: DataFrame) -> DataFrame:
    """One event a row that was passed over; ``rows``: statement_id, source_file, row_num, reason, ts."""
    return rows.select(F.lit("ROW_SKIP").alias("kind"), "statement_id", "source_file", F.concat_ws(":", F.format_string("%06d", "row_num"), "reason").alias("detail"), "ts")
