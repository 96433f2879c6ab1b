"""Queue and batch analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Markers in lower-cased error texts, first match wins.
ERROR_CLASSES = [
    ("MISSING_API_KEY", ["api key", "env var"]),
    ("TRANSPORT_ERROR", ["timeout", "transport", "connection"]),
    ("PARSE_ERROR", ["json", "parse"]),
    ("RATE_LIMITED", ["429", "quota", "rate"]),
]


def duration_text(seconds: Column) -> Column:
    """Whole seconds as ``5s``, ``2m 5s`` or ``1h 2m``."""
    s = F.floor(seconds).cast("long")
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    return (
        F.when(s < 60, F.concat(s, F.lit("s")))
        .when(s < 3600, F.concat(minutes, F.lit("m "), s % 60, F.lit("s")))
        .otherwise(F.concat(hours, F.lit("h "), F.floor((s % 3600) / 60), F.lit("m")))
    )


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000


def job_durations(jobs: DataFrame) -> DataFrame:
    took = F.when(F.col("completed_at").isNotNull(), duration_text(seconds_between(F.col("submitted_at"), F.col("completed_at"))))
    return jobs.select("job_id", "status", took.alias("time_taken"))


def batches(jobs: DataFrame) -> DataFrame:
    """Batches with file counts, status and time taken once nothing is active."""
    status = F.col("status")
    out = jobs.where("batch_id is not null").groupBy("batch_id").agg(
        F.count("*").alias("total_files"), F.count_if(status == "COMPLETED").alias("completed_count"),
        F.count_if(status == "FAILED").alias("failed_count"), F.count_if(status.isin("PENDING", "PROCESSING")).alias("active_count"),
        F.min("submitted_at").alias("first_submitted_at"), F.max("completed_at").alias("last_completed_at"),
    )
    took = duration_text(seconds_between(F.col("first_submitted_at"), F.col("last_completed_at")))
    return out.withColumn(
        "status", F.when(F.col("active_count") > 0, "PROCESSING").when(F.col("failed_count") > 0, "PARTIAL").otherwise("COMPLETED")
    ).withColumn("time_taken", F.when((F.col("active_count") == 0) & F.col("last_completed_at").isNotNull(), took))


def batch_detail(jobs: DataFrame, statements: DataFrame) -> DataFrame:
    """Batches with the invoices and open exceptions of their finished files' statements (job_id, invoices, exceptions)."""
    stats = jobs.where("batch_id is not null").join(statements, "job_id", "left").groupBy("batch_id").agg(
        F.coalesce(F.sum("invoices"), F.lit(0)).alias("total_invoices"), F.coalesce(F.sum("exceptions"), F.lit(0)).alias("total_exceptions")
    )
    return batches(jobs).join(stats, "batch_id").drop("first_submitted_at", "last_completed_at")


def recent_batches(jobs: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest finished batches (a top-k report)."""
    done = batches(jobs).where("status <> 'PROCESSING'")
    return done.orderBy(F.col("first_submitted_at").desc(), "batch_id").limit(n).select("batch_id", "status", "total_files")


def manual_uploads(jobs: DataFrame) -> DataFrame:
    """Jobs without a batch by submission date."""
    return jobs.where("batch_id is null").groupBy(F.date_format("submitted_at", "yyyy-MM-dd").alias("date")).agg(
        F.count("*").alias("n"), F.max("job_id").alias("last_job_id")
    )


def claimable(jobs: DataFrame) -> DataFrame:
    """The first pending job whose file is not being processed."""
    busy = jobs.where("status = 'PROCESSING'").select("pdf_filename").distinct()
    return jobs.where("status = 'PENDING'").join(busy, "pdf_filename", "left_anti").agg(F.min("id").alias("id"))


_JOB = ("job_id", "pdf_filename", "batch_id", "status", "submitted_at", "completed_at")


def history(jobs: DataFrame) -> DataFrame:
    """All jobs, newest first; jobs of one time go by their id."""
    return jobs.select(*_JOB).orderBy(F.col("submitted_at").desc(), "job_id")


def active(jobs: DataFrame) -> DataFrame:
    """Jobs that still concern somebody, newest first: not ended, or failed."""
    return history(jobs.where(F.col("status").isin("PENDING", "PROCESSING", "FAILED")))


def daily_counts(jobs: DataFrame) -> DataFrame:
    """Jobs by day of submission and status."""
    return jobs.groupBy(F.date_format("submitted_at", "yyyy-MM-dd").alias("day"), "status").agg(F.count("*").alias("n"))


def statement_documents(jobs: DataFrame, name: str = "pdf_filename") -> DataFrame:
    """Jobs whose file is a PDF by its name, whatever the case."""
    return jobs.where(F.lower(name).endswith(".pdf"))


def error_tail(text: Column, n: int = 4000) -> Column:
    return F.right(text, F.lit(n))


def error_class(success: Column, error: Column) -> Column:
    out = F.when(success, "SUCCESS").when(error.isNull() | (error == ""), "UNKNOWN_ERROR")
    for name, marks in ERROR_CLASSES:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.lower(error).contains(mark)
        out = out.when(hit, name)
    return out.otherwise("UNKNOWN_ERROR")


#: What a provider's error says to a reader; marks in lower case and marks as they are, first match wins.
ERROR_MESSAGES = [
    ("rate limited — try again shortly", ["rate_limit"], ["429"]),
    ("Claude API overloaded — try again shortly", ["overloaded_error"], ["529"]),
    ("invalid API key", ["authentication_error", "invalid x-api-key"], ["401"]),
    ("permission denied — check API key", ["permission_error"], ["403"]),
    ("request timed out", ["timeout", "timed out"], []),
    ("network error", ["connection", "network"], []),
]


def error_message(error: Column) -> Column:
    """A short message for a provider's error; an unknown one is its first line, 150 characters at most."""
    out = F.when(error.isNull() | (error == ""), "unknown error")
    for message, marks, exact in ERROR_MESSAGES:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.lower(error).contains(mark)
        for mark in exact:
            hit = hit | error.contains(mark)
        out = out.when(hit, message)
    return out.otherwise(F.substring(F.split_part(error, F.lit("\n"), F.lit(1)), 1, 150))


def logged_statement(text: Column) -> Column:
    """The statement id that a job's log text names first, or null."""
    return F.nullif(F.regexp_extract(text, r"Statement ID:\s*(\S+)", 1), F.lit(""))


def ai_activity(audit: DataFrame) -> DataFrame:
    """Calls of each statement, newest first: outcome, kind, provider, model and seconds taken."""
    outcome = F.when(F.col("interaction_type") == "ROW_SKIP", "SKIP").when(F.col("success"), "OK").otherwise("FAIL")
    took = F.when(F.col("latency_ms") > 0, F.concat(F.format_string("%.1f", F.col("latency_ms") / 1000), F.lit("s"))).otherwise("N/A")
    newest = Window.partitionBy("statement_id").orderBy(F.col("request_timestamp").desc(), "audit_id")
    return audit.select(
        "statement_id", F.row_number().over(newest).alias("place"), outcome.alias("outcome"), "interaction_type",
        F.coalesce(F.nullif(F.col("ai_provider"), F.lit("")), F.lit("unknown")).alias("provider"),
        F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit("unknown")).alias("model"), took.alias("latency"),
    )


def cache_lookup(cache: DataFrame) -> DataFrame:
    """Newest entry of each document that holds rows."""
    newest = Window.partitionBy("document_hash").orderBy(F.col("cached_at").desc(), F.col("job_id").desc())
    return cache.where("row_count > 0").withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")


def fold_events(events: DataFrame) -> DataFrame:
    """Current state of each job from its events (job_id, ts, event_seq, and columns whose last non-null value counts)."""
    order = F.struct("ts", "event_seq")
    columns = [c for c in events.columns if c not in ("job_id", "ts", "event_seq")]
    return events.groupBy("job_id").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])
