"""Gold layer: scored matches, exceptions with their state, and statement summaries.

State is never updated in place: dispositions and escalations are events, and the
current state of an exception is its latest event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.matching import exception_confidence, match_confidence

MONEY = "decimal(18,2)"


def key_hash(*parts: Column) -> Column:
    """Identifier of a natural key; a null part is written ``None``."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.sha2(F.concat_ws("|", *texts), 256)


def matched_invoices(decisions: DataFrame) -> DataFrame:
    rows = decisions.where("status = 'MATCHED'")
    return rows.select(
        "statement_id", "vendor_id", "seq", "invoice_number", "erp_invoice", "erp_seq", "level",
        F.col("outstanding_amount").alias("statement_amount"), "erp_amount",
        match_confidence(F.col("level"), F.col("outstanding_amount"), F.col("erp_amount")).alias("match_confidence"),
    )


def overall_status(open_count: Column) -> Column:
    return F.when(open_count == 0, "RECONCILED").when(open_count <= 3, "MINOR_EXCEPTIONS").otherwise("EXCEPTIONS_PRESENT")


def summaries(decisions: DataFrame) -> DataFrame:
    """One row per statement; the ledger total covers matched rows only."""
    matched = F.col("status") == "MATCHED"
    out = decisions.groupBy("statement_id", "vendor_id", "statement_period").agg(
        F.sum("outstanding_amount").cast(MONEY).alias("statement_total"),
        F.coalesce(F.sum(F.when(matched, F.col("erp_amount"))), F.lit(0)).cast(MONEY).alias("erp_total"),
        F.count("*").alias("total_invoice_count"),
        F.count_if(matched).alias("matched_count"),
        F.count_if(~matched).alias("exception_count"),
    )
    share = (F.col("matched_count") * 100).cast(MONEY) / F.col("total_invoice_count").cast(MONEY)
    return out.select(
        "*", (F.col("statement_total") - F.col("erp_total")).cast(MONEY).alias("difference"),
        F.round(share, 2).cast("double").alias("match_percentage"), overall_status(F.col("exception_count")).alias("overall_status"),
    )


def with_sources(summaries: DataFrame, lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """Summaries with vendor name and shop of the statement's first line, and the greatest version of its ledger rows."""
    first = lines.groupBy("statement_id").agg(F.min_by(F.struct("vendor_name", "shop"), "seq").alias("_first"))
    version = ledger.groupBy("statement_id").agg(F.max("erp_version").alias("erp_version"))
    joined = summaries.join(first, "statement_id", "left").join(version, "statement_id", "left")
    return joined.select(*summaries.columns, "_first.vendor_name", "_first.shop", "erp_version")


def match_exceptions(decisions: DataFrame) -> DataFrame:
    rows = decisions.where("status = 'EXCEPTION'")
    return rows.select(
        key_hash(F.col("statement_id"), F.col("seq"), F.col("reason")).alias("exception_id"), "statement_id", "vendor_id",
        "statement_period", "seq", "invoice_number", F.col("outstanding_amount").alias("statement_amount"), "erp_amount",
        F.col("reason").alias("exception_reason"), exception_confidence(F.col("reason")).alias("match_confidence"),
    )


def skip_exceptions(skipped: DataFrame) -> DataFrame:
    """Unusable rows as EXTRACTION_INCOMPLETE; the amount is the first that is there."""
    amount = F.coalesce(*(F.col(c).try_cast(MONEY) for c in ("outstanding_amount", "amount", "credit")))
    reason = F.lit("EXTRACTION_INCOMPLETE")
    return skipped.select(
        key_hash(F.col("statement_id"), F.col("row_num"), reason).alias("exception_id"), "statement_id", "vendor_id",
        F.col("row_num").alias("seq"), "invoice_number", amount.alias("statement_amount"), reason.alias("exception_reason"),
        exception_confidence(reason).alias("match_confidence"), "skip_reason",
    )


def current_state(raised: DataFrame, dispositions: DataFrame, escalations: DataFrame) -> DataFrame:
    """Exceptions with their latest disposition and escalation; events are (exception_id, ts, event_seq, ...)."""
    newest = Window.partitionBy("exception_id").orderBy(F.col("ts").desc(), F.col("event_seq").desc())

    def latest(events: DataFrame, *columns: str) -> DataFrame:
        return events.withColumn("_k", F.row_number().over(newest)).where("_k = 1").select("exception_id", *columns)

    closed = latest(dispositions, "disposition_status", F.col("ts").alias("resolved_at"))
    raised_up = latest(escalations, F.col("ts").alias("escalated_at"))
    return (
        raised.join(closed, "exception_id", "left").join(raised_up, "exception_id", "left")
        .withColumn("exception_status", F.when(F.col("resolved_at").isNotNull(), "RESOLVED").otherwise("OPEN"))
        .withColumn("escalation_status", F.when(F.col("escalated_at").isNotNull(), "ESCALATED").otherwise("NONE"))
    )


def bulk_approve(open_exceptions: DataFrame, threshold: float, ts: Column) -> DataFrame:
    """Disposition events that accept every open exception of at least ``threshold``."""
    chosen = open_exceptions.where((F.col("exception_status") == "OPEN") & (F.col("match_confidence") >= threshold))
    return chosen.select("exception_id", F.lit("ACCEPTED").alias("disposition_status"), ts.alias("ts"), F.lit(0).alias("event_seq"))


def reviewed(review: DataFrame, actions: DataFrame) -> DataFrame:
    """Review rows with the state that their latest action gives; actions are (review_id, action, reviewed_by, ts, event_seq)."""
    newest = actions.groupBy("review_id").agg(F.max_by(F.struct("action", "reviewed_by", "ts"), F.struct("ts", "event_seq")).alias("_last"))
    status = F.when(F.col("_last.action") == "approve", "APPROVED").when(F.col("_last.action").isNotNull(), "FLAGGED").otherwise(F.col("review_status"))
    return review.join(newest, "review_id", "left").withColumn("review_status", status).withColumns(
        {"reviewed_by": F.col("_last.reviewed_by"), "reviewed_at": F.col("_last.ts")}).drop("_last")


def flagged_exceptions(review: DataFrame, actions: DataFrame) -> DataFrame:
    """Exceptions that flagged review rows raise; duplicates keep no score."""
    flagged = review.join(actions.where("action = 'flag'"), "review_id")
    duplicate = F.col("rejection_category") == "DUPLICATE_RECORD"
    reason = F.when(duplicate, "DUPLICATE_RECORD").otherwise("EXTRACTION_INCOMPLETE")
    return flagged.select(
        "review_id", "statement_id", "invoice_number", F.col("amount").alias("statement_amount"), reason.alias("exception_reason"),
        F.when(~duplicate, exception_confidence(F.lit("EXTRACTION_INCOMPLETE"))).alias("match_confidence"),
        F.col("rejection_details").alias("explanation"),
    )
