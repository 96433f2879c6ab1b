"""Row quality at intake: skip, validate, de-duplicate and route.

All rules are ordered ``CASE`` expressions over the row; only de-duplication
looks at other rows, through a window of the statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import config

REQUIRED = ("invoice_number", "outstanding_amount")
NUMERIC = ("amount", "outstanding_amount", "credit")


def strip(value: Column) -> Column:
    """Drops all Unicode white space at both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def is_blank(value: Column) -> Column:
    return value.isNull() | (strip(value.cast("string")) == "")


def skip_reason() -> Column:
    """Why a row is unusable, or the empty string."""
    no_id = is_blank(F.col("invoice_number")) & is_blank(F.col("ro_number"))
    no_amount = is_blank(F.col("outstanding_amount")) & is_blank(F.col("amount")) & is_blank(F.col("credit"))
    return F.when(no_id, "no invoice identifier found").when(no_amount, "no amount found").otherwise("")


def is_number(value: Column) -> Column:
    return strip(value).rlike(config.NUMBER_SHAPE)


def with_default_amount(rows: DataFrame) -> DataFrame:
    """A missing outstanding amount is the amount."""
    return rows.withColumn("outstanding_amount", F.coalesce("outstanding_amount", "amount"))


def rejection() -> Column:
    """First failed check of a row that has its default amount, or the empty string."""
    out = F.when(F.lit(False), "")
    for c in REQUIRED:
        out = out.when(is_blank(F.col(c)), f"MISSING_MANDATORY_FIELD: {c} is required")
    for c in NUMERIC:
        bad = F.col(c).isNotNull() & ~is_number(F.col(c))
        out = out.when(bad, F.concat(F.lit(f"INVALID_FIELD_TYPE: {c} must be numeric, got '"), F.col(c), F.lit("'")))
    low = F.col("line_confidence") < config.LINE_CONFIDENCE_MIN
    text = F.concat(F.lit("LOW_CONFIDENCE: line_confidence "), F.col("line_confidence").cast("string"), F.lit(f" < threshold {config.LINE_CONFIDENCE_MIN}"))
    return out.when(low, text).otherwise("")


def category(reason: Column) -> Column:
    return F.split_part(reason, F.lit(":"), F.lit(1))


def route(rows: DataFrame) -> DataFrame:
    """Adds skip_reason, rejection_reason and route: SKIPPED, INVALID or VALID.

    Of valid rows with the same invoice number and amount in a statement the
    first stays; later ones become INVALID duplicates.
    """
    checked = with_default_amount(rows.withColumn("skip_reason", skip_reason()))
    checked = checked.withColumn("rejection_reason", F.when(F.col("skip_reason") == "", rejection()).otherwise(""))
    valid = (F.col("skip_reason") == "") & (F.col("rejection_reason") == "")
    same = Window.partitionBy("statement_id", valid, "invoice_number", "outstanding_amount").orderBy("row_num")
    checked = checked.withColumn("_copy", F.row_number().over(same))
    duplicate = valid & (F.col("_copy") > 1)
    reason = F.when(duplicate, F.lit("DUPLICATE_RECORD: invoice_number and outstanding_amount repeat")).otherwise(F.col("rejection_reason"))
    return (
        checked.withColumn("rejection_reason", reason).drop("_copy")
        .withColumn("route", F.when(F.col("skip_reason") != "", "SKIPPED").when(F.col("rejection_reason") != "", "INVALID").otherwise("VALID"))
    )


def skipped(rows: DataFrame) -> DataFrame:
    """What ``route`` marks as SKIPPED, row by row: no other row has a say in that, so nothing is sorted or shuffled."""
    checked = with_default_amount(rows.withColumn("skip_reason", skip_reason())).where("skip_reason <> ''")
    return checked.withColumn("rejection_reason", F.lit("")).withColumn("route", F.lit("SKIPPED"))


def review_queue(routed: DataFrame) -> DataFrame:
    """Rejected rows with their category and a JSON payload."""
    return routed.where("route = 'INVALID'").select(
        F.sha2(F.concat_ws("|", "statement_id", "row_num"), 256).alias("review_id"), "statement_id", "row_num",
        category(F.col("rejection_reason")).alias("rejection_category"), F.col("rejection_reason").alias("rejection_details"),
        F.to_json(F.struct("invoice_number", "outstanding_amount", "amount")).alias("raw_payload"),
        F.lit("PENDING_REVIEW").alias("review_status"),
    )


def parse_payload(review: DataFrame) -> DataFrame:
    """Adds invoice_number and amount of the payload; a malformed payload gives nulls."""
    payload = F.from_json("raw_payload", "invoice_number string, outstanding_amount string, amount string")
    return review.withColumn("_p", payload).select(
        *review.columns, F.col("_p.invoice_number").alias("invoice_number"),
        F.coalesce("_p.outstanding_amount", "_p.amount").alias("amount"),
    )
