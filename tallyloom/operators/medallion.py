"""Bronze and Silver projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.quality import is_number, strip

MONEY = "decimal(18,2)"


def money_text(value: Column) -> Column:
    """A decimal written plainly, or ``None``; what record ids hash."""
    return F.coalesce(value.cast(MONEY).cast("string"), F.lit("None"))


def safe_money(value: Column) -> Column:
    """A number's text as money; anything else is null."""
    return F.when(is_number(value), strip(value).try_cast("double").cast(MONEY))


def falsy_zero(first: Column, second: Column) -> Column:
    """``first`` unless it is null or zero, then ``second`` (zero counts as absent)."""
    return F.when(first.isNull() | (first == 0), second).otherwise(first)


def record_id(source: Column, statement: Column, invoice: Column, amount: Column, *more: Column) -> Column:
    parts = [source, statement, F.coalesce(invoice, F.lit("None")), money_text(amount), *more]
    return F.sha2(F.concat_ws("|", *parts), 256)


def bronze_rows(valid: DataFrame) -> DataFrame:
    """Extracted rows as texts; zero and missing amounts fall back on each other."""
    amount, outstanding = safe_money(F.col("amount")), safe_money(F.col("outstanding_amount"))
    return valid.select(
        "statement_id", "vendor_id", "row_num", F.col("invoice_number").alias("raw_invoice_number"), F.col("ro_number").alias("raw_ro_number"),
        falsy_zero(amount, outstanding).cast("string").alias("raw_amount"),
        falsy_zero(outstanding, amount).cast("string").alias("raw_outstanding_amount"), "line_confidence",
    )


def silver_statement(bronze: DataFrame) -> DataFrame:
    """Typed statement lines with record ids; ``seq`` keeps the row order."""
    amount = safe_money(F.col("raw_amount"))
    outstanding = falsy_zero(safe_money(F.col("raw_outstanding_amount")), amount)
    source = F.lit("VENDOR_STATEMENT")
    return bronze.select(
        record_id(source, F.col("statement_id"), F.col("raw_invoice_number"), outstanding).alias("record_id"),
        source.alias("record_source"), "statement_id", "vendor_id", F.col("raw_invoice_number").alias("invoice_number"),
        strip(F.col("raw_invoice_number")).alias("invoice_number_normalized"), F.col("raw_ro_number").alias("ro_number"),
        amount.alias("amount"), outstanding.alias("outstanding_amount"), F.lit("USD").alias("currency"), F.col("row_num").alias("seq"),
    )


def silver_ledger(rows: DataFrame, version: Column) -> DataFrame:
    """Typed ledger rows of a version; the version is part of the id."""
    source, statement = F.lit("INTERNAL_ERP"), F.concat(F.lit("VOUCHER-"), "vendor_id")
    return rows.select(
        record_id(source, statement, F.col("invoice_number"), F.col("outstanding_amount"), version.cast("string")).alias("record_id"),
        source.alias("record_source"), statement.alias("statement_id"), "vendor_id", "invoice_number",
        strip(F.col("invoice_number")).alias("invoice_number_normalized"), "ro_number", F.col("outstanding_amount"),
        version.cast("int").alias("erp_version"), F.col("erp_seq").alias("seq"),
    )


def silver_voucher(rows: DataFrame, posted: Column) -> DataFrame:
    """Paid vouchers as ledger rows: no order numbers, US dollars, period of the posting date."""
    source, statement = F.lit("INTERNAL_ERP"), F.concat(F.lit("VOUCHER-"), "vendor_id")
    return rows.select(
        record_id(source, statement, F.col("invoice_number"), F.col("outstanding_amount")).alias("record_id"),
        source.alias("record_source"), statement.alias("statement_id"), "vendor_id", "invoice_number",
        F.lit(None).cast("string").alias("ro_number"), F.lit(None).cast("string").alias("po_number"), "outstanding_amount",
        F.lit("USD").alias("currency"), F.left(F.date_format(posted, "yyyy-MM-dd"), F.lit(7)).alias("statement_period"),
    )


def next_version(versions: DataFrame, column: str = "erp_version") -> DataFrame:
    return versions.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_version"))
