"""Payment vouchers: a summary and its line items as two sheets of one workbook.

A workbook is a partition ``file=…`` of two tables, one for each sheet, so that all
vouchers are written and read in one pass. The summary of a workbook is its first row;
lines whose description names no bill, or that have no amount, are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.amounts import parse_c
from tallyloom.functions.dates import voucher_date
from tallyloom.functions.texts import bill_number
from tallyloom.operators.identity import vendor_identity
from tallyloom.operators.quality import strip

SUMMARY = "pos int, vendor string, voucher_date string, check_number string, grand_total string, file string"
ITEMS = "pos int, page int, date string, description string, orig_amount string, amount_due string, discount string, applied_amount string, file string"
#: Prefix of the ledger scope of a vendor's vouchers.
SCOPE = "VOUCHER-"


def write_vouchers(summary: DataFrame, items: DataFrame, path: str) -> None:
    """Both sheets of every workbook; workbooks in ``path`` that come again are replaced."""
    for sheet, rows in (("summary", summary), ("items", items)):
        writer = rows.repartition("file").sortWithinPartitions("file", "pos").write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").option("header", "true").option("escape", '"').partitionBy("file").csv(f"{path}/{sheet}")


def read_vouchers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(summary, items) of all workbooks below ``path``; empty cells are null."""
    return tuple(
        spark.read.schema(schema).option("header", "true").option("escape", '"').csv(f"{path}/{sheet}") for sheet, schema in (("summary", SUMMARY), ("items", ITEMS))
    )


def voucher_rows(summary: DataFrame, items: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Ledger rows: vendor, number, dates and amount of each bill, under the scope of its vendor."""
    first = summary.groupBy("file").agg(F.min_by(F.struct("vendor", "voucher_date"), "pos").alias("s"))
    first = first.select("file", strip(F.col("s.vendor")).alias("vendor_name"), voucher_date(F.col("s.voucher_date")).alias("posting_date"))
    rows = vendor_identity(items.join(first, "file"), aliases)
    rows = rows.withColumns({"invoice_number": bill_number(F.col("description")), "outstanding_amount": parse_c(F.col("applied_amount"))})
    return rows.where("invoice_number is not null and outstanding_amount is not null").select(
        F.concat(F.lit(SCOPE), "vendor_id").alias("statement_id"), "vendor_id", "vendor_name", "invoice_number", voucher_date(F.col("date")).alias("invoice_date"),
        "outstanding_amount", "posting_date", F.col("file").alias("source_file"), "pos",
    )


def voucher_ledger(ledger: DataFrame) -> DataFrame:
    """The rows of a ledger that come from vouchers of their own vendor; statement-scoped rows are no evidence."""
    return ledger.where(F.col("statement_id") == F.concat(F.lit(SCOPE), "vendor_id"))


def require_both_sides(lines: DataFrame, ledger: DataFrame) -> None:
    """Raises if there are no statement lines, or if a vendor with lines has no ledger row; one vendor is named."""
    if lines.isEmpty():
        raise ValueError("no statement lines")
    lone = lines.select("vendor_id").distinct().join(ledger.select("vendor_id").distinct(), "vendor_id", "left_anti").agg(F.min("vendor_id"), F.count("*")).first()
    if lone[1]:
        raise ValueError(f"{lone[1]} vendors have lines but no ledger rows, among them {lone[0]}")
