"""A ledger made from statement lines and a table of scenarios, for trying the matcher out.

Scenarios are rows by invoice number: ``missing`` and ``pending`` and ``duplicate``
(booleans), ``new_amount`` and ``new_number`` (null: as on the statement). Lines
without a scenario are posted as they are. A second line of a duplicate is written
whether or not the first one is missing. Posting dates follow the invoice date by a
few days that the invoice number decides, so that a rerun gives the same ledger.

Null invoice numbers have no scenario; null or unreadable dates give no posting
date; scenarios must be unique by number; an empty table of either gives what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
SCENARIO = f"invoice_number string, missing boolean, new_amount {MONEY}, new_number string, pending boolean, duplicate boolean"
#: Days between invoice and posting, least and most.
LAG = (1, 5)


def posting_date(invoice_number: Column, invoice_date: Column, lag: tuple[int, int] = LAG) -> Column:
    """ISO date some days after the invoice date; the number's MD5 decides how many."""
    least, most = lag
    mixed = F.conv(F.substring(F.md5(invoice_number), 1, 7), 16, 10).cast("int")
    return F.date_format(F.date_add(invoice_date.try_cast("date"), mixed % (most - least + 1) + least), "yyyy-MM-dd")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def generate(lines: DataFrame, scenarios: DataFrame, lag: tuple[int, int] = LAG) -> DataFrame:
    """Ledger rows of ``lines`` (statement_id, vendor_id, seq, invoice_number, ro_number, invoice_date, outstanding_amount)."""
    rows = lines.join(scenarios, "invoice_number", "left")
    same = ["statement_id", "vendor_id", "seq", "ro_number", "invoice_date"]
    posted = rows.where(~_flag("missing")).select(
        *same, F.lit(0).alias("copy"), F.coalesce("new_number", "invoice_number").alias("invoice_number"),
        F.coalesce("new_amount", "outstanding_amount").cast(MONEY).alias("outstanding_amount"),
        F.when(_flag("pending"), "PENDING").otherwise("POSTED").alias("status"),
        posting_date(F.col("invoice_number"), F.col("invoice_date"), lag).alias("posting_date"),
    )
    again = rows.where(_flag("duplicate")).select(
        *same, F.lit(1).alias("copy"), "invoice_number", F.col("outstanding_amount").cast(MONEY).alias("outstanding_amount"),
        F.lit("POSTED").alias("status"), F.lit(None).cast("string").alias("posting_date"),
    )
    return posted.unionByName(again)


def scenario_counts(lines: DataFrame, scenarios: DataFrame) -> DataFrame:
    """How many lines of each statement every scenario took, and the ledger rows they make."""
    present = ~_flag("missing")
    counts = lines.join(scenarios, "invoice_number", "left").groupBy("statement_id").agg(
        F.count("*").alias("total_source"), F.count_if(~present).alias("missing"),
        F.count_if(present & F.col("new_amount").isNotNull()).alias("amount_mismatch"),
        F.count_if(present & F.col("new_amount").isNull()).alias("exact_match"),
        F.count_if(present & _flag("pending")).alias("pending"), F.count_if(present & F.col("new_number").isNotNull()).alias("renumbered"),
        F.count_if(_flag("duplicate")).alias("duplicate"),
    )
    return counts.withColumn("erp_rows", F.col("total_source") - F.col("missing") + F.col("duplicate"))
