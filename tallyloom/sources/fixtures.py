"""Reconciliation inputs derived from the star-schema tables.

Statement lines and ledger rows come from orders; extracted rows add the faults
that validation must find; jobs come from events. Every view is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.tables import read_table

MONEY = "decimal(18,2)"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice per order: vendor is the customer's nation, statement is vendor and month."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        F.concat(F.lit("STMT-"), "n_nationkey", F.lit("-"), F.date_format("o_orderdate", "yyyyMM")).alias("statement_id"),
        F.col("n_name").alias("vendor_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("statement_period"),
        F.concat(F.lit("INV"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("invoice_number"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("RO-"), F.col("o_custkey") % 40)).alias("ro_number"),
        F.col("o_totalprice").cast(MONEY).alias("outstanding_amount"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("invoice_date"),
        F.col("o_orderkey").alias("okey"),
    )


def _plus(amount: str) -> Column:
    return (F.col("outstanding_amount") + F.lit(amount).cast(MONEY)).cast(MONEY)


def _copy(twice: Column) -> Column:
    """0 for every row, and 1 once more for a row that is there twice; one pass over the joined tables gives both."""
    return F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement side; every seventeenth order has its line twice, 0.20 apart."""
    rows = base(spark, sf_dir).withColumn("copy", _copy(F.col("okey") % 17 == 5))
    columns = ["statement_id", "vendor_id", "statement_period", "invoice_number", "ro_number", "invoice_date"]
    amount = F.when(F.col("copy") == 1, _plus("0.20")).otherwise(F.col("outstanding_amount"))
    return rows.select(*columns, amount.alias("outstanding_amount"), (F.col("okey") * 2 + F.col("copy")).alias("seq"))


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger side with missing, mismatched, renumbered, tolerated and duplicate invoices."""
    k = F.col("okey") % 20
    rows = base(spark, sf_dir).where(k != 0).withColumn("copy", _copy(k == 4))
    number = F.when(k == 2, F.concat("invoice_number", F.lit("-ERP-ALT"))).otherwise(F.col("invoice_number"))
    amount = (
        F.when(k == 1, (F.col("outstanding_amount") * F.lit("1.10").cast("decimal(3,2)")).cast(MONEY))
        .when(k == 3, _plus("0.30"))
        .when(F.col("copy") == 1, _plus("0.10"))
        .otherwise(F.col("outstanding_amount"))
    )
    return rows.select(
        "vendor_id", number.alias("invoice_number"), "ro_number", amount.alias("outstanding_amount"),
        (F.col("okey") * 2 + F.col("copy")).alias("erp_seq"),
    )


def extracted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as an extractor gives them: texts, with one kind of fault for each residue of the order key; one kind is a second copy."""
    rows = base(spark, sf_dir).withColumn("m", F.col("okey") % 30).withColumn("t", F.col("outstanding_amount").cast("string"))
    m, nothing = F.col("m"), F.lit(None).cast("string")
    return rows.withColumn("copy", _copy(m == 7)).select(
        "statement_id", "vendor_id", (F.col("okey") * 2 + F.col("copy")).alias("row_num"),
        F.when(m.isin(0, 2), nothing).when(m == 9, F.concat(F.lit("  "), "invoice_number", F.lit(" "))).otherwise(F.col("invoice_number")).alias("invoice_number"),
        F.when(m == 0, nothing).when(m == 2, "RO-2").otherwise(F.col("ro_number")).alias("ro_number"),
        F.when(m != 1, F.col("t")).alias("amount"),
        F.when(m.isin(1, 6), nothing).when(m == 3, "not_a_number").when(m == 8, "0.00").otherwise(F.col("t")).alias("outstanding_amount"),
        nothing.alias("credit"),
        F.when(m == 4, 0.65).when(m == 5, F.lit(None)).otherwise(0.95).cast("double").alias("line_confidence"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue of uploaded files from the event stream."""
    e = read_table(spark, sf_dir, "events")
    status = (
        F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "view", "PROCESSING")
        .when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED")
    )
    batch = F.when(
        F.col("user_id") % 5 != 0, F.concat(F.lit("BATCH-"), "user_id", F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    )
    ended = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 10) * 1_000_000)
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("JOB-"), "event_id").alias("job_id"),
        F.concat(F.lit("file_"), F.col("event_id") % 400, F.lit(".pdf")).alias("pdf_filename"),
        status.alias("status"), batch.alias("batch_id"), F.col("ts").cast("timestamp").alias("submitted_at"),
        F.when(F.col("event_type").isin("click", "purchase", "error"), ended).alias("completed_at"),
    )
