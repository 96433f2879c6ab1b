"""Intake, quality and medallion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import gold, medallion, quality, reports
from tallyloom.plans.oracles import fixtures, intake
from tallyloom.plans.register import Register
from tallyloom.sources.tables import last_wins

add = Register()
_ROW = ["statement_id", "row_num"]

add("skip_reason", lambda v: v.raw.select(*_ROW, quality.skip_reason().alias("skip_reason")), intake("SELECT statement_id, row_num, skip_reason FROM r1"))
add(
    "validate_rows",
    lambda v: quality.with_default_amount(v.raw.where(quality.skip_reason() == "")).select(*_ROW, quality.rejection().alias("rejection_reason")),
    intake("SELECT statement_id, row_num, rej AS rejection_reason FROM r3 WHERE skip_reason=''"),
)
add(
    "intake_routing",
    lambda v: v.routed.groupBy("statement_id", "route", quality.category(F.col("rejection_reason")).alias("category")).agg(F.count("*").alias("n")),
    intake("SELECT statement_id, route, split_part(rejection_reason,':',1) AS category, count(*) AS n FROM routed GROUP BY ALL"),
)
add("dedup_first", lambda v: v.routed.where("rejection_reason like 'DUPLICATE%'").select(*_ROW, "invoice_number"),
    intake("SELECT statement_id, row_num, invoice_number FROM routed WHERE rejection_reason LIKE 'DUPLICATE%'"))
add("bronze_rows", lambda v: v.bronze, intake("SELECT * FROM bronze"))
_SILVER = "record_id, record_source, statement_id, vendor_id, invoice_number, invoice_number_normalized, ro_number, currency, seq"
add(
    "silver_statement",
    lambda v: v.silver.select(*_SILVER.split(", "), F.col("amount").cast("double"), F.col("outstanding_amount").cast("double")),
    intake(f"SELECT {_SILVER}, CAST(amount AS DOUBLE) AS amount, CAST(outstanding_amount AS DOUBLE) AS outstanding_amount FROM silver"),
)
add(
    "silver_erp",
    lambda v: medallion.silver_ledger(v.ledger, F.lit(3)).withColumn("outstanding_amount", F.col("outstanding_amount").cast("double")),
    fixtures("""SELECT sha256('INTERNAL_ERP|VOUCHER-'||vendor_id||'|'||invoice_number||'|'||CAST(outstanding_amount AS VARCHAR)||'|3') AS record_id, 'INTERNAL_ERP' AS record_source,
    'VOUCHER-'||vendor_id AS statement_id, vendor_id, invoice_number, invoice_number AS invoice_number_normalized, ro_number, CAST(outstanding_amount AS DOUBLE) AS outstanding_amount,
    3 AS erp_version, erp_seq AS seq FROM f_erp"""),
)
add(
    "silver_voucher",
    lambda v: medallion.silver_voucher(v.lines, F.to_date(F.concat("statement_period", F.lit("-15")))).withColumn("outstanding_amount", F.col("outstanding_amount").cast("double")),
    fixtures("""SELECT sha256('INTERNAL_ERP|VOUCHER-'||vendor_id||'|'||invoice_number||'|'||CAST(outstanding_amount AS VARCHAR)) AS record_id, 'INTERNAL_ERP' AS record_source,
    'VOUCHER-'||vendor_id AS statement_id, vendor_id, invoice_number, CAST(NULL AS VARCHAR) AS ro_number, CAST(NULL AS VARCHAR) AS po_number,
    CAST(outstanding_amount AS DOUBLE) AS outstanding_amount, 'USD' AS currency, statement_period FROM f_stmt"""),
)
add(
    "silver_upsert_lastwins",
    lambda v: last_wins(v.lines.withColumn("key", F.concat_ws("|", "vendor_id", "ro_number")), ["key"], "seq").select("key", "seq", "invoice_number"),
    fixtures("""SELECT key, seq, invoice_number FROM (SELECT concat_ws('|', vendor_id, ro_number) AS key, seq, invoice_number,
    row_number() OVER (PARTITION BY concat_ws('|', vendor_id, ro_number) ORDER BY seq DESC) AS k FROM f_stmt) WHERE k=1"""),
)
add("record_id", lambda v: v.silver.select("statement_id", "seq", "record_id"), intake("SELECT statement_id, seq, record_id FROM silver"))
add(
    "skip_exceptions",
    lambda v: gold.skip_exceptions(v.routed.where("route = 'SKIPPED'")).withColumn("statement_amount", F.col("statement_amount").cast("double")).drop("vendor_id"),
    intake("""SELECT sha256(statement_id||'|'||row_num||'|EXTRACTION_INCOMPLETE') AS exception_id, statement_id, row_num AS seq, invoice_number,
    CAST(coalesce(TRY_CAST(outstanding_amount AS DECIMAL(18,2)), TRY_CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS statement_amount,
    'EXTRACTION_INCOMPLETE' AS exception_reason, CAST(0.5 AS DOUBLE) AS match_confidence, skip_reason FROM routed WHERE route='SKIPPED'"""),
)
add(
    "exception_suggestions",
    lambda v: reports.exception_suggestions(v.silver),
    intake("""SELECT statement_id, rank, invoice_number, CASE WHEN rank<=2 THEN 'missing' ELSE 'mismatch' END AS role,
    CASE WHEN rank=3 THEN CAST(round(CAST(outstanding_amount*0.85 AS DECIMAL(22,4)),2) AS DOUBLE) END AS suggested_amount
    FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY outstanding_amount DESC, seq) AS rank, count(*) OVER (PARTITION BY statement_id) AS n
          FROM silver WHERE invoice_number IS NOT NULL AND outstanding_amount IS NOT NULL) WHERE n>=3 AND rank<=3"""),
)
add(
    "review_payload",
    lambda v: quality.parse_payload(v.review).select("review_id", "rejection_category", "invoice_number", "amount"),
    intake("SELECT review_id, rejection_category, invoice_number, amount FROM review"),
)
add("review_queue_rows", lambda v: v.review.select("review_id", "statement_id", "row_num", "rejection_details", "review_status"),
    intake("SELECT review_id, statement_id, row_num, rejection_details, review_status FROM review"))

def _actions(v):
    """A flag for every third pending row, and an approval an hour later for every sixth."""
    day = F.lit("2002-01-01 00:00:00").cast("timestamp")
    rows = v.review.where("row_num % 3 = 0")
    first = rows.select("review_id", F.lit("flag").alias("action"), F.lit("a").alias("reviewed_by"), day.alias("ts"), F.lit(0).alias("event_seq"))
    later = rows.where("row_num % 6 = 0").select("review_id", F.lit("approve").alias("action"), F.lit("b").alias("reviewed_by"), (day + F.expr("interval 1 hour")).alias("ts"), F.lit(1).alias("event_seq"))
    return later.unionByName(first)


add(
    "review_actions", lambda v: gold.reviewed(v.review, _actions(v)).select("review_id", "review_status", "reviewed_by", "reviewed_at"),
    intake("""SELECT review_id, CASE WHEN row_num%6=0 THEN 'APPROVED' WHEN row_num%3=0 THEN 'FLAGGED' ELSE review_status END AS review_status,
    CASE WHEN row_num%6=0 THEN 'b' WHEN row_num%3=0 THEN 'a' END AS reviewed_by,
    CASE WHEN row_num%6=0 THEN TIMESTAMP '2002-01-01 01:00:00' WHEN row_num%3=0 THEN TIMESTAMP '2002-01-01 00:00:00' END AS reviewed_at FROM review"""),
)
add(
    "review_queue_files",
    lambda v: reports.review_files(v.review.withColumn("source_file", F.when(F.col("row_num") % 11 != 0, F.concat(F.lower("statement_id"), F.lit(".pdf"))))),
    intake("""SELECT source_file, CAST(sum(n) AS BIGINT) AS pending_count, string_agg(rejection_category||':'||n, ',' ORDER BY rejection_category||':'||n) AS category_breakdown
    FROM (SELECT CASE WHEN row_num%11<>0 THEN lower(statement_id)||'.pdf' END AS source_file, rejection_category, count(*) AS n FROM review GROUP BY ALL) GROUP BY 1"""),
)
add("review_queue_vendors", lambda v: reports.review_vendors(v.review, "statement_id"),
    intake("SELECT statement_id, rejection_category, count(*) AS n FROM review GROUP BY ALL"))
add(
    "flagged_exceptions",
    lambda v: gold.flagged_exceptions(quality.parse_payload(v.review), v.review.where("row_num % 3 = 0").select("review_id", F.lit("flag").alias("action"))).drop("explanation"),
    intake("""SELECT review_id, statement_id, invoice_number, amount AS statement_amount,
    CASE WHEN rejection_category='DUPLICATE_RECORD' THEN 'DUPLICATE_RECORD' ELSE 'EXTRACTION_INCOMPLETE' END AS exception_reason,
    CASE WHEN rejection_category<>'DUPLICATE_RECORD' THEN CAST(0.5 AS DOUBLE) END AS match_confidence FROM review WHERE row_num%3=0"""),
)
add(
    "statement_totals",
    lambda v: v.silver.groupBy("statement_id").agg(F.sum("outstanding_amount").cast("double").alias("statement_total")),
    intake("SELECT statement_id, CAST(sum(outstanding_amount) AS DOUBLE) AS statement_total FROM silver GROUP BY 1"),
)
QUERIES, ORACLES = add.queries, add.oracles
