"""Broken inputs, versions of a table, vouchers of two sheets, the event log and the report built on it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.operators import matching, reports
from tallyloom.plans.extraction_queries import _documents
from tallyloom.plans.oracles import fixtures, stated
from tallyloom.plans.register import Register
from tallyloom.plans.views import Views
from tallyloom.sources import event_log, extraction_cache, inputs, tables, vouchers
from tallyloom.streaming.intake import scratch

add = Register()


def _broken(v: Views):
    """Document texts of all statements: whole, cut off, empty, or of another kind, by their number of lines."""
    n = F.size(F.split("value", "invoice_number")) % 5
    text = F.when(n == 0, F.left("value", F.length("value") - 3)).when(n == 1, F.lit(" ")).when(n == 2, F.lit('{"page": 1}')).otherwise(F.col("value"))
    return _documents(v).withColumn("value", text)


add(
    "document_quarantine",
    lambda v: inputs.parse_documents(_broken(v)).select("doc_id", "reason", F.size("document.invoices").alias("n")).withColumn("n", F.when(F.col("reason").isNull(), F.col("n"))),
    fixtures("""SELECT statement_id AS doc_id, CASE (count(*)+1)%5 WHEN 0 THEN 'MALFORMED' WHEN 1 THEN 'EMPTY' WHEN 2 THEN 'NO_INVOICES' END AS reason,
    CAST(CASE WHEN (count(*)+1)%5>2 THEN count(*) END AS INT) AS n FROM f_stmt GROUP BY 1"""),
)


def _files(v: Views):
    k = F.col("seq") % 5
    body = F.concat(F.lit("%PDF-1.4\n<< /Type /Pages >>\n"), F.repeat(F.lit("<< /Type /Page >>\n"), (F.col("seq") % 4).cast("int")), "invoice_number")
    text = F.when(k == 0, "").when(k == 1, F.col("invoice_number")).when(k == 2, body).otherwise(F.concat(body, F.lit("\n%%EOF\n")))
    return v.lines.select(F.concat(F.lit("in/"), "seq", F.lit(".pdf")).alias("path"), "seq", F.encode(text, "UTF-8").alias("content"))


add(
    "file_quarantine", lambda v: inputs.inspect_files(_files(v)).select("seq", "reason", "page_count"),
    fixtures("SELECT seq, CASE seq%5 WHEN 0 THEN 'EMPTY' WHEN 1 THEN 'NOT_PDF' WHEN 2 THEN 'TRUNCATED' END AS reason, CAST(CASE WHEN seq%5>2 THEN seq%4 END AS INT) AS page_count FROM f_stmt"),
)


def _versions(v: Views):
    rows = v.lines.select("statement_id", "seq", F.col("outstanding_amount").cast("double").alias("amount"))
    old, new = rows.where("seq % 3 = 0").drop("amount"), rows.where("seq % 3 > 0")
    paths = [scratch(v.spark, "version") for _ in range(2)]
    for part, path in zip((old, new), paths, strict=True):
        part.write.parquet(path)
    nullable = StructType.fromDDL("statement_id string, seq long, amount double")
    return inputs.read_versions(v.spark, paths, [StructType(nullable.fields[:2]), nullable])


add("table_versions", _versions, fixtures("SELECT statement_id, seq, CAST(CASE WHEN seq%3>0 THEN outstanding_amount END AS DOUBLE) AS amount FROM f_stmt"))


def _cached(v: Views):
    """Three batches of extractions, the second of which comes twice."""
    found = v.jobs.select("id", F.sha2("pdf_filename", 256).alias("document_hash"), F.concat(F.lit("S"), F.col("id") % 7).alias("statement_id"), F.col("submitted_at").alias("ingestion_timestamp"),
                          F.col("pdf_filename").alias("source_file"), F.col("status").alias("extraction_method"), (F.col("id") % 5).alias("row_count"))
    cache = extraction_cache.open_cache(v.spark, scratch(v.spark, "cache"))
    for batch in (0, 1, 1, 2):
        extraction_cache.write_entries(cache, found.where(F.col("id") % 3 == batch), batch)
    return extraction_cache.entries(cache)


add(
    "cache_write", _cached,
    fixtures("""SELECT sha256(pdf_filename) AS document_hash, 'S'||(id%7) AS statement_id, submitted_at AS ingestion_timestamp, pdf_filename AS source_file, status AS extraction_method,
    CAST(id%5 AS BIGINT) AS row_count, CAST(id%3 AS BIGINT) AS batch FROM f_jobs
    QUALIFY row_number() OVER (PARTITION BY pdf_filename, id%7 ORDER BY id%3 DESC, submitted_at DESC, status DESC, id%5 DESC)=1"""),
)


def _copied(v: Views):
    """Jobs copied from one store to another."""
    old, new = scratch(v.spark, "store"), scratch(v.spark, "copy")
    v.jobs.write.parquet(old)
    tables.copy_rows(v.spark, old, new, "id", ["id", "job_id", "status"])
    return v.spark.read.parquet(new)


add("rows_copied", _copied, fixtures("SELECT id, job_id, status FROM f_jobs"))


def _vouchers(v: Views):
    """A workbook for every vendor, written as two sheets and read back; every third line names no bill or has no amount."""
    k = F.col("seq") % 6
    text = F.when(k == 2, F.lit(None)).otherwise(F.concat(F.lit("$"), F.format_number(F.col("outstanding_amount"), 2)))
    described = F.when(k == 5, F.lit("Payment")).when(k == 1, F.concat(F.lit("bill credit #"), "invoice_number")).otherwise(F.concat(F.lit(" Bill #"), "invoice_number"))
    items = v.lines.select(F.col("seq").cast("int").alias("pos"), F.lit(1).alias("page"), F.date_format("invoice_date", "M/d/yyyy").alias("date"), described.alias("description"), *[F.lit("1, \"x\"").alias(c) for c in ("orig_amount", "amount_due", "discount")],
                           text.alias("applied_amount"), F.concat("vendor_id", F.lit(".xlsx")).alias("file"))
    pages = v.lines.select(F.concat("vendor_id", F.lit(".xlsx")).alias("file"), F.col("vendor_id").alias("vendor")).distinct().withColumn("pos", F.explode(F.array(F.lit(1), F.lit(0))))
    vendor = F.when(F.col("pos") == 0, F.col("vendor")).otherwise(F.lit("a later row"))
    summary = pages.select("pos", vendor.alias("vendor"), F.lit("3/9/2002").alias("voucher_date"), F.lit("77").alias("check_number"), F.lit("$1").alias("grand_total"), "file")
    path = scratch(v.spark, "vouchers")
    vouchers.write_vouchers(summary, items, path)
    return vouchers.voucher_rows(*vouchers.read_vouchers(v.spark, path), {"FIRST": ["NATION_1"]})


add(
    "voucher_rows", _vouchers,
    fixtures("""SELECT 'VOUCHER-'||vid AS statement_id, vid AS vendor_id, vendor_id AS vendor_name, invoice_number, strftime(CAST(invoice_date AS DATE),'%Y-%m-%d') AS invoice_date,
    CAST(outstanding_amount AS DOUBLE) AS outstanding_amount, '2002-03-09' AS posting_date, vendor_id||'.xlsx' AS source_file, CAST(seq AS INT) AS pos
    FROM (SELECT *, CASE vendor_id WHEN 'NATION_1' THEN 'FIRST' ELSE vendor_id END AS vid FROM f_stmt) WHERE seq%6 NOT IN (2,5)"""),
)
add(
    "voucher_ledger",
    lambda v: vouchers.voucher_ledger(v.ledger.withColumn("statement_id", F.when(F.col("erp_seq") % 3 == 0, F.concat(F.lit("VOUCHER-"), "vendor_id")).when(F.col("erp_seq") % 3 == 1, F.lit("VOUCHER-OTHER")))).select("erp_seq", "statement_id"),
    fixtures("SELECT erp_seq, 'VOUCHER-'||vendor_id AS statement_id FROM f_erp WHERE erp_seq%3=0"),
)


def _events(v: Views, later: int):
    at = F.timestamp_seconds(F.lit(1_000_000_000 + later))
    named = v.lines.select("statement_id", F.concat("vendor_id", F.lit(".pdf")).alias("source_file"), F.col("seq").alias("row_num"), F.lit("no amount").alias("reason"), at.alias("ts"))
    documents = named.groupBy("statement_id", "source_file").agg(F.lit("RECONCILIATION").alias("route"), F.count("*").alias("n_rows"), F.max("ts").alias("ts"))
    return event_log.intake_events(documents).unionByName(event_log.skip_events(named.where("row_num % 9 = 0")))


def _logged(v: Views):
    """All events appended, and once more at a later time."""
    log = event_log.open_log(v.spark, scratch(v.spark, "event-log"))
    for later in (0, 60):
        event_log.append(log, _events(v, later))
    return log.read()


add(
    "event_log", lambda v: _logged(v).select("kind", "statement_id", "source_file", "detail", F.unix_seconds("ts").alias("at")),
    fixtures("""SELECT 'INTAKE' AS kind, statement_id, vendor_id||'.pdf' AS source_file, 'RECONCILIATION:'||count(*) AS detail, 1000000000 AS at FROM f_stmt GROUP BY statement_id, vendor_id
    UNION ALL SELECT 'ROW_SKIP', statement_id, vendor_id||'.pdf', CASE WHEN seq<1000000 THEN lpad(CAST(seq AS VARCHAR),6,'0') ELSE CAST(seq AS VARCHAR) END||':no amount', 1000000000 FROM f_stmt WHERE seq%9=0"""),
)
add(
    "statement_report_sections",
    lambda v: reports.report_sections(v.all_summaries, v.matched, v.exceptions, _events(v, 0)),
    stated("""SELECT statement_id, 'summary' AS section, 1 AS place, concat_ws('|', overall_status, matched_count, exception_count) AS text FROM all_sums
    UNION ALL SELECT statement_id, 'intake', 1, 'RECONCILIATION:'||count(*) FROM f_stmt GROUP BY 1
    UNION ALL SELECT statement_id, section, row_number() OVER (PARTITION BY statement_id, section ORDER BY s, r, invoice_number NULLS FIRST, seq), concat_ws('|', invoice_number, detail) FROM (
      SELECT 'matched' AS section, statement_id, seq, invoice_number, 'L'||level AS detail, '' AS s, '' AS r FROM matched
      UNION ALL SELECT 'exception', statement_id, seq, invoice_number, exception_status||':'||exception_reason, exception_status, exception_reason FROM exc)
    UNION ALL SELECT statement_id, 'audit', row_number() OVER (PARTITION BY statement_id ORDER BY d), 'ROW_SKIP|'||d FROM
      (SELECT statement_id, CASE WHEN seq<1000000 THEN lpad(CAST(seq AS VARCHAR),6,'0') ELSE CAST(seq AS VARCHAR) END||':no amount' AS d FROM f_stmt WHERE seq%9=0)"""),
)
_KINDS, _STATUSES = ("INVOICE", "RO", "PO", "OTHER"), ("EXACT", "TOLERANCE", "MISMATCH")
add(
    "tier_confidence",
    lambda v: v.lines.select("seq", F.get(F.array(*map(F.lit, _KINDS)), (F.col("seq") % 4).cast("int")).alias("kind"), F.get(F.array(*map(F.lit, _STATUSES)), (F.col("seq") % 3).cast("int")).alias("status")).select(
        "seq", matching.tier_confidence(F.col("kind"), F.col("status")).alias("score")),
    fixtures("""SELECT seq, CAST(coalesce(s, 0.6) AS DOUBLE) AS score FROM (SELECT *, ['INVOICE','RO','PO','OTHER'][CAST(seq%4 AS INT)+1] AS kind, ['EXACT','TOLERANCE','MISMATCH'][CAST(seq%3 AS INT)+1] AS status FROM f_stmt)
    LEFT JOIN (VALUES ('INVOICE','EXACT',1.0),('INVOICE','TOLERANCE',0.95),('INVOICE','MISMATCH',0.7),('PO','EXACT',0.85),('PO','TOLERANCE',0.8),('RO','EXACT',0.8),('RO','TOLERANCE',0.75)) t(kind,status,s) USING (kind, status)"""),
)
add(
    "shop_fallback",
    lambda v: v.lines.select("seq", inputs.shop_of(F.when(F.col("seq") % 3 == 0, "").when(F.col("seq") % 3 == 1, F.col("invoice_number")), F.when(F.col("seq") % 2 == 0, F.array("vendor_id", F.lit("second"))).otherwise(F.array().cast("array<string>"))).alias("shop")),
    fixtures("SELECT seq, CASE WHEN seq%3=1 THEN invoice_number WHEN seq%2=0 THEN vendor_id END AS shop FROM f_stmt"),
)
QUERIES, ORACLES = add.queries, add.oracles
