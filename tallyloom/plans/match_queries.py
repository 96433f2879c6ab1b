"""Matching, scoring and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import gold, ledger, matching, medallion, reports
from tallyloom.operators.matching import LINE
from tallyloom.plans.oracles import TOLERANCE, fixtures, silver_walked, walked
from tallyloom.plans.register import Register

add = Register()
_TOL = TOLERANCE.format(s="l.outstanding_amount", e="e.outstanding_amount")
_KEY = "l.vendor_id=e.vendor_id AND l.invoice_number=e.invoice_number"


def _first(edges, *columns):
    return edges.groupBy(*LINE).agg(*[F.min_by(c, "erp_seq").alias(c) for c in columns])


add(
    "match_level1",
    lambda v: _first(matching.level1_edges(v.lines, v.ledger).where("ok"), "erp_seq", "erp_amount").select(*LINE, "erp_seq", F.col("erp_amount").cast("double")),
    fixtures(f"""SELECT statement_id, seq, min(erp_seq) AS erp_seq, CAST(arg_min(e.outstanding_amount, erp_seq) AS DOUBLE) AS erp_amount
    FROM f_stmt l JOIN f_erp e ON {_KEY} WHERE {_TOL} GROUP BY statement_id, seq"""),
)
add(
    "match_level2",
    lambda v: _first(matching.level2_edges(v.lines, v.ledger).join(matching.level1_edges(v.lines, v.ledger), LINE, "left_anti"), "erp_seq", "erp_invoice"),
    fixtures(f"""SELECT statement_id, seq, min(erp_seq) AS erp_seq, arg_min(e.invoice_number, erp_seq) AS erp_invoice
    FROM f_stmt l JOIN f_erp e ON l.vendor_id=e.vendor_id AND l.ro_number=e.ro_number AND {_TOL}
    WHERE NOT EXISTS (SELECT 1 FROM f_erp x WHERE x.vendor_id=l.vendor_id AND x.invoice_number=l.invoice_number) GROUP BY statement_id, seq"""),
)
add(
    "amount_mismatch",
    lambda v: v.decisions.where("reason = 'Amount Mismatch'").select(*LINE, "invoice_number", F.col("erp_amount").cast("double")),
    walked("SELECT statement_id, seq, invoice_number, CAST(erp_amount AS DOUBLE) AS erp_amount FROM dec WHERE reason='Amount Mismatch'"),
)
add(
    "invoice_missing",
    lambda v: v.decisions.where("reason = 'Invoice Missing'").select(*LINE, "vendor_id", "invoice_number"),
    walked("SELECT statement_id, seq, vendor_id, invoice_number FROM dec WHERE reason='Invoice Missing'"),
)
add(
    "match_greedy",
    lambda v: v.decisions.select(*LINE, "invoice_number", "status", "level", "reason", "erp_seq", F.col("erp_amount").cast("double"), "erp_invoice"),
    walked("SELECT statement_id, seq, invoice_number, status, level, reason, erp_seq, CAST(erp_amount AS DOUBLE) AS erp_amount, erp_invoice FROM dec"),
)
add(
    "silver_match",
    lambda v: v.silver_decisions.select(*LINE, "invoice_number", "status", "level", "reason", "erp_seq", "erp_invoice"),
    silver_walked("""SELECT statement_id, ln.seq, invoice_number, CASE WHEN w.level IS NOT NULL THEN 'MATCHED' ELSE 'EXCEPTION' END AS status, w.level, w.reason, w.erp_seq, w.erp_invoice
    FROM ln JOIN walk w USING (statement_id, ord)"""),
)
add(
    "amount_tolerance",
    lambda v: v.lines.join(v.ledger.select("vendor_id", "invoice_number", "erp_seq", F.col("outstanding_amount").alias("e")), ["vendor_id", "invoice_number"]).select(
        *LINE, "erp_seq", matching.within_tolerance(F.col("outstanding_amount"), F.col("e")).alias("ok"),
        matching.amount_status(F.col("outstanding_amount"), F.col("e")).alias("amount_status")),
    fixtures(f"""SELECT statement_id, seq, erp_seq, {_TOL} AS ok, CASE WHEN abs(l.outstanding_amount-e.outstanding_amount)<=0.005 THEN 'EXACT' ELSE 'TOLERANCE' END AS amount_status
    FROM f_stmt l JOIN f_erp e ON {_KEY}"""),
)
add(
    "match_confidence",
    lambda v: v.matched.groupBy("level", "match_confidence").agg(F.count("*").alias("n")),
    walked("SELECT level, CAST(match_confidence AS DOUBLE) AS match_confidence, count(*) AS n FROM matched GROUP BY ALL"),
)
add(
    "exception_confidence",
    lambda v: gold.match_exceptions(v.decisions).groupBy("exception_reason", "match_confidence").agg(F.count("*").alias("n")),
    walked("SELECT reason AS exception_reason, CASE reason WHEN 'Invoice Missing' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS match_confidence, count(*) AS n FROM dec WHERE status='EXCEPTION' GROUP BY ALL"),
)
add(
    "status_tier",
    lambda v: v.all_summaries.groupBy("overall_status").agg(F.count("*").alias("n")),
    walked("SELECT overall_status, count(*) AS n FROM all_sums GROUP BY 1"),
)
_SUMMARY = ["statement_id", "vendor_id", "statement_period", "total_invoice_count", "matched_count", "exception_count", "match_percentage", "overall_status"]
add(
    "reconciliation_summary",
    lambda v: v.all_summaries.select(*_SUMMARY, *[F.col(c).cast("double") for c in ("statement_total", "erp_total", "difference")]),
    walked(f"SELECT {', '.join(_SUMMARY)}, CAST(statement_total AS DOUBLE) AS statement_total, CAST(erp_total AS DOUBLE) AS erp_total, CAST(difference AS DOUBLE) AS difference FROM all_sums"),
)
add(
    "summary_sources",
    lambda v: gold.with_sources(
        v.all_summaries.select("statement_id", "matched_count"),
        v.lines.select("statement_id", "seq", F.initcap("vendor_id").alias("vendor_name"), F.when(F.col("seq") % 4 == 0, F.concat(F.lit("Shop "), F.col("seq") % 9)).alias("shop")),
        v.lines.where("seq % 3 > 0").select("statement_id", (F.col("seq") % 7).alias("erp_version"))),
    walked("""SELECT statement_id, matched_count, vendor_name, shop, erp_version FROM all_sums
    JOIN (SELECT statement_id, arg_min(upper(vendor_id[1])||lower(vendor_id[2:]), seq) AS vendor_name, CASE WHEN min(seq)%4=0 THEN 'Shop '||(min(seq)%9) END AS shop FROM f_stmt GROUP BY 1) USING (statement_id)
    LEFT JOIN (SELECT statement_id, max(seq%7) AS erp_version FROM f_stmt WHERE seq%3>0 GROUP BY 1) USING (statement_id)"""),
)
add(
    "top_matched",
    lambda v: reports.top_matched(v.matched, 5),
    walked("""SELECT statement_id, rank, invoice_number, CAST(statement_amount AS DOUBLE) AS statement_amount FROM
    (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY statement_amount DESC, seq) AS rank FROM matched) WHERE rank<=5"""),
)
add(
    "mock_erp",
    lambda v: v.ledger.withColumn("lag_days", F.col("erp_seq") % 5 + 1).select(
        "vendor_id", "invoice_number", "ro_number", F.col("outstanding_amount").cast("double"), "erp_seq", "lag_days",
        F.when(F.col("erp_seq") % 13 == 0, "PENDING").otherwise("POSTED").alias("status")),
    fixtures("SELECT vendor_id, invoice_number, ro_number, CAST(outstanding_amount AS DOUBLE) AS outstanding_amount, erp_seq, erp_seq%5+1 AS lag_days, CASE WHEN erp_seq%13=0 THEN 'PENDING' ELSE 'POSTED' END AS status FROM f_erp"),
)


def _scenarios(v):
    """Scenarios by the residue of the order key; base rows are unique by invoice number."""
    k = F.col("seq") / 2 % 20
    return v.lines.where("seq % 2 = 0").select(
        "invoice_number", (k == 0).alias("missing"), F.when(k == 1, F.col("outstanding_amount") + 100).cast("decimal(18,2)").alias("new_amount"),
        F.when(k == 2, F.concat("invoice_number", F.lit("-ERP-ALT"))).alias("new_number"), k.isin(3, 0).alias("pending"), k.isin(4, 0).alias("duplicate"),
    ).where("missing or new_amount is not null or new_number is not null or pending or duplicate")


_SCENARIO = """sc AS (SELECT invoice_number, okey%20=0 AS missing, CASE WHEN okey%20=1 THEN outstanding_amount+100 END AS new_amount,
    CASE WHEN okey%20=2 THEN invoice_number||'-ERP-ALT' END AS new_number, okey%20 IN (0,3) AS pending, okey%20 IN (0,4) AS duplicate FROM f_base),
    sl AS (SELECT l.*, missing, new_amount, new_number, pending, duplicate FROM f_stmt l JOIN sc USING (invoice_number))"""
add(
    "ledger_generated",
    lambda v: ledger.generate(v.lines, _scenarios(v)).withColumn("outstanding_amount", F.col("outstanding_amount").cast("double")),
    fixtures("SELECT 1").removesuffix(" SELECT 1") + f""", {_SCENARIO} SELECT statement_id, vendor_id, seq, ro_number, invoice_date, 0 AS copy, coalesce(new_number, invoice_number) AS invoice_number,
    CAST(coalesce(new_amount, outstanding_amount) AS DOUBLE) AS outstanding_amount, CASE WHEN pending THEN 'PENDING' ELSE 'POSTED' END AS status,
    strftime(CAST(invoice_date AS DATE) + CAST(CAST('0x'||substr(md5(invoice_number),1,7) AS INT)%5+1 AS INT), '%Y-%m-%d') AS posting_date FROM sl WHERE NOT missing
    UNION ALL SELECT statement_id, vendor_id, seq, ro_number, invoice_date, 1, invoice_number, CAST(outstanding_amount AS DOUBLE), 'POSTED', NULL FROM sl WHERE duplicate""",
)
add(
    "ledger_scenario_counts", lambda v: ledger.scenario_counts(v.lines, _scenarios(v)),
    fixtures("SELECT 1").removesuffix(" SELECT 1") + f""", {_SCENARIO} SELECT *, total_source-missing+duplicate AS erp_rows FROM (SELECT statement_id, count(*) AS total_source, count(*) FILTER (missing) AS missing,
    count(*) FILTER (NOT missing AND new_amount IS NOT NULL) AS amount_mismatch, count(*) FILTER (NOT missing AND new_amount IS NULL) AS exact_match,
    count(*) FILTER (NOT missing AND pending) AS pending, count(*) FILTER (NOT missing AND new_number IS NOT NULL) AS renumbered, count(*) FILTER (duplicate) AS duplicate FROM sl GROUP BY 1)""",
)
add(
    "erp_scenario_counts",
    lambda v: v.lines.where("seq % 2 = 0").withColumn("k", (F.col("seq") / 2).cast("long") % 20).groupBy("statement_id").agg(
        F.count_if(F.col("k") == 0).alias("missing"), F.count_if(F.col("k") == 1).alias("amount_mismatch"), F.count_if(F.col("k") == 2).alias("renumbered"),
        F.count_if(F.col("k") == 4).alias("duplicate"), F.count("*").alias("total_source")),
    fixtures("""SELECT statement_id, count(*) FILTER (okey%20=0) AS missing, count(*) FILTER (okey%20=1) AS amount_mismatch, count(*) FILTER (okey%20=2) AS renumbered,
    count(*) FILTER (okey%20=4) AS duplicate, count(*) AS total_source FROM f_base GROUP BY 1"""),
)
add(
    "erp_version",
    lambda v: medallion.next_version(v.ledger.select((F.col("erp_seq") % 7).alias("erp_version"))),
    fixtures("SELECT coalesce(max(erp_seq%7),0)+1 AS next_version FROM f_erp"),
)
add(
    "erp_rows_reused",
    lambda v: v.matched.groupBy("statement_id", "erp_seq").agg(F.count("*").alias("n")).where("n > 1"),
    walked("SELECT statement_id, erp_seq, count(*) AS n FROM matched GROUP BY ALL HAVING count(*)>1"),
)
QUERIES, ORACLES = add.queries, add.oracles
