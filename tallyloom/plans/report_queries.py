"""Reporting queries over runs and exceptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom import config
from tallyloom.operators import gold, reports
from tallyloom.plans.oracles import stated
from tallyloom.plans.register import Register
from tallyloom.plans.views import now

add = Register()
_NOW = "TIMESTAMP '2002-01-01 00:00:00'"
_DAYS = f"CAST(floor(epoch({_NOW}-date_raised)/86400) AS BIGINT)"
_LABEL = "CASE exception_reason WHEN 'Invoice Missing' THEN 'missing' WHEN 'Amount Mismatch' THEN 'amount mismatch' ELSE 'extraction incomplete' END"
_TITLE = "list_aggregate(list_transform(string_split(replace(replace({0},'_',' '),'-',' '),' '), lambda w: upper(w[1])||lower(w[2:])),'string_agg',' ')"

add(
    "kpis", lambda v: reports.kpis(v.summaries, v.exceptions, v.review),
    stated("""SELECT CAST(sum(total_invoice_count) AS BIGINT) AS total_invoices, CAST(sum(matched_count) AS BIGINT) AS auto_reconciled, CAST(sum(statement_total) AS DOUBLE) AS statement_total,
    count(DISTINCT vendor_id) AS vendor_count, (SELECT count(*) FROM opened JOIN latest USING (statement_id)) AS open_exceptions, (SELECT count(*) FROM review) AS pending_review_count,
    round(CAST(sum(matched_count) AS DOUBLE)*100/sum(total_invoice_count),1) AS match_rate FROM latest"""),
)
add("latest_run", lambda v: v.latest.select("vendor_id", "statement_id", "run_ts"), stated("SELECT vendor_id, statement_id, run_ts FROM latest"))
add(
    "recent_runs", lambda v: reports.recent_runs(v.summaries, v.exceptions, 10).select("statement_id", "vendor_id", "total_invoice_count", "matched_count", "exception_count", "overall_status"),
    stated("""SELECT l.statement_id, l.vendor_id, total_invoice_count, matched_count, coalesce(c,0) AS exception_count, CASE WHEN coalesce(c,0)=0 THEN 'RECONCILED' ELSE 'EXCEPTIONS_PRESENT' END AS overall_status
    FROM (SELECT * FROM latest ORDER BY run_ts DESC, statement_id DESC LIMIT 10) l LEFT JOIN (SELECT statement_id, count(*) AS c FROM opened GROUP BY 1) o USING (statement_id)"""),
)
add(
    "runs_live_counts", lambda v: reports.live_counts(v.summaries, v.exceptions).select("statement_id", "exception_count", "overall_status"),
    stated("""SELECT s.statement_id, coalesce(c,0) AS exception_count, CASE WHEN coalesce(c,0)=0 THEN 'RECONCILED' ELSE 'EXCEPTIONS_PRESENT' END AS overall_status
    FROM sums s LEFT JOIN (SELECT statement_id, count(*) AS c FROM opened GROUP BY 1) o USING (statement_id)"""),
)
add(
    "vendor_latest_statement", lambda v: reports.last_run(v.summaries).select("vendor_id", "statement_id"),
    stated("SELECT vendor_id, statement_id FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY run_ts DESC, statement_id DESC) AS k FROM sums) WHERE k=1"),
)
_ONLY = f"""SELECT source_file, {_TITLE.format("replace(source_file,'.pdf','')")} AS vendor_name, count(*) AS exception_count
    FROM (SELECT coalesce(source_file,'Unknown source') AS source_file FROM orph) GROUP BY ALL"""
add(
    "vendor_summaries", lambda v: reports.vendor_summaries(v.summaries, v.exceptions),
    stated(f"""SELECT vendor_id AS vendor_name, l.statement_id, total_invoice_count, matched_count, coalesce(c,0) AS exception_count, overall_status, false AS exceptions_only
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY run_ts DESC, statement_id DESC) AS k FROM sums) WHERE k=1) l
    LEFT JOIN (SELECT statement_id, count(*) AS c FROM opened GROUP BY 1) o ON o.statement_id=l.statement_id
    UNION ALL SELECT vendor_name, NULL, 0, 0, exception_count, 'EXCEPTIONS_PRESENT', true FROM ({_ONLY})"""),
)
add(
    "vendor_cards", lambda v: reports.vendor_cards(v.summaries, v.exceptions),
    stated(f"""SELECT vendor_id AS vendor_name, l.statement_id, total_invoice_count, matched_count, coalesce(c,0) AS exception_count, overall_status, false AS exceptions_only, b AS reason_breakdown
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY run_ts DESC, statement_id DESC) AS k FROM sums) WHERE k=1) l
    LEFT JOIN (SELECT statement_id, CAST(sum(n) AS BIGINT) AS c, string_agg(label||':'||n, ',' ORDER BY label||':'||n) AS b
      FROM (SELECT statement_id, {_LABEL} AS label, count(*) AS n FROM opened GROUP BY ALL) GROUP BY 1) o ON o.statement_id=l.statement_id
    UNION ALL SELECT vendor_name, NULL, 0, 0, exception_count, 'EXCEPTIONS_PRESENT', true, NULL FROM ({_ONLY})"""),
)
add(
    "exceptions_of_file", lambda v: reports.of_file_title(v.exceptions, F.lit("Nation 18 199806")).select("exception_id", "source_file"),
    stated("SELECT exception_id, source_file FROM exc WHERE lower(replace(replace(source_file,'.pdf',''),'_',' '))='nation 18 199806'"),
)
add(
    "statement_report_rows", lambda v: reports.report_rows(v.matched, v.exceptions).withColumn("statement_amount", F.col("statement_amount").cast("double")).withColumn("erp_amount", F.col("erp_amount").cast("double")),
    stated("""SELECT row_number() OVER (PARTITION BY statement_id, section ORDER BY s, r, invoice_number NULLS FIRST, seq) AS place, section, statement_id, invoice_number,
    CAST(statement_amount AS DOUBLE) AS statement_amount, CAST(erp_amount AS DOUBLE) AS erp_amount, detail FROM (
    SELECT 'matched' AS section, statement_id, seq, invoice_number, statement_amount, erp_amount, 'L'||level AS detail, '' AS s, '' AS r FROM matched
    UNION ALL SELECT 'exception', statement_id, seq, invoice_number, statement_amount, erp_amount, exception_status||':'||exception_reason, exception_status, exception_reason FROM exc)"""),
)
add(
    "open_exceptions", lambda v: reports.open_list(v.exceptions, v.decisions, now()),
    stated(f"""SELECT exception_id, e.statement_id, e.vendor_id, e.invoice_number, exception_reason, l.invoice_date, l.ro_number, escalation_status, {_DAYS} AS days_open
    FROM opened e LEFT JOIN ln l ON l.statement_id=e.statement_id AND l.seq=e.seq"""),
)
add(
    "open_exceptions_missing", lambda v: reports.open_list(v.exceptions, v.decisions.where("reason = 'Invoice Missing'"), now(), "missing").select("exception_id", "invoice_number", "days_open"),
    stated(f"SELECT exception_id, invoice_number, {_DAYS} AS days_open FROM opened WHERE exception_reason='Invoice Missing'"),
)
add("open_exceptions_latest", lambda v: reports.open_in_latest(v.exceptions, v.summaries).select("exception_id", "statement_id", "exception_reason"),
    stated("SELECT exception_id, statement_id, exception_reason FROM opened JOIN latest USING (statement_id)"))
add("orphan_exceptions", lambda v: reports.orphans(v.exceptions, v.summaries).select("exception_id", "statement_id"), stated("SELECT exception_id, statement_id FROM orph"))
add("orphan_files", lambda v: reports.orphans(v.exceptions, v.summaries).select("source_file").distinct(), stated("SELECT DISTINCT source_file FROM orph"))
add("exceptions_only_vendors", lambda v: reports.exceptions_only_vendors(v.exceptions, v.summaries),
    stated(f"SELECT *, 'EXCEPTIONS_PRESENT' AS overall_status, true AS exceptions_only FROM ({_ONLY})"))
add(
    "exception_counts", lambda v: reports.exception_counts(v.exceptions),
    stated("""SELECT statement_id, total, resolved, CAST(CASE WHEN (200*resolved)%total=0 AND ((200*resolved)//total)%2=1
      THEN (100*resolved)//total + ((100*resolved)//total)%2 ELSE floor(CAST(resolved AS DOUBLE)*100/total+0.5) END AS INT) AS progress_percent
    FROM (SELECT statement_id, count(*) AS total, count(*) FILTER (exception_status<>'OPEN') AS resolved FROM exc GROUP BY 1)"""),
)
add("reason_breakdown", lambda v: reports.reason_breakdown(v.exceptions), stated(f"SELECT statement_id, {_LABEL} AS label, count(*) AS n FROM opened GROUP BY ALL"))
add(
    "high_conf_exceptions", lambda v: v.exceptions.where((F.col("exception_status") == "OPEN") & (F.col("match_confidence") >= 0.90)).select("exception_id", "match_confidence"),
    stated("SELECT exception_id, CAST(match_confidence AS DOUBLE) AS match_confidence FROM opened WHERE match_confidence>=0.90"),
)
add(
    "aging_summary", lambda v: reports.aging(v.exceptions, now()),
    stated(f"""SELECT vendor_id, min(date_raised) AS oldest, count(*) AS open_count, count(*) FILTER (escalation_status='ESCALATED') AS escalated_count,
    max({_DAYS}) AS oldest_days FROM opened GROUP BY vendor_id"""),
)
add(
    "aging_buckets",
    lambda v: reports.open_only(v.exceptions).withColumn("d", reports.days_between(F.col("date_raised"), F.lit("1998-08-20 00:00:00").cast("timestamp"))).groupBy(
        reports.age_badge(F.col("d")).alias("age"), reports.confidence_badge(F.col("match_confidence")).alias("confidence")).agg(F.count("*").alias("n")),
    stated("""SELECT CASE WHEN d<7 THEN 'fresh' WHEN d<=14 THEN 'aging' ELSE 'overdue' END AS age, CASE WHEN match_confidence>=0.95 THEN 'high' WHEN match_confidence>=0.80 THEN 'medium' ELSE 'low' END AS confidence,
    count(*) AS n FROM (SELECT *, floor(epoch(TIMESTAMP '1998-08-20 00:00:00'-date_raised)/86400) AS d FROM opened) GROUP BY ALL"""),
)
add("days_open", lambda v: v.exceptions.select("exception_id", reports.days_between(F.col("date_raised"), now()).alias("days_open")),
    stated(f"SELECT exception_id, {_DAYS} AS days_open FROM exc"))
add(
    "vendor_match_rate", lambda v: reports.vendor_match_rate(v.summaries),
    stated("""SELECT vendor_id, CAST(sum(matched_count) AS BIGINT) AS matched, CAST(sum(total_invoice_count) AS BIGINT) AS total,
    round(CAST(sum(matched_count) AS DOUBLE)*100/sum(total_invoice_count),1) AS match_rate, sum(matched_count)*100 < sum(total_invoice_count)*90 AS warn FROM sums GROUP BY 1"""),
)
add(
    "explain_candidates", lambda v: reports.explain_candidates(v.exceptions, config.EXPLAIN_PER_RUN),
    stated("""SELECT statement_id, exception_id, exception_reason, greatest(0, n-10) AS skipped FROM (SELECT *, row_number() OVER (PARTITION BY statement_id
    ORDER BY exception_reason, invoice_number NULLS FIRST, exception_id) AS k, count(*) OVER (PARTITION BY statement_id) AS n FROM opened) WHERE k<=10"""),
)
add(
    "bulk_approve_preview", lambda v: reports.bulk_preview(v.exceptions, v.summaries, config.BULK_APPROVE_MIN),
    stated("""SELECT vendor_id, count(DISTINCT exception_id) AS n FROM (SELECT o.vendor_id, exception_id FROM opened o JOIN latest USING (statement_id) WHERE match_confidence>=0.85
    UNION ALL SELECT vendor_id, exception_id FROM orph WHERE match_confidence>=0.85) GROUP BY 1"""),
)
add(
    "bulk_approve_events",
    lambda v: gold.bulk_approve(v.exceptions, config.BULK_APPROVE_MIN, now()).select("exception_id", "disposition_status"),
    stated("SELECT exception_id, 'ACCEPTED' AS disposition_status FROM opened WHERE match_confidence>=0.85"),
)
add(
    "exception_state", lambda v: v.exceptions.select("exception_id", "exception_status", "disposition_status", "escalation_status"),
    stated("SELECT exception_id, exception_status, disposition_status, escalation_status FROM exc"),
)
add(
    "vendor_name_for_statement",
    lambda v: reports.vendor_names(
        v.all_summaries.select("statement_id"),
        v.all_summaries.select("statement_id", F.when(F.col("statement_id").endswith("03"), "").when(F.col("statement_id").endswith("04"), F.initcap("vendor_id")).alias("vendor_name")),
        v.summaries),
    stated("""SELECT a.statement_id, CASE WHEN a.statement_id LIKE '%04' THEN list_aggregate(list_transform(string_split(a.vendor_id,' '), lambda w: upper(w[1])||lower(w[2:])),'string_agg',' ')
    ELSE s.vendor_id END AS vendor_name FROM all_sums a LEFT JOIN sums s USING (statement_id)"""),
)
add(
    "statement_report", lambda v: reports.statement_report(v.all_summaries, v.matched, v.exceptions),
    stated("""SELECT s.statement_id, total_invoice_count, matched_count, coalesce(ma,0) AS matched_amount, coalesce(sl,0) AS second_level, coalesce(r,0) AS raised, coalesce(o,0) AS open
    FROM all_sums s LEFT JOIN (SELECT statement_id, CAST(sum(statement_amount) AS DOUBLE) AS ma, count(*) FILTER (level=2) AS sl FROM matched GROUP BY 1) m USING (statement_id)
    LEFT JOIN (SELECT statement_id, count(*) AS r, count(*) FILTER (exception_status='OPEN') AS o FROM exc GROUP BY 1) e USING (statement_id)"""),
)
add(
    "all_runs", lambda v: reports.live_counts(v.all_summaries, v.exceptions).select("statement_id", "vendor_id", "run_ts", "exception_count", "overall_status"),
    stated("""SELECT s.statement_id, vendor_id, run_ts, coalesce(c,0) AS exception_count, CASE WHEN coalesce(c,0)=0 THEN 'RECONCILED' ELSE 'EXCEPTIONS_PRESENT' END AS overall_status
    FROM all_sums s LEFT JOIN (SELECT statement_id, count(*) AS c FROM opened GROUP BY 1) o USING (statement_id)"""),
)
add(
    "open_exceptions_mismatch", lambda v: reports.open_list(v.exceptions, v.decisions.where("reason = 'Amount Mismatch'"), now(), "mismatch").select("exception_id", "invoice_date", "days_open"),
    stated(f"SELECT exception_id, invoice_date, {_DAYS} AS days_open FROM opened o LEFT JOIN ln l ON l.statement_id=o.statement_id AND l.seq=o.seq WHERE exception_reason='Amount Mismatch'"),
)
QUERIES, ORACLES = add.queries, add.oracles
