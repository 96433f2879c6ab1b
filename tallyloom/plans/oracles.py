"""DuckDB SQL of the fixture views and of the sequential matcher, as common prefixes."""

from __future__ import annotations

FIXTURES = """
f_base AS (
  SELECT 'STMT-'||n_nationkey||'-'||strftime(o_orderdate,'%Y%m') AS statement_id, n_name AS vendor_id,
         strftime(o_orderdate,'%Y-%m') AS statement_period, 'INV'||lpad(CAST(o_orderkey AS VARCHAR),8,'0') AS invoice_number,
         CASE WHEN o_orderkey%3=0 THEN NULL ELSE 'RO-'||(o_custkey%40) END AS ro_number,
         CAST(o_totalprice AS DECIMAL(18,2)) AS outstanding_amount, strftime(o_orderdate,'%Y-%m-%d') AS invoice_date, o_orderkey AS okey
  FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey),
f_stmt AS (
  SELECT statement_id, vendor_id, statement_period, invoice_number, ro_number, invoice_date, outstanding_amount, okey*2 AS seq FROM f_base
  UNION ALL
  SELECT statement_id, vendor_id, statement_period, invoice_number, ro_number, invoice_date, CAST(outstanding_amount+0.20 AS DECIMAL(18,2)), okey*2+1
  FROM f_base WHERE okey%17=5),
f_b20 AS (SELECT *, okey%20 AS k FROM f_base),
f_erp AS (
  SELECT vendor_id, CASE WHEN k=2 THEN invoice_number||'-ERP-ALT' ELSE invoice_number END AS invoice_number, ro_number,
         CAST(CASE WHEN k=1 THEN outstanding_amount*1.10 WHEN k=3 THEN outstanding_amount+0.30 ELSE outstanding_amount END AS DECIMAL(18,2)) AS outstanding_amount,
         okey*2 AS erp_seq
  FROM f_b20 WHERE k<>0
  UNION ALL
  SELECT vendor_id, invoice_number, ro_number, CAST(outstanding_amount+0.10 AS DECIMAL(18,2)), okey*2+1 FROM f_b20 WHERE k=4),
f_b30 AS (SELECT *, okey%30 AS m, CAST(outstanding_amount AS VARCHAR) AS t FROM f_base),
f_raw AS (
  SELECT statement_id, vendor_id, okey*2 AS row_num,
    CASE WHEN m IN (0,2) THEN NULL WHEN m=9 THEN '  '||invoice_number||' ' ELSE invoice_number END AS invoice_number,
    CASE WHEN m=0 THEN NULL WHEN m=2 THEN 'RO-2' ELSE ro_number END AS ro_number,
    CASE WHEN m=1 THEN NULL ELSE t END AS amount,
    CASE WHEN m IN (1,6) THEN NULL WHEN m=3 THEN 'not_a_number' WHEN m=8 THEN '0.00' ELSE t END AS outstanding_amount,
    CAST(NULL AS VARCHAR) AS credit, CASE WHEN m=4 THEN 0.65 WHEN m=5 THEN NULL ELSE 0.95 END AS line_confidence
  FROM f_b30
  UNION ALL SELECT statement_id, vendor_id, okey*2+1, invoice_number, ro_number, t, t, NULL, 0.95 FROM f_b30 WHERE m=7),
f_jobs AS (
  SELECT event_id AS id, 'JOB-'||event_id AS job_id, 'file_'||(event_id%400)||'.pdf' AS pdf_filename,
    CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'PROCESSING' WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status,
    CASE WHEN user_id%5=0 THEN NULL ELSE 'BATCH-'||user_id||'-'||strftime(ts,'%Y%m%d') END AS batch_id, ts AS submitted_at,
    CASE WHEN event_type IN ('click','purchase','error') THEN ts + to_seconds(CAST(floor(value*10) AS BIGINT)) END AS completed_at
  FROM events)"""

TOLERANCE = "(abs({s}-{e})<=0.50 OR abs({s}-{e})<=0.01*abs({s}))"

INTAKE = """
r1 AS (SELECT *, CASE WHEN trim(coalesce(invoice_number,''))='' AND trim(coalesce(ro_number,''))='' THEN 'no invoice identifier found'
                      WHEN coalesce(outstanding_amount,amount,credit) IS NULL THEN 'no amount found' ELSE '' END AS skip_reason FROM f_raw),
r2 AS (SELECT statement_id, vendor_id, row_num, invoice_number, ro_number, amount, coalesce(outstanding_amount,amount) AS outstanding_amount,
              credit, line_confidence, skip_reason FROM r1),
r3 AS (SELECT *, CASE WHEN skip_reason<>'' THEN ''
  WHEN invoice_number IS NULL THEN 'MISSING_MANDATORY_FIELD: invoice_number is required'
  WHEN outstanding_amount IS NULL THEN 'MISSING_MANDATORY_FIELD: outstanding_amount is required'
  WHEN NOT regexp_full_match(coalesce(amount,'0'),'[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN 'INVALID_FIELD_TYPE: amount must be numeric, got '''||amount||''''
  WHEN NOT regexp_full_match(outstanding_amount,'[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN 'INVALID_FIELD_TYPE: outstanding_amount must be numeric, got '''||outstanding_amount||''''
  WHEN line_confidence<0.9 THEN 'LOW_CONFIDENCE: line_confidence '||line_confidence||' < threshold 0.9' ELSE '' END AS rej FROM r2),
r4 AS (SELECT *, row_number() OVER (PARTITION BY statement_id, skip_reason='' AND rej='', invoice_number, outstanding_amount ORDER BY row_num) AS cp FROM r3),
routed AS (SELECT statement_id, vendor_id, row_num, invoice_number, ro_number, amount, outstanding_amount, credit, line_confidence, skip_reason,
  CASE WHEN skip_reason='' AND rej='' AND cp>1 THEN 'DUPLICATE_RECORD: invoice_number and outstanding_amount repeat' ELSE rej END AS rejection_reason,
  CASE WHEN skip_reason<>'' THEN 'SKIPPED' WHEN rej<>'' OR cp>1 THEN 'INVALID' ELSE 'VALID' END AS route FROM r4),
review AS (SELECT sha256(statement_id||'|'||row_num) AS review_id, statement_id, row_num, split_part(rejection_reason,':',1) AS rejection_category,
  rejection_reason AS rejection_details, invoice_number, outstanding_amount AS amount, 'PENDING_REVIEW' AS review_status FROM routed WHERE route='INVALID')"""

SILVER = """
b0 AS (SELECT *, TRY_CAST(amount AS DECIMAL(18,2)) AS a, TRY_CAST(outstanding_amount AS DECIMAL(18,2)) AS o FROM routed WHERE route='VALID'),
bronze AS (SELECT statement_id, vendor_id, row_num, invoice_number AS raw_invoice_number, ro_number AS raw_ro_number,
  CAST(CASE WHEN a IS NULL OR a=0 THEN o ELSE a END AS VARCHAR) AS raw_amount,
  CAST(CASE WHEN o IS NULL OR o=0 THEN a ELSE o END AS VARCHAR) AS raw_outstanding_amount, line_confidence FROM b0),
silver AS (SELECT sha256('VENDOR_STATEMENT|'||statement_id||'|'||coalesce(raw_invoice_number,'None')||'|'||coalesce(raw_outstanding_amount,'None')) AS record_id,
  'VENDOR_STATEMENT' AS record_source, statement_id, vendor_id, raw_invoice_number AS invoice_number, trim(raw_invoice_number) AS invoice_number_normalized,
  raw_ro_number AS ro_number, CAST(raw_amount AS DECIMAL(18,2)) AS amount, CAST(raw_outstanding_amount AS DECIMAL(18,2)) AS outstanding_amount,
  'USD' AS currency, row_num AS seq FROM bronze)"""

WALK = f"""
ln AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY seq) AS ord FROM f_stmt),
c1 AS (SELECT l.statement_id, l.ord, list({{'s': e.erp_seq, 'a': e.outstanding_amount, 'i': e.invoice_number,
         'ok': {TOLERANCE.format(s='l.outstanding_amount', e='e.outstanding_amount')}}} ORDER BY e.erp_seq) AS c
       FROM ln l JOIN f_erp e ON l.vendor_id=e.vendor_id AND l.invoice_number=e.invoice_number GROUP BY l.statement_id, l.ord),
c2 AS (SELECT l.statement_id, l.ord, list({{'s': e.erp_seq, 'a': e.outstanding_amount, 'i': e.invoice_number, 'ok': true}} ORDER BY e.erp_seq) AS c
       FROM ln l JOIN f_erp e ON l.vendor_id=e.vendor_id AND l.ro_number=e.ro_number
        AND {TOLERANCE.format(s='l.outstanding_amount', e='e.outstanding_amount')} GROUP BY l.statement_id, l.ord),
cand AS MATERIALIZED (SELECT ln.statement_id, ln.ord, coalesce(c1.c, []) AS c1, coalesce(c2.c, []) AS c2
       FROM ln LEFT JOIN c1 USING (statement_id, ord) LEFT JOIN c2 USING (statement_id, ord)),
walk AS (
  SELECT DISTINCT statement_id, CAST(0 AS BIGINT) AS ord, CAST([] AS BIGINT[]) AS used, CAST(NULL AS INT) AS level, CAST(NULL AS VARCHAR) AS reason,
         CAST(NULL AS BIGINT) AS erp_seq, CAST(NULL AS DECIMAL(18,2)) AS erp_amount, CAST(NULL AS VARCHAR) AS erp_invoice FROM ln
  UNION ALL
  SELECT statement_id, ord, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.s) END, level,
         CASE WHEN level IS NOT NULL THEN NULL WHEN len(l1)>0 THEN 'Amount Mismatch' ELSE 'Invoice Missing' END, pick.s,
         CASE WHEN level IS NULL AND len(l1)>0 THEN l1[1].a ELSE pick.a END, pick.i
  FROM (SELECT *, CASE WHEN len(l1)>0 THEN h1[1] ELSE l2[1] END AS pick,
               CASE WHEN len(l1)>0 THEN CASE WHEN len(h1)>0 THEN 1 END WHEN len(l2)>0 THEN 2 END AS level
        FROM (SELECT c.statement_id, c.ord, w.used, list_filter(c.c1, lambda x: NOT list_contains(w.used, x.s)) AS l1,
                     list_filter(c.c1, lambda x: x.ok AND NOT list_contains(w.used, x.s)) AS h1,
                     list_filter(c.c2, lambda x: NOT list_contains(w.used, x.s)) AS l2
              FROM walk w JOIN cand c ON c.statement_id=w.statement_id AND c.ord=w.ord+1))),
dec AS (SELECT ln.*, w.level, w.reason, w.erp_seq, w.erp_amount, w.erp_invoice,
               CASE WHEN w.level IS NOT NULL THEN 'MATCHED' ELSE 'EXCEPTION' END AS status
        FROM ln JOIN walk w USING (statement_id, ord)),
matched AS (SELECT statement_id, vendor_id, seq, invoice_number, erp_invoice, erp_seq, level, outstanding_amount AS statement_amount, erp_amount,
  CASE WHEN level=1 THEN CASE WHEN abs(outstanding_amount-erp_amount)<=0.005 THEN 1.0 ELSE 0.95 END
       ELSE CASE WHEN abs(outstanding_amount-erp_amount)<=0.005 THEN 0.8 ELSE 0.75 END END AS match_confidence FROM dec WHERE status='MATCHED'),
sum0 AS (SELECT statement_id, vendor_id, statement_period, CAST(sum(outstanding_amount) AS DECIMAL(18,2)) AS statement_total,
  CAST(coalesce(sum(CASE WHEN status='MATCHED' THEN erp_amount END),0) AS DECIMAL(18,2)) AS erp_total, count(*) AS total_invoice_count,
  count(*) FILTER (status='MATCHED') AS matched_count, count(*) FILTER (status<>'MATCHED') AS exception_count FROM dec GROUP BY ALL),
all_sums AS (SELECT *, CAST(statement_total-erp_total AS DECIMAL(18,2)) AS difference,
  round(CAST(matched_count AS DOUBLE)*100/total_invoice_count, 2) AS match_percentage,
  CASE WHEN exception_count=0 THEN 'RECONCILED' WHEN exception_count<=3 THEN 'MINOR_EXCEPTIONS' ELSE 'EXCEPTIONS_PRESENT' END AS overall_status,
  CASE WHEN CAST(split_part(statement_id,'-',2) AS INT)%5=0 THEN date_trunc('quarter', strptime(statement_period||'-01','%Y-%m-%d'))
       ELSE strptime(statement_period||'-01','%Y-%m-%d') END AS run_ts FROM sum0)"""

STATE = """
sums AS (SELECT * FROM all_sums WHERE statement_id NOT LIKE '%06'),
raised0 AS (
  SELECT sha256(statement_id||'|'||seq||'|'||reason) AS exception_id, statement_id, vendor_id, seq, invoice_number,
         outstanding_amount AS statement_amount, erp_amount, reason AS exception_reason,
         CASE reason WHEN 'Invoice Missing' THEN 0.9 ELSE 0.85 END AS match_confidence FROM dec WHERE status='EXCEPTION'
  UNION ALL
  SELECT sha256(statement_id||'|'||row_num||'|EXTRACTION_INCOMPLETE'), statement_id, vendor_id, row_num, invoice_number,
         coalesce(TRY_CAST(outstanding_amount AS DECIMAL(18,2)), TRY_CAST(amount AS DECIMAL(18,2))), NULL, 'EXTRACTION_INCOMPLETE', 0.5
  FROM routed WHERE route='SKIPPED'),
raised AS (SELECT *, CASE WHEN seq%97=0 THEN NULL ELSE lower(vendor_id)||'_'||right(statement_id,6)||'.pdf' END AS source_file,
  strptime(right(statement_id,6)||'01','%Y%m%d') + to_hours(CAST(seq%40 AS INT)) AS date_raised FROM raised0),
exc AS (SELECT *, CASE WHEN seq%7=0 THEN 'RESOLVED' ELSE 'OPEN' END AS exception_status,
  CASE WHEN seq%14=0 THEN 'ACCEPTED' WHEN seq%7=0 THEN 'DISPUTED' END AS disposition_status,
  CASE WHEN seq%11=0 THEN 'ESCALATED' ELSE 'NONE' END AS escalation_status FROM raised),
latest AS (SELECT s.* FROM sums s JOIN (SELECT vendor_id, max(run_ts) AS ts FROM sums GROUP BY vendor_id) m ON s.vendor_id=m.vendor_id AND s.run_ts=m.ts),
opened AS (SELECT * FROM exc WHERE exception_status='OPEN'),
orph AS (SELECT * FROM opened e WHERE NOT EXISTS (SELECT 1 FROM sums s WHERE s.statement_id=e.statement_id))"""


def fixtures(body: str) -> str:
    return f"WITH {FIXTURES} {body}"


def intake(body: str) -> str:
    return f"WITH {FIXTURES}, {INTAKE}, {SILVER} {body}"


def walked(body: str) -> str:
    return f"WITH RECURSIVE {FIXTURES}, {WALK} {body}"


def silver_walked(body: str) -> str:
    """The sequential matcher over Silver lines; their number is the normalised one, or else the raw one."""
    key = "coalesce(nullif(l.invoice_number_normalized,''), l.invoice_number)"
    walk = WALK.split("dec AS (")[0].rstrip().rstrip(",")
    walk = walk.replace("FROM f_stmt)", "FROM silver)").replace("l.invoice_number=e.invoice_number", f"{key}=e.invoice_number")
    return f"WITH RECURSIVE {FIXTURES}, {INTAKE}, {SILVER}, {walk} {body}"


def stated(body: str) -> str:
    return f"WITH RECURSIVE {FIXTURES}, {INTAKE}, {SILVER}, {WALK}, {STATE} {body}"
