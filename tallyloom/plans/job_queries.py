"""Queue and batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import jobs
from tallyloom.plans.oracles import fixtures
from tallyloom.plans.register import Register
from tallyloom.streaming import intake

add = Register()
_TOOK = "CASE WHEN {s}<60 THEN {s}||'s' WHEN {s}<3600 THEN ({s}//60)||'m '||({s}%60)||'s' ELSE ({s}//3600)||'h '||(({s}%3600)//60)||'m' END"
_BATCHES = f"""bt0 AS (SELECT batch_id, count(*) AS total_files, count(*) FILTER (status='COMPLETED') AS completed_count, count(*) FILTER (status='FAILED') AS failed_count,
  count(*) FILTER (status IN ('PENDING','PROCESSING')) AS active_count, min(submitted_at) AS first_submitted_at, max(completed_at) AS last_completed_at
  FROM f_jobs WHERE batch_id IS NOT NULL GROUP BY batch_id),
bt1 AS (SELECT *, CAST(floor(epoch(last_completed_at-first_submitted_at)) AS BIGINT) AS s FROM bt0),
bt AS (SELECT batch_id, total_files, completed_count, failed_count, active_count, first_submitted_at, last_completed_at,
  CASE WHEN active_count>0 THEN 'PROCESSING' WHEN failed_count>0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status,
  CASE WHEN active_count=0 THEN {_TOOK.format(s='s')} END AS time_taken FROM bt1)"""


def _batches(body: str) -> str:
    return fixtures("SELECT 1").removesuffix(" SELECT 1") + f", {_BATCHES} {body}"


_BATCH = ["batch_id", "total_files", "completed_count", "failed_count", "active_count", "status", "time_taken"]
_ERRORS = ["Connection timeout", "bad JSON in reply", "HTTP 429", "missing API key", "boom", None]
_ERROR_SQL = "CASE id%6 WHEN 0 THEN 'Connection timeout' WHEN 1 THEN 'bad JSON in reply' WHEN 2 THEN 'HTTP 429' WHEN 3 THEN 'missing API key' WHEN 4 THEN 'boom' END"


def _error():
    out = F.when(F.lit(False), "")
    for k, text in enumerate(_ERRORS[:-1]):
        out = out.when(F.col("id") % 6 == k, text)
    return out


add("job_durations", lambda v: jobs.job_durations(v.jobs),
    fixtures(f"SELECT job_id, status, {_TOOK.format(s='s')} AS time_taken FROM (SELECT *, CAST(floor(epoch(completed_at-submitted_at)) AS BIGINT) AS s FROM f_jobs)"))
add("batches", lambda v: jobs.batches(v.jobs).select(*_BATCH), _batches(f"SELECT {', '.join(_BATCH)} FROM bt"))
add(
    "batch_detail",
    lambda v: jobs.batch_detail(v.jobs, v.jobs.where("status = 'COMPLETED'").select("job_id", (F.col("id") % 50).alias("invoices"), (F.col("id") % 7).alias("exceptions"))),
    _batches(f"""SELECT {', '.join(_BATCH)}, total_invoices, total_exceptions FROM bt JOIN (SELECT batch_id,
    CAST(coalesce(sum(CASE WHEN status='COMPLETED' THEN id%50 END),0) AS BIGINT) AS total_invoices,
    CAST(coalesce(sum(CASE WHEN status='COMPLETED' THEN id%7 END),0) AS BIGINT) AS total_exceptions FROM f_jobs WHERE batch_id IS NOT NULL GROUP BY batch_id) USING (batch_id)"""),
)
add("recent_batches", lambda v: jobs.recent_batches(v.jobs, 3),
    _batches("SELECT batch_id, status, total_files FROM bt WHERE status<>'PROCESSING' ORDER BY first_submitted_at DESC, batch_id LIMIT 3"))
add("manual_uploads", lambda v: jobs.manual_uploads(v.jobs),
    fixtures("SELECT strftime(submitted_at,'%Y-%m-%d') AS date, count(*) AS n, max(job_id) AS last_job_id FROM f_jobs WHERE batch_id IS NULL GROUP BY 1"))
add("claimable_job", lambda v: jobs.claimable(v.jobs),
    fixtures("SELECT min(id) AS id FROM f_jobs j WHERE status='PENDING' AND NOT EXISTS (SELECT 1 FROM f_jobs p WHERE p.status='PROCESSING' AND p.pdf_filename=j.pdf_filename)"))
_JOB = "job_id, pdf_filename, batch_id, status, submitted_at, completed_at"
add("active_jobs", lambda v: jobs.active(v.jobs), fixtures(f"SELECT {_JOB} FROM f_jobs WHERE status IN ('PENDING','PROCESSING','FAILED')"))
add("job_history", lambda v: jobs.history(v.jobs), fixtures(f"SELECT {_JOB} FROM f_jobs"))
add("job_daily_counts", lambda v: jobs.daily_counts(v.jobs), fixtures("SELECT strftime(submitted_at,'%Y-%m-%d') AS day, status, count(*) AS n FROM f_jobs GROUP BY ALL"))
_NAMES = "CASE id%4 WHEN 0 THEN upper(pdf_filename) WHEN 1 THEN pdf_filename||'.txt' WHEN 2 THEN NULL ELSE pdf_filename END"
add(
    "document_files",
    lambda v: jobs.statement_documents(v.jobs.select("job_id", F.expr("CASE id%4 WHEN 0 THEN upper(pdf_filename) WHEN 1 THEN concat(pdf_filename,'.txt') WHEN 2 THEN NULL ELSE pdf_filename END").alias("pdf_filename"))),
    fixtures(f"SELECT job_id, name AS pdf_filename FROM (SELECT job_id, {_NAMES} AS name FROM f_jobs) WHERE regexp_matches(name, '[.][pP][dD][fF]$')"),
)
_MESSAGES = ["Rate_Limit hit", "code 529", "HTTP 401", "Permission_Error", "read TIMED OUT", "Network down", "first line\nsecond line", ""]
_MESSAGE_SQL = "list_value('Rate_Limit hit', 'code 529', 'HTTP 401', 'Permission_Error', 'read TIMED OUT', 'Network down', 'first line'||chr(10)||'second line', '')[CAST(id%8 AS INT)+1]||CASE WHEN id%8=7 THEN '' ELSE CAST(id%300 AS VARCHAR) END"
add(
    "error_message",
    lambda v: v.jobs.select("job_id", F.concat(F.get(F.array(*map(F.lit, _MESSAGES)), (F.col("id") % 8).cast("int")), F.when(F.col("id") % 8 == 7, "").otherwise((F.col("id") % 300).cast("string"))).alias("e")).select(
        "job_id", jobs.error_message(F.col("e")).alias("message")),
    fixtures(f"""SELECT job_id, CASE WHEN e='' THEN 'unknown error' WHEN regexp_matches(e,'(?i)rate_limit') OR e LIKE '%429%' THEN 'rate limited — try again shortly'
    WHEN regexp_matches(e,'(?i)overloaded_error') OR e LIKE '%529%' THEN 'Claude API overloaded — try again shortly'
    WHEN regexp_matches(e,'(?i)authentication_error|invalid x-api-key') OR e LIKE '%401%' THEN 'invalid API key'
    WHEN regexp_matches(e,'(?i)permission_error') OR e LIKE '%403%' THEN 'permission denied — check API key'
    WHEN regexp_matches(e,'(?i)timeout|timed out') THEN 'request timed out' WHEN regexp_matches(e,'(?i)connection|network') THEN 'network error'
    ELSE left(string_split(e, chr(10))[1],150) END AS message FROM (SELECT job_id, {_MESSAGE_SQL} AS e FROM f_jobs)"""),
)
add(
    "logged_statement",
    lambda v: v.jobs.select("job_id", jobs.logged_statement(F.when(F.col("id") % 3 == 0, "no id here").otherwise(F.concat(F.lit("saved. Statement ID:  STMT-"), "id", F.lit("-199801 and Statement ID: STMT-0")))).alias("statement_id")),
    fixtures("SELECT job_id, CASE WHEN id%3<>0 THEN 'STMT-'||id||'-199801' END AS statement_id FROM f_jobs"),
)
add(
    "ai_activity",
    lambda v: jobs.ai_activity(v.jobs.select(
        F.concat(F.lit("STMT-"), F.col("id") % 50).alias("statement_id"), F.col("id").alias("audit_id"), F.col("submitted_at").alias("request_timestamp"),
        F.when(F.col("id") % 6 == 0, "ROW_SKIP").otherwise("EXTRACTION").alias("interaction_type"), (F.col("status") == "COMPLETED").alias("success"),
        F.when(F.col("id") % 5 != 0, "anthropic").alias("ai_provider"), F.when(F.col("id") % 7 == 0, "").otherwise("m").alias("model"),
        F.when(F.col("id") % 9 != 0, F.col("id") % 40 * 250).alias("latency_ms"))),
    fixtures("""SELECT statement_id, row_number() OVER (PARTITION BY statement_id ORDER BY submitted_at DESC, id) AS place, CASE WHEN id%6=0 THEN 'SKIP' WHEN status='COMPLETED' THEN 'OK' ELSE 'FAIL' END AS outcome,
    CASE WHEN id%6=0 THEN 'ROW_SKIP' ELSE 'EXTRACTION' END AS interaction_type, CASE WHEN id%5<>0 THEN 'anthropic' ELSE 'unknown' END AS provider,
    CASE WHEN id%7=0 THEN 'unknown' ELSE 'm' END AS model, CASE WHEN id%9<>0 AND id%40>0 THEN (t//10)||'.'||(t%10)||'s' ELSE 'N/A' END AS latency
    FROM (SELECT *, 'STMT-'||(id%50) AS statement_id, (id%40*25+5)//10 AS t FROM f_jobs)"""),
)
add("error_tail", lambda v: v.jobs.where("status = 'FAILED'").select("job_id", jobs.error_tail(F.concat_ws(" at ", "pdf_filename", "batch_id"), 20).alias("tail")),
    fixtures("SELECT job_id, right(concat_ws(' at ', pdf_filename, batch_id), 20) AS tail FROM f_jobs WHERE status='FAILED'"))
add(
    "error_class", lambda v: v.jobs.select("job_id", jobs.error_class(F.col("status") == "COMPLETED", _error()).alias("error_class")),
    fixtures(f"""SELECT job_id, CASE WHEN status='COMPLETED' THEN 'SUCCESS' WHEN e LIKE '%API key%' THEN 'MISSING_API_KEY' WHEN e LIKE '%timeout%' THEN 'TRANSPORT_ERROR'
    WHEN e LIKE '%JSON%' THEN 'PARSE_ERROR' WHEN e LIKE '%429%' THEN 'RATE_LIMITED' ELSE 'UNKNOWN_ERROR' END AS error_class FROM (SELECT *, {_ERROR_SQL} AS e FROM f_jobs)"""),
)
add(
    "cache_lookup",
    lambda v: jobs.cache_lookup(v.jobs.select(F.sha2("pdf_filename", 256).alias("document_hash"), (F.col("id") % 5).alias("row_count"), F.col("submitted_at").alias("cached_at"), "job_id")),
    fixtures("""SELECT document_hash, row_count, cached_at, job_id FROM (SELECT sha256(pdf_filename) AS document_hash, id%5 AS row_count, submitted_at AS cached_at, job_id,
    row_number() OVER (PARTITION BY pdf_filename ORDER BY submitted_at DESC, job_id DESC) AS k FROM f_jobs WHERE id%5>0) WHERE k=1"""),
)
add(
    "job_state", lambda v: jobs.fold_events(intake.status_events(v.jobs)),
    fixtures("SELECT job_id, status, completed_at FROM f_jobs"),
)
QUERIES, ORACLES = add.queries, add.oracles
