"""Streaming intake: deliveries in any order, content seen before, replaced statements, one job in flight."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.plans.oracles import fixtures
from tallyloom.plans.register import Register
from tallyloom.plans.views import Views
from tallyloom.sources.commits import CommitTable, newest_of
from tallyloom.sources.tables import read_table
from tallyloom.streaming import intake, queue

add = Register()
_CREATED = "event_type IN ('purchase','click')"
_JOBS = f"""SELECT 'file_'||(event_id%400)||'.pdf' AS pdf_filename, 'BATCH-'||strftime(ts,'%Y%m%d') AS batch_id, count(*) AS n_events, min(event_id) AS first_id
    FROM events WHERE {_CREATED} GROUP BY ALL"""
add("stream_intake", lambda v: intake.run_once(v.spark, v.sf_dir), _JOBS)


def _taken(v: Views):
    """Events that came in five deliveries, the newest first."""
    return intake.run(v.spark, intake.newest_first(v.spark, v.sf_dir)).read()


add("stream_intake_newest_first", lambda v: intake.intake_jobs(_taken(v)), _JOBS)
_DELIVERED = """e AS (SELECT *, 4 - least(4, (epoch_us(ts)-a)*5//greatest(1,z-a)) AS d FROM events, (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM events)),
    c AS (SELECT * FROM e WHERE event_type IN ('purchase','click'))"""
add(
    "intake_late",
    lambda v: _taken(v).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if("late").alias("late"), F.count("*").alias("n_events")),
    f"""WITH {_DELIVERED} SELECT strftime(ts,'%Y-%m-%d') AS day, count(*) FILTER (d > 0 AND ts < (SELECT max(ts) FROM c) - INTERVAL 2 DAY) AS late, count(*) AS n_events FROM c GROUP BY 1""",
)
add(
    "intake_batches",
    lambda v: _taken(v).groupBy("batch_id").agg(F.count("*").alias("n_events"), F.min("id").alias("least_id"), F.max("id").alias("greatest_id")),
    f"""WITH {_DELIVERED} SELECT 'DELIVERY-'||lpad(CAST(d AS VARCHAR),6,'0')||'-'||lpad(CAST(k//100 AS VARCHAR),5,'0') AS batch_id, count(*) AS n_events, min(event_id) AS least_id, max(event_id) AS greatest_id
    FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ts, event_id)-1 AS k FROM c) GROUP BY 1""",
)


def _documents(v: Views):
    """Every document, in four deliveries by descending id."""
    docs = read_table(v.spark, v.sf_dir, "documents")
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    rows = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.timestamp_seconds("doc_id").alias("ts"), F.col("doc_id").cast("string").alias("name"), F.col("doc_id").alias("k"))
    path = intake.deliver(rows, 3 - F.expr(f"k * 4 div {top + 1}"), 4, intake.scratch(v.spark, "documents"))
    stream = v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = intake.document_table(v.spark, intake.scratch(v.spark, "known"))
    intake.start(stream, intake.write_documents(found), intake.scratch(v.spark, "documents-state")).awaitTermination()
    return found.read()


add(
    "stream_documents_once", lambda v: _documents(v).select("content_hash", F.col("name").cast("long").alias("doc_id"), F.col("batch").alias("delivery")),
    """SELECT content_hash, doc_id, delivery FROM (SELECT sha256(coalesce(text,'')) AS content_hash, doc_id, 3 - doc_id*4//((SELECT max(doc_id) FROM documents)+1) AS delivery FROM documents)
    QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY delivery, doc_id)=1""",
)


def _replaced(v: Views):
    """All lines, then the lines of even months again with other amounts and without every seventh; the second delivery comes twice."""
    rows = v.lines.select("statement_id", "seq", F.col("outstanding_amount").cast("double").alias("amount"))
    again = rows.where("cast(right(statement_id, 1) as int) % 2 = 0 and seq % 7 > 0").withColumn("amount", F.col("amount") + 1)
    table = CommitTable(v.spark, intake.scratch(v.spark, "statements"), rows.schema)
    for batch, part in ((0, rows), (1, again), (1, again)):
        table.commit(part, batch)
    return newest_of(table.read(), "statement_id")


add(
    "statement_replace", lambda v: _replaced(v).select("statement_id", "seq", F.round("amount", 2).alias("amount"), "batch"),
    fixtures("""SELECT statement_id, seq, round(CAST(outstanding_amount AS DOUBLE)+b, 2) AS amount, CAST(b AS BIGINT) AS batch FROM
    (SELECT *, CASE WHEN CAST(right(statement_id,1) AS INT)%2=0 AND max(seq%7) OVER (PARTITION BY statement_id)>0 THEN 1 ELSE 0 END AS b FROM f_stmt) WHERE b=0 OR seq%7>0"""),
)


def _queued(v: Views):
    """Submissions and ends of all jobs in three deliveries by time, and a tick for every file at the end."""
    jobs = v.jobs.select("job_id", "pdf_filename", "submitted_at", F.col("id").alias("seq"), (F.unix_seconds("completed_at") - F.unix_seconds("submitted_at")).alias("seconds"))
    events = queue.finished(jobs)
    span = events.agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("z")).first()
    tick = events.groupBy("pdf_filename").agg(F.timestamp_micros(F.lit(span["z"] + 10**13)).alias("ts")).select(
        "ts", "pdf_filename", F.lit(None).cast("string").alias("job_id"), F.lit("TICK").alias("kind"), F.lit(0).cast("long").alias("seq"))
    number = F.least(F.lit(2), F.expr(f"(unix_micros(ts) - {span['a']}) * 3 div {max(1, span['z'] - span['a'])}"))
    path = intake.deliver(events.unionByName(tick), number, 3, intake.scratch(v.spark, "queue"))
    stream = v.spark.readStream.schema(tick.schema).option("maxFilesPerTrigger", 1).parquet(path)
    table = CommitTable(v.spark, intake.scratch(v.spark, "claims"), queue.CLAIMS)
    intake.start(queue.claims(stream), lambda rows, micro: table.commit(rows, micro) and None, intake.scratch(v.spark, "queue-state")).awaitTermination()
    return table.read()


add(
    "stream_queue", lambda v: _queued(v).drop("batch"),
    fixtures("""SELECT pdf_filename, job_id, event, CAST(CASE event WHEN 'CLAIMED' THEN fin-took ELSE fin END AS BIGINT) AS at FROM (
      SELECT *, total + max(epoch_us(submitted_at)-(total-took)) OVER w AS fin FROM (
        SELECT *, sum(took) OVER (PARTITION BY pdf_filename ORDER BY submitted_at, id ROWS UNBOUNDED PRECEDING) AS total FROM (
          SELECT *, least(coalesce(CAST(floor(epoch(completed_at)) AS BIGINT)-CAST(floor(epoch(submitted_at)) AS BIGINT),1800),1800)*1000000 AS took FROM f_jobs))
      WINDOW w AS (PARTITION BY pdf_filename ORDER BY submitted_at, id ROWS UNBOUNDED PRECEDING)),
      LATERAL (SELECT unnest(['CLAIMED', CASE WHEN took<1800000000 THEN 'ENDED' ELSE 'TIMED_OUT' END]) AS event)"""),
)
QUERIES, ORACLES = add.queries, add.oracles
