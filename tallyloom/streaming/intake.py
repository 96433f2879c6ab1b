"""Arrival of documents as a stream of events, and the event log of jobs.

Deliveries are files of events. Every micro-batch is one delivery: its created-file
events are numbered by time and named in batches of at most ``DELIVERY_LIMIT``, and go
to a commit table under the micro-batch's number. Nothing is dropped by the order of
arrival: an event that comes more than ``LATENESS`` behind the newest time of earlier
deliveries is marked late and counts all the same, since jobs by file and day are
summed when the table is read.

Documents that arrive again under another name, however much later, have a content
hash that an earlier commit holds; they are left out by a join with those commits.
A delivery that is replayed after a failure changes neither table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.numbering import number_rows
from tallyloom.sources.commits import CommitTable
from tallyloom.sources.tables import read_table, shared_dir

#: Event types that stand for an uploaded file.
CREATED = ("purchase", "click")
#: Most events of one named batch, and how far behind the newest event one may be without being late.
DELIVERY_LIMIT, LATENESS = 100, "2 days"
#: The trigger of a running intake.
POLL = "30 seconds"

_EVENTS = "ts timestamp, id long, pdf_filename string, batch_id string, late boolean"
_DOCUMENTS = "content_hash string, ts timestamp, name string"


def arrivals(events: DataFrame) -> DataFrame:
    """Created-file events with their file name; works on batches and streams."""
    created = events.where(F.col("event_type").isin(*CREATED))
    return created.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"),
        F.concat(F.lit("file_"), F.col("event_id") % 400, F.lit(".pdf")).alias("pdf_filename"),
    )


def start(stream: DataFrame, write, checkpoint: str, poll: str | None = None) -> StreamingQuery:
    """The stream written by micro-batch: all that is there and no more, or every ``poll`` until stopped."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def event_table(spark: SparkSession, path: str) -> CommitTable:
    return CommitTable(spark, path, _EVENTS)


def write_events(table: CommitTable):
    """foreachBatch function: one delivery of events into ``table``."""

    def write(events: DataFrame, micro: int) -> None:
        if table.has(micro):
            return
        newest = table.high(micro)
        behind = F.lit(False) if newest is None else F.col("ts") < F.lit(newest) - F.expr(f"interval {LATENESS}")
        numbered = number_rows(arrivals(events), ["ts", "id"])
        name = F.format_string("DELIVERY-%06d-%05d", F.lit(micro), F.floor(F.col("place") / DELIVERY_LIMIT).cast("long"))
        table.commit(numbered.withColumns({"batch_id": name, "late": F.coalesce(behind, F.lit(False))}), micro, high="ts")

    return write


def intake_jobs(taken: DataFrame) -> DataFrame:
    """One job per file and day, with its number of events and the first one's id."""
    day = F.concat(F.lit("BATCH-"), F.date_format("ts", "yyyyMMdd")).alias("batch_id")
    return taken.groupBy("pdf_filename", day).agg(F.count("*").alias("n_events"), F.min("id").alias("first_id"))


def document_table(spark: SparkSession, path: str) -> CommitTable:
    return CommitTable(spark, path, _DOCUMENTS)


def write_documents(table: CommitTable):
    """foreachBatch function: of each content the first document that ever came, into ``table``.

    The micro-batch's number is part of the key: hashes of its own earlier attempt do not hide it.
    """

    def write(documents: DataFrame, micro: int) -> None:
        first = documents.groupBy("content_hash").agg(F.min(F.struct("ts", "name")).alias("f")).select("content_hash", "f.*")
        table.commit(first.join(table.read(before=micro).select("content_hash"), "content_hash", "left_anti"), micro)

    return write


def deliver(rows: DataFrame, number: Column, count: int, path: str) -> str:
    """Writes ``rows`` as ``count`` deliveries, one after the other, by their ``number`` from 0; the folder of the files."""
    for k in range(count):
        rows.where(number == k).coalesce(1).write.mode("append").parquet(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallyloom-{name}-{uuid.uuid4().hex}"


def run_once(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """Takes in every delivery that has arrived and returns the jobs by file and day."""
    source = read_table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files_per_trigger)
    one_file = source.inputFiles()[:1]
    if one_file and one_file[0].endswith("/events.parquet"):
        stream = stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        stream = stream.parquet(f"{sf_dir}/events.parquet")
    return intake_jobs(run(spark, stream).read())


def run(spark: SparkSession, stream: DataFrame) -> CommitTable:
    """All of ``stream`` taken into a new event table."""
    table = event_table(spark, scratch(spark, "events"))
    start(stream, write_events(table), scratch(spark, "events-state")).awaitTermination()
    return table


def newest_first(spark: SparkSession, sf_dir: str, count: int = 5) -> DataFrame:
    """The events of a folder as a stream of ``count`` deliveries, the newest time span first."""
    events = read_table(spark, sf_dir, "events")
    span = events.agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("a"), F.unix_micros(F.max("ts").cast("timestamp")).alias("z")).first()
    number = count - 1 - F.least(F.lit(count - 1), F.expr(f"(unix_micros(cast(ts as timestamp)) - {span['a']}) * {count} div {max(1, span['z'] - span['a'])}"))
    path = deliver(events, number, count, scratch(spark, "deliveries"))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def status_events(jobs: DataFrame) -> DataFrame:
    """The event log behind a queue: submitted, taken up, ended."""
    submitted = jobs.select("job_id", F.col("submitted_at").alias("ts"), F.lit(0).alias("event_seq"), F.lit("PENDING").alias("status"), F.lit(None).cast("timestamp").alias("completed_at"))
    taken = jobs.where("status <> 'PENDING'").select("job_id", F.col("submitted_at").alias("ts"), F.lit(1).alias("event_seq"), F.lit("PROCESSING").alias("status"), F.lit(None).cast("timestamp").alias("completed_at"))
    ended = jobs.where("status in ('COMPLETED', 'FAILED')").select("job_id", F.col("completed_at").alias("ts"), F.lit(2).alias("event_seq"), "status", "completed_at")
    return submitted.unionByName(taken).unionByName(ended)
