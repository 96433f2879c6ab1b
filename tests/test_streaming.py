"""Deliveries in any order, replays, restarts, and the queue of one job in flight against a sequential walk."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.numbering import number_rows
from tallyloom.sources.commits import CommitTable, newest_of
from tallyloom.streaming import intake, queue

EVENTS = "event_id long, user_id long, event_type string, value double, ts timestamp"
DAY = datetime(2024, 1, 1, 10)


def event(k, at, kind="click"):
    return k, 0, kind, 0.0, at


def test_numbers_are_gapless_by_order(spark):
    rows = spark.createDataFrame([(k * 37 % 1000, None if k % 5 == 0 else "x") for k in range(1000)], "k int, t string").repartition(7)
    found = [(r["place"], r["k"]) for r in number_rows(rows, ["k"]).collect()]
    assert sorted(found) == [(k, k) for k in range(1000)]
    assert number_rows(rows.limit(0), ["k"]).count() == 0


def test_an_unlisted_folder_is_not_read_and_a_batch_is_written_once(spark, tmp_path):
    table = CommitTable(spark, str(tmp_path / "t"), "id long, ts timestamp")
    one = spark.createDataFrame([(1, DAY), (2, DAY + timedelta(days=1))], "id long, ts timestamp")
    assert table.read().count() == 0 and table.high(9) is None
    one.withColumn("batch", F.lit(0).cast("long")).write.parquet(f"{table.path}/data/0-killed")  # the writer died before it listed the folder
    assert table.read().count() == 0
    assert table.commit(one, 0, high="ts") and not table.commit(one.withColumn("id", F.col("id") + 10), 0)
    again = CommitTable(spark, str(tmp_path / "t"), "id long, ts timestamp")
    assert not again.commit(one, 0) and again.commit(one.limit(0), 1)
    assert sorted(r["id"] for r in again.read().collect()) == [1, 2]
    assert again.high(1) == DAY + timedelta(days=1) and again.read(before=0).count() == 0


def test_a_broken_commit_fails_before_it_is_listed(spark, tmp_path):
    table = CommitTable(spark, str(tmp_path / "t"), "id long")
    broken = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        table.commit(broken, 0)
    assert table.read().count() == 0 and table.commit(spark.range(5), 0) and table.read().count() == 5


def test_newest_batch_of_a_key_replaces_it(spark, tmp_path):
    table = CommitTable(spark, str(tmp_path / "t"), "s string, v int")
    for batch, rows in enumerate(([("a", 1), ("a", 2), ("b", 3)], [("a", 4)], [("c", 5)])):
        table.commit(spark.createDataFrame(rows, "s string, v int"), batch)
    assert sorted((r["s"], r["v"]) for r in newest_of(table.read(), "s").collect()) == [("a", 4), ("b", 3), ("c", 5)]


def test_deliveries_in_any_order_lose_nothing(spark, tmp_path):
    """Ten days late, repeated within a day, restarted after each delivery, and one delivery replayed."""
    deliveries = [
        [event(1, DAY + timedelta(days=12)), event(2, DAY, "view")], [event(1, DAY), event(401, DAY + timedelta(hours=1))],
        [event(2, DAY + timedelta(days=11))], [event(801, DAY + timedelta(hours=2)), event(None, None)],
    ]
    table = intake.event_table(spark, str(tmp_path / "t"))
    for k, rows in enumerate(deliveries):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"d{k}"))
        stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        intake.start(stream, intake.write_events(table), str(tmp_path / "state")).awaitTermination()
    intake.write_events(table)(spark.createDataFrame(deliveries[1], EVENTS), 1)
    rows = {(r["id"], r["ts"]): (r["late"], r["batch_id"]) for r in table.read().collect()}
    late = {k for k, (is_late, _) in rows.items() if is_late}
    assert len(rows) == 6 and late == {(1, DAY), (401, DAY + timedelta(hours=1)), (801, DAY + timedelta(hours=2))}
    assert {b for _, b in rows.values()} == {f"DELIVERY-00000{k}-00000" for k in range(4)}
    jobs = {(r["pdf_filename"], r["batch_id"]): (r["n_events"], r["first_id"]) for r in intake.intake_jobs(table.read()).collect()}
    assert jobs[("file_1.pdf", "BATCH-20240101")] == (3, 1) and jobs[("file_2.pdf", "BATCH-20240112")] == (1, 2)


def test_content_seen_in_an_earlier_delivery_is_left_out_for_ever(spark, tmp_path):
    table = intake.document_table(spark, str(tmp_path / "t"))
    write, schema = intake.write_documents(table), "ts timestamp, content_hash string, name string"
    parts = [[(DAY, "h", "b"), (DAY, "h", "a"), (DAY, None, "n")], [(DAY + timedelta(days=400), "h", "c"), (DAY + timedelta(days=400), "g", "d")], [(DAY - timedelta(days=9), "g", "e")]]
    for micro, rows in enumerate(parts):
        frame = spark.createDataFrame(rows, schema)
        write(frame, micro)
        write(frame, micro)  # a replay
    assert sorted((r["content_hash"] or "", r["name"], r["batch"]) for r in table.read().collect()) == [("", "n", 0), ("g", "d", 1), ("h", "a", 0)]


LIMIT = 100


def sequential(events):
    """Plain walk over all events of all files, in order of arrival: (file, job, event, second)."""
    files, out = {}, []
    for at, file, kind, job in events:
        f = files.setdefault(file, {"run": None, "since": 0, "wait": [], "now": 0})
        f["now"] = max(f["now"], at)

        def clear(f, file, event, when):
            out.append((file, f["run"], event, when))
            f["run"] = None
            if f["wait"]:
                f["run"], f["since"] = f["wait"].pop(0), when
                out.append((file, f["run"], "CLAIMED", when))

        if kind == "END" and f["run"] == job and job is not None and f["now"] <= f["since"] + LIMIT:
            clear(f, file, "ENDED", f["now"])
            continue
        while f["run"] is not None and f["since"] + LIMIT <= f["now"]:
            clear(f, file, "TIMED_OUT", f["since"] + LIMIT)
        if kind == "SUBMIT" and job != f["run"] and job not in f["wait"]:
            if f["run"] is None:
                f["run"], f["since"] = job, f["now"]
                out.append((file, job, "CLAIMED", f["now"]))
            else:
                f["wait"].append(job)
    return sorted(out)


def test_queue_equals_a_sequential_walk_over_restarts(spark, tmp_path):
    rng, events, at = random.Random(4), [], 0
    for k in range(240):
        at += rng.randrange(25)
        file = f"f{rng.randrange(4)}"
        job = f"{file}-{rng.randrange(40)}"
        events.append((at, file, rng.choice(["SUBMIT", "SUBMIT", "END"]), job))
    events += [(at + 100_000, f"f{k}", "TICK", None) for k in range(4)]
    table = CommitTable(spark, str(tmp_path / "claims"), queue.CLAIMS)
    schema = "ts timestamp, pdf_filename string, job_id string, kind string, seq long"
    for part in range(3):  # a new query for each delivery, from the state of the last
        rows = [(datetime(2024, 1, 1) + timedelta(seconds=a), f, j, kind, n) for n, (a, f, kind, j) in enumerate(events) if n * 3 // len(events) == part]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"d{part}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        intake.start(queue.claims(stream, LIMIT), lambda rows, micro: table.commit(rows, micro) and None, str(tmp_path / "state")).awaitTermination()
    zero = int((datetime(2024, 1, 1) - datetime(1970, 1, 1)).total_seconds())
    found = sorted((r["pdf_filename"], r["job_id"], r["event"], r["at"] // 1_000_000 - zero) for r in table.read().collect())
    assert found == sequential(events) and {e for _, _, e, _ in found} == {"CLAIMED", "ENDED", "TIMED_OUT"}


def test_the_end_of_a_job_that_a_time_limit_has_let_in_counts():
    """No event lies between the limit of the first job and the end of the second; a third ends at its limit."""
    walk = queue.Walk(None, 0, 0, [], LIMIT)
    for at, kind, job in [(0, "SUBMIT", "a"), (5, "SUBMIT", "b"), (6, "SUBMIT", "c"), (130, "END", "b"), (230, "END", "c")]:
        walk.take(kind, job, at)
    assert walk.out == [("a", "CLAIMED", 0), ("a", "TIMED_OUT", 100), ("b", "CLAIMED", 100), ("b", "ENDED", 130), ("c", "CLAIMED", 130), ("c", "ENDED", 230)]
