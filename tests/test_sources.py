"""Broken inputs, versions of tables, vouchers, and the event log."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.operators import matching
from tallyloom.sources import event_log, extraction_cache, inputs, tables, vouchers


def test_good_and_bad_documents_add_up(spark):
    good = '{"invoices": [{"invoice_number": "A", "amount": 1.5}], "vendor_metadata": {"vendor_name": "V"}}'
    texts = [good, good[:-4], "", None, "  ", "[1", "{}", '{"invoices": []}', '{"invoices": null}', "no json"]
    rows = inputs.parse_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id int, value string"))
    kept, quarantine = inputs.divide(rows)
    assert {r["doc_id"]: r["reason"] for r in quarantine.collect()} == {1: "MALFORMED", 2: "EMPTY", 3: "EMPTY", 4: "EMPTY", 5: "MALFORMED", 6: "NO_INVOICES", 8: "NO_INVOICES", 9: "MALFORMED"}
    found = {r["doc_id"]: [i["invoice_number"] for i in r["document"]["invoices"]] for r in kept.collect()}
    assert found == {0: ["A"], 7: []}


def test_files_are_read_and_broken_ones_set_aside(spark, tmp_path):
    whole = b"%PDF-1.7\n1 0 obj <</Type/Pages/Count 2>> <</Type /Page>>\n<</Type/Page >>\n\xff\xfe\n%%EOF\n"
    for name, content in {"a.pdf": whole, "b.pdf": b"\n", "c.pdf": b"PK\x03\x04", "sub/d.pdf": whole[:-6], "e.txt": whole}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    kept, quarantine = inputs.divide(inputs.inspect_files(inputs.read_files(spark, str(tmp_path))))
    assert {r["path"].rsplit("/", 1)[1]: r["page_count"] for r in kept.collect()} == {"a.pdf": 2}
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in quarantine.collect()} == {"b.pdf": "NOT_PDF", "c.pdf": "NOT_PDF", "d.pdf": "TRUNCATED"}


def test_a_file_of_no_version_is_an_error_of_the_plan(spark, tmp_path):
    old, new = StructType.fromDDL("a long"), StructType.fromDDL("a long, b string")
    spark.range(2).toDF("a").write.parquet(str(tmp_path / "old"))
    spark.range(2).select(F.lit("x").alias("b"), F.col("id").alias("a")).write.parquet(str(tmp_path / "new"))
    spark.range(2).select(F.col("id").cast("int").alias("a")).write.parquet(str(tmp_path / "typed"))
    spark.range(2).toDF("z").write.parquet(str(tmp_path / "other"))
    paths = [str(tmp_path / n) for n in ("old", "new")]
    assert sorted(map(tuple, inputs.read_versions(spark, paths, [old, new]).collect()), key=str) == sorted([(0, None), (1, None), (0, "x"), (1, "x")], key=str)
    for bad in ("typed", "other"):
        with pytest.raises(ValueError, match="columns"):
            inputs.read_versions(spark, [str(tmp_path / bad)], [old, new])
    with pytest.raises(ValueError, match="keep"):
        inputs.read_versions(spark, paths, [new, old])


def test_vouchers_come_back_and_are_replaced(spark, tmp_path):
    path = str(tmp_path / "v")

    def put(file, vendor, described, amount):
        summary = spark.createDataFrame([(0, vendor, "1/2/2025", None, "$1", file), (1, "second row", "x", None, None, file)], vouchers.SUMMARY)
        items = [(k, 1, "12/31/2024", d, None, None, None, a, file) for k, (d, a) in enumerate(zip(described, amount, strict=True))]
        vouchers.write_vouchers(summary, spark.createDataFrame(items, vouchers.ITEMS), path)

    put("one", " Acme, Inc ", ["Bill #A-1", "bill credit #B, \"2\"", "Payment", "Bill #"], ["$1,000.50", "-1,687.60", "5", "5"])
    put("two", "Other", ["Bill #C", "Bill #D", None], ["7", None, "9"])
    put("two", "Other", ["Bill #E"], ["8"])
    rows = vouchers.voucher_rows(*vouchers.read_vouchers(spark, path), {"ACME": ["Acme, Inc"]})
    found = sorted((r["statement_id"], r["invoice_number"], r["outstanding_amount"], r["invoice_date"], r["posting_date"], r["source_file"]) for r in rows.collect())
    assert found == [("VOUCHER-ACME", "A-1", 1000.5, "2024-12-31", "2025-01-02", "one"), ("VOUCHER-ACME", 'B, "2"', -1687.6, "2024-12-31", "2025-01-02", "one"),
                     ("VOUCHER-OTHER", "E", 8.0, "2024-12-31", "2025-01-02", "two")]


def test_both_sides_are_required(spark):
    lines = spark.createDataFrame([("A",), ("B",), ("B",)], "vendor_id string")
    ledger = spark.createDataFrame([("VOUCHER-A", "A"), ("S1", "B"), ("VOUCHER-A", "B")], "statement_id string, vendor_id string")
    scoped = vouchers.voucher_ledger(ledger)
    assert [r["vendor_id"] for r in scoped.collect()] == ["A"]
    vouchers.require_both_sides(lines, ledger)
    with pytest.raises(ValueError, match="1 vendors.*among them B"):
        vouchers.require_both_sides(lines, scoped)
    with pytest.raises(ValueError, match="no statement lines"):
        vouchers.require_both_sides(lines.limit(0), ledger)


def test_an_event_is_logged_once(spark, tmp_path):
    log, one, two = event_log.open_log(spark, str(tmp_path / "log")), datetime(2024, 1, 1), datetime(2024, 1, 2)
    events = [("INTAKE", "S1", "a.pdf", "x", one), ("INTAKE", "S1", "a.pdf", "x", two), ("ROW_SKIP", "S1", None, "x", one), ("ROW_SKIP", None, "S1", "x", one), ("ROW_SKIP", "S1", None, None, one)]
    frame = spark.createDataFrame(events, event_log.EVENT)
    assert event_log.append(log, frame) == 1 and event_log.append(log, frame) == 2
    event_log.append(log, spark.createDataFrame([("INTAKE", "S1", "a.pdf", "y", two)], event_log.EVENT))
    rows = log.read().collect()
    assert len(rows) == 5 and {(r["detail"], r["ts"]) for r in rows if r["kind"] == "INTAKE"} == {("x", one), ("y", two)}


def test_unknown_kinds_score_like_fuzzy_ones(spark):
    rows = spark.createDataFrame([("PO", "EXACT"), ("FUZZY", "MISMATCH"), (None, None), ("RO", "MISMATCH"), ("INVOICE", "MISMATCH")], "k string, s string")
    assert [r[0] for r in rows.select(matching.tier_confidence(F.col("k"), F.col("s"))).collect()] == [0.85, 0.6, 0.6, 0.6, 0.7]


def test_cache_entries_are_those_of_the_newest_batch(spark, tmp_path):
    schema = "document_hash string, statement_id string, ingestion_timestamp timestamp, source_file string, extraction_method string, row_count int, other int"
    cache = extraction_cache.open_cache(spark, str(tmp_path / "cache"))

    def rows(*found):
        return spark.createDataFrame([(h, s, datetime.fromisoformat(t), f, m, n, 0) for h, s, t, f, m, n in found], schema)

    first = rows(("h", "S1", "2024-01-01", "a", "x", 3), ("h", "S1", "2024-01-02", "b", "x", 2), ("h", "S2", "2024-01-01", "a", "x", 9), (None, "S1", "2024-01-01", "a", "x", 1))
    assert extraction_cache.write_entries(cache, first, 0)
    assert not extraction_cache.write_entries(cache, rows(("h", "S1", "2025-01-01", "z", "x", 7)), 0)  # the batch again
    assert extraction_cache.write_entries(cache, rows(("h", "S1", "2023-01-01", "c", "y", 0)), 1)
    found = {(r["document_hash"], r["statement_id"], r["source_file"], r["row_count"], r["batch"]) for r in extraction_cache.entries(cache).collect()}
    assert found == {("h", "S1", "c", 0, 1), ("h", "S2", "a", 9, 0)}
    assert extraction_cache.write_entries(cache, first.limit(0), 2) and extraction_cache.entries(cache).count() == 2


def test_copied_rows_follow_each_other_by_file(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), F.lit("x").alias("extra")).repartition(5).write.parquet(old)
    tables.copy_rows(spark, old, new, "id", ["id"])
    files = spark.read.parquet(new).groupBy(F.input_file_name().alias("f")).agg(F.min("id").alias("a"), F.max("id").alias("z")).orderBy("f").collect()
    assert spark.read.parquet(new).columns == ["id"] and spark.read.parquet(new).count() == 1000
    assert all(one["z"] < two["a"] for one, two in zip(files, files[1:], strict=False))


def test_scan_of_a_statement_opens_its_folder_only(spark, tmp_path):
    path = str(tmp_path / "lines")
    tables.replace_statements(spark.createDataFrame([(f"S{k % 9}", k) for k in range(90)], "statement_id string, n int"), path)
    found = tables.statement_rows(spark.read.parquet(path), "S4")
    assert sorted(r["n"] for r in found.collect()) == list(range(4, 90, 9))
    assert found.select(F.input_file_name().alias("f")).distinct().where("f not like '%statement_id=S4%'").isEmpty()
    assert "PartitionFilters: [isnotnull(statement_id" in found._jdf.queryExecution().toString()
    assert tables.statement_rows(spark.read.parquet(path), "S99").count() == 0
