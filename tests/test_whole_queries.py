"""Queries over all rows, and the operators' rules for ties, against literals and brute force."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from tallyloom.operators import extraction, quality
from tallyloom.plans import registry, report_queries
from tallyloom.plans.views import Views
from tallyloom.sources import fixtures
from tallyloom.sources.tables import read_table


def test_ties_of_headers_go_by_text(spark):
    heads = spark.createDataFrame([(1, 0, "Ref"), (1, 0, "Invoice #"), (1, 0, "Amount"), (1, 0, "amount "), (1, 1, "Amount")], "doc_id long, pos int, header string")
    for frame in (heads, heads.orderBy(F.desc("header"))):
        b = {r["field"]: (r["header"], r["pos"]) for r in extraction.map_columns_b(frame.coalesce(1)).collect()}
        assert b == {"invoice_number": ("Invoice #", 0), "amount": ("Amount", 0)}
        assert ("Amount", 0) in {(r["header"], r["pos"]) for r in extraction.map_columns_a(frame.coalesce(1)).collect()}


def test_a_grid_row_holds_several_cells_and_ties_go_by_text(spark):
    cells = [(1, 0, 0, 1, 3, "b"), (1, 0, 0, 1, 3, "a"), (1, 0, 2, 1, 3, "c"), (1, 0, 3, 1, 3, "out")]
    found = extraction.cells_to_grid(spark.createDataFrame(cells, "table_id long, row_index int, column_index int, n_rows int, n_columns int, content string"))
    assert found.first()["cells"] == ["a", "", "c"]


def test_grid_of_all_line_items(spark, sf_dir):
    want = {}
    for r in read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").collect():
        c, place = r["l_partkey"] % 4, (r["l_orderkey"], r["l_linenumber"] - 1)
        if c < 3 and place[1] < 5:
            row = want.setdefault(place, ["", "", ""])
            row[c] = min(filter(None, (row[c], str(r["l_partkey"]))))
    found = {(r["table_id"], r["row_index"]): r["cells"] for r in registry.QUERIES["cells_to_grid"](spark, sf_dir).collect()}
    assert found == {k: "|".join(v) for k, v in want.items()}
    assert any(sum(map(bool, v)) > 1 for v in want.values())


def test_every_word_is_in_a_column_and_in_a_row(spark):
    path = "/root/testdata/sf0.01"  # sf0.001 may have no two words at one place
    n = read_table(spark, path, "lineitem").count()
    for name in ("bucket_columns", "row_cluster"):
        words = registry.QUERIES[name](spark, path).agg(F.sum(F.size(F.split("text", " ")))).first()[0]
        assert words == n, name


def _written(frame):
    """Names of the written tables that ``frame`` reads, and its other files."""
    folders = [path.split("/")[-2] for path in frame.inputFiles()]
    tables = {f.removeprefix("tallyloom-").rsplit("-", 1)[0] for f in folders if f.startswith("tallyloom-")}
    return tables, [f for f in folders if not f.startswith("tallyloom-")]


def test_exceptions_and_their_events_read_what_was_raised_once(spark, sf_dir):
    assert _written(Views(spark, sf_dir).exceptions) == ({"raised"}, [])


def test_skipped_rows_are_those_of_the_routing(spark, sf_dir):
    views = Views(spark, sf_dir)
    one, other = quality.skipped(views.raw), views.routed.where("route = 'SKIPPED'").select(*quality.skipped(views.raw).columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect())) and not one.isEmpty()


def test_open_lists_read_lines_of_their_reason_from_the_decisions(spark, sf_dir):
    for name in ("open_exceptions", "open_exceptions_missing", "open_exceptions_mismatch"):
        assert _written(report_queries.add.builds[name](Views(spark, sf_dir))) == ({"raised", "decisions"}, []), name


def test_all_runs_count_what_is_open_now(spark, sf_dir):
    views = Views(spark, sf_dir)
    written = {r["statement_id"]: r["exception_count"] for r in views.all_summaries.collect()}
    unusable = fixtures.base(spark, sf_dir).where("okey % 30 in (0, 1)").selectExpr("statement_id", "okey * 2 as seq")  # no number, no amount
    raised = views.decisions.where("status = 'EXCEPTION'").select("statement_id", "seq").unionAll(unusable)
    still_open = Counter(r["statement_id"] for r in raised.collect() if r["seq"] % 7)
    want = {k: (still_open[k], "EXCEPTIONS_PRESENT" if still_open[k] else "RECONCILED") for k in written}
    found = report_queries.add.builds["all_runs"](views).collect()
    assert len(found) == len(want) and {r["statement_id"]: (r["exception_count"], r["overall_status"]) for r in found} == want
    assert any(still_open[k] > n for k, n in written.items()) and any(still_open[k] < n for k, n in written.items())
