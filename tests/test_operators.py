"""Literal cases of the rules that are easy to get wrong, and of operators that SQL cannot say."""

from __future__ import annotations

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import amounts
from tallyloom.operators import extraction, matching, medallion
from tallyloom.sources import tables

LINES = "statement_id string, vendor_id string, statement_period string, invoice_number string, ro_number string, outstanding_amount decimal(18,2), seq long"
LEDGER = "vendor_id string, invoice_number string, ro_number string, outstanding_amount decimal(18,2), erp_seq long"


def _money(x):
    return None if x is None else Decimal(x)


def match(spark, lines, ledger):
    lines = [("S", "V", "2026-07", inv, ro, _money(a), k) for k, (inv, ro, a) in enumerate(lines)]
    ledger = [("V", inv, ro, _money(a), k) for k, (inv, ro, a) in enumerate(ledger)]
    found = matching.match(spark.createDataFrame(lines, LINES), spark.createDataFrame(ledger, LEDGER))
    return [(r["status"], r["level"], r["reason"], r["erp_seq"]) for r in found.orderBy("seq").collect()]


def test_invoice_level_shuts_out_the_second_level(spark):
    found = match(spark, [("A", "R", "100.00")], [("A", None, "200.00"), ("B", "R", "100.00")])
    assert found == [("EXCEPTION", None, "Amount Mismatch", None)]


def test_second_level_needs_the_amount(spark):
    assert match(spark, [("A", "R", "100.00")], [("B", "R", "150.00"), ("C", "R", "100.40")]) == [("MATCHED", 2, None, 1)]


def test_a_ledger_row_serves_one_line_only(spark):
    found = match(spark, [("A", None, "100.00"), ("A", None, "100.20")], [("A", None, "100.10")])
    assert found == [("MATCHED", 1, None, 0), ("EXCEPTION", None, "Invoice Missing", None)]


@pytest.mark.parametrize("stmt,erp,ok", [("100.00", "100.50", True), ("100.00", "101.00", True), ("100.00", "101.01", False), ("0.00", "0.50", True), ("0.00", "0.51", False), ("-10.00", "-10.60", False)])
def test_tolerance_is_either_or(spark, stmt, erp, ok):
    assert match(spark, [("A", None, stmt)], [("A", None, erp)])[0][0] == ("MATCHED" if ok else "EXCEPTION")


def sequential(lines, ledger):
    used, out = set(), []
    near = lambda s, e: abs(s - e) <= 50 or abs(s - e) * 100 <= abs(s)  # noqa: E731  in cents
    for inv, ro, a in lines:
        free = [(k, e) for k, e in enumerate(ledger) if k not in used]
        first = [(k, e) for k, e in free if e[0] == inv]
        level, pool = (1, first) if first else (2, [(k, e) for k, e in free if ro is not None and e[1] == ro])
        hit = next((k for k, e in pool if near(a, e[2])), None)
        if hit is not None:
            used.add(hit)
            out.append(("MATCHED", level, None, hit))
        else:
            out.append(("EXCEPTION", None, "Amount Mismatch" if first else "Invoice Missing", None))
    return out


_SIDE = st.lists(st.tuples(st.sampled_from("ABC"), st.sampled_from(["R", "Q", None]), st.integers(9_900, 10_200)), min_size=1, max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_SIDE, _SIDE)
def test_matching_equals_a_sequential_walk(spark, lines, ledger):
    cents = lambda side: [(i, r, f"{a / 100:.2f}") for i, r, a in side]
    assert match(spark, cents(lines), cents(ledger)) == sequential(lines, ledger)


def test_zero_is_falsy(spark):
    row = spark.range(1).select(medallion.falsy_zero(F.lit("0.00").cast("decimal(18,2)"), F.lit("5.00").cast("decimal(18,2)")).alias("x"))
    assert float(row.first()["x"]) == 5.0


@pytest.mark.parametrize("text,a,b,c,d", [
    ("$1,234.56", 1234.56, 1234.56, 1234.56, None), ("(100.00)", -100.0, 100.0, None, None), ("100.00-", -100.0, None, None, None),
    ("", None, None, None, None), ("12.5", 12.5, 12.5, 12.5, 12.5), (None, None, None, None, None)])
def test_amount_parsers(spark, text, a, b, c, d):
    t = F.lit(text).cast("string")
    assert tuple(spark.range(1).select(*(f(t) for f in (amounts.parse_a, amounts.parse_b, amounts.parse_c, amounts.parse_d))).first()) == (a, b, c, d)


def test_salvage_of_broken_json():
    whole = '{"rows": [{"a": "x } \\" y"}, {"b": [1, {"c": 2}]}, {"d": "cut'
    assert extraction.salvage_objects(whole) == ['{"a": "x } \\" y"}', '{"b": [1, {"c": 2}]}']
    assert extraction.salvage_objects(None) == extraction.salvage_objects("{}") == []


def test_pseudo_table(spark):
    text = "Invoice  Date   Amount\n\n  A1 12/31/2025 5.00 \nsingle\n"
    row = spark.range(1).select(extraction.pseudo_table(F.lit(text)).alias("x")).first()["x"]
    assert row == [["Invoice", "Date", "Amount"], ["A1", "12/31/2025", "5.00"], ["single"]]


def test_row_clusters_follow_the_running_mean(spark):
    words = spark.createDataFrame([(1, 0.0, 10.0, "a"), (1, 2.0, 10.9, "c"), (1, 1.0, 11.4, "b"), (1, 0.0, 20.0, "d")], "page_id long, x double, y double, text string")
    found = [(r["row_no"], r["text"]) for r in extraction.row_clusters(words, 1.0).orderBy("row_no").collect()]
    assert found == [(0, "a b c"), (1, "d")]


def test_replace_and_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_statements(spark.createDataFrame([("S1", 1), ("S2", 2)], "statement_id string, n int"), path)
    tables.replace_statements(spark.createDataFrame([("S2", 3)], "statement_id string, n int"), path)
    current = spark.read.parquet(path).select("statement_id", "n")
    assert {tuple(r) for r in current.collect()} == {("S1", 1), ("S2", 3)}
    changes = spark.createDataFrame([("S1", 7, 1), ("S1", 8, 2), ("S3", 9, 1)], "statement_id string, n int, seq int")
    merged = tables.upsert(current.withColumn("seq", F.lit(0)), changes, ["statement_id"], "seq")
    assert {(r["statement_id"], r["n"]) for r in merged.collect()} == {("S1", 8), ("S2", 3), ("S3", 9)}


def test_numbers_meet_by_the_normalised_form(spark):
    assert match(spark, [("A", None, "100.00")], [("A", None, "100.00")]) == [("MATCHED", 1, None, 0)]
    lines = spark.createDataFrame([("S", "V", "2026-07", " A ", None, _money("100.00"), 0, "A"), ("S", "V", "2026-07", "B", None, _money("5.00"), 1, ""), ("S", "V", "2026-07", "C", None, _money("5.00"), 2, None)],
                                  LINES + ", invoice_number_normalized string")
    ledger = spark.createDataFrame([("V", "A", None, _money("100.00"), 7), ("V", "B", None, _money("5.00"), 8)], LEDGER)
    assert [(r["status"], r["erp_seq"]) for r in matching.match(lines, ledger).orderBy("seq").collect()] == [("MATCHED", 7), ("MATCHED", 8), ("EXCEPTION", None)]


def test_match_equals_the_whole_fold(spark):
    """Lines pushed to level 2 by other lines' level-2 edges, over several statements."""
    import random

    rng, lines, ledger = random.Random(3), [], []
    for s in range(12):
        for k in range(25):
            lines.append((f"S{s}", "V", "2026-07", rng.choice("ABCDEFGHIJKLMNOPQ"), rng.choice(["R", "T", None]), _money(f"{rng.randrange(95, 105)}.00"), k))
    for k in range(60):
        ledger.append(("V", rng.choice("ABCDEFGHIJKLMNOPQXYZ"), rng.choice(["R", "T", None]), _money(f"{rng.randrange(95, 105)}.00"), k))
    lines, ledger = spark.createDataFrame(lines, LINES), spark.createDataFrame(ledger, LEDGER)
    columns = ["statement_id", "seq", "status", "level", "reason", "erp_seq", "erp_amount"]
    one, other = (sorted(map(tuple, f(lines, ledger).select(*columns).collect()), key=str) for f in (matching.match, matching.fold_all))
    assert one == other and {r[3] for r in one} == {1, 2, None}
    for frames in ((lines.limit(0), ledger), (lines, ledger.limit(0))):
        assert {r["status"] for r in matching.match(*frames).collect()} <= {"EXCEPTION"}


def test_components_join_what_contested_rows_connect(spark):
    """Random bipartite edges: every component is one group, and nothing else shares its group."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(8)
    edges = [(f"S{rng.randrange(9)}", rng.randrange(80), rng.randrange(70)) for _ in range(480)]
    label, lines_of = {}, {}
    for s, line, row in edges:  # union by renaming
        lines_of.setdefault((s, row), set()).add(line)
        a, b = label.setdefault((s, "l", line), (s, "l", line)), label.setdefault((s, "r", row), (s, "r", row))
        if a != b:
            label = {k: a if v == b else v for k, v in label.items()}
    frame = spark.createDataFrame([*edges, ("S9", 1, 1)], "statement_id string, seq long, erp_seq long")
    found = {(r["statement_id"], r["seq"]): r["component"] for r in matching.components(frame).collect()}
    want = {(s, line): label[s, "l", line] for s, line, row in edges if len(lines_of[s, row]) > 1}
    assert found.keys() == want.keys()
    pairs = {(found[k], want[k]) for k in found}
    assert len(pairs) == len(set(found.values())) == len(set(want.values())) > 20
    assert matching.components(frame.where(F.lit(False))).count() == 0


def test_salvage_goes_on_behind_a_bad_element():
    assert extraction.salvage_objects('{"rows": [{"a": 1}, {bad: 2}, null, {"b": 3}], "x": [{"c": 4}]}') == ['{"a": 1}', '{"b": 3}']
    assert extraction.salvage_objects('{"rows": [{"a": "} ]"}, {"b": {"c": 1}}, {"d"') == ['{"a": "} ]"}', '{"b": {"c": 1}}']


def test_tables_of_the_search_grow_with_lines_and_rows(spark, monkeypatch):
    """Every line is near to every ledger row: pairs go with the square, tables must not."""
    n, sizes = 200, []
    lines = spark.createDataFrame([(f"S{k % 5}", "V", "2026-07", f"L{k}", "R", _money("100.00"), k) for k in range(n)], LINES)
    ledger = spark.createDataFrame([("V", f"E{k}", "R", _money("100.10"), k) for k in range(n)], LEDGER)

    def counted(df, name):
        sizes.append(df.count())
        return tables.settle(df, name)

    monkeypatch.setattr(matching, "settle", counted)
    found = matching.match(lines, ledger).orderBy("seq").collect()
    assert [r["erp_seq"] for r in found] == [k // 5 for k in range(n)]
    assert max(sizes) <= 2 * n


@pytest.mark.parametrize("numbers,block", [("AB", 100_000), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 20)])
def test_trees_and_blocks_equal_the_whole_fold(spark, monkeypatch, numbers, block):
    """Numbers of many rows, groups dealt by statement, null and negative amounts, two vendors, numbers that connect repair orders."""
    import random

    monkeypatch.setattr(matching, "LINES", block)
    rng, lines, ledger = random.Random(5), [], []
    amount = lambda: rng.choice([None, _money(f"{rng.randrange(-105, 105)}.00"), _money(f"{rng.randrange(9800, 10200) / 100:.2f}")])
    for k in range(400):
        lines.append((f"S{k % 7}", rng.choice("VW"), "2026-07", rng.choice([*numbers, "", None]), rng.choice(["R", "T", "U", "", None]), amount(), k))
        ledger.append((rng.choice("VW"), rng.choice([*numbers, "x", "", None]), rng.choice(["R", "T", "U", "", None]), amount(), k))
    lines, ledger = spark.createDataFrame(lines, LINES), spark.createDataFrame(ledger, LEDGER)
    columns = ["statement_id", "seq", "status", "level", "reason", "erp_seq", "erp_amount", "erp_invoice"]
    one, other = (sorted(map(tuple, f(lines, ledger).select(*columns).collect()), key=str) for f in (matching.match, matching.fold_all))
    assert one == other and {r[3] for r in one} == {1, 2, None}


def test_a_line_goes_through_the_matcher_whole(spark):
    """One decision for each line: those of one place are not multiplied by a join back, other columns stay, lines without a place find nothing."""
    lines = [("S", "V", "2026-07", "A", None, _money("1.00"), 1, 7), ("S", "V", "2026-07", "A", None, _money("1.00"), 1, 8), (None, "V", "2026-08", "A", None, _money("1.00"), 2, 9), ("S", None, None, "A", None, None, 3, None)]
    ledger = spark.createDataFrame([("V", "A", None, _money("1.00"), k) for k in (0, 1)], LEDGER)
    found = matching.match(spark.createDataFrame(lines, LINES + ", more int"), ledger)
    rows = {(r["more"], r["statement_period"], r["status"], r["level"]) for r in found.collect()}
    assert found.count() == 4
    assert rows == {(7, "2026-07", "MATCHED", 1), (8, "2026-07", "MATCHED", 1), (9, "2026-08", "EXCEPTION", None), (None, None, "EXCEPTION", None)}
