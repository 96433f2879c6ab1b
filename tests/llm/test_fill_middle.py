"""Fill-in-middle against a plain version, SQL and the exact round trip."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from compare import of_duck, of_spark
from tallyloom.llm import fill_middle

SCHEMA = "doc_id long, text string, n long, FORM string, fim0_output string"
TEXTS = [
    (1, "Alpha beta, GAMMA-delta"), (1, "Alpha beta, GAMMA-delta"), (2, None), (3, ""), (4, " \n\t\r"), (None, "no id here"), (None, None), (5, "a<P>b"), (6, "<S>"), (7, "x<M>"),
    (8, "<<S<M <P S> <p> <P"), (9, "café ▁ 日本語 \U0001f600 fin\0 end"), (10, "word, " * 60_000), (11, "é" * 70_000), (12, "<" * 50), (13, "one"),
] + [(k, f"Doc {k}: <P <S> x" if k % 9 == 0 else f"text no {k} <M S>P>{'y ' * (k % 7)}") for k in range(14, 400)]


def plain(doc_id, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return str(row)


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, 5, "f", "o") for i, t in TEXTS], SCHEMA)


def test_outputs_equal_a_plain_version_and_turn_back(awkward, monkeypatch):
    out = fill_middle.restore(fill_middle.transform(awkward), "fim1_form", "fim1_output")
    assert out.columns == ["doc_id", "text", "n", "FORM", "fim0_output", "fim1_n", "fim1_form", "fim1_prefix_chars", "fim1_middle_chars", "fim1_output", "restored"]
    rows = out.collect()
    found = sorted(((r["doc_id"], r["text"], *r[5:10]) for r in rows), key=key)
    assert found == sorted(((i, t, *plain(i, t)) for i, t in TEXTS), key=key)
    assert all(r["restored"] == (r["text"] or "") and (r["n"], r["FORM"], r["fim0_output"]) == (5, "f", "o") for r in rows)
    assert {r["fim1_form"] for r in rows} == {"plain", "psm", "spm"}


def test_other_seed_and_shares(awkward):
    out = fill_middle.transform(awkward.select("doc_id", "text"), seed=7, rewritten_percent=100, suffix_first_percent=100)
    assert {r["form"] for r in out.where("doc_id > 13 and doc_id % 9 > 0").collect()} == {"spm"}
    again = fill_middle.transform(awkward.select("doc_id", "text"), seed=7)
    assert sorted((r["output"] for r in again.collect()), key=key) == sorted((plain(i, t, 7)[4] for i, t in TEXTS), key=key)


def test_small_slices_give_the_same(awkward, monkeypatch):
    batch = awkward.select("text").where("text is not null").toArrow().to_batches()
    assert sum(b.num_rows for b in fill_middle._slices(iter(batch))) == sum(b.num_rows for b in batch)
    monkeypatch.setattr(fill_middle, "SLICE_BYTES", 64)
    parts = list(fill_middle._slices(iter(batch)))
    assert [t for p in parts for t in p.column(0).to_pylist()] == [t for b in batch for t in b.column(0).to_pylist()]
    assert all(p.num_rows == 1 or p.column(0).nbytes < 64 + 8 * 80 for p in parts)


def test_digests(awkward, spark):
    found = sorted((tuple(r) for r in fill_middle.digests(awkward).collect()), key=key)
    want = []
    for i, t in TEXTS:
        n, form, p, m, output = plain(i, t)
        want.append((i, n, form, p, m, sha(output), sha(t or "")))
    assert found == sorted(want, key=key)
    empty = spark.createDataFrame([], SCHEMA)
    assert fill_middle.digests(empty).count() == 0 and fill_middle.restore(fill_middle.transform(empty), "fim1_form", "fim1_output").count() == 0


def test_query_equals_sql_and_the_plain_version(spark, sf_dir, duck):
    found = fill_middle.op11_fill_middle(spark, sf_dir)
    assert of_spark(found) == of_duck(duck, fill_middle.SQL)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in found.collect():
        n, form, p, m, output = plain(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r) == (r["doc_id"], n, form, p, m, sha(output), sha(texts[r["doc_id"]] or ""))
    plans = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plans and "Exchange" not in plans
