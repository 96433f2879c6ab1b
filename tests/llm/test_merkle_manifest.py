"""Merkle manifests against a plain version, SQL and tampering."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from compare import of_duck, of_spark
from tallyloom.llm import merkle_manifest as mm

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, idx long, leaf string, path string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(leaves, fanout):
    """Root and, for every leaf, its list of (left, right)."""
    ways, level, where = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, at in enumerate(where):
            run = level[at // fanout * fanout : (at // fanout + 1) * fanout]
            ways[k].append(("".join(run[: at % fanout]), "".join(run[at % fanout + 1 :])))
        level = [sha("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)]
        where = [at // fanout for at in where]
    return level[0], ways


def plain(rows, fanout=16):
    """rows: (doc_id, source, lang, n_chars, text) -> the query's rows."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    if not rows:
        return []
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        ranked = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (ranked, *climb([leaf(r) for r in ranked], fanout))
    root, over = climb([trees[s][1] for s in order], fanout)
    out = []
    for s, top in zip(order, over, strict=True):
        ranked, subroot, ways = trees[s]
        for row, way in zip(ranked, ways, strict=True):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = leaf((*row[:4], lower(row[4]))) if tampered else leaf(row)
            for left, right in way + top:
                folded = sha(left + folded + right)
            out.append((row[0], leaf(row), subroot, root, sha("".join(a + b for a, b in way + top)), folded, folded == root))
    return out


def key(row):
    return str(row)


def query(docs):
    """The registered query over a frame in place of the table."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    claimed = mm.leaf([mm.ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in mm.COLUMNS])
    found, nodes = mm.manifest(docs, payload={"claimed": F.when(tampered, claimed)})
    folded = mm.fold(F.coalesce("claimed", "leaf"), F.col("path"))
    return found.select("id", "leaf", "subroot", "root", mm.proof(F.col("path")), folded, folded == F.col("root")), nodes


def test_awkward_rows(spark):
    rows = [(1, "a", "en", 3, "Abc"), (1, "a", "en", 3, "Abc"), (1, "a", None, 3, "abc"), (None, "a", "en", None, None), (None, None, None, None, None), (2, None, "en", 0, ""),
            (3, "", "de", 5, "ÄöÜß"), (4, "é", "fr", 1, "X" * 200_000), (5, "lone", "en", 1, "Z"), (6, "\U0001f600", "x", 2, "-"), (7, "z", "x", 2, "2:ab")]
    rows += [(k, "many", "en", k, f"Text {k}") for k in range(300)] + [(9, "same", "en", 1, "Same")] * 40
    rows += [(k, f"s{k}", "en", 1, "One") for k in range(10)]
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame([(*r, "g", 1, "l", "p") for r in rows], SCHEMA).repartition(7)
    found, nodes = query(docs)
    found = sorted((tuple(r) for r in found.collect()), key=key)
    assert found == sorted(plain(rows), key=key)
    assert {r[-1] for r in found} == {True, False}
    levels = {(r["tree"], r["level"]): r["n"] for r in nodes.groupBy("tree", "level").agg(F.count("*").alias("n")).collect()}
    assert levels["1many", 1] == 19 and levels["1many", 2] == 2 and levels["1many", 3] == 1 and levels["1same", 1] == 3 and ("1lone", 1) not in levels
    assert levels[None, 1] == 2 and levels[None, 2] == 1


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 1, "T")], [(k, "a", "en", 1, "T") for k in range(17)], [(k, "a", "en", 1, "T") for k in range(16)]])
def test_small_tables(spark, rows):
    found, _ = query(spark.createDataFrame([(*r, "g", 1, "l", "p") for r in rows], SCHEMA))
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_peaks_of_any_cut_leave_no_run_half(fanout):
    """Cut n leaves anywhere: closed runs plus open nodes give each level once, and open nodes are few."""
    rng = random.Random(fanout)
    for n in (1, 2, 5, 16, 17, 40, 257, 900):
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(rng.randrange(6)))})
        leaves, made = [sha(str(k)) for k in range(n)], {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            out = []
            peaks = mm.Peaks("g", n, fanout, out)
            for k in range(a, b):
                peaks.put(k, leaves[k])
            peaks.end()
            for _, _, level, idx, digest, is_open in out:
                assert (level, idx) not in made
                made[level, idx] = digest, is_open
            for level in {r[2] for r in out}:
                assert sum(r[5] for r in out if r[2] == level) <= 2 * (fanout - 1)
        level = {k: h for k, h in enumerate(leaves)}
        for up in range(1, 12):
            runs = {}
            for k, h in level.items():
                runs.setdefault(k // fanout, []).append((k, h))
            parents = {r: sha("".join(h for _, h in sorted(m))) for r, m in runs.items()}
            for (lv, idx), (digest, _) in made.items():
                if lv == up:
                    assert parents[idx] == digest
            level = parents


def test_other_fanout_and_columns(spark):
    rows = [(k, f"s{k % 3}", f"text {k}") for k in range(100)]
    docs = spark.createDataFrame(rows, "k long, part string, body string")
    found, _ = mm.manifest(docs, ("k", "body"), "part", "k", fanout=3)
    for r in found.collect():
        way = [(s["left"], s["right"]) for s in r["path"]]
        acc = r["leaf"]
        assert acc == sha(f"{len(str(r['id']))}:{r['id']}{len(f'text {r['id']}')}:text {r['id']}")
        for left, right in way:
            acc = sha(left + acc + right)
        assert acc == r["root"] and len(way) == 5


def test_query_equals_sql_and_the_plain_version(spark, sf_dir, duck):
    found = mm.op12_merkle_manifest(spark, sf_dir)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*mm.COLUMNS).collect()]
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(plain(rows), key=key)
    assert of_spark(found) == of_duck(duck, mm.SQL)
