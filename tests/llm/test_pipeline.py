"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

import corpus_pipeline
from tallyloom.llm import best_fit_packing, pii_anchors, quality_fm
from tallyloom.llm.common import settle, table
from tallyloom.llm.word_ids import WordIds
from test_llm_operators import AWKWARD, SCHEMA, check_packing, deduped
from test_near_copies import brute


def test_stages_in_turn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, sf_dir), f"test-{name}")
        if name == "packing":
            check_packing(rows.items(), out, best_fit_packing.CAPACITY)
            break
        assert out.columns == columns
        found = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality":
            scores = quality_fm.classify(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))
            want = {r["doc_id"]: rows[r["doc_id"]] for r in scores.collect() if r["predicted"]}
            assert 0 < len(want) < len(rows)
        elif name == "line_dedup":
            want = {i: t for i, t in deduped(rows.items()).items() if t or not rows[i]}
            assert sum(map(len, want.values())) < sum(len(t or "") for t in rows.values())
            found = {i: t or "" for i, t in found.items()}
        elif name == "near_dedup":
            groups = dict(brute(list(rows.items())))  # five words, similarity 0.8
            want = {i: t for i, t in rows.items() if groups[i] == i}
        else:
            want = {i: None if t is None else pii_anchors.redacted(t) for i, t in rows.items()}
        assert found == want, name
        docs, rows = out, found


def test_stages_on_awkward_rows(spark, sf_dir):
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            assert name == "packing" or out.columns == docs.columns
            out.write.mode("overwrite").format("noop").save()
    machine = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    good = [i for (i, *_), s in zip(AWKWARD, quality_fm._scores(machine, [r[1] for r in AWKWARD]), strict=True) if s >= quality_fm.CUT]
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    assert sorted(map(str, good)) == sorted(str(r["doc_id"]) for r in kept.collect())
    near = [r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, sf_dir).collect()]
    # Rows 2, 3 and 4 have no words, row 1 stands there twice; the row without id stays.
    assert sorted(near, key=str) == sorted([1, 2, None, 5, 6, 7, 8, 9], key=str)
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.mask_personal(spark, docs, sf_dir).collect()}
    assert masked == {r[0]: None if r[1] is None else pii_anchors.redacted(r[1]) for r in AWKWARD}


def test_packing_is_the_same_whatever_its_workers_remember(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1)
    one, other = (sorted(map(tuple, best_fit_packing.pack(docs, **kept).select("doc_id", "piece", "ids_crc32", "length").collect())) for kept in ({}, {"remembered": 5}))
    assert one == other and WordIds(remembered=5).remembered == 5
    words = WordIds(remembered=5)
    words.of_text("a b c d e f g h i j k")
    assert len(words) <= 5 and len(words.parts) <= 5
