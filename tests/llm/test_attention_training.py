"""What the attention model is trained on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

from tallyloom.llm import attention_lm as lm
from tallyloom.llm.word_ids import word_ids


def test_every_id_is_a_target_once_behind_its_context(monkeypatch):
    monkeypatch.setattr(lm, "HELD", 7)
    texts = [" ".join(f"word{k} of{k % 9}" for k in range(n)) for n in (0, 1, 11, 12, 300)] + [None]
    found, windows_of = [], list(lm._held(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])))
    for windows, valid in windows_of:
        assert windows.shape == valid.shape and windows.shape[1] == lm.WINDOW + 1
        found += windows[:, lm.CONTEXT + 1 :][valid[:, lm.CONTEXT + 1 :]].tolist()
    want = []
    for t in texts:
        want += np.frombuffer(word_ids().of_text(t or ""), "<u4").tolist() + [lm.END_ID]
    assert found == want and len(windows_of) > 1
    last = windows_of[-2][0]  # the long text: contexts are the ids before
    assert (last[1:, : lm.CONTEXT + 1] == last[:-1, lm.SCORED :]).all()


def test_texts_with_marks_are_spelt_alike_when_counted_trained_and_scored():
    texts = ["plain words here", "a <|endoftext|> b <|startoftext|>", "A <| b", "<|endoftext|>", "plain words", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    want = [np.frombuffer(word_ids().of_text(t or ""), "<u4").tolist() + [lm.END_ID] for t in texts]
    trained = []
    for windows, valid in lm._held(batch):
        trained += windows[:, lm.CONTEXT + 1 :][valid[:, lm.CONTEXT + 1 :]].tolist()
    assert trained == sum(want, [])
    counts, words = {}, {}
    for rows in lm._gather(iter([batch])):
        for kind, key, n in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            of = counts if kind == lm._ID else words
            of[key] = of.get(key, 0) + n
    flat = sum(want, [])
    assert counts == {k: flat.count(k) for k in set(flat)}
    line = sum(((t or "").lower().split() for t in texts), [])
    assert words == {lm._key(w.encode()): line.count(w) for w in set(line)} | {lm._END_KEY: len(texts)}


ODD = ["  A b\x0bc\t d\x85e ", "", None, " \n ", "x", "é\xa0f Ⅷ B\x1cq\x1f it's a1.", "a <|endoftext|> b.", "\x00 a, " * 90]


def test_words_are_numbered_as_a_plain_split_gives_them():
    numbers = lm.Numbers()
    found, sizes = numbers.of(pa.array(ODD))
    words = {n: w for w, n in numbers.items()}
    lines = [[words[n] for n in line] for line in np.split(found, np.cumsum(sizes)[:-1].tolist())]
    assert lines == [(t or "").encode().lower().split() + [lm._END_WORD] for t in ODD]


def test_texts_are_spelt_once_and_trained_and_scored_from_their_ids(monkeypatch):
    held = [k % 3 == 1 for k in range(len(ODD))]
    columns = [pa.array(ODD), pa.array(range(len(ODD)), pa.int64()), pa.array(held), pa.array([0] * len(ODD), pa.int8())]
    rows = pa.Table.from_batches(lm._gather(iter([pa.RecordBatch.from_arrays(columns, names=["text", "doc_id", "held_out", "part"])])))
    want = [[*np.frombuffer(word_ids().of_text(t or ""), "<u4").tolist(), lm.END_ID] for t in ODD]
    texts = rows.filter(pa.compute.equal(rows["kind"], lm._TEXT)).combine_chunks()
    assert (texts["text"].to_pylist(), texts["held_out"].to_pylist()) == (ODD, held)
    assert [i.tolist() for i in lm._ids_of(texts["ids"].chunk(0))] == want
    ids = rows.filter(pa.compute.equal(rows["kind"], lm._ID))
    taught = sum((w for w, h in zip(want, held, strict=True) if not h), [])
    assert dict(zip(ids["key"].to_pylist(), ids["n"].to_pylist(), strict=True)) == {k: taught.count(k) for k in set(taught)}
    from_texts = list(lm._held(pa.RecordBatch.from_arrays([pa.array(ODD)], names=["text"])))
    monkeypatch.setattr(lm, "word_ids", None)  # nothing is spelt again
    from_ids = list(lm._held(texts.select(["ids"]).to_batches()[0]))
    for a, b in zip(from_texts, from_ids, strict=True):
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_block_equals_a_plain_version():
    rng = np.random.default_rng(8)
    classes = lm.frequency_classes(rng.integers(0, 9, lm.VOCABULARY_SIZE), np.arange(lm.VOCABULARY_SIZE) % 2 == 0)
    flat = rng.normal(0, 0.4, len(lm.initial_weights()))
    w, ids = lm._views(flat), rng.integers(0, 49_000, (3, lm.WINDOW + 1))
    want = np.zeros((len(ids), lm.SCORED))
    for window, out in zip(ids, want, strict=True):
        x = w["bucket"][window[:-1] % lm.BUCKETS] + w["kind"][classes.of_id[window[:-1]]] + w["place"]
        keys, values = np.split(x @ w["key_value"], 2, axis=1)
        for j in range(lm.SCORED):
            at = lm.CONTEXT + j
            near = np.exp(keys[: at + 1] @ (x[at] @ w["query"]) / lm.WIDTH**0.5)
            h = near @ values[: at + 1] / near.sum() @ w["mix"] + x[at]
            logits = (np.maximum(h @ w["grow"] + w["grown"], 0) @ w["shrink"] + h) @ w["out"] + w["bias"]
            out[j] = np.log10(np.exp(logits)[classes.of_id[window[at + 1]]] / np.exp(logits).sum())
    assert np.allclose(lm.Scorer(lm.Model(flat, classes)).class_logs(ids), want, rtol=1e-9)
    loss = lm._train_batch(flat, ids, np.ones(ids.shape, bool), classes)[1]
    assert np.isclose(loss, -want.mean() * np.log(10), rtol=1e-9)


def test_long_texts_are_read_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(lm, "READ", 3)
    monkeypatch.setattr(lm, "READ_BYTES", 10)
    texts = ["a" * n for n in (4, 4, 4, 30, 0, 0, 0, 0, 9, 1)] + [None]
    parts = [p.column(0).to_pylist() for p in lm._parts(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]).slice(0), 0)]
    assert sum(parts, []) == texts
    assert [len(p) for p in parts] == [2, 1, 1, 3, 3, 1]
    assert list(lm._parts(pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["text"]), 0)) == []
