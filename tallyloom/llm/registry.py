"""Queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from tallyloom.llm import (
    attention_lm,
    best_fit_packing,
    fill_middle,
    hilbert_sharding,
    host_rules,
    line_dedup,
    merkle_manifest,
    pii_anchors,
    piece_codec,
    progressive_jpeg,
    quality_fm,
    secret_scan,
    simhash_anchors,
)

_MODULES = (
    line_dedup,
    best_fit_packing,
    piece_codec,
    simhash_anchors,
    pii_anchors,
    progressive_jpeg,
    host_rules,
    attention_lm,
    hilbert_sharding,
    quality_fm,
    fill_middle,
    merkle_manifest,
    secret_scan,
)

QUERIES: dict = {}
ORACLES: dict = {}
for _module in _MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLES.update(getattr(_module, "ORACLES", {}))
