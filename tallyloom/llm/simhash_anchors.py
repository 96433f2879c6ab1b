"""SimHash near-duplicates by anchor-point covering.

Anchors are the 4,096 codewords of the perfect binary Golay code on 23 of the 64
fingerprint bits. Its covering radius is 3: every fingerprint lies within 3 bits
of an anchor, so whatever differs from it in at most ``THRESHOLD`` bits lies
within 3 + ``THRESHOLD`` of the same anchor. Each distinct fingerprint is
therefore copied to every anchor within that reach (about 22 copies) and
fingerprints are compared inside an anchor only.

An anchor with more than ``GROUP_ROWS`` fingerprints is dealt again: each of its
fingerprints goes to the anchors of the next block of bits (23 more, then the
last 18, whose anchors are the code shortened to that length), and the group is
then the pair or triple of anchors. Two fingerprints that may be linked meet in
every block, so no link is lost however often a group is dealt. What is still
large after the last block is compared block by block in bounded memory.

Equal fingerprints are one node from the start, so groups of copies cost nothing.
A group sends out the edges of a spanning forest instead of pairs.

Defined cases: null and empty texts have the fingerprint zero and are linked
like any other; rows with a null id link others like any row and get their
component's smallest id, or null if it has none; repeated rows give repeated
result rows; a very long text is hashed whole; an empty table gives an empty
result; other columns, also of clashing names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import settle, table
from tallyloom.llm.components import component_labels

THRESHOLD = 2
SHINGLE = 3
SEED = 42
#: Fingerprints of a group that are compared without dealing it again.
GROUP_ROWS = 4_000
#: Comparisons held in memory at a time.
COMPARED = 4_000_000

#: Fixed values of the Golay code: length, generator polynomial and its degree.
LENGTH, GENERATOR, DEGREE = 23, 0xC75, 11
#: First bit and number of bits of the blocks that are dealt one after the other.
BLOCKS = ((0, 23), (23, 23), (46, 18))


def fingerprint_bytes(text: str, shingle: int = SHINGLE) -> bytes:
    """Eight big-endian bytes; ASCII letters are lower-cased, words are split at ASCII blanks."""
    words = text.encode().lower().split()
    if not words:
        return bytes(8)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    hashes = b"".join([xxhash.xxh64_digest(g, SEED) for g in grams])
    n = len(hashes) // 8
    ones = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(n, 64).sum(axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > n).tobytes()


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join(fingerprint_bytes(t.as_py() or "", shingle) for t in batch.column(1))
            prints = np.frombuffer(found, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    picked = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return picked.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _remainder(v: int) -> int:
    for b in range(LENGTH - 1, DEGREE - 1, -1):
        if v >> b & 1:
            v ^= GENERATOR << (b - DEGREE)
    return v


@cache
def cover(length: int, threshold: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of single bits, and error patterns by remainder, of the code shortened to ``length`` bits.

    Patterns reach ``threshold`` bits beyond the covering radius; without a threshold they end at the radius.
    """
    columns = np.array([_remainder(1 << b) for b in range(length)])
    every = np.arange(1 << length, dtype=np.uint32)
    weight = np.bitwise_count(every)

    def light(most: int) -> tuple[np.ndarray, np.ndarray]:
        words = every[weight <= most]
        remainder = np.zeros(len(words), np.int64)
        for b in range(length):
            remainder ^= np.where(words >> b & 1, columns[b], 0)
        return words, remainder

    radius = next(r for r in range(length) if len(np.unique(light(r)[1])) == 1 << DEGREE)
    words, remainder = light(radius + (threshold or 0))
    order = np.argsort(remainder, kind="stable")
    starts = np.searchsorted(remainder[order], np.arange((1 << DEGREE) + 1))
    return columns, words[order].astype(np.int64), starts


def anchors_of(prints: np.ndarray, block: int = 0, threshold: int | None = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor of a block within reach of each fingerprint's bits there."""
    low, length = BLOCKS[block]
    columns, patterns, starts = cover(length, threshold)
    covered = prints >> low & ((1 << length) - 1)
    remainder = np.zeros(len(prints), np.int64)
    for b in range(length):
        remainder ^= np.where(covered >> b & 1, columns[b], 0)
    n = starts[remainder + 1] - starts[remainder]
    row = np.repeat(np.arange(len(prints)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (covered[row] ^ patterns[starts[remainder][row] + within]) >> DEGREE


def _deal(block: int):
    """Copies (group, fp) of rows (group, fp) to the anchors of a block; a group holds the anchors so far, 12 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 5_000):
                groups, prints = (c.to_numpy(zero_copy_only=False) for c in batch.slice(k, 5_000).columns)
                row, anchor = anchors_of(prints, block)
                yield pa.RecordBatch.from_arrays([pa.array(groups[row] << 12 | anchor), pa.array(prints[row])], names=["group", "fp"])

    return run


def links(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within the threshold, in blocks."""
    values, step = prints.view(np.uint64), max(1, COMPARED // max(len(prints), 1))
    for k in range(0, len(prints), step):
        i, j = np.nonzero(np.bitwise_count(values[k : k + step, None] ^ values[None, k:]) <= THRESHOLD)
        keep = i < j
        yield i[keep] + k, j[keep] + k


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smallest one of its component) of one group."""
    prints = np.sort(prints)
    label = np.arange(len(prints))
    for i, j in links(prints):
        while len(i):
            a, b = label[i], label[j]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
    moved = label != np.arange(len(label))
    return prints[moved], prints[label[moved]]


def _compare(group: pa.Table) -> pa.Table:
    a, b = forest(group.column("fp").to_numpy())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_edges(distinct: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` that links connect."""
    crowded, edges = distinct.select(F.lit(0).cast("long").alias("group"), "fp"), None
    for block in range(len(BLOCKS)):
        dealt = settle(crowded.mapInArrow(_deal(block), "group long, fp long"), f"dealt-{block}")
        sizes = settle(dealt.groupBy("group").count().where(F.col("count") > 1), f"sizes-{block}")
        large = sizes.where(F.col("count") > group_rows)
        last = block == len(BLOCKS) - 1 or large.isEmpty()
        calm = dealt.join(sizes if last else sizes.where(F.col("count") <= group_rows), "group", "left_semi")
        found = calm.groupBy("group").applyInArrow(_compare, "a long, b long")
        edges = found if edges is None else edges.union(found)
        if last:
            return edges
        crowded = dealt.join(large, "group", "left_semi")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest id that links reach."""
    prints = settle(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    labels = component_labels(near_edges(distinct, group_rows))
    linked = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("root"), "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = linked.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op4_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash_anchors": op4_simhash_anchors}
