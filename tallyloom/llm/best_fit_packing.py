"""Best-fit packing of token sequences by hierarchical residuals.

Round 0 runs where the texts are read: documents become ids and pieces, and the
pieces of a block (``BLOCK_PIECES`` of one partition) are packed best-fit, longest
first. Bins that are nearly full are final. The others travel on as items, each
as long as its contents, to fewer nodes; a node packs its items best-fit and
again keeps back what is nearly full. Rounds end at a single node, or when a
round merges almost nothing. A node never holds more than about ``NODE_BINS``
items, however many bins cannot be filled, and every bin is kept.

Bins keep their contents gapless: an item's pieces shift by its offset.

Defined cases: a null or empty text is the end id alone; null ids and repeated
rows are packed like any others; a very long text is cut into full pieces and one
rest; an empty table gives an empty result; other columns, also of clashing names,
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import settle, table
from tallyloom.llm.word_ids import REMEMBERED, word_ids

CAPACITY = 2048
END_ID = 0
#: Bins with less room than this are final.
SLACK = 4
BLOCK_PIECES = 100_000
NODE_BINS = 50_000
#: A round must leave fewer than this share of its bins, or it is the last.
PROGRESS = 0.95

_ID_BYTES = 4
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long"
_MERGED = "bin long, parent long, base long, fill long"


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, longest first into the fullest bin that still takes it.

    Open bins are stacked by their room, and a bit mask of the rooms in use gives
    the smallest one that is large enough.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        if fitting := rooms >> length:
            room = length + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            b, room, used = used, capacity, used + 1
        bins[k], offsets[k] = b, capacity - room
        if left := room - length:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins, offsets


def _fills(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lengths).astype(np.int64)[bins] if len(bins) else bins


def _pack_partition(capacity: int, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_bin = TaskContext.get().partitionId() << 33
        pieces: list[tuple] = []

        def packed() -> pa.RecordBatch:
            nonlocal next_bin
            columns = list(zip(*pieces, strict=True))
            lengths = np.array(columns[3], np.int64)
            bins, at = best_fit(lengths, capacity)
            fills = _fills(bins, lengths)
            names = bins + next_bin
            next_bin += int(bins.max()) + 1
            pieces.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:]),
                 pa.array(names), pa.array(at), pa.array(fills)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "fill"],
            )

        ids_of, step, end = word_ids(remembered=remembered).of_text, capacity * _ID_BYTES, END_ID.to_bytes(_ID_BYTES, "little")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py() or "") + end
                for piece, k in enumerate(range(0, len(ids), step)):
                    part = ids[k : k + step]
                    pieces.append((doc_id, piece, k // _ID_BYTES, len(part) // _ID_BYTES, zlib.crc32(part)))
                if len(pieces) >= BLOCK_PIECES:
                    yield packed()
        if pieces:
            yield packed()

    return run


def _merge_node(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("bin").to_numpy())
        names, lengths = group.column("bin").to_numpy()[order], group.column("fill").to_numpy()[order]
        bins, base = best_fit(lengths, capacity)
        parents = np.zeros(int(bins.max()) + 1, np.int64)
        parents[bins[base == 0]] = names[base == 0]
        return pa.table({"bin": names, "parent": parents[bins], "base": base, "fill": _fills(bins, lengths)})

    return run


def merge_underfull(bins: DataFrame, capacity: int = CAPACITY, node_bins: int = NODE_BINS) -> DataFrame:
    """(bin, parent, base) for the underfull ``bins`` (bin, fill): where each goes in the end, and how far in."""
    spark = bins.sparkSession
    placed = None
    bins = settle(bins, "bins")
    n = bins.count()
    level = 0
    while n > 1:
        nodes = -(-n // node_bins)
        node = F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(nodes)).alias("node")
        merged = bins.select("bin", "fill", node).groupBy("node").applyInArrow(_merge_node(capacity), _MERGED)
        merged = settle(merged, "merged")
        if placed is None:
            placed = merged.select("bin", "parent", "base")
        else:
            step = merged.select(F.col("bin").alias("parent"), F.col("parent").alias("up"), F.col("base").alias("more"))
            placed = settle(
                placed.join(step, "parent", "left").select(
                    "bin", F.coalesce("up", "parent").alias("parent"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")
                ),
                "placed",
            )
        bins = merged.where((F.col("base") == 0) & (F.col("fill") <= capacity - SLACK)).select(F.col("parent").alias("bin"), "fill")
        left = bins.count()
        if nodes == 1 or left > PROGRESS * n:
            break
        n, level = left, level + 1
    return placed if placed is not None else spark.createDataFrame([], "bin long, parent long, base long")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, node_bins: int = NODE_BINS,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """One row per piece: its document, place in the document, checksum of its ids, sequence and offset.

    A worker's table of words holds at most ``remembered``; fewer take less memory and more time.
    """
    picked = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    pieces = settle(picked.mapInArrow(_pack_partition(capacity, remembered), _PIECES), "pieces")
    under = F.col("fill") <= capacity - SLACK
    placed = merge_underfull(pieces.where(under & (F.col("at") == 0)).select("bin", "fill"), capacity, node_bins)
    moved = pieces.where(under).join(placed, "bin", "left")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    final = pieces.where(~under).select(*columns, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    return final.unionByName(
        moved.select(
            *columns, F.coalesce("parent", "bin").alias("sequence_id"),
            (F.col("at") + F.coalesce("base", F.lit(0))).alias("offset"),
        )
    )


def sequences(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, as arrays of ids. Needs distinct, non-null ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = word_ids().of_text, END_ID.to_bytes(_ID_BYTES, "little")
        for batch in batches:
            row = batch.to_pydict()
            parts = []
            for text, start, length in zip(row["text"], row["start"], row["length"], strict=True):
                ids = np.frombuffer(ids_of(text or "") + end, "<u4")[start : start + length]
                parts.append(ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"]
            )

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = packed.join(texts, "doc_id").select("sequence_id", "offset", "start", "length", "text")
    parts = parts.mapInArrow(cut, "sequence_id long, offset long, ids array<int>")
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most CAPACITY ids a sequence
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
