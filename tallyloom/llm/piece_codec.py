"""SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

All pieces of a model form one automaton. One pass over a stretch of text visits,
at every position, the pieces that end there (the current state and its output
links) and relaxes the best score of that position, so the segmentation with the
largest sum of piece scores is known at the last character. Equal sums keep the
longest piece.

Pieces hold the blank mark only at their start, and some characters (line feeds,
unknown ones) occur in no piece at all. A text therefore falls apart, without
changing its best segmentation, into stretches that begin with blanks; a worker
encodes each distinct stretch once and remembers its ids.

Characters without a piece become byte pieces, a blank mark in the text included,
so decoding gives back every text exactly.

Defined cases: null and empty texts have no ids and decode to the empty text;
null ids and repeated rows pass one by one; a very long text, also one unbroken
stretch, takes one pass, and long stretches are not remembered; an empty table
gives an empty result; other columns, also of clashing names, are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import table

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Stretches that a worker remembers at most.
REMEMBERED = 600_000
#: Longer stretches (characters) are not remembered.
LONGEST = 64


class PieceCodec(dict):
    """Maps a stretch of marked text to its ids (little-endian signed 32 bits)."""

    def __init__(self, path: str | None = None):
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        size = model.get_piece_size()
        names = [model.id_to_piece(k) for k in range(size)]
        self.byte_ids = {int(names[k][3:5], 16): k for k in range(size) if model.is_byte(k)}
        skipped = [model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k) for k in range(size)]
        self.pieces = {names[k]: (k, model.get_score(k)) for k in range(size) if not skipped[k]}
        self.known = {p for p in self.pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, (k, score) in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), k, score))
        self.automaton.make_automaton()
        self.text_of = [b""] * size
        for piece, (k, _) in self.pieces.items():
            self.text_of[k] = piece.replace(BLANK, " ").encode()
        for value, k in self.byte_ids.items():
            self.text_of[k] = bytes([value])
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("a piece holds a blank mark behind another character")
        joined = {c for p in self.pieces if len(p) > 1 for c in p}
        if not joined <= self.known:
            raise ValueError("a character of a longer piece has no piece of its own")
        apart = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        self.stretches = re.compile(f"[{apart}]+|{BLANK}*[^{BLANK}{apart}]+|{BLANK}+")

    def viterbi(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are known."""
        n = len(text)
        best, back = [0.0] + [float("-inf")] * n, [(0, 0)] * (n + 1)
        for last, (length, k, score) in self.automaton.iter(text):
            start = last + 1 - length
            total = best[start] + score
            if total > best[last + 1]:
                best[last + 1], back[last + 1] = total, (start, k)
        ids, at = [], n
        while at:
            at, k = back[at]
            ids.append(k)
        return ids[::-1]

    def __missing__(self, stretch: str) -> bytes:
        ids: list[int] = []
        run = ""
        for c in stretch:
            if c in self.known:
                run += c
                continue
            ids += self.viterbi(run)
            ids += [self.byte_ids[b] for b in c.encode()]
            run = ""
        ids += self.viterbi(run)
        packed = array("i", ids).tobytes()
        if len(stretch) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if BLANK in text:
            return self._encode_marks(text)
        return b"".join(map(self.__getitem__, self.stretches.findall(BLANK + text.replace(" ", BLANK))))

    def _encode_marks(self, text: str) -> bytes:
        """As ``encode``, for texts that hold the blank mark itself, which becomes bytes."""
        mark = array("i", [self.byte_ids[b] for b in BLANK.encode()]).tobytes()
        return mark.join(
            b"".join(map(self.__getitem__, self.stretches.findall(part.replace(" ", BLANK))))
            for part in (" " + text).split(BLANK)
        )

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text_of.__getitem__, ids)).decode()[1:]


@cache
def codec(path: str | None = None) -> PieceCodec:
    return PieceCodec(path)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces = codec()
    for batch in batches:
        packed = [pieces.encode(t.as_py() or "") for t in batch.column(1)]
        ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(packed), np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "ids"]
        )


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every document."""
    picked = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return picked.mapInArrow(_encode, "doc_id long, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces = codec()
    for batch in batches:
        texts = [pieces.decode(ids.values.to_pylist() if ids.is_valid else []) for ids in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids."""
    picked = encoded.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{ids_col}` as ids")
    return picked.mapInArrow(_decode, "doc_id long, text string")


def _round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces = codec()
    low, high = min(pieces.byte_ids.values()), max(pieces.byte_ids.values())
    for batch in batches:
        packed, counts, as_bytes, checksums, same = [], [], [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            ids = np.frombuffer(pieces.encode(text), np.int32)
            packed.append(ids)
            counts.append(len(ids))
            as_bytes.append(int(((ids >= low) & (ids <= high)).sum()))
            checksums.append(zlib.crc32(ids.tobytes()))
            same.append(pieces.decode(ids.tolist()) == text)
        ends = pa.array(np.cumsum([0, *counts]).astype(np.int32))
        values = pa.array(np.concatenate(packed) if packed else np.zeros(0, np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in (counts, as_bytes, checksums)), pa.array(same, pa.bool_()),
             pa.ListArray.from_arrays(ends, values)],
            names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "round_trip", "ids"],
        )


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, their count and checksum, and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as bigint) as doc_id", "text")
    return docs.mapInArrow(
        _round_trip, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean, ids array<int>"
    )


QUERIES = {"op3_piece_codec": op3_piece_codec}
