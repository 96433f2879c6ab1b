"""Quality classifier: a factorisation machine over hashed words, text structure and size.

A document is a vector of word-bucket shares and structure statistics. The
machine scores it with one weight per feature and low-rank pairwise
interactions, in time linear in the features by the identity
``sum_{i<j} <v_i, v_j> x_i x_j = ((sum v_i x_i)^2 - sum v_i^2 x_i^2) / 2``.

Learning takes at most ``TRAIN_ROWS`` labelled rows (those with the smallest
hash of their id), whose feature vectors are built by Spark and fitted with
numpy on the driver. Every document is scored, whole, inside Spark tasks.
Language, source, id and labels are never inputs of a score.

Defined cases: null and empty texts are scored from their statistics like any
other; labels of unknown documents and null labels are ignored; without any
usable label the score is 0.5; repeated rows are scored one by one, and ids of more
than ``MOST_COPIES`` rows teach nothing; a very long text is counted whole; an
empty table gives an empty result; other columns, also of clashing names, are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import table

BUCKETS = 4096
RANK = 8
#: The most labelled rows that a fit takes.
TRAIN_ROWS = 8_000
#: Rows of one id beyond which the id is left out of the sample, so that its bound holds.
MOST_COPIES = 4
EPOCHS, MIN_STEPS, BATCH, RATE, DECAY = 6, 500, 128, 0.02, 1e-5
#: Rows whose crc32(id as text) leaves this remainder are held out.
HELD_OUT = (5, 0)
CUT = 0.3

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>"
_ENDS = b".!?"
STATISTICS = 16
FEATURES = BUCKETS + STATISTICS
#: Documents scored at a time.
CHUNK = 256


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word-bucket shares and structure statistics, all between 0 and about 1."""
    raw = text.encode()
    words = raw.split()
    n, size = len(words), max(1, len(raw))

    def share(kind: bytes) -> float:
        return 1 - len(raw.translate(None, kind)) / size if raw else 0.0

    buckets = np.fromiter(map(zlib.crc32, words), np.uint32, n) & (BUCKETS - 1)
    counts = np.bincount(buckets, minlength=BUCKETS).astype(np.float32)
    lines = [s for s in raw.split(b"\n") if s.strip()]
    same = np.count_nonzero(buckets[1:] == buckets[:-1]) / max(1, n - 1)
    distinct = np.count_nonzero(counts)
    statistics = [
        1.0,
        np.log1p(n) / 10,
        np.log1p(size) / 14,
        min(1.0, (size - n) / max(1, n) / 20),
        share(_UPPER),
        share(_LETTERS),
        share(_DIGITS),
        share(_SYMBOLS),
        share(b"!"),
        share(b"|"),
        share(_ENDS),
        share(b","),
        same,
        distinct / max(1, min(n, BUCKETS)),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, len(lines) / max(1, n)),
    ]
    return counts / max(1, n) * 8, np.array(statistics, np.float32)


class Machine(NamedTuple):
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        linear = x @ self.weights + self.bias
        pairs = ((x @ self.factors) ** 2).sum(1) - (x * x) @ (self.factors**2).sum(1)
        return linear + pairs / 2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x).astype(np.float64), -30, 30)))


def empty_machine() -> Machine:
    return Machine(0.0, np.zeros(FEATURES, np.float32), np.zeros((FEATURES, RANK), np.float32))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Machine:
    """Adam on the logistic loss; ``x`` is rows by features. Few rows get more epochs."""
    random = np.random.default_rng(seed)
    machine = empty_machine()
    weights, factors = machine.weights, random.normal(0, 0.05, machine.factors.shape).astype(np.float32)
    bias = np.zeros(1, np.float32)
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (bias, weights, factors)]
    step = 0
    for _ in range(max(EPOCHS, -(-MIN_STEPS // -(-len(y) // BATCH)))):
        order = random.permutation(len(y))
        for k in range(0, len(y), BATCH):
            rows = order[k : k + BATCH]
            part = x[rows].astype(np.float32)
            error = (Machine(bias[0], weights, factors).score(part) - y[rows]).astype(np.float32) / len(rows)
            sums = part @ factors
            slope = (
                np.array([error.sum()], np.float32),
                part.T @ error + DECAY * weights,
                part.T @ (error[:, None] * sums) - factors * ((part * part).T @ error)[:, None] + DECAY * factors,
            )
            step += 1
            for (p, m, v), g in zip(state, slope, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Machine(float(bias[0]), weights, factors)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for text in batch.column(1):
            shares, statistics = features(text.as_py() or "")
            packed.append(np.concatenate([shares, statistics]).astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["y", "x"])


def held_out(id_col: str = "doc_id") -> Column:
    modulus, remainder = HELD_OUT
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    train_rows: int = TRAIN_ROWS,
) -> Machine:
    """A machine fitted to the rows of at most ``train_rows`` labelled, not held-out ids."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("float").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows_of = texts.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") <= MOST_COPIES)
    present = usable.join(rows_of, "id", "left_semi")
    sample = present.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    rows = texts.join(F.broadcast(sample), "id").select("y", "text").mapInArrow(_vectors, "y float, x binary").toArrow()
    if rows.num_rows == 0:
        return empty_machine()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(-1, FEATURES)
    y = rows.column("y").to_numpy()
    order = np.lexsort((x[:, BUCKETS + 2], x[:, BUCKETS + 1], y))  # the same rows give the same machine
    return fit(x[order], y[order])


def _scores(machine: Machine, texts: list[str | None] | pa.Array) -> np.ndarray:
    out = np.zeros(len(texts))
    for k in range(0, len(texts), CHUNK):
        some = texts[k : k + CHUNK]
        part = [np.concatenate(features(t or "")) for t in (some.to_pylist() if isinstance(some, pa.Array) else some)]
        out[k : k + CHUNK] = machine.score(np.stack(part))
    return out


def classify(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(_scores(machine, batch.column(2)), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], names=["doc_id", "held_out", "score"])

    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    scored = picked.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def accepted(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the machine does not reject, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array(_scores(machine, texts) >= CUT))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_quality_fm": op10_quality_fm}
