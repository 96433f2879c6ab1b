"""Language-model scoring with a causal self-attention model trained in numpy.

Passes, of which the first alone spells texts:

1. ``gather`` spells every document, counts words and subword ids of those of
   training, and settles the ids beside the texts.
2. Training rounds: every training document belongs to one round, by the hash of
   its text; later rounds are larger. In a round, partitions start from the same
   weights and run Adam once over the contiguous windows of their ids, so every
   id of every training document is a target exactly once. Weights and the
   optimiser's moments are then averaged in two levels, by number of windows.
3. Scoring: each text becomes overlapping windows of ids; a window scores only
   the ids behind its context, so every id is scored once, with batched masked
   attention. The model predicts an id's class (frequency classes of about equal
   mass); within the class the smoothed corpus share of the id counts.

The network is one block: id and place embeddings, masked self-attention with a
residual, a feed-forward layer with a residual, and the class logits.

The base score is that of single words with add-one counts. Words whose count
reaches a power of two that at most ``COMMON_WORDS`` words reach are sent to the
tasks; all rarer words are looked up by a shuffled join, so the vocabulary may
grow without bound.

Words are known by a 64-bit hash. Defined cases: null and empty texts are the end
token alone, null ids are training rows, repeated rows count as often as they
occur and are scored one by one, an empty table gives an empty result; a very long
text is cut into windows like any other and held whole only as ids; other columns,
also of clashing names, are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache
from math import prod
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import settle, table
from tallyloom.llm.word_ids import VOCABULARY_SIZE, word_ids

#: Rows whose crc32(id as text) leaves this remainder are held out.
HELD_OUT = (7, 2)
START_ID, END_ID = 49_406, 49_407
CONTEXT, SCORED = 4, 20
WINDOW = CONTEXT + SCORED
COMMON_WORDS = 500_000
#: Distinct words, and bytes of them, that a worker numbers before it begins again.
TABLED, TABLED_BYTES = 600_000, 48_000_000
CLASSES, WIDTH, HIDDEN, BUCKETS = 64, 16, 32, 2_048
RATE, WARM, SLOWING, NODES, SEED = 0.01, 30, 500, 64, 11
#: Windows of a training step: a learner's first steps are small.
EARLY_STEPS, EARLY_BATCH, BATCH = 200, 48, 256
#: Parts of 8 of the training documents that each round takes.
ROUNDS = (1, 2, 5)
#: Training windows that a task holds and shuffles at a time.
HELD = 10_000
#: Windows scored at a time.
BLOCK = 192
#: Texts read at a time, and bytes of them if they are more than one.
READ, READ_BYTES = 1_024, 8_000_000

#: Stands for the end of a text; no word holds a space.
_END_WORD = b" end"
_WORD, _ID, _TEXT = 0, 1, 2


def held_out(id_col: str = "doc_id") -> Column:
    modulus, remainder = HELD_OUT
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


_END_KEY = _key(_END_WORD)


class Numbers(dict):
    """Numbers words as a worker meets them, and holds their keys by number."""

    def __init__(self):
        super().__init__()
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.bytes, self.keys = 0, array("q")

    def __missing__(self, word: bytes) -> int:
        self.keys.append(_key(word))
        self.bytes += len(word)
        self[word] = number = len(self.keys) - 1
        return number

    def full(self) -> bool:
        return len(self) >= TABLED or self.bytes >= TABLED_BYTES

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts in turn, each closed by the end, and how many each text has."""
        trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words = pc.ascii_split_whitespace(trimmed)
        sizes = pc.list_value_length(words).to_numpy().astype(np.int64)
        encoded = words.flatten().dictionary_encode()
        of_word = np.array([self[w] for w in encoded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()], np.int64)
        closed = np.full(int(sizes.sum()) + len(sizes), self[_END_WORD], np.int64)
        closed[np.arange(len(closed) - len(sizes)) + np.repeat(np.arange(len(sizes)), sizes)] = of_word[encoded.indices.to_numpy()]
        blank = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)  # taken as one empty word
        if blank.any():
            closed = np.delete(closed, (np.cumsum(sizes + 1) - 2)[blank])
            sizes[blank] = 0
        return closed, sizes + 1


class Spelt(Numbers):
    """Numbered words with their ids."""

    def clear(self) -> None:
        super().clear()
        self.ids, self.ends, self.spell = array("H"), array("q", [0]), word_ids().spell

    def __missing__(self, word: bytes) -> int:
        number = super().__missing__(word)
        self.ids.extend(memoryview(self.spell(word)).cast("I") if word and word != _END_WORD else [END_ID])
        self.ends.append(len(self.ids))
        return number

    def ids_of(self, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lines of numbered words (none is empty) in turn, and where each line's ids end."""
        ids, ends = np.frombuffer(self.ids, np.uint16), np.frombuffer(self.ends, np.int64)
        first, n = ends[numbers], ends[numbers + 1]
        n -= first
        upto = np.cumsum(n)
        first -= upto - n
        at = np.repeat(first, n)
        at += np.arange(len(at))
        return ids[at], upto[np.cumsum(sizes) - 1]


@cache
def _spelt() -> Spelt:
    """The worker's own table, until training begins."""
    return Spelt()


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds texts; long texts come a few at a time."""
    upto, k = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64), 0
    while k < len(upto):
        most = READ_BYTES + (upto[k - 1] if k else 0)
        n = min(READ, max(1, int(np.searchsorted(upto, most, "right")) - k))
        yield batch.slice(k, n)
        k += n


_COUNTED = {"kind": pa.int8(), "key": pa.int64(), "n": pa.int64()}
_SPELT = {"doc_id": pa.int64(), "held_out": pa.bool_(), "part": pa.int8(), "text": pa.string(), "ids": pa.binary()}
_GATHERED = "kind byte, key long, n long, doc_id long, held_out boolean, part byte, text string, ids binary"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n): word counts and id counts of the texts not held out.

    Batches are texts alone, all of training, or (text, doc_id, held_out, part). The latter come back as rows of
    kind ``_TEXT`` with their ids (little-endian unsigned 16 bits, closed by the end id) among the counts.
    """
    table_ = _spelt()
    word_counts, id_counts, wide = np.zeros(0, np.int64), np.zeros(VOCABULARY_SIZE, np.int64), False

    def rows(kind: int, length: int, **columns: pa.Array) -> pa.RecordBatch:
        columns["kind"] = pa.array(np.full(length, kind, np.int8))
        schema = pa.schema(_COUNTED | (_SPELT if wide else {}))
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(length, f.type) for f in schema], schema=schema)

    def counted(kind: int, counts: np.ndarray, keys: np.ndarray | None = None) -> pa.RecordBatch:
        seen = np.flatnonzero(counts)
        return rows(kind, len(seen), key=pa.array(seen if keys is None else keys[seen]), n=pa.array(counts[seen]))

    for batch in batches:
        wide = batch.num_columns > 1
        for part in _parts(batch, 0):
            if table_.full():
                yield counted(_WORD, word_counts, np.array(table_.keys, np.int64)[: len(word_counts)])
                word_counts = word_counts[:0]
                table_.clear()
            texts = part.column(0)
            numbers, sizes = table_.of(texts)
            ids, ends = table_.ids_of(numbers, sizes)
            marked = np.flatnonzero(pc.match_substring(pc.fill_null(texts, ""), "<|"))
            if len(marked):  # ids of texts where a mark of a special token may stand are not those of their words
                each = np.split(ids, ends[:-1])
                for j in marked:
                    each[j] = np.append(np.frombuffer(word_ids().of_text(texts[j].as_py()), "<u4"), END_ID).astype(np.uint16)
                ids, ends = np.concatenate(each), np.cumsum([len(e) for e in each])
            taught = ~part.column(2).to_numpy(zero_copy_only=False) if wide else np.ones(len(texts), bool)
            new = np.bincount(numbers[np.repeat(taught, sizes)], minlength=len(table_.keys))
            new[: len(word_counts)] += word_counts
            word_counts = new
            id_counts += np.bincount(ids[np.repeat(taught, np.diff(ends, prepend=0))], minlength=VOCABULARY_SIZE)
            if wide:
                offsets = np.concatenate([[0], 2 * ends]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))])
                yield rows(_TEXT, len(texts), text=texts, doc_id=part.column(1), held_out=part.column(2), part=part.column(3), ids=packed)
    if len(word_counts):
        yield counted(_WORD, word_counts, np.array(table_.keys, np.int64)[: len(word_counts)])
        yield counted(_ID, id_counts)


class Classes(NamedTuple):
    """Class of every id and the log10 share of the id in its class."""

    of_id: np.ndarray
    share: np.ndarray


def frequency_classes(counts: np.ndarray, closes_word: np.ndarray) -> Classes:
    """Ids that close a word and ids that do not, each by falling count, cut into classes of about equal mass."""
    order = np.lexsort((-counts, closes_word))
    mass = counts[order] + 1.0
    reached = np.cumsum(mass) - mass / 2
    of_id = np.zeros(len(counts), np.int64)
    of_id[order] = np.minimum((reached / mass.sum() * CLASSES).astype(np.int64), CLASSES - 1)
    total = np.bincount(of_id, weights=counts + 1.0, minlength=CLASSES)
    return Classes(of_id, np.log10((counts + 1.0) / total[of_id]))


_SHAPES = {
    "bucket": (BUCKETS, WIDTH), "kind": (CLASSES, WIDTH), "place": (WINDOW, WIDTH), "query": (WIDTH, WIDTH), "key_value": (WIDTH, 2 * WIDTH),
    "mix": (WIDTH, WIDTH), "grow": (WIDTH, HIDDEN), "grown": (HIDDEN,), "shrink": (HIDDEN, WIDTH), "out": (WIDTH, CLASSES), "bias": (CLASSES,),
}
#: Ids that share a bucket, at most.
_LAYERS = -(-VOCABULARY_SIZE // BUCKETS)
#: Exponents are cut here; those of trained models stay far below.
_LARGEST = np.float32(60)
#: What a scored place may not see: the places behind it in its window.
_MASK = np.where(np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None], 0, -1e9).astype(np.float32)


_SIZES = {name: prod(shape) for name, shape in _SHAPES.items()}


def _views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, size in _SIZES.items():
        out[name] = flat[at : at + size].reshape(_SHAPES[name])
        at += size
    return out


def initial_weights() -> np.ndarray:
    flat = np.random.default_rng(SEED).normal(0, 0.15, sum(_SIZES.values())).astype(np.float32)
    w = _views(flat)
    w["grown"][:], w["bias"][:] = 0, 0
    w["out"] *= 0.3
    return flat


class Room:
    """Arrays by name that are used again from batch to batch."""

    def __init__(self, dtype: np.dtype):
        self.dtype, self.held = dtype, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        n = prod(shape)
        found = self.held.get(name)
        if found is None or len(found) < n:
            found = self.held[name] = np.empty(n, self.dtype)
        return found[:n].reshape(shape)

    def ones(self, n: int) -> np.ndarray:
        found = self("ones", n)
        found[:] = 1
        return found


class Folded(NamedTuple):
    """Products of weights that stand next to each other: places meet by ``near``, their mixture goes through ``mixed``."""

    near: np.ndarray
    mixed: np.ndarray
    lift: np.ndarray  # of the classes: exponents of their bias


def _folded(w: dict[str, np.ndarray]) -> Folded:
    key, value = w["key_value"][:, :WIDTH], w["key_value"][:, WIDTH:]
    return Folded(w["query"] @ key.T * w["query"].dtype.type(WIDTH**-0.5), value @ w["mix"], np.exp(np.minimum(w["bias"], _LARGEST)))


def _exp(x: np.ndarray) -> np.ndarray:
    """Exponents in place of ``x``; to look for large ones costs less than to cut all."""
    if x.max(initial=0) > _LARGEST:
        np.minimum(x, _LARGEST, out=x)
    return np.exp(x, out=x)


def _forward(w: dict[str, np.ndarray], folded: Folded, x: np.ndarray, room: Room) -> tuple[np.ndarray, ...]:
    """The block over embedded windows ``x``; the last result holds the logits of every scored place without their bias."""
    n, rows = len(x), len(x) * SCORED
    late = room("late", n, SCORED, WIDTH)
    late[:] = x[:, CONTEXT:]
    late = late.reshape(rows, WIDTH)
    u = np.matmul(late, folded.near, out=room("u", rows, WIDTH)).reshape(n, SCORED, WIDTH)
    a = np.matmul(u, x.transpose(0, 2, 1), out=room("a", n, SCORED, WINDOW))
    a += _MASK
    _exp(a)
    mass = (a.reshape(rows, WINDOW) @ room.ones(WINDOW))[:, None]
    m = np.matmul(a, x, out=room("m", n, SCORED, WIDTH)).reshape(rows, WIDTH)
    m /= mass
    h = np.matmul(m, folded.mixed, out=room("h", rows, WIDTH))
    h += late
    r = np.matmul(h, w["grow"], out=room("r", rows, HIDDEN))
    r += w["grown"]
    r += np.abs(r, out=room("sizes", rows, HIDDEN))  # twice the positive part
    f = np.matmul(r, w["shrink"] * w["shrink"].dtype.type(0.5), out=room("f", rows, WIDTH))
    f += h
    return late, u, a, mass, m, h, r, f, np.matmul(f, w["out"], out=room("d", rows, CLASSES))


def _train_batch(flat: np.ndarray, ids: np.ndarray, valid: np.ndarray, classes: Classes, room: Room | None = None) -> tuple[np.ndarray, float]:
    """Gradient of the mean loss over the valid scored targets of ``ids`` (rows of WINDOW + 1 ids), and the loss.

    The gradient lies in ``room`` until the next call.
    """
    room = room or Room(flat.dtype)
    slope = room("slope", len(flat))
    w, g = _views(flat), _views(slope)
    folded = _folded(w)
    n, rows = len(ids), len(ids) * SCORED
    inputs, targets = ids[:, :-1], np.take(classes.of_id, ids[:, CONTEXT + 1 :]).ravel()
    counted = valid[:, CONTEXT + 1 :].ravel()
    flat_ids = inputs.ravel()
    # Ids by bucket: each distinct one is embedded once, and one row for it goes back to the tables.
    order = np.argsort((flat_ids % BUCKETS * _LAYERS + flat_ids // BUCKETS).astype(np.uint16), kind="stable")
    ordered = np.take(flat_ids, order)
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts = np.flatnonzero(fresh)
    ordered = ordered[starts]
    bucket, kind = ordered % BUCKETS, np.take(classes.of_id, ordered)
    x, spare = room("x", n, WINDOW, WIDTH), room("spare", n, WINDOW, WIDTH)
    number = np.empty(len(flat_ids), np.int64)
    number[order] = np.cumsum(fresh) - 1
    np.take(w["bucket"][bucket] + w["kind"][kind], number.reshape(n, WINDOW), 0, out=x, mode="clip")
    x += w["place"]
    late, u, a, mass, m, h, r, f, d = _forward(w, folded, x, room)
    _exp(d)
    # The bias lifts a class's exponents alike, so it goes to the narrower factors.
    total, at, n_counted = d @ folded.lift, np.arange(rows) * CLASSES + targets, counted.sum()
    lift, hits = np.take(folded.lift, targets), np.take(d, at)
    loss = -np.log(hits * lift / total) @ counted / n_counted
    d.reshape(-1)[at] = hits - total / lift
    share = (counted / (total * n_counted)).astype(flat.dtype)
    # ``d`` times ``share`` and the lift is the slope of the logits.
    spread = np.multiply(f, share[:, None], out=spare.reshape(-1, WIDTH)[:rows])
    np.multiply(np.matmul(d.T, spread, out=room("out", CLASSES, WIDTH)).T, folded.lift, out=g["out"])
    np.multiply(np.matmul(share, d, out=g["bias"]), folded.lift, out=g["bias"])
    df = np.matmul(d, w["out"].T * folded.lift[:, None], out=room("df", rows, WIDTH))
    df *= share[:, None]
    dr = np.matmul(df, w["shrink"].T, out=room("dr", rows, HIDDEN))
    dr *= r > 0
    np.matmul(r.T, df, out=g["shrink"])
    g["shrink"] *= flat.dtype.type(0.5)
    np.matmul(h.T, dr, out=g["grow"])
    np.matmul(room.ones(rows), dr, out=g["grown"])
    dh = np.matmul(dr, w["grow"].T, out=room("dh", rows, WIDTH))
    dh += df
    d_mixed = m.T @ dh
    np.matmul(w["key_value"][:, WIDTH:].T, d_mixed, out=g["mix"])
    np.matmul(d_mixed, w["mix"].T, out=g["key_value"][:, WIDTH:])
    dm = np.matmul(dh, folded.mixed.T, out=room("dm", rows, WIDTH))
    dm /= mass
    inner = np.einsum("ij,ij->i", dm, m).reshape(n, SCORED, 1)
    dm = dm.reshape(n, SCORED, WIDTH)
    ds = np.matmul(dm, x.transpose(0, 2, 1), out=room("ds", n, SCORED, WINDOW))
    ds -= inner
    ds *= a
    dx = np.matmul(ds.transpose(0, 2, 1), u, out=room("dx", n, WINDOW, WIDTH))
    dx += np.matmul(a.transpose(0, 2, 1), dm, out=spare)
    du = np.matmul(ds, x, out=room("du", n, SCORED, WIDTH)).reshape(rows, WIDTH)
    d_near = late.T @ du * flat.dtype.type(WIDTH**-0.5)
    np.matmul(d_near, w["key_value"][:, :WIDTH], out=g["query"])
    np.matmul(d_near.T, w["query"], out=g["key_value"][:, :WIDTH])
    dh += np.matmul(du, folded.near.T, out=spare.reshape(-1, WIDTH)[:rows])
    dx[:, CONTEXT:] += dh.reshape(n, SCORED, WIDTH)
    dx.sum(0, out=g["place"])
    by_id = np.add.reduceat(np.take(dx.reshape(-1, WIDTH), order, 0, out=spare.reshape(-1, WIDTH), mode="clip"), starts, axis=0)
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    g["bucket"][:] = 0
    g["bucket"][bucket[heads]] = np.add.reduceat(by_id, heads, axis=0)
    kinds = np.zeros((len(ordered), CLASSES), flat.dtype)
    kinds[np.arange(len(ordered)), kind] = 1
    np.matmul(kinds.T, by_id, out=g["kind"])
    return slope, float(loss)


class Learner:
    """Weights, Adam's two moments and the number of steps taken."""

    def __init__(self, state: np.ndarray, steps: int, classes: Classes, seed: int):
        self.weights, self.mean, self.square = self.state = state.copy()
        self.steps, self.classes, self.room = steps, classes, Room(state.dtype)
        self.random = np.random.default_rng(seed)

    def fit(self, windows: np.ndarray, valid: np.ndarray) -> None:
        """One shuffled pass over the windows."""
        order, k = self.random.permutation(len(windows)), 0
        while k < len(order):
            size = EARLY_BATCH if self.steps < EARLY_STEPS else BATCH
            rows, k = order[k : k + size], k + size
            slope, _ = _train_batch(self.weights, windows[rows], valid[rows], self.classes, self.room)
            self.steps += 1
            step, spare = self.steps, self.room("moved", len(slope))
            rate = RATE * min(1, step / WARM, (SLOWING / step) ** 0.5) / (1 - 0.9**step)
            self.mean += np.multiply(np.subtract(slope, self.mean, out=spare), np.float32(0.1), out=spare)
            np.multiply(slope, slope, out=slope)
            self.square += np.multiply(np.subtract(slope, self.square, out=spare), np.float32(0.01), out=spare)
            np.sqrt(np.multiply(self.square, np.float32(1 / (1 - 0.99**step)), out=spare), out=spare)
            spare += np.float32(1e-8)
            self.weights -= np.multiply(np.divide(self.mean, spare, out=spare), np.float32(rate), out=spare)


class Windows(NamedTuple):
    """Windows over texts of ids: where each begins in ``line``, its text, and how many ids lie between that text's first and its own."""

    line: np.ndarray
    at: np.ndarray
    text: np.ndarray
    first: np.ndarray
    lengths: np.ndarray

    def ids(self, some: slice) -> np.ndarray:
        """Rows of WINDOW + 1 ids, of which those behind the context are targets."""
        return np.lib.stride_tricks.sliding_window_view(self.line, WINDOW + 1)[self.at[some]]

    def left(self, some: slice) -> np.ndarray:
        """Ids of the text from the first target on."""
        return self.lengths[self.text[some]] - self.first[some]


def windows_of(texts: list[np.ndarray]) -> Windows:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    n_windows = -(-lengths // SCORED)
    room = n_windows * SCORED + CONTEXT + 1
    starts = np.cumsum(room) - room
    line = np.full(int(room.sum()), END_ID, np.int32)
    for start, ids in zip(starts.tolist(), texts, strict=True):
        line[start : start + CONTEXT + 1] = START_ID
        line[start + CONTEXT + 1 : start + CONTEXT + 1 + len(ids)] = ids
    text = np.repeat(np.arange(len(lengths)), n_windows)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)) * SCORED
    return Windows(line, starts[text] + first, text, first, lengths)


def _ids_of(column: pa.Array) -> list[np.ndarray]:
    """Ids of each row of ``column``: packed ones as ``_gather`` settles them, or those of texts."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return [np.append(np.frombuffer(word_ids().of_text(t or ""), "<u4"), END_ID) for t in column.to_pylist()]
    return [np.frombuffer(p, "<u2") for p in column.to_pylist()]


def _held(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The batch's training windows, about ``HELD`` at a time, and which of their places hold ids."""
    texts, k, n = _ids_of(batch.column(0)), 0, 0
    for upto, ids in enumerate(texts, 1):
        n += -(-len(ids) // SCORED)
        if n >= HELD or upto == len(texts):
            w, every = windows_of(texts[k:upto]), slice(None)
            yield w.ids(every), np.arange(-CONTEXT - 1, SCORED) < w.left(every)[:, None]
            k, n = upto, 0


def _fit_partition(state: np.ndarray, steps: int, classes: Classes, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _spelt().clear()
        learner, seen = Learner(state, steps, classes, seed), 0
        for batch in batches:
            for windows, valid in _held(batch):
                learner.fit(windows, valid)
                seen += len(windows)
        if seen:
            node = TaskContext.get().partitionId() % NODES
            columns = [pa.array([k], pa.int64()) for k in (node, seen, learner.steps)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([learner.state.tobytes()], pa.binary())], names=["node", "n", "steps", "state"])

    return run


def _average(group: pa.Table) -> pa.Table:
    """Mean state by number of windows; the steps are those of the partition that took most."""
    n, steps = group.column("n").to_numpy(), group.column("steps").to_numpy()
    mean: np.ndarray | int = 0
    for each, k in zip(group.column("state"), n, strict=True):
        mean = mean + np.frombuffer(each.as_py(), np.float32) * np.float32(k / n.sum())
    return pa.table({"n": [int(n.sum())], "steps": [int(steps.max())], "state": pa.array([mean.tobytes()], pa.binary())})


class Model(NamedTuple):
    weights: np.ndarray
    classes: Classes


def train(gathered: DataFrame, rounds: int = len(ROUNDS)) -> Model:
    """Classes from all id counts; the state is averaged over partitions after every round."""
    taught = gathered.where((F.col("kind") == _TEXT) & ~F.col("held_out"))
    counts = np.zeros(VOCABULARY_SIZE, np.int64)
    by_id = gathered.where(F.col("kind") == _ID).groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # of the vocabulary
    counts[by_id.column("key").to_numpy()] = by_id.column("n").to_numpy()
    name_of = word_ids().tokenizer.id_to_token
    closes = np.array([(name_of(k) or "").endswith("</w>") for k in range(VOCABULARY_SIZE)])
    classes, weights = frequency_classes(counts, closes), initial_weights()
    state, steps, done = np.stack([weights, np.zeros_like(weights), np.zeros_like(weights)]), 0, 0
    for turn, parts in enumerate(ROUNDS[:rounds]):
        share = taught.where((F.col("part") >= done) & (F.col("part") < done + parts)).select("ids")
        done += parts
        fitted = share.mapInArrow(_fit_partition(state, steps, classes, SEED + turn), "node long, n long, steps long, state binary")
        nodes = fitted.groupBy("node").applyInArrow(_average, "n long, steps long, state binary").toArrow()  # at most NODES rows
        if nodes.num_rows:
            mean = _average(nodes)
            state = np.frombuffer(mean.column("state")[0].as_py(), np.float32).reshape(3, -1)
            steps = mean.column("steps")[0].as_py()
    return Model(state[0], classes)


class Scorer:
    """A model with one embedding row per id, for scoring many windows."""

    def __init__(self, model: Model):
        self.w = w = _views(model.weights)
        self.folded = _folded(w)
        self.of_id, self.share = model.classes.of_id.astype(np.int32), model.classes.share
        every = np.arange(len(model.classes.of_id))
        self.embedded = w["bucket"][every % BUCKETS] + w["kind"][model.classes.of_id]
        self.room = Room(model.weights.dtype)

    def class_logs(self, ids: np.ndarray) -> np.ndarray:
        """log10 probability of the class of every scored target of windows of WINDOW + 1 ids."""
        n = len(ids)
        x = np.take(self.embedded, ids[:, :-1], axis=0, out=self.room("x", n, WINDOW, WIDTH), mode="clip")
        x += self.w["place"]
        logits = _forward(self.w, self.folded, x, self.room)[-1]
        targets = np.take(self.of_id, ids[:, CONTEXT + 1 :]).ravel()
        chosen = np.take(logits, np.arange(n * SCORED) * CLASSES + targets) + np.take(self.w["bias"], targets)
        chosen -= np.log(_exp(logits) @ self.folded.lift)
        return chosen.reshape(n, SCORED) / np.log(10)

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text of ids, which is closed by the end id."""
        w = windows_of(texts)
        value = np.zeros(len(w.at))
        for k in range(0, len(value), BLOCK):
            some = slice(k, k + BLOCK)
            ids = w.ids(some)
            each = self.class_logs(ids) + np.take(self.share, ids[:, CONTEXT + 1 :])
            each[np.arange(SCORED) >= w.left(some)[:, None]] = 0
            value[some] = each.sum(1)
        return np.bincount(w.text, weights=value, minlength=len(texts))


class Logged(Numbers):
    """Numbered words with log10(count + 1), or NaN for a rare word."""

    def __init__(self, common: np.ndarray, common_logs: np.ndarray):
        super().__init__()
        self.common, self.common_logs = common, common_logs

    def clear(self) -> None:
        super().clear()
        self.logs = array("d")

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and logs of all numbers; the words met since the last call are looked up together."""
        keys, k = np.array(self.keys, np.int64), len(self.logs)
        if k < len(keys):
            found = np.full(len(keys) - k, np.nan)
            if len(self.common):
                at = np.minimum(np.searchsorted(self.common, keys[k:]), len(self.common) - 1)
                hit = self.common[at] == keys[k:]
                found[hit] = self.common_logs[at[hit]]
            self.logs.frombytes(found.tobytes())
        return keys, np.array(self.logs)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(np.int64)))


def _score(model: Model, keys: np.ndarray, logs: np.ndarray):
    """Rows with the model's score, the base parts of common words, and the rare words' keys and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _spelt().clear()
        table_, scorer = Logged(keys, logs), Scorer(model)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in _parts(batch, 2):
                if table_.full():
                    table_.clear()
                numbers, sizes = table_.of(part.column(2))
                word_keys, word_logs = table_.columns()
                found, starts = word_logs[numbers], np.cumsum(sizes) - sizes
                lacks = np.isnan(found)
                found[lacks] = 0
                rare, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[lacks] << 32 | numbers[lacks], return_counts=True)
                ends = np.searchsorted(rare, np.arange(1, len(sizes) + 1) << 32)
                rows = np.arange(row, row + part.num_rows)
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), part.column(0), part.column(1), pa.array(sizes), pa.array(sizes - np.add.reduceat(lacks.astype(np.int64), starts)),
                     pa.array(np.add.reduceat(found, starts)), pa.array(scorer.log10(_ids_of(part.column(3)))),
                     _lists(word_keys[rare & 0xFFFFFFFF], ends), _lists(times, ends)],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "times"],
                )

    return run


_SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, "
    "rare array<long>, times array<long>"
)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = len(ROUNDS)) -> DataFrame:
    """Base and model scores of every document, learnt from those not held out."""
    part = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(sum(ROUNDS))).cast("byte").alias("part")
    picked = docs.select(
        F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out")
    ).select("text", "doc_id", "held_out", part)
    gathered = settle(picked.mapInArrow(_gather, _GATHERED), "gathered", codec="zstd")
    counts = settle(gathered.where(F.col("kind") == _WORD).groupBy("key").agg(F.sum("n").alias("c")), "counts")
    bits = counts.groupBy(F.length(F.bin("c")).alias("bits")).agg(F.count("*").alias("n"), F.sum("c").alias("total"))
    by_bits = sorted(bits.collect(), reverse=True)  # at most 63 rows
    total, distinct, common, least = sum(r["total"] for r in by_bits), sum(r["n"] for r in by_bits), 0, 1 << 62
    for r in by_bits:
        common += r["n"]
        if common > COMMON_WORDS:
            break
        least = 1 << (r["bits"] - 1)
    table_ = counts.where(F.col("c") >= least).toArrow()  # at most COMMON_WORDS rows
    keys, values = table_.column("key").to_numpy(), table_.column("c").to_numpy()
    order = np.argsort(keys)
    run = _score(train(gathered, rounds), keys[order], np.log10(values[order] + 1.0))
    texts = gathered.where(F.col("kind") == _TEXT).select("doc_id", "held_out", "text", "ids")
    scored = settle(texts.mapInArrow(run, _SCORED), "scored")

    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
        "row", F.col("w.rare").alias("key"), F.col("w.times").alias("times")
    )
    rare = rare.join(counts, "key").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("logs")
    )
    each = float(np.log10(total + distinct + 1.0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
        "score",
    )


def op8_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op8_attention_lm": op8_attention_lm}
