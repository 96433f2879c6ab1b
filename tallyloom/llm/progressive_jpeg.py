"""Media columns as progressive JPEG, coded and decoded with numpy for many images at a time.

Decoding accumulates spectral-selection and successive-approximation scans into
coefficient arrays. A scan is cut into the segments between its restart markers,
and the segments of all images of a batch are decoded side by side: every step
reads one Huffman code of each segment. Coefficients then go through an exact
integer inverse transform, chroma is upsampled to full resolution and the result
is an RGB tensor.

Payloads are stored in the format's own unit, the quantised coefficient: byte b
of a payload is the coefficient ``int8(b - 96)``, 64 to a block in zigzag order,
blocks in the raster order of Y, Cb and Cr (4:2:0). Reading the scans back gives
the payload bit by bit; a comment holds its length.

Memory: texts are taken in chunks of ``CHUNK_BYTES``; within a chunk, or within
one longer text, segments are coded and blocks transformed in groups of fixed
size, so that only the text's own bytes, coefficients and tensor (about ten times
the text) are held whole.

Defined cases: null and empty texts are 64 zero bytes; null ids and repeated rows
pass as they are; extra columns, also of clashing names, do not matter; an empty
table gives an empty result; a broken stream raises ``ValueError``.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import table

BLOCK = 64
#: Added to a coefficient to give its byte: lower-case letters become small numbers.
CENTRE = 96
#: Payload bytes of the texts that are taken together.
CHUNK_BYTES = 3_000_000
#: Blocks coded, transformed or put into one tensor band at a time, and blocks decoded at a time.
CODED_BLOCKS, DECODED_BLOCKS = 8_192, 65_536
#: Images of at most so many blocks have their scan orders remembered.
SMALL_IMAGE = 1_024


class Script(NamedTuple):
    """One scan: components, spectral band, high and low bit of the approximation, restart interval."""

    components: tuple[int, ...]
    first: int
    last: int
    high: int
    low: int
    restart: int


#: DC and the low AC band of Y come in two approximations, the other bands in one scan.
SCRIPT = (
    Script((0, 1, 2), 0, 0, 0, 1, 32),
    Script((0,), 1, 5, 0, 1, 64),
    Script((0,), 6, 63, 0, 0, 8),
    Script((1,), 1, 63, 0, 0, 8),
    Script((2,), 1, 63, 0, 0, 8),
    Script((0,), 1, 5, 1, 0, 64),
    Script((0, 1, 2), 0, 0, 1, 0, 32),
)
#: Widest band that the encoder refines: no zero run can reach 16.
WIDEST_REFINED = 16


def zigzag() -> np.ndarray:
    """Raster position of each coefficient in zigzag order."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([y * 8 + x for y, x in cells])


ZIGZAG = zigzag()


class Huffman:
    """Codes of a table given as counts by length and symbols, for both directions."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.counts, self.symbols = counts, symbols
        self.code, self.length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        # A 16-bit look-up: symbol above bit 5, code length below.
        self.lookup = np.zeros(1 << 16, np.int64)
        code = at = 0
        for length, n in enumerate(counts, 1):
            for symbol in symbols[at : at + n]:
                self.code[symbol], self.length[symbol] = code, length
                self.lookup[code << (16 - length) : (code + 1) << (16 - length)] = symbol << 5 | length
                code += 1
            at += n
            code <<= 1

    @classmethod
    def of_lengths(cls, lengths: dict[int, int]) -> Huffman:
        ordered = sorted(lengths, key=lambda s: (lengths[s], s))
        counts = bytes(sum(v == k for v in lengths.values()) for k in range(1, 17))
        return cls(counts, bytes(ordered))


@cache
def stock_tables() -> dict[str, Huffman]:
    """Tables for text-like coefficients; every symbol that 8-bit coefficients can need has a code."""
    plain = {4: 2, 5: 2, 3: 3, 7: 3, 1: 4, 2: 4, 6: 5, 8: 6}
    first = {run << 4 | size: plain[size] if run == 0 else 11 for run in range(16) for size in range(1, 9)}
    first |= {0xF0: 11} | {run << 4: 11 for run in range(15)}
    refine = {run << 4 | 1: 3 if run < 3 else 7 for run in range(16)}
    refine |= {0xF0: 7, 0x00: 3} | {run << 4: 7 for run in range(1, 15)}
    return {"dc": Huffman.of_lengths(dict.fromkeys(range(12), 4)), "ac": Huffman.of_lengths(first), "refine": Huffman.of_lengths(refine)}


def _scan_order(mcus: tuple[int, int], shapes: tuple[tuple[int, ...], ...], chosen: tuple[int, ...]) -> tuple[np.ndarray, int]:
    if len(chosen) == 1:
        _, _, base, stride, _, wide, high = shapes[chosen[0]]
        return (base + np.arange(high)[:, None] * stride + np.arange(wide)).ravel(), 1
    parts = []
    for h, v, base, stride, lines, _, _ in (shapes[k] for k in chosen):
        at = base + np.arange(lines)[:, None] * stride + np.arange(stride)
        parts.append(at.reshape(mcus[0], v, mcus[1], h).transpose(0, 2, 1, 3).reshape(-1, v * h))
    joined = np.concatenate(parts, 1)
    return joined.ravel(), joined.shape[1]


_small_scan_order = lru_cache(2048)(_scan_order)


@dataclass
class Component:
    name: int
    h: int
    v: int
    quantiser: int
    base: int = 0
    stride: int = 0
    lines: int = 0
    wide: int = 0
    high: int = 0


@dataclass
class Frame:
    """Sizes of an image and where its components' blocks lie in the batch's coefficient array."""

    width: int
    height: int
    components: list[Component]
    mcus: tuple[int, int] = (0, 0)
    blocks: int = 0

    def place(self, base: int) -> int:
        h, v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.mcus = (-(-self.height // (8 * v)), -(-self.width // (8 * h)))
        start = base
        for c in self.components:
            c.base, c.stride, c.lines = base, self.mcus[1] * c.h, self.mcus[0] * c.v
            c.wide = -(-(-(-self.width * c.h // h)) // 8)
            c.high = -(-(-(-self.height * c.v // v)) // 8)
            base += c.stride * c.lines
        self.blocks = base - start
        return base

    def order(self, chosen: tuple[int, ...]) -> tuple[np.ndarray, int]:
        """Blocks in the order of a scan over the chosen components, and blocks per MCU."""
        shapes = tuple((c.h, c.v, c.base - self.components[0].base, c.stride, c.lines, c.wide, c.high) for c in self.components)
        order, each = (_small_scan_order if self.blocks <= SMALL_IMAGE else _scan_order)(self.mcus, shapes, chosen)
        return order + self.components[0].base, each

    def slots(self, chosen: tuple[int, ...]) -> np.ndarray:
        """Index into ``chosen`` of each block of an MCU."""
        return np.repeat(np.arange(len(chosen)), [self.components[k].h * self.components[k].v for k in chosen])


def _size(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def _magnitude(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.where(values < 0, values + (1 << sizes) - 1, values)


class Segments(NamedTuple):
    """Scan order over a batch: blocks, the segment of each, first block and count of each segment."""

    order: np.ndarray
    of_block: np.ndarray
    first: np.ndarray
    count: np.ndarray
    by_image: list[int]


def _segments(scans: list[tuple[Frame, Scan]]) -> Segments:
    orders, counts, by_image = [], [], []
    for frame, scan in scans:
        order, each = frame.order(scan.script.components)
        step = scan.script.restart * each if scan.script.restart else len(order)
        n = -(-len(order) // step)
        orders.append(order)
        counts += [step] * (n - 1) + [len(order) - step * (n - 1)]
        by_image.append(n)
    count = np.array(counts, np.int64)
    return Segments(np.concatenate(orders), np.repeat(np.arange(len(count)), count), np.cumsum(count) - count, count, by_image)


def _groups(s: Segments, most: int) -> Iterator[tuple[int, int, Segments]]:
    """Runs of segments with at most ``most`` blocks (or one segment): first and last one's number, and the run itself."""
    ends, a = np.cumsum(s.count), 0
    while a < len(s.count):
        begin = int(s.first[a])
        b = max(a + 1, int(np.searchsorted(ends, begin + most, side="right")))
        cut = slice(begin, int(ends[b - 1]))
        yield a, b, Segments(s.order[cut], s.of_block[cut] - a, s.first[a:b] - begin, s.count[a:b], [])
        a = b


def _pack_bits(segment: np.ndarray, values: np.ndarray, lengths: np.ndarray, n: int) -> list[bytes]:
    """Bytes of ``n`` segments from codes of up to 32 bits in order, padded with ones, stuffed."""
    bits = np.bincount(segment, weights=lengths, minlength=n).astype(np.int64)
    pad = -bits % 8
    at = np.searchsorted(segment, np.arange(n), side="right")
    values = np.insert(values, at, (1 << pad) - 1).astype(np.uint64)
    lengths = np.insert(lengths, at, pad)
    kept = lengths > 0
    values, lengths = values[kept], lengths[kept]
    offset = np.cumsum(lengths) - lengths
    words = np.zeros(int(lengths.sum()) // 32 + 2, np.uint32)
    word, room = offset >> 5, 64 - (offset & 31) - lengths
    wide = values << room.astype(np.uint64)
    if len(word):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[starts]] = np.bitwise_or.reduceat((wide >> np.uint64(32)).astype(np.uint32), starts)
        over = np.flatnonzero(room < 32)
        words[word[over] + 1] |= (wide[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    data = words.byteswap().tobytes()
    ends = np.cumsum((bits + pad) // 8).tolist()
    return [data[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _encode_dc(coefficients: np.ndarray, frames: list[Frame], scan: Script, s: Segments, table_: Huffman) -> list[bytes]:
    values = coefficients[s.order, 0].astype(np.int64) >> scan.low
    if scan.high:
        return _pack_bits(s.of_block, values & 1, np.ones(len(values), np.int64), len(s.count))
    slots = frames[0].slots(scan.components)
    slot = slots[(np.arange(len(values)) - s.first[s.of_block]) % len(slots)]
    by_slot = np.lexsort((np.arange(len(values)), slot, s.of_block))
    sorted_ = values[by_slot]
    fresh = np.concatenate([[True], (slot[by_slot][1:] != slot[by_slot][:-1]) | (s.of_block[by_slot][1:] != s.of_block[by_slot][:-1])])
    before = np.where(fresh, 0, np.concatenate([[0], sorted_[:-1]]))
    difference = np.empty_like(values)
    difference[by_slot] = sorted_ - before
    sizes = _size(difference)
    codes = table_.code[sizes] << sizes | _magnitude(difference, sizes)
    return _pack_bits(s.of_block, codes, table_.length[sizes] + sizes, len(s.count))


def _encode_ac_first(coefficients: np.ndarray, scan: Script, s: Segments, table_: Huffman) -> list[bytes]:
    band = coefficients[s.order, scan.first : scan.last + 1].astype(np.int64)
    if scan.low:
        band = np.sign(band) * (np.abs(band) >> scan.low)
    row, column = np.nonzero(band)
    values = band[row, column]
    fresh = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    run = column - np.where(fresh, -1, np.concatenate([[0], column[:-1]])[: len(column)]) - 1
    sizes = _size(values)
    symbols = (run & 15) << 4 | sizes
    codes, lengths = table_.code[symbols] << sizes | _magnitude(values, sizes), table_.length[symbols] + sizes
    if len(run) and run.max() > 15:
        long_runs = np.repeat(np.arange(len(run)), run >> 4)
        codes = np.insert(codes, long_runs, table_.code[0xF0])
        lengths = np.insert(lengths, long_runs, table_.length[0xF0])
        row = np.insert(row, long_runs, row[long_runs])
    # Blocks that end in zeros; an empty block goes on with the run of the block before it.
    last = np.full(len(band), -1)
    np.maximum.at(last, row[: len(row)], 0)
    filled = np.zeros(len(band), bool)
    filled[row] = True
    ends_empty = band[:, -1] == 0
    goes_on = ~filled & ends_empty & np.concatenate([[False], ends_empty[:-1]])
    goes_on[s.first] = False
    heads = np.flatnonzero(ends_empty & ~goes_on)
    if len(heads):
        stops = np.flatnonzero(np.concatenate([~goes_on, [True]]))
        runs = stops[np.searchsorted(stops, heads, side="right")] - heads
        power = np.floor(np.log2(runs)).astype(np.int64)
        at = np.searchsorted(row, heads, side="right")
        codes = np.insert(codes, at, table_.code[power << 4] << power | (runs - (1 << power)))
        lengths = np.insert(lengths, at, table_.length[power << 4] + power)
        row = np.insert(row, at, heads)
    return _pack_bits(s.of_block[row], codes, lengths, len(s.count))


def _encode_ac_refine(coefficients: np.ndarray, scan: Script, s: Segments, table_: Huffman) -> list[bytes]:
    if scan.last - scan.first >= WIDEST_REFINED:
        raise ValueError("refined bands are at most 16 wide")
    band = coefficients[s.order, scan.first : scan.last + 1].astype(np.int64)
    size = np.abs(band) >> scan.low
    new, old = size == 1, size > 1
    group = np.cumsum(new, 1) - new
    empty = size == 0
    seen = np.cumsum(empty, 1) - empty
    new_row, new_column = np.nonzero(new)
    fresh = np.concatenate([[True], new_row[1:] != new_row[:-1]]) if len(new_row) else np.zeros(0, bool)
    total = seen[new_row, new_column]
    run = total - np.where(fresh, 0, np.concatenate([[0], total[:-1]])[: len(total)])
    symbols = run << 4 | 1
    old_row, old_column = np.nonzero(old)
    end_row = np.flatnonzero(~new[:, -1])
    parts = (
        (new_row, group[new_row, new_column] * 32, table_.code[symbols] << 1 | (band[new_row, new_column] > 0), table_.length[symbols] + 1),
        (old_row, group[old_row, old_column] * 32 + 1 + old_column, size[old_row, old_column] & 1, np.ones(len(old_row), np.int64)),
        (end_row, new.sum(1)[end_row] * 32, np.full(len(end_row), table_.code[0]), np.full(len(end_row), table_.length[0])),
    )
    row, place, codes, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row * 1024 + place, kind="stable")
    return _pack_bits(s.of_block[row[order]], codes[order], lengths[order], len(s.count))


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def encode(payloads: list[bytes], script: tuple[Script, ...] = SCRIPT) -> list[bytes]:
    """A progressive JPEG for every payload (a positive multiple of 64 bytes)."""
    frames, base, blocks = [], 0, []
    for payload in payloads:
        mcus = -(-len(payload) // (6 * BLOCK))
        wide = int(np.ceil(np.sqrt(mcus)))
        frame = Frame(16 * wide, 16 * -(-mcus // wide), [Component(1, 2, 2, 0), Component(2, 1, 1, 0), Component(3, 1, 1, 0)])
        base = frame.place(base)
        frames.append(frame)
        filled = np.zeros(frame.blocks * BLOCK, np.int16)
        filled[: len(payload)] = (np.frombuffer(payload, np.uint8) - np.uint8(CENTRE)).view(np.int8)
        blocks.append(filled)
    coefficients = np.concatenate(blocks).reshape(-1, BLOCK)
    tables = stock_tables()
    define = b"".join(bytes([kind]) + t.counts + t.symbols for kind, t in ((0, tables["dc"]), (0x10, tables["ac"]), (0x11, tables["refine"])))
    files = []
    for frame, payload in zip(frames, payloads, strict=True):
        parts = b"".join(bytes([c.name, c.h << 4 | c.v, c.quantiser]) for c in frame.components)
        files.append([
            b"\xff\xd8", _marker(0xFE, b"payload %d" % len(payload)), _marker(0xDB, b"\0" + b"\1" * 64),
            _marker(0xC2, struct.pack(">BHHB", 8, frame.height, frame.width, len(frame.components)) + parts), _marker(0xC4, define),
        ])
    for scan in script:
        s = _segments([(frame, Scan(scan, [], None, [])) for frame in frames])
        cut: list[bytes] = []
        for _, _, part in _groups(s, CODED_BLOCKS):
            if scan.first == 0:
                cut += _encode_dc(coefficients, frames, scan, part, tables["dc"])
            elif scan.high:
                cut += _encode_ac_refine(coefficients, scan, part, tables["refine"])
            else:
                cut += _encode_ac_first(coefficients, scan, part, tables["ac"])
        ac = 1 if scan.high and scan.first else 0
        head = bytes([len(scan.components)]) + b"".join(bytes([frames[0].components[c].name, ac]) for c in scan.components)
        head = _marker(0xDD, struct.pack(">H", scan.restart)) + _marker(0xDA, head + bytes([scan.first, scan.last, scan.high << 4 | scan.low]))
        at = 0
        for out, n in zip(files, s.by_image, strict=True):
            out.append(head)
            for k in range(n):
                out += (cut[at + k], bytes([0xFF, 0xD0 + k % 8])) if k < n - 1 else (cut[at + k],)
            at += n
    return [b"".join([*out, b"\xff\xd9"]) for out in files]


@dataclass
class Scan:
    script: Script
    dc: list[Huffman]
    ac: Huffman | None
    segments: list[bytes]


@dataclass
class Parsed:
    frame: Frame | None = None
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


@cache
def _huffman(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


def parse(data: bytes) -> Parsed:
    """Markers of a progressive JPEG, with the entropy-coded segments of its scans."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    out, tables, restart, at = Parsed(), {}, 0, 2
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("marker expected")
        code = data[at + 1]
        if code == 0xD9:
            return out
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if code == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                values = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int64)
                out.quantisers[body[k] & 15] = values
                k += 65 + 64 * bool(wide)
        elif code == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                n = sum(counts)
                tables[body[k]] = _huffman(counts, body[k + 17 : k + 17 + n])
                k += 17 + n
        elif code == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [body[6 + 3 * k : 9 + 3 * k] for k in range(n)]
            out.frame = Frame(width, height, [Component(p[0], p[1] >> 4, p[1] & 15, p[2]) for p in parts])
        elif code == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif code == 0xFE:
            out.comment = body
        elif code == 0xDA:
            n = body[0]
            names = [c.name for c in out.frame.components]
            chosen = tuple(names.index(body[1 + 2 * k]) for k in range(n))
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            if not (found := _SCAN_END.search(data, at)):
                raise ValueError("scan without end")
            raw, at = data[at : found.start()], found.start()
            pieces = [p.replace(b"\xff\x00", b"\xff") for p in _RESTART.split(raw)]
            dc = [tables.get(body[2 + 2 * k] >> 4) for k in range(n)]
            script = Script(chosen, first, last, bits >> 4, bits & 15, restart)
            out.scans.append(Scan(script, dc, tables.get(0x10 | body[2] & 15), pieces))
        elif 0xC0 <= code <= 0xCF:
            raise ValueError("not a progressive JPEG")


class _Bits:
    """Segments' bytes in one buffer, with the 64 bits from each byte on."""

    def __init__(self, segments: list[bytes]):
        data = np.frombuffer(b"".join(segments) + bytes(8), np.uint8)
        n = len(data) - 7
        self.words = np.zeros(n, np.uint64)
        for k in range(8):
            self.words |= data[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
        sizes = np.array([len(x) for x in segments], np.int64)
        self.starts = (np.cumsum(sizes) - sizes) * 8

    def window(self, at: np.ndarray) -> np.ndarray:
        """The (at least 57) bits from bit ``at`` on, left-aligned."""
        try:
            return self.words[at >> 3] << (at & 7).astype(np.uint64)
        except IndexError:
            raise ValueError("segment too short") from None


_ONE = np.uint64(1)


def _take(window: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first ``n`` bits (0 to 16 of them) of each window."""
    return ((window >> _ONE) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _code(window: np.ndarray, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = lookup[(window >> np.uint64(48)).astype(np.int64)]
    length = found & 31
    if not length.all():
        raise ValueError("no such code")
    return found >> 5, length


def _signed(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    return extra - np.where(extra < (1 << size) >> 1, (1 << size) - 1, 0)


def _decode_dc(bits: _Bits, coefficients: np.ndarray, scan: Scan, s: Segments, slots: np.ndarray) -> None:
    low = scan.script.low
    if scan.script.high:
        at = bits.starts[s.of_block] + np.arange(len(s.order)) - s.first[s.of_block]
        coefficients[s.order, 0] |= ((bits.window(at) >> np.uint64(63)).astype(np.int16) << low).astype(np.int16)
        return
    at, seen = bits.starts.copy(), np.zeros((len(s.count), len(scan.dc)), np.int64)
    live = np.arange(len(s.count))
    for step in range(int(s.count.max())):
        live = live[s.count[live] > step]
        slot = slots[step % len(slots)]
        window = bits.window(at[live])
        size, length = _code(window, scan.dc[slot].lookup)
        extra = _take(window << length.astype(np.uint64), size)
        at[live] += length + size
        seen[live, slot] += _signed(extra, size)
        coefficients[s.order[s.first[live] + step], 0] = seen[live, slot] << low


def _decode_ac_first(bits: _Bits, flat: np.ndarray, scan: Scan, s: Segments) -> None:
    first, last, low = scan.script.first, scan.script.last, scan.script.low
    lookup = scan.ac.lookup
    at, block, end = bits.starts.copy(), s.first.copy(), s.first + s.count
    k = np.full(len(at), first)
    while len(at):
        window = bits.window(at)
        symbol, length = _code(window, lookup)
        run, size = symbol >> 4, symbol & 15
        ends = (size == 0) & (run < 15)
        some_end = ends.any()
        extra_bits = np.where(ends, run, size) if some_end else size
        extra = _take(window << length.astype(np.uint64), extra_bits)
        at += length + extra_bits
        k += run
        filled = size > 0
        place = s.order[block] * BLOCK + k
        value = _signed(extra, size) << low
        if filled.all():
            if k.max() > 63:
                raise ValueError("coefficient outside the block")
            flat[place] = value
        else:
            if k[filled].max(initial=0) > 63:
                raise ValueError("coefficient outside the block")
            flat[place[filled]] = value[filled]
        k += 1
        done = k > last
        if some_end:
            done |= ends
            block[ends] += (1 << run[ends]) + extra[ends] - 1
        if done.any():
            block += done
            k[done] = first
            live = block < end
            if not live.all():
                at, block, end, k = at[live], block[live], end[live], k[live]


def _decode_ac_refine(bits: _Bits, flat: np.ndarray, scan: Scan, s: Segments) -> None:
    """One coefficient of each segment a step. A segment reads a code (0), fills a run (1) or ends blocks (2)."""
    first, last = scan.script.first, scan.script.last
    one = 1 << scan.script.low
    lookup = scan.ac.lookup
    at, block, end = bits.starts.copy(), s.first.copy(), s.first + s.count
    k, state = np.full(len(at), first), np.zeros(len(at), np.int64)
    run, new, blocks = np.zeros_like(k), np.zeros_like(k), np.zeros_like(k)
    while len(at):
        asks = np.flatnonzero(state == 0)
        if len(asks):
            window = bits.window(at[asks])
            symbol, length = _code(window, lookup)
            zeros, size = symbol >> 4, symbol & 15
            stops = (size == 0) & (zeros < 15)
            n = np.where(stops, zeros, (size > 0).astype(np.int64))
            extra = _take(window << length.astype(np.uint64), n)
            at[asks] += length + n
            state[asks] = np.where(stops, 2, 1)
            blocks[asks] = np.where(stops, (1 << zeros) + extra, 0)
            run[asks] = zeros
            new[asks] = np.where(size > 0, np.where(extra > 0, one, -one), 0)
        place = s.order[block] * BLOCK + k
        held = flat[place].astype(np.int64)
        old = held != 0
        bit = (bits.window(at) >> np.uint64(63)).astype(np.int64)
        grown = old & (bit > 0) & ((np.abs(held) & one) == 0)
        fills = ~old & (state == 1) & (run == 0)
        at += old
        flat[place] = held + np.where(grown, np.sign(held) * one, 0) + np.where(fills, new, 0)
        run -= ~old & (state == 1)
        state[fills] = 0
        k += 1
        done = k > last
        block += done
        k[done] = first
        blocks -= done & (state == 2)
        state[done & ((state == 1) | (blocks == 0))] = 0
        live = block < end
        if not live.all():
            at, block, end, k, state, run, new, blocks = (x[live] for x in (at, block, end, k, state, run, new, blocks))


def _waves(image: Parsed) -> list[list[Scan]]:
    """Scans that follow each other and differ in their one component only: they touch different blocks."""
    out: list[list[Scan]] = []
    for scan in image.scans:
        last = out[-1][-1] if out else None
        joins = (
            last is not None and len(scan.script.components) == len(last.script.components) == 1
            and scan.script[1:] == last.script[1:] and scan.ac is last.ac and scan.script.first
            and all(x.script.components != scan.script.components for x in out[-1])
        )
        out[-1].append(scan) if joins else out.append([scan])
    return out


def coefficients_of(images: list[Parsed]) -> np.ndarray:
    """Blocks by 64 coefficients in zigzag order; equal scans of different images are decoded together."""
    base = 0
    for image in images:
        if image.frame is None:
            raise ValueError("no frame")
        base = image.frame.place(base)
    out = np.zeros((base, BLOCK), np.int16)
    flat = out.reshape(-1)
    waves = [_waves(x) for x in images]
    for turn in range(max(map(len, waves), default=0)):
        alike: dict[tuple, list[tuple[Frame, Scan]]] = {}
        for image, own in zip(images, waves, strict=True):
            for scan in own[turn] if turn < len(own) else ():
                slots = tuple(image.frame.slots(scan.script.components)) if scan.script.first == 0 else ()
                key = (scan.script[1:5], tuple(map(id, scan.dc)) if scan.script.first == 0 else (), id(scan.ac), slots)
                alike.setdefault(key, []).append((image.frame, scan))
        for key, group in alike.items():
            scans = [x for _, x in group]
            s = _segments(group)
            if any(len(x.segments) != n for x, n in zip(scans, s.by_image, strict=True)):
                raise ValueError("restart markers missing")
            pieces = [piece for x in scans for piece in x.segments]
            for a, b, part in _groups(s, DECODED_BLOCKS):
                bits = _Bits(pieces[a:b])
                if scans[0].script.first == 0:
                    _decode_dc(bits, out, scans[0], part, np.array(key[3]))
                elif scans[0].script.high:
                    _decode_ac_refine(bits, flat, scans[0], part)
                else:
                    _decode_ac_first(bits, flat, scans[0], part)
    return out


_BASIS_BITS = 11


def _basis() -> np.ndarray:
    """Rows are frequencies; integers, so that sums in doubles are exact."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    scale = np.where(u == 0, np.sqrt(0.125), 0.5)
    return np.round(scale * np.cos((2 * x + 1) * u * np.pi / 16) * (1 << _BASIS_BITS))


def samples_of(coefficients: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """8 by 8 samples (0 to 255) of each block; the same block gives the same samples in any batch."""
    basis = _basis()
    out = np.empty((len(coefficients), 8, 8), np.uint8)
    for k in range(0, len(coefficients), CODED_BLOCKS):
        part = coefficients[k : k + CODED_BLOCKS]
        raster = np.zeros((len(part), BLOCK))
        raster[:, ZIGZAG] = part * quantiser
        rows = (raster.reshape(-1, 8) @ basis).reshape(-1, 8, 8)
        both = (rows.transpose(0, 2, 1).reshape(-1, 8) @ basis).reshape(-1, 8, 8).transpose(0, 2, 1)
        out[k : k + CODED_BLOCKS] = np.clip(np.floor(both / (1 << 2 * _BASIS_BITS) + 0.5) + 128, 0, 255)
    return out


def samples_by_block(images: list[Parsed], coefficients: np.ndarray) -> np.ndarray:
    """Samples of all blocks of a batch, each with its component's quantiser."""
    tables: dict[bytes, list[slice]] = {}
    for image in images:
        for c in image.frame.components:
            tables.setdefault(image.quantisers[c.quantiser].tobytes(), []).append(slice(c.base, c.base + c.stride * c.lines))
    if len(tables) == 1:
        return samples_of(coefficients, np.frombuffer(next(iter(tables)), np.int64))
    out = np.zeros((len(coefficients), 8, 8), np.uint8)
    for quantiser, parts in tables.items():
        blocks = np.concatenate([np.arange(p.start, p.stop) for p in parts])
        out[blocks] = samples_of(coefficients[blocks], np.frombuffer(quantiser, np.int64))
    return out


def rgb_of(image: Parsed, samples: np.ndarray) -> np.ndarray:
    """Full-resolution tensor (height, width, 3) of bytes; chroma samples are repeated."""
    frame = image.frame
    h, v = max(c.h for c in frame.components), max(c.v for c in frame.components)
    planes = []
    for c in frame.components:
        plane = samples[c.base : c.base + c.stride * c.lines].reshape(c.lines, c.stride, 8, 8)
        plane = plane.transpose(0, 2, 1, 3).reshape(c.lines * 8, c.stride * 8)
        if (v, h) != (c.v, c.h):
            plane = plane.repeat(v // c.v, 0).repeat(h // c.h, 1)
        planes.append(plane[: frame.height, : frame.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2)
    out = np.empty((frame.height, frame.width, 3), np.uint8)
    step = max(1, CODED_BLOCKS * BLOCK // max(1, frame.width))
    for top in range(0, frame.height, step):
        band = slice(top, top + step)
        y, cb, cr = (p[band].astype(np.int32) for p in planes)
        y, cb, cr = (y << 16) + (1 << 15), cb - 128, cr - 128
        # The format's colour conversion, times 2 ** 16.
        for k, colour in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
            out[band, :, k] = np.clip(colour >> 16, 0, 255)
    return out


def payload_of(image: Parsed, coefficients: np.ndarray) -> bytes:
    """The bytes that ``encode`` stored."""
    first = image.frame.components[0].base
    n = int(image.comment.split()[1])
    stored = coefficients[first : first + image.frame.blocks].ravel()[:n]
    return (stored.astype(np.uint8) + np.uint8(CENTRE)).tobytes()


def decode(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """Payload and RGB tensor of each file."""
    images = [parse(f) for f in files]
    coefficients = coefficients_of(images)
    samples = samples_by_block(images, coefficients)
    return [(payload_of(x, coefficients), rgb_of(x, samples)) for x in images]


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def pad(text: str) -> bytes:
    return padded(text.encode())


def _chunks(batch: pa.RecordBatch, column: int, size_of) -> Iterator[tuple[slice, list]]:
    """Rows of a batch in runs whose values reach ``CHUNK_BYTES`` at their last row."""
    start, total, held = 0, 0, []
    for k, value in enumerate(batch.column(column)):
        held.append(size_of(value.as_py()))
        total += len(held[-1])
        if total >= CHUNK_BYTES:
            yield slice(start, k + 1), held
            start, total, held = k + 1, 0, []
    if held:
        yield slice(start, start + len(held)), held


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, payloads in _chunks(batch, 1, lambda t: pad(t or "")):
            ids = batch.column(0).slice(rows.start, len(payloads))
            yield pa.RecordBatch.from_arrays([ids, pa.array(encode(payloads), pa.binary())], names=["doc_id", "media"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): every whole text as a progressive JPEG."""
    return _texts(docs, id_col, text_col).mapInArrow(_encode, "doc_id long, media binary")


#: What decoding gives: the bytes stored, and the full-resolution tensor row by row, three bytes a pixel, with its sums by colour.
TENSOR = "payload binary, height int, width int, rgb binary, red long, green long, blue long"


def _decoded(files: list[bytes]) -> list[pa.Array]:
    rows = []
    for payload, rgb in decode(files):
        rows.append((payload, *rgb.shape[:2], rgb.tobytes(), *rgb.reshape(-1, 3).sum(0, dtype=np.int64).tolist()))
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *_names(TENSOR)]
    for batch in batches:
        for rows, files in _chunks(batch, 1, bytes):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, len(files)), *_decoded(files)], names=names)


def decode_column(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, ``TENSOR``) of every stored medium."""
    picked = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return picked.mapInArrow(_tensors, f"doc_id long, {TENSOR}")


def _both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "media", *_names(TENSOR)]
    for batch in batches:
        for rows, texts in _chunks(batch, 1, lambda t: (t or "").encode()):
            files = encode([padded(t) for t in texts])
            ids = batch.column(0).slice(rows.start, len(files))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(files, pa.binary()), *_decoded(files)], names=names)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, ``TENSOR``): every text stored as media, and the media read back, in one pass."""
    return _texts(docs, id_col, text_col).mapInArrow(_both_ways, f"doc_id long, n_bytes long, media binary, {TENSOR}")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every text's media, of the payload read back from it, and of the RGB tensor (its size, sums by colour, checksum)."""
    checksum = F.lpad(F.lower(F.hex(F.crc32("rgb"))), 8, "0")
    return media_columns(docs, id_col, text_col).select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "red", "green", "blue", checksum).alias("feature"),
    )


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


QUERIES = {"op6_progressive_jpeg": op6_progressive_jpeg}
