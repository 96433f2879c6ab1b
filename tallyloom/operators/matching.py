"""Two-level one-to-one matching of statement lines with ledger rows.

Level 1 is the invoice number: if any free ledger row of the vendor has it, the
first one within tolerance matches, and without one the line is an amount
mismatch. Only lines without such a row try level 2, the repair-order number and
the amount. Within a statement lines go in ``seq`` order and use ledger rows up.

Lines and ledger rows that may affect each other are dealt to one group: those of a
vendor and repair order, or, without one, of a number; groups that a number connects
are one. A task streams over sorted groups. It holds a group's ledger rows, ordered by
amount under a tree of minima, and walks the lines statement by statement, so the
first free row within tolerance costs a logarithm of the group, however many rows
are near. No table of near pairs is made, and the work grows with lines and rows, not
with the square of a vendor's. Groups of more than ``LINES`` lines are dealt by
statement to several tasks, which hold the same ledger rows.

The number of either side is the normalised one where there is one, else the raw
one. Null and empty numbers, repair orders and amounts find nothing; lines without
any edge are missing invoices; an empty side gives exceptions only, or nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import config
from tallyloom.operators.components import component_labels
from tallyloom.sources.tables import forget, settle

MONEY = "decimal(18,2)"
LINE = ["statement_id", "seq"]
#: Lines of a group that one task walks.
LINES = 100_000


def within_tolerance(stmt: Column, ledger: Column) -> Column:
    """Difference at most the absolute tolerance, or at most the share of the statement amount; null is false."""
    gap = F.abs(stmt - ledger)
    share = F.lit(config.TOLERANCE_PCT).cast("decimal(4,2)") * F.abs(stmt)
    return F.coalesce((gap <= F.lit(config.TOLERANCE_ABS).cast(MONEY)) | (gap <= share), F.lit(False))


def amount_status(stmt: Column, ledger: Column) -> Column:
    exact = F.abs(stmt - ledger) <= F.lit(config.EXACT_EPSILON).cast("decimal(5,3)")
    return F.when(exact, "EXACT").otherwise("TOLERANCE")


def match_confidence(level: Column, stmt: Column, ledger: Column) -> Column:
    status = amount_status(stmt, ledger)
    out = F.lit(None).cast("double")
    for (number, kind), score in config.MATCH_CONFIDENCE.items():
        out = F.when((level == number) & (status == kind), score).otherwise(out)
    return F.when(level.isin(1, 2), out).when(level.isNotNull(), config.FUZZY_CONFIDENCE)


def tier_confidence(kind: Column, status: Column) -> Column:
    """Score of a kind of match (INVOICE, RO, PO, else fuzzy) and an amount status (EXACT, TOLERANCE, MISMATCH)."""
    named = {("INVOICE" if level == 1 else "RO", s): score for (level, s), score in config.MATCH_CONFIDENCE.items()} | config.OTHER_CONFIDENCE
    out = F.when(F.lit(False), config.FUZZY_CONFIDENCE)
    for (k, s), score in named.items():
        out = out.when((kind == k) & (status == s), score)
    return out.otherwise(config.FUZZY_CONFIDENCE)


def exception_confidence(reason: Column) -> Column:
    out = F.lit(config.DEFAULT_CONFIDENCE)
    for name, score in config.EXCEPTION_CONFIDENCE.items():
        out = F.when(reason == name, score).otherwise(out)
    return out


def _bucket(amount: Column) -> Column:
    """Rising step function whose steps are about as wide as the tolerance."""
    value = amount.cast("double")
    return F.floor(F.signum(value) * F.log1p(F.abs(value) / 50) * 100).cast("int")


def match_key(rows: DataFrame) -> Column:
    """The normalised invoice number, or the raw one where that is null or empty."""
    raw = F.col("invoice_number")
    normalised = F.nullif(F.col("invoice_number_normalized"), F.lit("")) if "invoice_number_normalized" in rows.columns else F.lit(None).cast("string")
    return F.nullif(F.coalesce(normalised, raw), F.lit(""))


def level1_edges(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """Lines with the vendor's ledger rows of the same invoice number, whatever the amount."""
    e = ledger.select(
        "vendor_id", match_key(ledger).alias("match_key"), "erp_seq", F.col("outstanding_amount").alias("erp_amount"),
        F.col("invoice_number").alias("erp_invoice"),
    )
    joined = lines.withColumn("match_key", match_key(lines)).join(e, ["vendor_id", "match_key"])
    return joined.select(
        *LINE, F.lit(1).alias("level"), "erp_seq", "erp_amount", "erp_invoice",
        within_tolerance(F.col("outstanding_amount"), F.col("erp_amount")).alias("ok"),
    )


def level2_edges(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """Lines with the vendor's ledger rows of the same repair order within tolerance."""
    amount = F.col("outstanding_amount")
    reach = F.greatest(
        F.lit(config.TOLERANCE_ABS).cast(MONEY), (F.abs(amount) * F.lit(config.TOLERANCE_PCT).cast("decimal(4,2)")).cast(MONEY) + F.lit("0.01").cast(MONEY)
    )
    usable = "ro_number is not null and ro_number <> '' and outstanding_amount is not null"
    near = lines.where(usable).withColumn(
        "bucket", F.explode(F.sequence(_bucket(amount - reach), _bucket(amount + reach)))
    )
    e = ledger.where(usable).select(
        "vendor_id", "ro_number", _bucket(amount).alias("bucket"), "erp_seq", amount.alias("erp_amount"),
        F.col("invoice_number").alias("erp_invoice"),
    )
    joined = near.join(e, ["vendor_id", "ro_number", "bucket"]).where(within_tolerance(amount, F.col("erp_amount")))
    return joined.select(*LINE, F.lit(2).alias("level"), "erp_seq", "erp_amount", "erp_invoice", F.lit(True).alias("ok"))


def _walk(statement: str, rows: list[tuple]) -> list[tuple]:
    """Decisions of connected lines of one statement, in order; ``rows``: seq, level, erp_seq, ok, erp_amount, erp_invoice."""
    used: set[int] = set()
    edges: dict[int, list[tuple]] = {}
    for seq, *edge in rows:
        edges.setdefault(seq, []).append(tuple(edge))
    out = []
    for seq in sorted(edges):
        free = sorted(e for e in edges[seq] if e[1] not in used)
        first = [e for e in free if e[0] == 1]
        pick = next((e for e in first or free if e[2]), None)
        if pick:
            used.add(pick[1])
            out.append((statement, seq, pick[0], None, pick[1], pick[3], pick[4]))
        else:
            out.append((statement, seq, None, "Amount Mismatch" if first else "Invoice Missing", None, first[0][3] if first else None, None))
    return out


_EDGE = ["seq", "level", "erp_seq", "ok", "erp_amount", "erp_invoice"]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks group after group of rows that stand together: statement, component, edge."""
    key, rows, out = None, [], []
    for batch in batches:
        for statement, component, *edge in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (statement, component):
                if rows:
                    out += _walk(key[0], rows)
                key, rows = (statement, component), []
            rows.append(edge)
        if len(out) > 10_000:
            yield _batch(out)
            out = []
    yield _batch(out + _walk(key[0], rows) if rows else out)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [[]] * len(_FOLDED)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOLDED, strict=True)], schema=_FOLDED)


def folded(edges: DataFrame) -> DataFrame:
    """Decisions of all lines of ``edges`` with statement_id and component; a task holds one component at a time."""
    near = edges.select("statement_id", "component", *_EDGE).repartition("statement_id", "component")
    return near.sortWithinPartitions("statement_id", "component").mapInArrow(_fold, _DECISION)


_FOLDED = pa.schema([
    ("statement_id", pa.string()), ("seq", pa.int64()), ("level", pa.int32()), ("reason", pa.string()), ("erp_seq", pa.int64()),
    ("erp_amount", pa.decimal128(18, 2)), ("erp_invoice", pa.string()),
])
_DECISION = f"statement_id string, seq long, level int, reason string, erp_seq long, erp_amount {MONEY}, erp_invoice string"


def _rows(edges: DataFrame) -> DataFrame:
    """Every ledger row that a statement's lines have edges to: its first line, and whether there is another."""
    return edges.groupBy("statement_id", "erp_seq").agg(F.min("seq").alias("head"), (F.min("seq") < F.max("seq")).alias("contested"))


def _line(seq: str) -> Column:
    return F.xxhash64("statement_id", seq)


def components(edges: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """(statement_id, seq, component) of the lines that contest a ledger row; each is linked to the row's first line."""
    rows = _rows(edges).where("contested").drop("contested")
    linked = edges.join(rows, ["statement_id", "erp_seq"]).select(*LINE, _line("seq").alias("a"), _line("head").alias("b"))
    made = [] if made is None else made
    contested = settle(linked.distinct(), "contested")
    made.append(contested)
    labels = component_labels(contested.select("a", "b"), "line-components", made)
    own = contested.select(*LINE, "a").distinct().join(labels, F.col("a") == F.col("node"), "left")
    return own.select(*LINE, F.coalesce("label", "a").alias("component"))


_NONE = 1 << 62
#: Rows of a number that are looked through one by one; more get a tree.
_FEW = 8
_ABS_CENTS, _PCT = int(Decimal(str(config.TOLERANCE_ABS)) * 100), int(Decimal(str(config.TOLERANCE_PCT)) * 100)


class _Rows:
    """Ledger rows by amount (those without one last), under a tree of minima of their places in ``erp_seq`` order."""

    def __init__(self, rows: list[int], ledger: _Ledger):
        self.rows, self.ledger = rows, ledger
        cents = [ledger.cents[row] for row in rows]
        order = sorted((c, place) for place, c in enumerate(cents) if c is not None)
        self.amounts = [c for c, _ in order]
        leaves = [place for _, place in order] + [place for place, c in enumerate(cents) if c is None]
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.leaf_of = dict(zip(leaves, range(self.size, self.size + len(leaves)), strict=True))
        self.tree = [_NONE] * self.size + leaves + [_NONE] * (self.size - len(leaves))
        for k in range(self.size - 1, 0, -1):
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])
        self.hidden: list[int] = []

    def _set(self, place: int, value: int) -> None:
        tree, k = self.tree, self.leaf_of[place]
        tree[k] = value
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def _least(self, a: int, z: int) -> int:
        tree, least, a, z = self.tree, _NONE, a + self.size, z + self.size
        while a < z:
            if a & 1:
                least = min(least, tree[a])
                a += 1
            if z & 1:
                z -= 1
                least = min(least, tree[z])
            a, z = a >> 1, z >> 1
        return least

    def first(self, used: set[int], low: int | None = None, high: int | None = None) -> int | None:
        """First free row by ``erp_seq``, of all or of those with amounts from ``low`` to ``high``."""
        a, z = (0, len(self.rows)) if low is None else (bisect_left(self.amounts, low), bisect_right(self.amounts, high))
        while (place := self._least(a, z)) != _NONE:
            row = self.rows[place]
            if self.ledger.seqs[row] not in used:
                return row
            if not self.hidden:
                self.ledger.touched.append(self)
            self.hidden.append(place)
            self._set(place, _NONE)
        return None

    def restore(self) -> None:
        for place in self.hidden:
            self._set(place, place)
        self.hidden = []


class _Ledger:
    """Ledger rows of a group, added in ``erp_seq`` order, and what the lines of one statement have used of them."""

    def __init__(self) -> None:
        self.seqs: list[int] = []
        self.cents: list[int | None] = []
        self.invoices: list[str | None] = []
        self.numbers: dict[tuple, list[int] | _Rows] = {}
        self.orders: dict[tuple, list[int] | _Rows] = {}
        self.used: set[int] = set()
        self.touched: list[_Rows] = []

    def add(self, seq: int, vendor: str, number: str | None, order: str | None, cents: int | None, invoice: str | None) -> None:
        row = len(self.seqs)
        self.seqs.append(seq)
        self.cents.append(cents)
        self.invoices.append(invoice)
        if number is not None:
            self.numbers.setdefault((vendor, number), []).append(row)
        if order is not None and cents is not None:
            self.orders.setdefault((vendor, order), []).append(row)

    def next_statement(self) -> None:
        self.used.clear()
        for rows in self.touched:
            rows.restore()
        self.touched.clear()

    def _first(self, known: dict, key: tuple, low: int | None, high: int | None) -> tuple[int | None, int | None]:
        """First free row of ``key``, and first one within the amounts; without amounts there is none within."""
        rows = known[key]
        if isinstance(rows, list):
            if len(rows) <= _FEW:
                free = [row for row in rows if self.seqs[row] not in self.used]
                near = (row for row in free if low is not None and self.cents[row] is not None and low <= self.cents[row] <= high)
                return free[0] if free else None, next(near, None)
            rows = known[key] = _Rows(rows, self)
        return rows.first(self.used), None if low is None else rows.first(self.used, low, high)

    def decide(self, vendor: str, number: str | None, order: str | None, cents: int | None) -> tuple[int | None, int | None]:
        """Level (0: amount mismatch, null: nothing found), ledger row."""
        reach = None if cents is None else max(_ABS_CENTS, abs(cents) * _PCT // 100)
        low, high = (None, None) if reach is None else (cents - reach, cents + reach)
        if (vendor, number) in self.numbers:
            first, near = self._first(self.numbers, (vendor, number), low, high)
            if near is not None:
                self.used.add(self.seqs[near])
                return 1, near
            if first is not None:
                return 0, first
        if low is not None and (vendor, order) in self.orders:
            _, near = self._first(self.orders, (vendor, order), low, high)
            if near is not None:
                self.used.add(self.seqs[near])
                return 2, near
        return None, None


_FOUND = [("level", pa.int32()), ("reason", pa.string()), ("erp_seq", pa.int64()), ("erp_cents", pa.int64()), ("erp_invoice", pa.string())]
_FOUND_SQL = "level int, reason string, erp_seq long, erp_cents long, erp_invoice string"
_SIDES = ["group", "block", "side", "statement_id", "seq", "vendor_id", "match_key", "ro_number", "cents", "invoice_number"]


def _values(column: pa.Array) -> list:
    """``column`` as a list; texts and whole numbers go through numpy, which takes a small part of the time."""
    if pa.types.is_integer(column.type) and column.null_count:
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks group after group: first its ledger rows, then its lines by statement. Every line leaves with its decision; the last
    column, which holds the line whole, is handed on as it is."""
    ledger, group, part, statement = _Ledger(), None, None, None
    for batch in batches:
        out = []
        *sides, whole = batch.columns
        for g, block, side, of, seq, vendor, number, order, cents, invoice in zip(*map(_values, sides), strict=True):
            if g != group or block != part:
                ledger, group, part, statement = _Ledger(), g, block, None
            if side == 0:
                ledger.add(seq, vendor, number, order, cents, invoice)
                continue
            if of != statement:
                ledger.next_statement()
                statement = of
            level, row = ledger.decide(vendor, number, order, cents)
            if level:
                out.append((level, None, ledger.seqs[row], ledger.cents[row], ledger.invoices[row]))
            elif level == 0:
                out.append((None, "Amount Mismatch", None, ledger.cents[row], None))
            else:
                out.append((None, None, None, None, None))
        if out:
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _FOUND, strict=True)]
            lines = whole.filter(pa.compute.equal(sides[2], 1))
            yield pa.RecordBatch.from_arrays([lines, *columns], names=["line", *[name for name, _ in _FOUND]])


def _side(rows: DataFrame, side: int, statement: str | None, seq: str, line: Column) -> DataFrame:
    """Rows in the columns that both sides share; ``node``: their vendor and repair order, or else their number.

    Rows that cannot be dealt with others have no node: those without a vendor or either number, and lines without a place.
    """
    order = F.nullif(F.col("ro_number"), F.lit(""))
    out = rows.select(
        F.lit(side).alias("side"), (F.col(statement) if statement else F.lit(None).cast("string")).alias("statement_id"), F.col(seq).alias("seq"),
        "vendor_id", match_key(rows).alias("match_key"), order.alias("ro_number"),
        (F.col("outstanding_amount").cast(MONEY) * F.lit(100).cast("decimal(3,0)")).cast("long").alias("cents"),
        (F.lit(None).cast("string") if statement else F.col("invoice_number")).alias("invoice_number"), line.alias("line"),
    )
    by_number = F.when(F.col("match_key").isNotNull(), F.xxhash64(F.lit("number"), "vendor_id", "match_key"))
    node = F.when(F.col("ro_number").isNotNull(), F.xxhash64(F.lit("order"), "vendor_id", "ro_number")).otherwise(by_number)
    placed = F.col("vendor_id").isNotNull() & (F.col("statement_id").isNotNull() & F.col("seq").isNotNull() if statement else F.lit(True))
    return out.withColumn("node", F.when(placed, node))


def grouped(both: DataFrame, made: list[DataFrame]) -> DataFrame:
    """``both`` sides with the group of their node: nodes that a number of lines and ledger rows connects are one."""
    keyed = both.where("match_key is not null").select("node", "side", F.xxhash64("vendor_id", "match_key").alias("number"))
    ends = [F.min("node").alias("b"), F.max("node").alias("z"), F.min("side").alias("s"), F.max("side").alias("t")]
    mixed = settle(keyed.groupBy("number").agg(*ends).where("b < z and s < t").select("number", "b"), "mixed")
    made.append(mixed)
    if mixed.isEmpty():
        return both.withColumn("group", F.col("node"))
    links = keyed.join(mixed, "number").select(F.col("node").alias("a"), "b").distinct()
    labels = component_labels(links, "node-groups", made)
    return both.join(labels, "node", "left").withColumn("group", F.coalesce("label", "node")).drop("label")


def dealt(both: DataFrame) -> DataFrame:
    """Groups of many lines in blocks of statements; their ledger rows go to each block."""
    lines = both.where("side = 1 and (ro_number is not null or `group` <> node)")
    large = lines.groupBy("group").agg(F.ceil(F.count("*") / LINES).cast("int").alias("blocks")).where("blocks > 1")
    counted = both.join(F.broadcast(large), "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("statement_id"), F.col("blocks")).cast("int")
    at = F.when(F.col("side") == 1, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    return counted.withColumn("block", F.explode(at))


def match(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every line with its level and ledger row, or its exception reason, written once.

    ``lines``: statement_id, seq, vendor_id, invoice_number, ro_number, outstanding_amount and more.
    ``ledger``: vendor_id, erp_seq, invoice_number, ro_number, outstanding_amount. Either side may
    have invoice_number_normalized. Both are read once; a line goes through the walk whole, so that
    its decision is not joined back to it.
    """
    whole = F.struct(*lines.columns)
    sides = _side(lines, 1, "statement_id", "seq", whole)
    line = sides.schema["line"].dataType
    both = settle(sides.unionByName(_side(ledger, 0, None, "erp_seq", F.lit(None).cast(line)).where("node is not null")), "sides")
    made = [both]
    rows = dealt(grouped(both.where("node is not null"), made)).select(*_SIDES, "line").repartition("group", "block")
    found = rows.sortWithinPartitions("group", "block", "side", "statement_id", "seq").mapInArrow(_decide, f"line {line.simpleString()}, {_FOUND_SQL}")
    alone = both.where("node is null").select("line", *[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema[1:]])
    amount = (F.col("erp_cents").cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)
    decided = found.unionByName(alone).select("line.*", "level", "reason", "erp_seq", amount.alias("erp_amount"), "erp_invoice")
    decisions = settle(_named(decided), "decisions")
    forget(*made)
    return decisions


def _named(decided: DataFrame) -> DataFrame:
    """Decisions with the reason of those that found nothing, and their status."""
    return decided.withColumn("reason", F.when(F.col("level").isNull(), F.coalesce("reason", F.lit("Invoice Missing")))).withColumn(
        "status", F.when(F.col("level").isNotNull(), "MATCHED").otherwise("EXCEPTION")
    )


def _stated(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    return _named(lines.join(decisions, LINE, "left"))


def fold_all(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """The same decisions by folding every statement whole, over all edges; tests compare ``match`` with it."""
    edges = level1_edges(lines, ledger).unionByName(level2_edges(lines, ledger))
    return _stated(lines, folded(edges.withColumn("component", F.lit(0).cast("long"))))
