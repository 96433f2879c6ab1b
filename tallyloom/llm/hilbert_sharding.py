"""Sharding by Hilbert-curve order (DataFrame operations only).

Several metadata dimensions are quantised to four bits each: a text column by the
share of rows that sort before its value, the size by its logarithm. Both keep the
column's order. Every row gets its index on a three-dimensional Hilbert curve,
rows are ranked along the curve and the ranking is cut into runs. A run touches a
small box of the metadata space, so the minimum and maximum of a shard's columns
prune it in all dimensions.

The ranking needs no global sort: rows are counted per curve cell (at most 4,096
cells, a fixed number), crowded cells are cut into slices by a mix of id and size,
rows are numbered inside a slice, and slice and cell offsets are added. Rows that
share an id are spread by their sizes; only rows equal in both share a slice.

Defined cases: null language or source count as the empty string, a null text
has no bytes, a null id sorts as -1, repeated rows keep a slot each, a very long
text only counts its bytes, an empty table gives an empty result. Other columns,
also of clashing names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import settle, table

BITS = 4
DIMENSIONS = 3
SHARDS = 24
#: Rows that one numbering task gets; more rows mean more tasks.
SLICE_ROWS = 500
#: Distinct values that one task orders when a text column is quantised.
VALUES_A_TASK = 200_000

#: Odd multiplier that spreads ids over 32 bits.
_MULTIPLIER = 2654435761
_SIZE_MULTIPLIER = 40503 * 65537


def curve_tables(n: int = DIMENSIONS) -> tuple[str, str]:
    """Digit and next state of the curve for state * 2^n + corner, one character each.

    A state is an entry corner and a direction; the rule is the usual one of Gray
    codes with rotations. Digits are written 0-7, states as letters from "a".
    """
    size, mask = 1 << n, (1 << n) - 1

    def left(v: int, k: int) -> int:
        k %= n
        return ((v << k) | (v >> (n - k))) & mask

    def gray(v: int) -> int:
        return v ^ (v >> 1)

    rank_of = {gray(w): w for w in range(size)}

    def trailing_ones(v: int) -> int:
        return next(k for k in range(n + 1) if not v >> k & 1)

    digits, states = "", ""
    for state in range(size * n):
        entry, direction = divmod(state, n)
        for corner in range(size):
            w = rank_of[left(corner ^ entry, n - (direction + 1) % n)]
            start = gray(2 * ((w - 1) // 2)) if w else 0
            turn = trailing_ones(w if w % 2 else w - 1) % n if w else 0
            digits += str(w)
            states += chr(97 + (entry ^ left(start, direction + 1)) * n + (direction + turn + 1) % n)
    return digits, states


def hilbert_index(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """Index on the curve of three coordinates below ``2 ** bits``."""
    digits, states = map(F.lit, curve_tables())
    state, index = F.lit(0), F.lit(0)
    for b in range(bits - 1, -1, -1):
        corner = sum(F.shiftright(c, b).bitwiseAND(1) * (1 << k) for k, c in enumerate((x, y, z)))
        at = state * 8 + corner + 1
        index = index * 8 + F.substring(digits, at, F.lit(1)).cast("int")
        state = F.ascii(F.substring(states, at, F.lit(1))) - 97
    return index


def cuts(docs: DataFrame, column: str, bits: int = BITS) -> list[tuple[int, str]]:
    """(step, least value) of every quantisation step that holds values, in order: at most ``2 ** bits`` of them.

    A value's step is the share of rows that sort before the middle of its rows.
    Distinct values are counted, dealt by range, added up inside a range, and the
    ranges' sums added.
    """
    value = F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")
    counts = settle(docs.select(value).groupBy("value").agg(F.count("*").alias("n")), "values")
    ranges = max(1, -(-counts.count() // VALUES_A_TASK))
    dealt = settle(counts.repartitionByRange(ranges, "value").withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("range").agg(F.sum("n").alias("rows"))  # a row for each of the ranges
    earlier = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"), F.sum("rows").over(Window.partitionBy(F.lit(0))).alias("total"))
    placed = dealt.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0))).join(sums, "range")
    step = F.expr(f"int(((start + inside) * 2 + n) * {1 << bits} div (2 * total))")
    found = placed.groupBy(step.alias("step")).agg(F.min("value").alias("value")).collect()  # at most 2 ** bits rows
    return sorted(map(tuple, found))


def _step(column: str, at: list[tuple[int, str]]) -> Column:
    """The last step whose least value is reached."""
    value, out = F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(0)
    for step, least in at:
        out = F.when(value >= F.lit(least), step).otherwise(out)
    return out


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple[str, str] = ("lang", "source"),
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Row counts of the shards differ by at most one; slots are gapless from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    spread = F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), F.lit(1 << 31)) * _MULTIPLIER + F.pmod(size, F.lit(1 << 20)) * _SIZE_MULTIPLIER
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _step(categories[0], cuts(docs, categories[0])).alias("x"),
        _step(categories[1], cuts(docs, categories[1])).alias("y"),
        F.least(F.lit(15), F.greatest(F.lit(0), F.length(F.bin(size)) - 4)).alias("z"),
        F.pmod(spread, F.lit(1 << 32)).alias("mix"),
    )
    rows = settle(
        rows.select("doc_id", "size", "text_crc32", "mix", hilbert_index(*map(F.col, "xyz")).alias("cell")),
        "hilbert",
    )

    along = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"))  # at most 8 ** BITS rows
    cells = cells.select(
        "cell",
        F.ceil(F.col("n") / slice_rows).alias("slices"),
        F.coalesce(F.sum("n").over(along), F.lit(0)).alias("cell_start"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    rows = rows.join(F.broadcast(cells), "cell").withColumn(
        "slice", F.shiftright(F.col("mix") * F.col("slices"), 32)
    )
    before = Window.partitionBy("cell").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("cell", "slice")
        .agg(F.count("*").alias("n"))
        .select("cell", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("slice_start"))
    )
    inside = Window.partitionBy("cell", "slice").orderBy("mix", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    ranked = rows.withColumn("inside", F.row_number().over(inside)).join(starts, ["cell", "slice"])
    rank = F.col("cell_start") + F.col("slice_start") + F.col("inside") - 1
    ranked = ranked.withColumn("rank", rank).withColumn("shard", F.expr(f"int((rank * {shards}) div total)"))
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"rank - (shard * total + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("cell").alias("hilbert_cell"),
    )


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    digits, states = curve_tables()
    steps, state, index = [], "0", "0"
    for b in range(BITS - 1, -1, -1):
        at = f"{state} * 8 + ((x >> {b}) & 1) + ((y >> {b}) & 1) * 2 + ((z >> {b}) & 1) * 4 + 1"
        steps.append((at, index))
        index = f"({index}) * 8 + CAST(substr('{digits}', {at}, 1) AS INT)"
        state = f"(ascii(substr('{states}', {at}, 1)) - 97)"
    # text_crc32 has no function in DuckDB and is compared by a test instead.
    ranked = """
{0}_n AS (SELECT coalesce({1}, '') AS value, count(*) AS n FROM documents GROUP BY 1),
{0}_q AS (SELECT value, CAST((2 * sum(n) OVER (ORDER BY value) - n) * 16 // (2 * sum(n) OVER ()) AS INT) AS {0} FROM {0}_n),"""
    return f"""
WITH {ranked.format("x", "lang")}{ranked.format("y", "source")}
q AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, x, y FROM documents
  JOIN x_q ON x_q.value = coalesce(lang, '') JOIN y_q ON y_q.value = coalesce(source, '')),
p AS (SELECT *, least(15, greatest(0, length(bin(size)) - 4)) AS z,
             ((coalesce(doc_id, -1) % 2147483648 + 2147483648) % 2147483648 * {_MULTIPLIER} + size % 1048576 * {_SIZE_MULTIPLIER}) % 4294967296 AS mix FROM q),
h AS (SELECT doc_id, size, mix, {index} AS cell FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY cell, mix, doc_id NULLS FIRST, size) - 1 AS rank,
             count(*) OVER () AS total FROM h)
SELECT doc_id, size, 'rows' AS law, CAST(rank * {SHARDS} // total AS INT) AS shard,
       rank - (CAST(rank * {SHARDS} // total AS INT) * total + {SHARDS - 1}) // {SHARDS} AS slot,
       CAST(NULL AS INT) AS grown_shard, cell AS hilbert_cell
FROM r"""


#: The columns of op9 that SQL can give; see the tests for the rest.
SQL_WITHOUT_CRC = _oracle()
QUERIES = {"op9_hilbert_sharding": op9_hilbert_sharding}
