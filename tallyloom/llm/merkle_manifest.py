"""Merkle manifest of a dataset: a tree for each group of rows, and one over the groups' roots.

Rows are numbered within their group in a fixed order; each consecutive run of
``FANOUT`` nodes becomes its parent, the last run may be shorter and is not padded,
until one node is left. Partitions of numbered rows build what lies wholly inside
them: a stack of peaks, one pile for each level, where a full aligned run carries
into the next level and gives out its members as node records. What a partition
cannot finish, at its edges or at the end of a group, stays open; open nodes of all
partitions meet by run, level by level, until every group has its root. A partition
leaves at most ``2 * (FANOUT - 1)`` open nodes for each level and group, so the
merging grows with the number of partitions and groups and not with the rows.

A group may hold any share of the rows: numbering takes ranges of (group, order)
whose counts are added up, and every later step goes by (group, run). Digests are
lowercase hex, and parents hash the hex digits of their children. Numbered rows,
node records and merged nodes are tables in the shared folder, so a lost executor
costs a re-read.

Defined cases: null values are ``-`` in a leaf, a null group stands before all
others, null ids come first in their group; rows of equal id and group go by leaf,
and rows repeated whole are leaves of their own; a very long text is hashed whole
by the JVM; a table of one row has its leaf as root and an empty proof; an empty
table gives an empty result; other columns, also of clashing names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import ascii_lower, settle, table

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left:string,right:string>>"


def leaf(values: list[Column]) -> Column:
    """Digest of a row: ``-`` for a null, else the UTF-8 byte count, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def group_key(column: Column) -> Column:
    """Text that orders like ``column`` bytewise, with null before everything."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), text))


def depth(n: Column, fanout: int = FANOUT) -> Column:
    """Levels above the leaves of a group of ``n``: 0 for one leaf."""
    powers = [fanout**k for k in range(63) if fanout**k < 1 << 62]
    return reduce(lambda a, b: a + b, [(n > F.lit(p)).cast("int") for p in powers])


def number(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (g and more) with ``idx`` in its group, by ``order``, and the group's size ``n``.

    Ranges of (g, order) are sorted and written once; the rows of each range and
    group are counted, and the counts before a range are added to the places in it.
    """
    rows = settle(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    by = ["g", *order, "_row"]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row").withColumn("_at", F.monotonically_increasing_id())
    rows = settle(rows, "ranges").withColumn("_range", F.shiftright("_at", 33))
    counts = settle(rows.groupBy("g", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_from")), "range-counts")
    before = Window.partitionBy("g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.join(counts.groupBy("g").agg(F.sum("_n").alias("n")), "g").select("g", "_range", "_from", "_before", "n")
    return rows.join(starts, ["g", "_range"]).withColumn("idx", F.col("_before") + F.col("_at") - F.col("_from")).drop("_at", "_range", "_from", "_before")


def _digest(members: list[str]) -> str:
    return hashlib.sha256("".join(members).encode()).hexdigest()


class Peaks:
    """Stack over consecutive leaves of one group; ``out`` gets (g, n, level, idx, hash, open) records."""

    def __init__(self, g: str, n: int, fanout: int, out: list[tuple]):
        self.g, self.n, self.fanout, self.out = g, n, fanout, out
        self.piles: list[list[tuple[int, str]]] = []

    def put(self, idx: int, digest: str, level: int = 0) -> None:
        """Adds a node; a pile that holds a full aligned run carries its parent up."""
        if level == len(self.piles):
            self.piles.append([])
        pile = self.piles[level]
        if pile and idx % self.fanout == 0:
            self.give(level, True)  # a run whose beginning another partition holds ends here
        pile.append((idx, digest))
        if len(pile) == self.fanout:
            parent = _digest([h for _, h in pile])
            self.give(level, False)
            self.put(idx // self.fanout, parent, level + 1)

    def give(self, level: int, is_open: bool) -> None:
        """Hands out a pile; closed leaves are known already and are left out."""
        pile = self.piles[level]
        if is_open or level:
            self.out.extend((self.g, self.n, level, idx, digest, is_open) for idx, digest in pile)
        pile.clear()

    def end(self) -> None:
        for level in range(len(self.piles)):
            self.give(level, True)


_NODE = pa.schema([("g", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.string()), ("open", pa.bool_())])
_NODE_DDL = "g string, n long, level int, idx long, hash string, open boolean"


def _stack(fanout: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        peaks, due, out = None, None, []
        for batch in batches:
            for g, n, idx, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if due != (g, idx):
                    if peaks:
                        peaks.end()
                    peaks = Peaks(g, n, fanout, out)
                peaks.put(idx, digest)
                due = (g, idx + 1)
            if len(out) > 10_000:
                yield _records(out)
        if peaks:
            peaks.end()
        if out:
            yield _records(out)

    return over


def _records(out: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _NODE, strict=True)]
    out.clear()
    return pa.RecordBatch.from_arrays(arrays, schema=_NODE)


def _runs(nodes: DataFrame, fanout: int, members: Column) -> DataFrame:
    """(g, n, run, m): the members of each run in order, at most ``fanout`` of them."""
    return nodes.groupBy("g", "n", F.expr(f"idx div {fanout}").alias("run")).agg(F.sort_array(F.collect_list(members)).alias("m"))


def build(numbered: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, int]:
    """Nodes above the leaves (g, n, level, idx, hash) and the number of levels of the largest group.

    ``numbered``: g, n, idx, leaf.
    """
    source = numbered.select("g", "n", "idx", "leaf").sortWithinPartitions("g", "idx")
    records = settle(source.mapInArrow(_stack(fanout), _NODE_DDL), "peaks")
    levels = numbered.agg(F.max(depth(F.col("n"), fanout))).first()[0] or 0
    found = [records.where("level > 0").drop("open")]
    parents = None
    for level in range(levels):
        here = records.where(F.col("open") & (F.col("level") == level)).drop("open")
        here = here if parents is None else here.unionByName(parents)
        runs = _runs(here.where(depth(F.col("n"), fanout) > level), fanout, F.struct("idx", "hash"))
        width = F.ceil(F.col("n") / F.lit(fanout**level)).cast("long")
        whole = F.size("m") == F.least(F.lit(fanout), width - F.col("run") * fanout)
        digest = F.sha2(F.array_join(F.transform("m", lambda x: x["hash"]), ""), 256)
        parents = settle(
            runs.select("g", "n", F.lit(level + 1).alias("level"), F.col("run").alias("idx"),
                        F.when(whole, digest).otherwise(F.raise_error(F.lit("a run of nodes is not whole"))).alias("hash")),
            f"merged{level + 1}",
        )
        found.append(parents)
    return reduce(DataFrame.unionByName, found), levels


def roots(numbered: DataFrame, nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(g, n, root) of every group."""
    lone = numbered.where("n = 1").select("g", "n", F.col("leaf").alias("root"))
    return lone.unionByName(nodes.where(F.col("level") == depth(F.col("n"), fanout)).select("g", "n", F.col("hash").alias("root")))


def _siblings(m: Column, at: Column, name: str) -> Column:
    """The digests left and right of place ``at`` (from 0) in a run."""
    digests = F.transform(m, lambda x: x[name])
    return F.struct(F.array_join(F.slice(digests, F.lit(1), at), "").alias("left"), F.array_join(F.slice(digests, at + 2, F.size(m)), "").alias("right"))


def paths(numbered: DataFrame, nodes: DataFrame, levels: int, above: DataFrame, payload: list[str], fanout: int = FANOUT) -> DataFrame:
    """Every leaf (g, idx, leaf, ``payload``) with ``path``: the siblings left and right of its way up, and beyond its group's root.

    ``above``: g, n, path of each group's root in the tree over groups. Each run
    meets its parent's path once, so a path is shuffled once for ``fanout`` leaves.
    """
    top = above.withColumn("_depth", depth(F.col("n"), fanout))
    way = top.where(F.col("_depth") == levels).select("g", F.lit(0).cast("long").alias("run"), "path")
    for level in range(levels - 1, 0, -1):
        members = nodes.where((F.col("level") == level) & (depth(F.col("n"), fanout) > level))
        joined = _runs(members, fanout, F.struct("idx", "hash")).join(way, ["g", "run"])
        joined = joined.select("g", "m", "path", F.posexplode("m").alias("at", "x"))
        way = joined.select("g", F.col("x.idx").alias("run"), F.concat(F.array(_siblings(F.col("m"), F.col("at"), "hash")), "path").alias("path"))
        way = way.unionByName(top.where(F.col("_depth") == level).select("g", F.lit(0).cast("long").alias("run"), "path"))
    if levels:
        way = way.unionByName(top.where("_depth = 0").select("g", F.lit(0).cast("long").alias("run"), "path"))
    joined = _runs(numbered, fanout, F.struct("idx", "leaf", *payload)).join(way, ["g", "run"])
    joined = joined.select("g", "n", "m", "path", F.posexplode("m").alias("at", "x"))
    step = F.when(F.col("n") > 1, F.array(_siblings(F.col("m"), F.col("at"), "leaf"))).otherwise(F.array().cast(_STEP))
    return joined.select("g", "x.*", F.concat(step, "path").alias("path"))


def fold(digest: Column, path: Column) -> Column:
    """Root that a leaf's digest leads to along its path."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof(path: Column) -> Column:
    """Digest of a path: all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(
    docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group_col: str = "source", id_col: str = "doc_id",
    payload: dict[str, Column] | None = None, fanout: int = FANOUT,
) -> tuple[DataFrame, DataFrame]:
    """The rows' leaves with subroot, root and path, and the node records of all trees.

    ``payload`` names columns computed from ``docs`` that go along with each leaf. Nodes
    are (tree, level, idx, hash): ``tree`` is the group's key, or null for the tree over groups.
    """
    payload = payload or {}
    leaves = docs.select(
        group_key(F.col(group_col)).alias("g"), F.col(id_col).alias("id"), leaf([F.col(c) for c in columns]).alias("leaf"),
        *[c.alias(k) for k, c in payload.items()],
    )
    numbered = number(leaves, ["id", "leaf"])
    nodes, levels = build(numbered, fanout)
    subroots = settle(roots(numbered, nodes, fanout), "subroots")
    over = number(subroots.select(F.lit("").alias("g"), F.col("g").alias("member"), F.col("n").alias("size"), F.col("root").alias("leaf")), ["member"])
    over_nodes, over_levels = build(over, fanout)
    root = roots(over, over_nodes, fanout).select("root")
    none = over.select("g", "n").distinct().withColumn("path", F.array().cast(_STEP))
    above = paths(over, over_nodes, over_levels, none, ["member", "size"], fanout)
    above = settle(above.select(F.col("member").alias("g"), F.col("size").alias("n"), F.col("leaf").alias("subroot"), "path").crossJoin(F.broadcast(root)), "above")  # one row
    found = paths(numbered, nodes, levels, above.select("g", "n", "path"), ["id", *payload], fanout)
    found = found.join(above.select("g", "subroot", "root"), "g").select("id", *payload, "g", "idx", "leaf", "subroot", "root", "path")
    kept = ["level", "idx", "hash"]
    records = nodes.select(F.col("g").alias("tree"), *kept).unionByName(over_nodes.select(F.lit(None).cast("string").alias("tree"), *kept))
    return found, records


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    claimed = leaf([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS])
    found, _ = manifest(docs, payload={"claimed": F.when(tampered, claimed)})
    folded = found.withColumn("folded_root", fold(F.coalesce("claimed", "leaf"), F.col("path")))
    return folded.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_SHIFT = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_PART = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _row(text: str) -> str:
    return "sha256(" + " || ".join(_PART.format(c) for c in (*COLUMNS[:-1], text)) + ")"


#: Levels one after the other over whole tables; each leaf then walks up through both trees.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_row('text')} AS leaf, {_row(_LOWER)} AS changed,
         list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda a, b: list_reduce(list_prepend(xor(a, b), [1, 2, 3, 4, 5, 6, 7, 8]), {_SHIFT})) AS crc FROM documents),
l AS (SELECT *, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN changed ELSE leaf END AS claimed,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT source, 0 AS level, idx, n AS width, leaf AS hash FROM l
      UNION ALL SELECT source, level + 1, idx // 16, (any_value(width) + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx)) FROM t WHERE width > 1 GROUP BY source, level, idx // 16),
s AS (SELECT source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t WHERE width = 1),
o AS (SELECT 0 AS level, idx, n AS width, hash FROM s
      UNION ALL SELECT level + 1, idx // 16, (any_value(width) + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx)) FROM o WHERE width > 1 GROUP BY level, idx // 16),
run AS (SELECT coalesce('1' || source, '0') AS tree, level, width, idx // 16 AS run, list(hash ORDER BY idx) AS m FROM t GROUP BY ALL
        UNION ALL SELECT 'over', level, width, idx // 16, list(hash ORDER BY idx) FROM o GROUP BY ALL),
go AS (
  SELECT doc_id, source, l.idx AS row, coalesce('1' || source, '0') AS tree, 0 AS level, l.idx AS idx, claimed AS folded, '' AS proof, l.leaf AS leaf FROM l
  UNION ALL
  SELECT doc_id, go.source, row, CASE WHEN width > 1 THEN go.tree ELSE 'over' END, CASE WHEN width > 1 THEN go.level + 1 ELSE 0 END,
         CASE WHEN width > 1 THEN go.idx // 16 ELSE s.idx END,
         CASE WHEN width > 1 THEN sha256(array_to_string(list_concat(m[1:go.idx % 16], [folded], m[go.idx % 16 + 2:]), '')) ELSE folded END,
         CASE WHEN width > 1 THEN proof || array_to_string(list_concat(m[1:go.idx % 16], m[go.idx % 16 + 2:]), '') ELSE proof END, go.leaf
  FROM go JOIN run ON run.tree = go.tree AND run.level = go.level AND run.run = go.idx // 16 JOIN s ON s.source IS NOT DISTINCT FROM go.source
  WHERE width > 1 OR go.tree <> 'over')
SELECT doc_id, leaf, s.hash AS subroot, o.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = o.hash AS verified
FROM go JOIN s ON s.source IS NOT DISTINCT FROM go.source JOIN o ON o.width = 1 AND go.tree = 'over' AND go.level = o.level"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": SQL}
