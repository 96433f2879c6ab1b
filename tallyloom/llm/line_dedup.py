"""Line de-duplication over overlapping windows of three lines (DataFrame operations).

Every three consecutive lines of a document form a window, known by a 128-bit
hash. A window that occurs again anywhere (in a later document, or further down
in its own) has later occurrences; the lines these cover are merged into spans
and removed. Occurrences are ordered by (document id, row, line number), where the
row is the place of a document in the table. A line is removed only if the same
line stands at an earlier place, so the first occurrence of every line stays.

Rows are numbered once, in a table in the shared folder, so that all branches and
all recomputed tasks see the same numbers.

Windows meet in a group-by whose map side already folds copies, and later
occurrences come from a join with the repeated windows only, which Spark can
split where one window is very frequent.

Defined cases: documents of fewer than three lines form no window and stay as
they are, as do null texts and rows with a null id; rows that share an id, and
rows repeated whole, are documents of their own, and the later ones lose what the
earlier ones hold; a very long text gives one window a line and stays in one row;
an empty table gives an empty result. Columns other than id and text pass
through, and helper columns have names that input columns do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import settle, table

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, row_col: str, window: int = WINDOW) -> DataFrame:
    """(row, start) of every window occurrence that is not the first."""
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(row_col).alias("row"), _lines(F.col(text_col)).alias("lines")
    )
    starts = F.sequence(F.lit(0), F.size("lines") - window)

    def key(i: Column) -> Column:
        lines = [F.get("lines", i + k) for k in range(window)]
        return F.struct(F.xxhash64(*lines).alias("h"), F.xxhash64(F.lit(1), *lines).alias("g"))

    windows = rows.where(F.size("lines") >= window).select("id", "row", F.posexplode(F.transform(starts, key)).alias("start", "w"))
    windows = windows.select("id", "row", "start", "w.h", "w.g")
    place = F.struct("id", "row", "start")
    first = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.where(F.col("first") < F.col("last")).drop("last")
    return windows.join(first, ["h", "g"]).where(place > F.col("first")).select("row", "start")


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> tuple[DataFrame, tuple[str, str, str]]:
    """``docs`` with cleaned texts, and the names of three added columns: lines, removed lines, spans removed.

    Spans are written ``first-last`` by line number, comma-joined.
    """
    mark = next(m for m in ("_dup", *(f"_dup{k}" for k in range(99))) if not any(c.startswith(m) for c in docs.columns))
    n_lines, n_removed, spans = f"{mark}_lines", f"{mark}_removed", f"{mark}_spans"
    row = f"{mark}_row"
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    later = repeated_windows(numbered, id_col, text_col, row, window).withColumnRenamed("row", row)
    covered = later.groupBy(row).agg(
        F.sort_array(
            F.array_distinct(
                F.flatten(F.transform(F.collect_set("start"), lambda s: F.sequence(s, s + window - 1)))
            )
        ).alias(f"{mark}_covered")
    )
    out = numbered.join(covered, row, "left")
    out = out.withColumn(f"{mark}_all", _lines(F.col(text_col)))
    gone, lines = F.col(f"{mark}_covered"), F.col(f"{mark}_all")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(gone.isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    )
    opens = F.filter(gone, lambda x, i: (i == 0) | (F.get(gone, i - 1) != x - 1))
    closes = F.filter(gone, lambda x, i: F.coalesce(F.get(gone, i + 1) != x + 1, F.lit(True)))
    written = F.array_join(F.zip_with(opens, closes, lambda a, b: F.concat_ws("-", a, b)), ",")
    out = out.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(n_lines),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_removed),
        F.coalesce(written, F.lit("")).alias(spans),
    )
    return out, (n_lines, n_removed, spans)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, (n_lines, n_removed, spans) = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed"),
        F.col(spans).alias("removed_spans"), "text",
    )


SQL = """
WITH l0 AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, generate_subscripts(lines, 1) - 1 AS pos, unnest(lines) AS line FROM l0),
w AS (SELECT doc_id, pos, line, lead(line) OVER o AS b, lead(line, 2) OVER o AS c
      FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, pos) AS k
      FROM w WHERE c IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE k > 1),
island AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone),
span AS (SELECT doc_id, min(pos) AS a, max(pos) AS z FROM island GROUP BY doc_id, g),
spans AS (SELECT doc_id, string_agg(a || '-' || z, ',' ORDER BY a) AS removed_spans FROM span GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text
         FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT l0.doc_id, CAST(coalesce(len(l0.lines), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(removed_spans, '') AS removed_spans,
       CASE WHEN l0.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM l0 LEFT JOIN n USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)"""

QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES = {"op1_line_dedup": SQL}
