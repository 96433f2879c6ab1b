"""Fill-in-middle transformation in DuckDB SQL over Arrow batches.

Every Arrow batch of a partition is registered as a view of an in-memory DuckDB
connection; one SQL statement cuts the texts into units (runs of ASCII letters and
single other characters), takes prefix, middle and suffix as list slices and spells
the output. Python only moves Arrow batches, cut so that about ``SLICE_BYTES`` of
text are at hand at once; a longer text is a batch of its own, and its list of units
takes 16 bytes a unit beside the text.

Where to cut and which form to write come from the sha256 of the seed and the
document's id, so a lost task gives the same rows again and equal ids cut alike.

Defined cases: a null text is empty, an empty one stays plain with no units; a text
that holds a mark stays plain, so every output can be turned back; a null id hashes
as the empty string; repeated rows give equal rows; a very long text is cut whole;
an empty table gives an empty result. Added columns have names that input columns
do not; columns other than id and text pass through ``transform`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import table, text_of

SEED = 1
#: Documents of a hundred that are rewritten, and of those the ones that begin with the suffix.
REWRITTEN_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
#: Text taken into DuckDB at once.
SLICE_BYTES = 4 << 20

_CUT = """
cut AS (
  SELECT rid, id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, sha256('{seed}:' || id) AS h FROM given),
places AS (
  SELECT rid, text, units, CAST(len(units) AS BIGINT) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS y,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS rewritten, CAST('0x' || h[25:32] AS BIGINT) % 100 AS suffix_first FROM cut),
formed AS (
  SELECT rid, text, n, units, least(x, y) AS a, greatest(x, y) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR rewritten >= {rewritten}
              THEN 'plain' WHEN suffix_first < {suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM places),
parts AS (
  SELECT rid, text, n, form, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, a), '') END AS prefix,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, a + 1, b), '') END AS middle,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, b + 1, n), '') END AS suffix FROM formed),
spelt AS (
  SELECT rid, n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
         CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts)"""

#: A mark stands nowhere in the parts, so the first one found is the one that was written.
_RESTORED = """
ends AS (
  SELECT rid, form, output, string_split(substr(output, 4), CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS halves FROM {source}),
tails AS (SELECT rid, form, output, halves[1] AS one, string_split(halves[2], '<M>') AS rest FROM ends),
restored AS (
  SELECT rid, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN one || rest[2] || rest[1] ELSE rest[1] || rest[2] || one END AS text FROM tails)"""


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches whose last column, the text, holds about ``SLICE_BYTES``."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.cast(pc.binary_length(batch.columns[-1]), pa.int64())).to_numpy()
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(ends.searchsorted(before + SLICE_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _over(sql: str, given: list[str]):
    """mapInArrow function: ``sql`` over each slice as the view ``given`` (rid and the named columns, which stand last, the text at the end).

    The columns before them are put in front of those that ``sql`` makes.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for part in _slices(batches):
                kept, columns = part.columns[: -len(given)], part.columns[-len(given) :]
                con.register("given", pa.table([pa.array(range(part.num_rows), pa.int64()), *columns], names=["rid", *given]))
                made = con.execute(sql).to_arrow_table().drop_columns("rid")
                con.unregister("given")
                arrays = [*kept, *[pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in made.columns]]
                yield pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])

    return over


def _mapped(df: DataFrame, keep: list[str], given: dict, sql: str, added: dict[str, str]) -> DataFrame:
    """The columns ``keep`` of ``df`` and the columns ``added`` (name: type) that ``sql`` makes of the columns ``given``."""
    taken = {c.lower() for c in keep}
    mark = next(m for m in ("", *(f"fim{k}_" for k in range(99))) if not any(f"{m}{n}".lower() in taken for n in added))
    kinds = [*[df.schema[c].dataType.simpleString() for c in keep], *added.values()]
    source = df.select(*keep, *given.values()).toDF(*[f"c{k}" for k in range(len(keep) + len(given))])
    out = source.mapInArrow(_over(sql, list(given)), ", ".join(f"c{k} {t}" for k, t in enumerate(kinds)))
    return out.toDF(*keep, *[f"{mark}{n}" for n in added])


def _cut(seed: int, rewritten: int, suffix_first: int) -> str:
    return _CUT.format(seed=int(seed), rewritten=int(rewritten), suffix_first=int(suffix_first))


def _id_and_text(id_col: str, text_col: str) -> dict:
    return {"id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "text": text_of(text_col)}


_ADDED = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint"}


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
    rewritten_percent: int = REWRITTEN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output."""
    sql = f"WITH {_cut(seed, rewritten_percent, suffix_first_percent)} SELECT rid, n, form, prefix_chars, middle_chars, output FROM spelt ORDER BY rid"
    return _mapped(docs, docs.columns, _id_and_text(id_col, text_col), sql, {**_ADDED, "output": "string"})


def restore(outputs: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """``outputs`` with ``restored``: the text as it was, from output and form alone."""
    sql = f"WITH {_RESTORED.format(source='given')} SELECT rid, text AS restored FROM restored ORDER BY rid"
    return _mapped(outputs, outputs.columns, {"form": F.col(form_col), "output": F.col(output_col)}, sql, {"restored": "string"})


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``transform`` and ``restore`` in one statement, with the sha256 of output and restored text in place of the texts."""
    sql = f"""WITH {_cut(seed, REWRITTEN_PERCENT, SUFFIX_FIRST_PERCENT)}, {_RESTORED.format(source='spelt')}
    SELECT rid, n, spelt.form, prefix_chars, middle_chars, sha256(spelt.output) AS output_sha256, sha256(restored.text) AS restored_sha256
    FROM spelt JOIN restored USING (rid) ORDER BY rid"""
    return _mapped(docs, [id_col], _id_and_text(id_col, text_col), sql, {**_ADDED, "output_sha256": "string", "restored_sha256": "string"})


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


#: Plain SQL over the whole table: the units' positions by their lengths, parts and digests by substring.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]'), lambda x: length(x)) AS size,
             list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, len(size) AS n, least(r[1] % (len(size) + 1), r[2] % (len(size) + 1)) AS a, greatest(r[1] % (len(size) + 1), r[2] % (len(size) + 1)) AS b,
             CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
e AS (SELECT *, CAST(coalesce(list_sum(size[1:a]), 0) AS BIGINT) AS pa, CAST(coalesce(list_sum(size[1:b]), 0) AS BIGINT) AS pb FROM c),
p AS (SELECT *, substr(text, 1, pa) AS p, substr(text, pa + 1, pb - pa) AS m, substr(text, pb + 1) AS s FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN pa END AS prefix_chars, CASE WHEN form <> 'plain' THEN pb - pa END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p"""

QUERIES = {"op11_fill_middle": op11_fill_middle}
ORACLES = {"op11_fill_middle": SQL}
