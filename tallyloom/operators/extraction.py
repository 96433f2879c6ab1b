"""Operators on what an extractor gives: text lines, grids, keyed rows, boxes and broken JSON.

Grids are ``array<array<string>>``; keyed rows are maps with the column order
beside them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import config
from tallyloom.functions.texts import is_currency, is_invoice_like
from tallyloom.operators.quality import strip


def pseudo_table(text: Column) -> Column:
    """Rows of cells from flat text: cut at two or more blanks, or at any blank where that gives one cell."""

    def cells(line: Column) -> Column:
        wide = F.split(line, r"\s{2,}")
        narrow = F.split(line, r"\s+")
        return F.when((F.size(wide) == 1) & (F.size(narrow) > 1), narrow).otherwise(wide)

    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")
    return F.transform(lines, cells)


def _bound(value: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` of ``value``, which is computed once however often the rule names it."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def header_words(row: Column) -> Column:
    """How many header words the joined, lower-cased row holds."""
    return _bound(F.lower(F.array_join(row, " ", "")), lambda joined: sum(joined.contains(w).cast("int") for w in config.HEADER_WORDS))


def find_header(grid: Column) -> Column:
    """Index of the first row with two header words, or null."""
    marked = F.transform(grid, lambda row, i: F.when((F.size(row) > 0) & (header_words(row) >= 2), i))
    return F.get(F.filter(marked, lambda i: i.isNotNull()), F.lit(0))


def normalize_header(header: Column) -> Column:
    return F.replace(strip(F.lower(header)), F.lit("_"), F.lit(" "))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _field_a(h: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, words in config.COLUMN_KEYWORDS:
        hit = _any(h, words)
        out = out.when(hit | (h == "amount") if name == "amount" else hit, name)
    return out


def header_field_a(header: Column) -> Column:
    """Field of a header in a keyed table: the first branch with a keyword in it."""
    return _bound(normalize_header(header), _field_a)


def _named(headers: DataFrame, text: Column, field: Callable[[Column], Column]) -> DataFrame:
    """Headers that have a field, by ``field`` of ``text``; as a row of an array the text is worked out once and the field in generated code."""
    named = headers.select("*", F.explode(F.array(text)).alias("_text")).withColumn("field", field(F.col("_text")))
    return named.where("field is not null").drop("_text")


def map_columns_a(headers: DataFrame, values: DataFrame | None = None, sample: int = 200) -> DataFrame:
    """First header of each field, at one position the first by text; ``headers``: doc_id, pos, header.

    Of several invoice headers the one whose values look least like account codes is
    taken, by its first ``sample`` values that are not null; without values or at equal
    shares the first. ``values``: doc_id, pos, header, row_num, value.
    """
    mapped = _named(headers, normalize_header(F.col("header")), _field_a)
    place = F.struct(F.lit(None).cast("double").alias("share"), "pos", "header")
    if values is not None:
        invoices = mapped.where("field = 'invoice_number'").select("doc_id", "pos", "header").distinct()
        several = invoices.withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).where("n > 1").drop("n")
        share = account_shares(values.join(several, ["doc_id", "pos", "header"], "left_semi"), sample)
        mapped = mapped.join(share.withColumn("field", F.lit("invoice_number")), ["doc_id", "pos", "header", "field"], "left")
        place = F.struct(F.coalesce("share", F.lit(2.0)).alias("share"), "pos", "header")  # a share is at most 1
    best = mapped.groupBy("doc_id", "field").agg(F.min(place).alias("best"))
    return best.select("doc_id", "field", "best.header", "best.pos")


def _field_b(h: Column) -> Column:
    dated = h.contains("date")
    out = (
        F.when(~dated & (_any(h, config.TABLE_INVOICE_KEYWORDS) | h.rlike(r"\bref\b")), "invoice_number")
        .when(h.contains("invoice") & dated, "invoice_date")
        .when(h.contains("due") & dated, "due_date")
    )
    for name, words in config.TABLE_KEYWORDS:
        out = out.when(_any(h, words), name)
    return out


def header_field_b(header: Column) -> Column:
    """Field of a header in a page table."""
    return _bound(strip(F.lower(header)), _field_b)


def map_columns_b(headers: DataFrame) -> DataFrame:
    """Last header of each field, but the first of ``amount``; at one position the first by text."""
    mapped = _named(headers.where("header is not null and header <> ''"), strip(F.lower(F.col("header"))), _field_b)
    rank = F.when(F.col("field") == "amount", -F.col("pos")).otherwise(F.col("pos"))
    return mapped.groupBy("doc_id", "field").agg(F.min_by("header", F.struct(-rank, "header")).alias("header"), F.max_by("pos", rank).alias("pos"))


def header_info(text: Column, shop_words: tuple[str, ...] = ("collision", "auto body", "shop")) -> tuple[Column, Column]:
    """First line as vendor, first line with a shop word as shop."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")
    shops = F.filter(lines, lambda s: F.lower(s).rlike("|".join(shop_words)))
    return F.get(lines, F.lit(0)), F.get(shops, F.lit(0))


def cleanest_column(values: DataFrame, sample: int = 200) -> DataFrame:
    """Of several candidate columns the one with the smallest share of account prefixes.

    ``values``: doc_id, pos (of the column), header, row_num, value. The first
    ``sample`` values of a column decide (a rule of the operator); ties go to the first column.
    """
    return account_shares(values, sample).groupBy("doc_id").agg(F.min_by("header", F.struct("share", "pos")).alias("header"))


def account_shares(values: DataFrame, sample: int = 200) -> DataFrame:
    """(doc_id, pos, header, share): the share of account prefixes among a column's first ``sample`` values that are not null."""
    order = Window.partitionBy("doc_id", "pos", "header").orderBy("row_num", "value")
    seen = values.where("value is not null").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= sample)
    return seen.groupBy("doc_id", "pos", "header").agg(F.avg(F.col("value").rlike(config.ACCOUNT_PREFIX).cast("int")).alias("share"))


def fallback_fields(rows: DataFrame) -> DataFrame:
    """Invoice and amount by value shape; ``rows``: row_id, cells array<struct<key, value>>, used array<string>."""
    free = F.filter("cells", lambda c: ~F.array_contains("used", c["value"]))
    invoices = F.filter(free, lambda c: is_invoice_like(c["value"]))
    amounts = F.filter(free, lambda c: is_currency(c["value"]))
    return rows.select("row_id", F.get(invoices, F.lit(0))["value"].alias("invoice_number"), F.get(amounts, F.lit(0))["value"].alias("amount_text"))


def cells_to_grid(cells: DataFrame) -> DataFrame:
    """Rows of cells from (table_id, row_index, column_index, n_rows, n_columns, content); gaps are empty, of several cells at one place the first by text stays."""
    inside = cells.where("row_index between 0 and n_rows - 1 and column_index between 0 and n_columns - 1")
    inside = inside.groupBy("table_id", "row_index", "n_columns", "column_index").agg(F.min("content").alias("content"))
    by_row = inside.groupBy("table_id", "row_index", "n_columns").agg(F.map_from_entries(F.collect_list(F.struct("column_index", "content"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.col("n_columns") - 1), lambda k: F.coalesce(F.element_at("m", k), F.lit("")))
    return by_row.select("table_id", "row_index", filled.alias("cells"))


def continuation_tables(tables: DataFrame) -> DataFrame:
    """Which header each table of a document uses: its own, the last one of equal width, or none.

    ``tables``: doc_id, table_no, width, header_row (null without one; a header
    counts only among the first rows).
    """
    order = Window.partitionBy("doc_id").orderBy("table_no").rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("header_row") <= 1
    out = tables.withColumn("_w", F.last(F.when(own, F.col("width")), ignorenulls=True).over(order)).withColumn(
        "_t", F.last(F.when(own, F.col("table_no")), ignorenulls=True).over(order)
    )
    use = F.when(F.coalesce(own, F.lit(False)), "own").when(F.col("_w").isNull(), "no header").when(F.col("_w") == F.col("width"), "continued").otherwise("width differs")
    return out.select("doc_id", "table_no", use.alias("use"), F.when(use.isin("own", "continued"), F.col("_t")).alias("header_table"))


def block_groups(rows: DataFrame, wanted: str) -> DataFrame:
    """Details and footers under the header that is open; a footer closes it. Only groups that match ``wanted`` stay.

    ``rows``: file, pos, role (header, detail or footer), label.
    """
    before = Window.partitionBy("file").orderBy("pos")
    closed = F.coalesce(F.sum((F.col("role") == "footer").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = rows.withColumn("_closed", closed)
    here = Window.partitionBy("file", "_closed").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = marked.withColumn("group_header", F.last(F.when(F.col("role") == "header", F.col("label")), ignorenulls=True).over(here))
    lone = (F.col("role") == "footer") & F.col("label").rlike(wanted)
    return out.where(F.col("group_header").rlike(wanted) | lone).select("file", "pos", "role", "group_header")


def bucket_columns(words: DataFrame, bounds: list[tuple[str, float]], rest: str) -> DataFrame:
    """Words joined by column, left to right; a column takes what starts left of its bound."""
    name = F.when(F.lit(False), "")
    for column, bound in bounds:
        name = name.when(F.col("x") < bound, column)
    placed = words.withColumn("column", name.otherwise(rest))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "text"))), lambda w: w["text"]), " ")
    return placed.groupBy("row_id", "column").agg(joined.alias("text"))


def row_clusters(words: DataFrame, tolerance: float) -> DataFrame:
    """Visual rows: words in order of y join the first row whose running mean of y is near.

    ``words``: page_id, x, y, text. No word can join a row beyond a gap in y that is
    wider than the tolerance, so a page is cut at such gaps and each piece is folded by
    itself, with built-in functions.
    """
    order = Window.partitionBy("page_id").orderBy("y", "x", "text")
    placed = words.select("page_id", F.col("x").cast("double"), F.col("y").cast("double"), "text")
    gap = F.coalesce(F.col("y") - F.lag("y").over(order) > tolerance * (1 + 1e-9) + 1e-9, F.lit(False))  # rounding of means stays below
    pieces = placed.withColumn("gap", gap.cast("int")).withColumn("piece", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kind = "array<struct<y:double,n:int,words:array<struct<x:double,text:string>>>>"

    def put(rows: Column, w: Column) -> Column:
        near = F.get(F.filter(F.transform(rows, lambda r, i: F.when(F.abs(r["y"] - w["y"]) <= tolerance, i)), lambda i: i.isNotNull()), F.lit(0))
        word = F.struct(w["x"].alias("x"), w["text"].alias("text"))

        def into(at: Column) -> Column:
            grown = F.transform(
                rows,
                lambda r, i: F.when(
                    i == at,
                    F.struct(((r["y"] * r["n"] + w["y"]) / (r["n"] + 1)).alias("y"), (r["n"] + 1).alias("n"), F.array_append(r["words"], word).alias("words")),
                ).otherwise(r),
            )
            fresh = F.array_append(rows, F.struct(w["y"].alias("y"), F.lit(1).alias("n"), F.array(word).alias("words")))
            return F.when(at.isNull(), fresh).otherwise(grown).cast(kind)

        return _bound(near, into)

    ordered = F.sort_array(F.collect_list(F.struct("y", "x", "text")))
    folded = pieces.groupBy("page_id", "piece").agg(ordered.alias("w")).select("page_id", "piece", F.aggregate("w", F.array().cast(kind), put).alias("rows"))
    by_y = F.array_sort("rows", lambda a, b: F.when(a["y"] < b["y"], -1).when(a["y"] > b["y"], 1).otherwise(0))
    lines = folded.select("page_id", "piece", F.posexplode(by_y).alias("at", "r"))
    row_no = F.row_number().over(Window.partitionBy("page_id").orderBy("piece", "at")) - 1
    return lines.select("page_id", row_no.alias("row_no"), F.array_join(F.transform(F.sort_array("r.words"), lambda w: w["text"]), " ").alias("text"))


def is_page_furniture(transaction: Column, *others: Column, header_words: tuple[str, ...] = config.PAGE_HEADER_WORDS, titles: tuple[str, ...] = config.REPORT_TITLES) -> Column:
    """Blank rows, header words, print times, the report's title and address, and page numbers."""

    def furniture(txn: Column) -> Column:
        empty = txn == ""
        for o in others:
            empty = empty & (F.coalesce(o, F.lit("")) == "")
        out = empty | txn.isin(*header_words) | txn.rlike(r"^\d{1,2}/\d{1,2}/\d{2,4},?\s*\d{1,2}:\d{2}") | txn.rlike(r"^\d+\s*/\s*\d+$")
        for title in titles:
            out = out | txn.contains(title)
        return out

    return _bound(F.lower(strip(F.coalesce(transaction, F.lit("")))), furniture)


def page_merge(pages: DataFrame) -> DataFrame:
    """Documents from pages: all rows in page order, least confidence, first page's metadata.

    ``pages``: doc_id, page_no, metadata, confidence, rows array<string>.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page_no", "rows"))), lambda p: p["rows"])
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"), F.min("confidence").alias("confidence"), F.min_by("metadata", "page_no").alias("metadata"),
        F.flatten(ordered).alias("rows"),
    )


def columns_union(pages: DataFrame) -> DataFrame:
    """Column names of a document's pages in order of first sight; ``pages``: doc_id, page_no, columns."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page_no", "columns"))), lambda p: p["columns"])
    return pages.groupBy("doc_id").agg(F.array_distinct(F.flatten(ordered)).alias("columns"))


DOCUMENT_SCHEMA = (
    "document_metadata struct<document_type:string,source_file:string,page_count:int>, vendor_metadata struct<vendor_name:string>, "
    "statement_metadata struct<statement_date:string>, invoices array<struct<invoice_number:string,outstanding_amount:double,amount:double,"
    "ro_number:string,line_confidence:double>>, extraction_confidence struct<overall:double>, warnings array<string>"
)


def document_invoices(documents: DataFrame) -> DataFrame:
    """Invoices of JSON documents with their position; ``documents``: doc_id, value."""
    parsed = documents.select("doc_id", F.from_json("value", DOCUMENT_SCHEMA).alias("d"))
    return parsed.select("doc_id", F.col("d.vendor_metadata.vendor_name").alias("vendor_name"), F.posexplode_outer("d.invoices").alias("pos", "i")).select(
        "doc_id", "vendor_name", "pos", "i.invoice_number", F.coalesce("i.outstanding_amount", "i.amount").alias("outstanding_amount")
    )


def document_routing(kind: Column) -> Column:
    return F.when(kind == "VENDOR_STATEMENT", "RECONCILIATION").otherwise("PARKED")


def is_truncated(n_rows: Column, n_columns: Column, salvaged: Column, baseline: Column, ratio: float = 0.10) -> Column:
    short = salvaged & (baseline > 0) & (n_rows < baseline * ratio)
    return ((n_rows == 0) & (n_columns > 0)) | F.coalesce(short, F.lit(False))


_ROWS = re.compile(r'"(?:rows|invoices)"\s*:\s*\[')


#: What matters when braces are counted: whole strings, braces, and the bracket that ends the array.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\]]', re.S)


def salvage_objects(text: str | None) -> list[str]:
    """Whole objects of the ``rows`` or ``invoices`` array of a JSON text that may break off.

    Elements that are no valid object are passed over; the array ends at its bracket or where an object has no end.
    """
    start = _ROWS.search(text or "")
    depth, begin, out = 0, 0, []
    for token in _TOKEN.finditer(text, start.end()) if start else ():
        mark = token.group()
        if mark == "{":
            begin = begin if depth else token.start()
            depth += 1
        elif mark == "}" and depth:
            depth -= 1
            if not depth:
                try:
                    out.append(json.dumps(json.loads(text[begin : token.end()]), sort_keys=True))
                except ValueError:
                    continue
        elif mark == "]" and not depth:
            break
    return out


def salvaged_header(text: Column, field: str) -> Column:
    """A header field's text, as it stands before the rows of a JSON text that may break off; null without one."""
    head = F.regexp_extract(text, r'(?s)^(.*?)"(?:rows|invoices)"', 1)
    return F.nullif(F.regexp_extract(head, rf'"{field}"\s*:\s*"([^"]*)"', 1), F.lit(""))


NESTED_ROW = (
    "raw map<string,string>, mapped struct<invoice_number:string,date:string,due_date:string,charges:string,amount_due:string,"
    "ro_number:string,po_number:string,description:string,credits:string,shop:string>"
)


def nested_invoices(rows: DataFrame, column: str = "row_json") -> DataFrame:
    """``rows`` with an ``invoice`` struct from nested rows {raw, mapped}; without ``mapped`` the raw columns, or the row itself, count."""
    parsed = F.from_json(F.col(column), NESTED_ROW)
    flat = F.from_json(F.col(column), "map<string,string>")
    raw = F.when(F.size(F.coalesce(parsed["raw"], F.create_map().cast("map<string,string>"))) > 0, parsed["raw"])
    filled = F.coalesce(*[parsed["mapped"][c] for c in _NESTED]).isNotNull()
    loose = F.coalesce(raw, flat)

    def of(name: str) -> Column:
        return F.when(filled, parsed["mapped"][name]).otherwise(loose[name])

    return rows.withColumn("invoice", F.struct(
        of("invoice_number").alias("invoice_number"), of("date").alias("invoice_date"), of("due_date").alias("due_date"),
        of("charges").try_cast("double").alias("amount"), of("amount_due").try_cast("double").alias("outstanding_amount"),
        of("ro_number").alias("ro_number"), of("po_number").alias("po_number"),
        F.coalesce(F.to_json(raw), of("description")).alias("description"), of("credits").try_cast("double").alias("credit"), of("shop").alias("shop"),
    ))


_NESTED = ("invoice_number", "date", "due_date", "charges", "amount_due", "ro_number", "po_number", "description", "credits", "shop")


def salvage(texts: DataFrame, column: str = "text") -> DataFrame:
    """``texts`` with ``objects``: the whole objects as JSON, in order (Arrow batches)."""

    @F.pandas_udf("array<string>")
    def objects(values: pd.Series) -> pd.Series:
        return values.map(salvage_objects)

    return texts.withColumn("objects", objects(F.col(column)))


def fenced_json(text: Column) -> Column:
    """The text itself if it begins like JSON, else its first fenced block."""
    return F.when(strip(text).rlike(r"^[\[{]"), text).otherwise(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")))
