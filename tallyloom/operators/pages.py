"""Statement lines from pages: which source a page is read from, its header and columns, its lines and warnings.

A page is read from its table; a page without one and with hardly any text is taken
as scanned and read from the text that character recognition gave, with less
confidence; other pages are passed over with a warning. The first page's text names
vendor and shop for all pages of the document. Every step is a column of the page's own
row; only the first page's names and the document's result meet by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import config
from tallyloom.functions.amounts import parse_b
from tallyloom.functions.texts import is_totals_row
from tallyloom.operators.extraction import find_header, header_field_b, header_info, pseudo_table
from tallyloom.operators.quality import strip

FIELDS = ("invoice_number", "invoice_date", "due_date", "outstanding_amount", "amount", "ro_number", "po_number", "work_order_number", "description")
_WARNING = "struct<code:string,severity:string,page_no:int,message:string>"


def _short(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) < config.SCANNED_TEXT_BELOW


def _warning(code: str, severity: str, message: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("page_no").cast("int").alias("page_no"), F.lit(message).alias("message")).cast(_WARNING)


def decide(pages: DataFrame) -> DataFrame:
    """``pages`` with the ``table`` to read, whether it is ``scanned``, the ``header`` row's place, and a ``warning`` where there is nothing to read.

    ``pages``: doc_id, page_no, text, grid (array<array<string>> or null), scan_text (null: no recognition).
    """
    whole = F.coalesce(F.size("grid") >= 2, F.lit(False))
    out = pages.withColumns({"whole": whole, "sparse": _short(F.col("text"))})
    pseudo = F.when(~F.col("whole") & F.col("sparse") & ~_short(F.col("scan_text")), pseudo_table(F.col("scan_text")))
    out = out.withColumn("pseudo", pseudo)
    scanned = F.coalesce(~F.col("whole") & (F.size("pseudo") >= 2), F.lit(False))
    out = out.withColumn("scanned", scanned).withColumn("table", F.when(F.col("whole"), F.col("grid")).when(F.col("scanned"), F.col("pseudo")))
    out = out.withColumn("header", find_header(F.col("table")))
    warning = (
        F.when(~F.col("whole") & ~F.col("sparse"), _warning("UNSUPPORTED_LAYOUT", "MEDIUM", "no table structure"))
        .when(~F.col("whole") & F.col("scan_text").isNull(), _warning("OTHER", "MEDIUM", "looks scanned and could not be recognised"))
        .when(~F.col("whole") & _short(F.col("scan_text")), _warning("UNSUPPORTED_LAYOUT", "MEDIUM", "recognised text is too short"))
        .when(~F.col("whole") & ~F.col("scanned"), _warning("AMBIGUOUS_COLUMN", "HIGH", "recognised text has no columns"))
        .when(F.col("header").isNull(), _warning("AMBIGUOUS_COLUMN", "HIGH", "no column headers"))
    )
    return out.withColumn("warning", warning).drop("whole", "sparse", "pseudo")


def _column_places(names: Column) -> Column:
    """Place of each field's column: the last one, but the first of ``amount``; null without one."""
    last = {f: F.size(names) - F.array_position(F.reverse(names), f) for f in FIELDS}
    places = {f: F.array_position(names, f) - 1 if f == "amount" else p for f, p in last.items()}
    return F.struct(*[F.when(F.array_contains(names, f), p).cast("int").alias(f) for f, p in places.items()])


def lines(decided: DataFrame) -> DataFrame:
    """One row per statement line: doc_id, page_no, row_no, the fields, shop and confidence; ``decided``: of ``decide``."""
    first = decided.where("page_no = 1").select("doc_id", header_info(F.col("text"), config.SHOP_WORDS)[1].alias("shop"))
    read = decided.where("header is not null")
    names = F.transform(F.get("table", F.col("header")), lambda c: F.coalesce(F.when(c != "", header_field_b(c)), F.lit("")))
    read = read.withColumn("names", names).withColumn("place", _column_places(F.col("names")))
    body = F.slice("table", F.col("header") + 2, F.size("table"))
    read = read.select("doc_id", "page_no", "scanned", "place", F.posexplode(body).alias("at", "row"))

    def cell(field: str) -> Column:
        value = F.get("row", F.col(f"place.{field}"))
        return F.when(value != "", strip(value)).alias(field)

    cells = read.select("doc_id", "page_no", "scanned", (F.col("at") + 1).alias("row_no"), *[cell(f) for f in FIELDS])
    found = F.coalesce(F.col("invoice_number") != "", F.lit(False)) | F.coalesce(F.col("outstanding_amount") != "", F.lit(False))
    kept = cells.where(found & ~is_totals_row(F.col("invoice_number")))
    kept = kept.withColumns({"outstanding_amount": parse_b(F.col("outstanding_amount")), "amount": parse_b(F.col("amount"))})
    amount = F.coalesce(F.when(F.col("amount") != 0, F.col("amount")), F.col("outstanding_amount"))
    confidence = F.when(F.col("scanned"), config.SCANNED_LINE_CONFIDENCE).otherwise(config.TABLE_LINE_CONFIDENCE)
    return kept.withColumns({"amount": amount, "line_confidence": confidence}).drop("scanned").join(first, "doc_id", "left")


def documents(decided: DataFrame, found: DataFrame) -> DataFrame:
    """One row per document: vendor, shop, pages, lines, total, confidence, scanned pages, and the warnings in page order."""
    vendor, shop = header_info(F.col("text"), config.SHOP_WORDS)
    place = F.struct("page_no", "warning")
    pages = decided.groupBy("doc_id").agg(
        F.count("*").alias("page_count"), F.max(F.when(F.col("page_no") == 1, vendor)).alias("vendor"), F.max(F.when(F.col("page_no") == 1, shop)).alias("shop"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("warning").isNotNull(), place))), lambda x: x["warning"]).alias("warnings"),
        F.sort_array(F.collect_list(F.when(F.col("scanned"), F.col("page_no")))).alias("scanned_pages"),
    )
    sums = found.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.col("outstanding_amount").cast("decimal(18,2)")).alias("total"))
    both = pages.join(sums, "doc_id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    some = F.col("n_lines") > 0
    return both.withColumns({
        "total": F.when(some, F.coalesce("total", F.lit(0).cast("decimal(18,2)"))),
        "confidence": F.when(some, config.TABLE_LINE_CONFIDENCE).otherwise(config.NO_LINES_CONFIDENCE),
    })
