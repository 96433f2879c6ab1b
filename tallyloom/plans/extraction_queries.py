"""Extraction operators over texts, cells, headers and words derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import extraction, pages
from tallyloom.plans.oracles import fixtures
from tallyloom.plans.register import Register
from tallyloom.plans.views import Views
from tallyloom.sources.tables import read_table

add = Register()
#: Headers of the fixture documents by residue of the order key.
_HEADERS = ["Invoice #", "Posting Date", "Amount Due", "Credits", "Amount", "RO No", "Notes", "Shop", "Ref", "Inv No"]
_HEADER_SQL = "['" + "','".join(_HEADERS) + "']"


def _items(v: Views):
    return read_table(v.spark, v.sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


def _headers(v: Views):
    """Headers of a document, chosen by line item; several may stand at one position."""
    names = F.array(*map(F.lit, _HEADERS))
    return _items(v).select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).cast("int").alias("pos"), "l_partkey").select(
        "doc_id", "pos", F.get(names, (F.col("l_partkey") % len(_HEADERS)).cast("int")).alias("header"), "l_partkey")


def _values(v: Views):
    """Three values a column: account codes, plain numbers and nulls, by residues of the part."""
    part = F.col("l_partkey")
    rows = _headers(v).withColumn("row_num", F.explode(F.array(*map(F.lit, range(3)))))
    value = F.when((part + F.col("row_num")) % 5 == 0, None).when((part + F.col("row_num")) % 3 == 0, F.concat(F.lit("60 35 "), part)).otherwise(F.concat(F.lit("P"), part))
    return rows.withColumn("value", value)


_HEADERS_SQL = f"hd AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber-1 AS INT) AS pos, {_HEADER_SQL}[CAST(l_partkey%{len(_HEADERS)} AS INT)+1] AS header, l_partkey FROM lineitem)"
#: Several headers at one position are settled by text, several invoice columns by their values.
add(
    "map_columns_a", lambda v: extraction.map_columns_a(_headers(v), _values(v)),
    f"""WITH {_HEADERS_SQL}, m AS (SELECT *, CASE header WHEN 'Invoice #' THEN 'invoice_number' WHEN 'Inv No' THEN 'invoice_number' WHEN 'Posting Date' THEN 'invoice_date' WHEN 'Amount Due' THEN 'outstanding_amount'
    WHEN 'Credits' THEN 'credit' WHEN 'Amount' THEN 'amount' WHEN 'RO No' THEN 'ro_number' WHEN 'Notes' THEN 'description' WHEN 'Shop' THEN 'shop' END AS field FROM hd),
    vl AS (SELECT doc_id, pos, header, CASE WHEN (l_partkey+k)%5=0 THEN NULL WHEN (l_partkey+k)%3=0 THEN 1.0 ELSE 0.0 END AS a FROM m, (SELECT unnest([0,1,2]) AS k) WHERE field='invoice_number'),
    sh AS (SELECT doc_id, pos, header, avg(a) AS share FROM vl GROUP BY ALL)
    SELECT m.doc_id, field, m.header, m.pos FROM m LEFT JOIN sh ON field='invoice_number' AND sh.doc_id=m.doc_id AND sh.pos=m.pos AND sh.header=m.header
    WHERE field IS NOT NULL QUALIFY row_number() OVER (PARTITION BY m.doc_id, field ORDER BY coalesce(share, 2), m.pos, m.header)=1""",
)
add(
    "map_columns_b", lambda v: extraction.map_columns_b(_headers(v)),
    f"""WITH {_HEADERS_SQL}, m AS (SELECT *, CASE header WHEN 'Invoice #' THEN 'invoice_number' WHEN 'Inv No' THEN 'invoice_number' WHEN 'Amount Due' THEN 'outstanding_amount' WHEN 'Amount' THEN 'amount'
    WHEN 'RO No' THEN 'ro_number' WHEN 'Ref' THEN 'invoice_number' END AS field FROM hd), r AS (SELECT *, CASE WHEN field='amount' THEN pos ELSE -pos END AS k FROM m WHERE field IS NOT NULL)
    SELECT doc_id, field, header, pos FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY k, header)=1""",
)
add(
    "pseudo_table", lambda v: read_table(v.spark, v.sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(extraction.pseudo_table(F.col("text"))).alias("row_no", "cells")).select(
        "doc_id", "row_no", F.size("cells").alias("n_cells"), F.get("cells", F.lit(0)).alias("first_cell")),
    r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$', '', 'g')), lambda s: s<>'') AS lines FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, CAST(generate_subscripts(lines, 1)-1 AS INT) AS row_no, unnest(lines) AS line FROM l),
    c AS (SELECT *, string_split_regex(line, '[\s\x0B]{2,}') AS wide, string_split_regex(line, '[\s\x0B]+') AS narrow FROM p)
    SELECT doc_id, row_no, CAST(CASE WHEN len(wide)=1 THEN len(narrow) ELSE len(wide) END AS INT) AS n_cells, CASE WHEN len(wide)=1 THEN narrow[1] ELSE wide[1] END AS first_cell FROM c""",
)
add(
    "find_header",
    lambda v: v.lines.select("seq", extraction.find_header(F.array(F.array("vendor_id"), F.array(F.lit("x"), F.lit("")), F.when(F.col("seq") % 3 == 0, F.array(F.lit("Invoice"), F.lit("Amt Due"))).otherwise(F.array("invoice_number")),
                                                              F.array(F.lit("Date"), F.lit("Balance")))).alias("header_row")),
    fixtures("SELECT seq, CAST(CASE WHEN seq%3=0 THEN 2 ELSE 3 END AS INT) AS header_row FROM f_stmt"),
)


def _documents(v: Views):
    invoice = F.struct(F.col("invoice_number"), F.col("outstanding_amount").cast("double").alias("outstanding_amount"), F.lit(0.95).alias("line_confidence"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", invoice.alias("i")))), lambda x: x["i"])
    docs = v.lines.groupBy("statement_id", "vendor_id").agg(ordered.alias("invoices"))
    value = F.to_json(F.struct(F.struct(F.col("vendor_id").alias("vendor_name")).alias("vendor_metadata"), F.col("invoices")))
    return docs.select(F.col("statement_id").alias("doc_id"), value.alias("value"))


add(
    "doc_json_explode", lambda v: extraction.document_invoices(_documents(v)),
    fixtures("""SELECT statement_id AS doc_id, vendor_id AS vendor_name, CAST(row_number() OVER (PARTITION BY statement_id ORDER BY seq)-1 AS INT) AS pos, invoice_number,
    CAST(outstanding_amount AS DOUBLE) AS outstanding_amount FROM f_stmt"""),
)


def _pages(v: Views):
    return v.lines.select(
        F.col("statement_id").alias("doc_id"), F.col("seq").alias("page_no"), F.col("invoice_number").alias("metadata"), ((F.col("seq") % 10) / 10).alias("confidence"),
        F.array("invoice_number", F.col("outstanding_amount").cast("string")).alias("rows"), F.array(F.lit("Invoice"), F.concat(F.lit("C"), F.col("seq") % 4)).alias("columns"))


add(
    "page_merge", lambda v: extraction.page_merge(_pages(v)).withColumn("rows", F.array_join("rows", "|")),
    fixtures("""SELECT statement_id AS doc_id, count(*) AS page_count, min((seq%10)/10) AS confidence, arg_min(invoice_number, seq) AS metadata,
    string_agg(invoice_number||'|'||CAST(outstanding_amount AS VARCHAR), '|' ORDER BY seq) AS rows FROM f_stmt GROUP BY 1"""),
)
add(
    "columns_union", lambda v: extraction.columns_union(_pages(v)).withColumn("columns", F.array_join("columns", "|")),
    fixtures("""SELECT doc_id, 'Invoice|'||string_agg(c, '|' ORDER BY k) AS columns FROM (SELECT statement_id AS doc_id, 'C'||(seq%4) AS c, min(seq) AS k FROM f_stmt GROUP BY ALL) GROUP BY 1"""),
)
add(
    "cleanest_column",
    lambda v: extraction.cleanest_column(v.lines.select(F.col("statement_id").alias("doc_id"), (F.col("seq") % 3).alias("pos"), F.concat(F.lit("H"), F.col("seq") % 3).alias("header"), F.col("seq").alias("row_num"),
                                                        F.when(F.col("seq") % 7 < 3, F.concat(F.lit("60 35 "), "invoice_number")).otherwise(F.col("invoice_number")).alias("value"))),
    fixtures("""SELECT doc_id, arg_min(header, [share, pos]) AS header FROM (SELECT doc_id, pos, header, avg(CASE WHEN a THEN 1.0 ELSE 0.0 END) AS share
    FROM (SELECT statement_id AS doc_id, seq%3 AS pos, 'H'||(seq%3) AS header, seq%7<3 AS a, row_number() OVER (PARTITION BY statement_id, seq%3 ORDER BY seq) AS k FROM f_stmt) WHERE k<=200 GROUP BY ALL) GROUP BY doc_id"""),
)


def _all_cells(v: Views):
    return _items(v).select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).cast("int").alias("row_index"), (F.col("l_partkey") % 4).cast("int").alias("column_index"),
                             F.lit(5).alias("n_rows"), F.lit(3).alias("n_columns"), F.col("l_partkey").cast("string").alias("content"))


add(
    "cells_to_grid", lambda v: extraction.cells_to_grid(_all_cells(v)).withColumn("cells", F.array_join("cells", "|")),
    """SELECT l_orderkey AS table_id, CAST(l_linenumber-1 AS INT) AS row_index,
    concat_ws('|', coalesce(min(t) FILTER (c=0),''), coalesce(min(t) FILTER (c=1),''), coalesce(min(t) FILTER (c=2),'')) AS cells
    FROM (SELECT *, l_partkey%4 AS c, CAST(l_partkey AS VARCHAR) AS t FROM lineitem) WHERE c<3 AND l_linenumber<=5 GROUP BY ALL""",
)
add(
    "continuation_tables",
    lambda v: extraction.continuation_tables(v.lines.select(F.col("statement_id").alias("doc_id"), F.col("seq").alias("table_no"), (F.col("seq") % 4 / 2).cast("int").alias("width"),
                                                            F.when(F.col("seq") % 5 < 2, (F.col("seq") % 3).cast("int")).alias("header_row"))),
    fixtures("""SELECT doc_id, table_no, use, CASE WHEN use IN ('own','continued') THEN t END AS header_table FROM (
      SELECT *, CASE WHEN own THEN 'own' WHEN w IS NULL THEN 'no header' WHEN w=width THEN 'continued' ELSE 'width differs' END AS use FROM (
        SELECT *, last_value(CASE WHEN own THEN width END IGNORE NULLS) OVER o AS w, last_value(CASE WHEN own THEN table_no END IGNORE NULLS) OVER o AS t FROM (
          SELECT statement_id AS doc_id, seq AS table_no, CAST(floor((seq%4)/2) AS INT) AS width, seq%5<2 AND seq%3<=1 AS own FROM f_stmt)
        WINDOW o AS (PARTITION BY doc_id ORDER BY table_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""),
)
add(
    "block_groups",
    lambda v: extraction.block_groups(v.lines.select(F.col("statement_id").alias("file"), F.col("seq").alias("pos"),
                                                     F.when(F.col("seq") % 5 == 0, "header").when(F.col("seq") % 7 == 0, "footer").otherwise("detail").alias("role"),
                                                     F.concat(F.when(F.col("seq") % 2 == 0, "KEEP ").otherwise("DROP "), "invoice_number").alias("label")), "KEEP"),
    fixtures("""SELECT file, pos, role, group_header FROM (
      SELECT *, last_value(CASE WHEN role='header' THEN label END IGNORE NULLS) OVER (PARTITION BY file, closed ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS group_header FROM (
        SELECT *, coalesce(sum(CASE WHEN role='footer' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS closed FROM (
          SELECT statement_id AS file, seq AS pos, CASE WHEN seq%5=0 THEN 'header' WHEN seq%7=0 THEN 'footer' ELSE 'detail' END AS role,
                 CASE WHEN seq%2=0 THEN 'KEEP ' ELSE 'DROP ' END||invoice_number AS label FROM f_stmt)))
      WHERE group_header LIKE '%KEEP%' OR (role='footer' AND label LIKE '%KEEP%')"""),
)
_BOUNDS = [("date", 20.0), ("invoice", 35.0)]
#: Words at one place go by text.
add(
    "bucket_columns",
    lambda v: extraction.bucket_columns(_items(v).select(F.col("l_orderkey").alias("row_id"), F.col("l_quantity").alias("x"), F.col("l_partkey").cast("string").alias("text")), _BOUNDS, "amount"),
    """SELECT l_orderkey AS row_id, CASE WHEN l_quantity<20 THEN 'date' WHEN l_quantity<35 THEN 'invoice' ELSE 'amount' END AS column,
    string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_quantity, CAST(l_partkey AS VARCHAR)) AS text FROM lineitem GROUP BY ALL""",
)
add(
    "row_cluster",
    lambda v: extraction.row_clusters(_items(v).select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("double").alias("x"), (F.col("l_quantity") / 4).alias("y"), F.col("l_partkey").cast("string").alias("text")), 1.0),
    """WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, t) AS k, count(*) OVER (PARTITION BY page_id) AS n FROM
      (SELECT l_orderkey AS page_id, CAST(l_linenumber AS DOUBLE) AS x, CAST(l_quantity/4 AS DOUBLE) AS y, CAST(l_partkey AS VARCHAR) AS t FROM lineitem)),
    f AS (SELECT page_id, k, n, [{'y': y, 'n': 1, 'ws': [{'x': x, 't': t}]}] AS r FROM w WHERE k=1
      UNION ALL SELECT page_id, k, n, CASE WHEN hit=0 THEN list_append(r, {'y': y, 'n': 1, 'ws': [{'x': x, 't': t}]}) ELSE
        list_concat(r[1:hit-1], [{'y': (r[hit].y*r[hit].n+y)/(r[hit].n+1), 'n': r[hit].n+1, 'ws': list_append(r[hit].ws, {'x': x, 't': t})}], r[hit+1:]) END FROM
        (SELECT w.*, f.r, coalesce(list_position(list_transform(f.r, lambda e: abs(e.y-w.y)<=1.0), true), 0) AS hit FROM f JOIN w ON w.page_id=f.page_id AND w.k=f.k+1)),
    e AS (SELECT page_id, unnest(r) AS r, generate_subscripts(r, 1) AS made FROM f WHERE k=n)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY r.y, made)-1 AS INT) AS row_no, array_to_string(list_transform(list_sort(r.ws), lambda e: e.t), ' ') AS text FROM e""",
)
add(
    "fallback_mapping",
    lambda v: extraction.fallback_fields(v.lines.select(F.col("seq").alias("row_id"), F.array(
        F.struct(F.lit("Col A").alias("key"), F.lit("12DEC25").alias("value")), F.struct(F.lit("Col B").alias("key"), F.col("invoice_number").alias("value")),
        F.struct(F.lit("Col C").alias("key"), F.col("outstanding_amount").cast("string").alias("value"))).alias("cells"),
        F.when(F.col("seq") % 4 == 0, F.array("invoice_number")).otherwise(F.array().cast("array<string>")).alias("used"))),
    fixtures("SELECT seq AS row_id, CASE WHEN seq%4>0 THEN invoice_number END AS invoice_number, CAST(outstanding_amount AS VARCHAR) AS amount_text FROM f_stmt"),
)


def _truncated(v: Views):
    row = F.concat(F.lit('{"invoice": "'), "invoice_number", F.lit('", "note": "a } \\" b"}'))
    body = F.concat(F.lit('{"rows": ['), row, F.lit(", "), row, F.lit("]}"))
    return v.lines.select("seq", F.when(F.col("seq") % 2 == 0, body).otherwise(F.left(body, F.length(body) - 5)).alias("text"))


add(
    "json_salvage", lambda v: extraction.salvage(_truncated(v)).select("seq", F.size("objects").alias("n"), F.get_json_object(F.get("objects", F.lit(0)), "$.invoice").alias("invoice")),
    fixtures("SELECT seq, CAST(CASE WHEN seq%2=0 THEN 2 ELSE 1 END AS INT) AS n, invoice_number AS invoice FROM f_stmt"),
)


def _broken(v: Views):
    """Row arrays with a bad element, a null and a broken end, behind header fields."""
    head = F.concat(F.lit('{"vendor_name" : "'), "vendor_id", F.lit('", "statement_date": "'), "statement_period", F.lit('", "rows": ['))
    rows = F.concat(F.lit('{"n": "'), "invoice_number", F.lit('"}, {bad: 2}, null, {"n": "b ] }"}, {"n": '))
    return v.lines.select("seq", F.when(F.col("seq") % 3 == 0, rows).otherwise(F.concat(head, rows)).alias("text"))


add(
    "json_salvage_broken",
    lambda v: extraction.salvage(_broken(v)).select(
        "seq", F.array_join("objects", "|").alias("objects"), extraction.salvaged_header(F.col("text"), "vendor_name").alias("vendor_name"),
        extraction.salvaged_header(F.col("text"), "statement_date").alias("statement_date")),
    fixtures("""SELECT seq, CASE WHEN seq%3=0 THEN '' ELSE '{"n": "'||invoice_number||'"}|{"n": "b ] }"}' END AS objects,
    CASE WHEN seq%3<>0 THEN vendor_id END AS vendor_name, CASE WHEN seq%3<>0 THEN statement_period END AS statement_date FROM f_stmt"""),
)
_ROW_FORMS = ["""'{"raw": {"Inv": "' || invoice_number || '"}, "mapped": {"invoice_number": "' || invoice_number || '", "date": "2024-01-02", "charges": "12.5", "amount_due": "x"}}'""",
              """'{"raw": {"invoice_number": "' || invoice_number || '", "amount_due": "7"}, "mapped": {}}'""",
              """'{"invoice_number": "' || invoice_number || '", "description": "plain", "credits": "-3"}'""", "'not json'"]
_ROW_JSON = "CASE seq % 4 " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(_ROW_FORMS)) + " END"
add(
    "nested_rows", lambda v: extraction.nested_invoices(v.lines.select("seq", F.expr(_ROW_JSON).alias("row_json"))).select(
        "seq", "invoice.invoice_number", "invoice.invoice_date", "invoice.amount", "invoice.outstanding_amount", "invoice.description", "invoice.credit"),
    fixtures("""SELECT seq, CASE WHEN seq%4<3 THEN invoice_number END AS invoice_number, CASE WHEN seq%4=0 THEN '2024-01-02' END AS invoice_date,
    CAST(CASE WHEN seq%4=0 THEN 12.5 END AS DOUBLE) AS amount, CAST(CASE WHEN seq%4=1 THEN 7 END AS DOUBLE) AS outstanding_amount,
    CASE seq%4 WHEN 0 THEN '{"Inv":"'||invoice_number||'"}' WHEN 1 THEN '{"invoice_number":"'||invoice_number||'","amount_due":"7"}' WHEN 2 THEN 'plain' END AS description,
    CAST(CASE WHEN seq%4=2 THEN -3 END AS DOUBLE) AS credit FROM f_stmt"""),
)
add(
    "fenced_json",
    lambda v: v.lines.select("seq", extraction.fenced_json(F.expr("CASE seq % 4 WHEN 0 THEN concat(' {\"i\": \"', invoice_number, '\"}') WHEN 1 THEN concat('Here:\n```json\n{', invoice_number, '}\n```\nDone ```x```') "
                                                                 "WHEN 2 THEN concat('```', invoice_number, '```') ELSE invoice_number END")).alias("body")),
    fixtures("""SELECT seq, CASE seq%4 WHEN 0 THEN ' {"i": "'||invoice_number||'"}' WHEN 1 THEN '{'||invoice_number||'}'||chr(10) WHEN 2 THEN invoice_number END AS body FROM f_stmt"""),
)
add(
    "truncated_documents",
    lambda v: v.lines.select("seq", extraction.is_truncated(F.col("seq") % 7, F.col("seq") % 3, F.col("seq") % 2 == 0, F.when(F.col("seq") % 5 != 0, F.col("seq") % 41)).alias("truncated")),
    fixtures("""SELECT seq, (seq%7=0 AND seq%3>0) OR coalesce(seq%2=0 AND b>0 AND seq%7 < b*0.1, false) AS truncated FROM (SELECT *, CASE WHEN seq%5<>0 THEN seq%41 END AS b FROM f_stmt)"""),
)


def _heads():
    return F.concat(F.lit("\n  "), "vendor_id", F.lit("\nStatement\n"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("West COLLISION "), "seq", F.lit(" \n"))).otherwise(""), F.lit("Auto body two"))


add(
    "header_info", lambda v: v.lines.select("seq", *[c.alias(n) for c, n in zip(extraction.header_info(_heads()), ("vendor", "shop"), strict=True)]),
    fixtures("SELECT seq, vendor_id AS vendor, CASE WHEN seq%2=0 THEN 'West COLLISION '||seq ELSE 'Auto body two' END AS shop FROM f_stmt"),
)


def _statement_pages(v: Views):
    """Ten lines of a statement a page: as a table, as scanned text, as a table without headers, or as nothing that can be read."""
    number = F.expr("(row_number() OVER (PARTITION BY statement_id ORDER BY seq) - 1) div 10")
    lines = v.lines.select("statement_id", "vendor_id", "seq", "invoice_number", F.col("outstanding_amount").cast("string").alias("due"), (number + 1).cast("int").alias("page_no"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "invoice_number", "due"))), lambda x: F.array(x["invoice_number"], x["due"], F.lit("")))
    pages = lines.groupBy("statement_id", "vendor_id", "page_no").agg(ordered.alias("body"), F.min("seq").alias("seq"))
    kind = F.col("seq") % 6
    head = F.array(F.array(F.lit("Statement"), F.lit(""), F.lit(None).cast("string")), F.array(*map(F.lit, ("Invoice No", "Amount Due", "RO No"))))
    total = F.array(F.array(F.lit(""), F.lit(None).cast("string"), F.lit("")), F.array(F.lit("Subtotal"), F.lit("$1,000.00"), F.lit("")))
    grid = F.concat(head, "body", total)
    spelt = F.array_join(F.transform(grid, lambda r: F.rtrim(F.array_join(r, "   ", ""))), "\n")
    text = F.concat("vendor_id", F.lit("\nWest Collision "), "page_no")
    return pages.select(
        F.col("statement_id").alias("doc_id"), "page_no", F.when(kind == 2, F.repeat(F.concat(text, F.lit(" ")), 60)).otherwise(text).alias("text"),
        F.when(kind < 2, grid).when(kind == 3, F.slice(grid, 3, 99)).alias("grid"), F.when(kind == 4, F.concat(spelt, F.lit("   "), F.repeat(F.lit("x"), 500))).when(kind == 5, spelt).alias("scan_text"))


_PAGES_SQL = """pl AS (SELECT *, CAST((row_number() OVER (PARTITION BY statement_id ORDER BY seq)-1)//10+1 AS INT) AS page_no, CAST((row_number() OVER (PARTITION BY statement_id ORDER BY seq)-1)%10+1 AS INT) AS row_no FROM f_stmt),
    pk AS (SELECT *, min(seq) OVER (PARTITION BY statement_id, page_no)%6 AS kind FROM pl)"""


def _of_pages(body: str) -> str:
    return fixtures("SELECT 1").removesuffix(" SELECT 1") + f", {_PAGES_SQL} {body}"


add(
    "page_lines",
    lambda v: pages.lines(pages.decide(_statement_pages(v))).select(
        "doc_id", "page_no", "row_no", "invoice_number", "outstanding_amount", "amount", "line_confidence", F.substring("shop", 1, 14).alias("shop")),
    _of_pages("""SELECT statement_id AS doc_id, page_no, row_no, invoice_number, CAST(outstanding_amount AS DOUBLE) AS outstanding_amount, CAST(outstanding_amount AS DOUBLE) AS amount,
    CAST(CASE WHEN kind=4 THEN 0.5 ELSE 0.65 END AS DOUBLE) AS line_confidence, 'West Collision' AS shop FROM pk WHERE kind IN (0,1,4)"""),
)


def _page_documents(v: Views):
    decided = pages.decide(_statement_pages(v))
    return pages.documents(decided, pages.lines(decided))


add(
    "page_warnings",
    lambda v: _page_documents(v).select("doc_id", "vendor", "page_count", "confidence", F.explode_outer("warnings").alias("w")).select("doc_id", "vendor", "page_count", "confidence", "w.code", "w.severity", "w.page_no"),
    _of_pages("""SELECT doc_id, vendor_id AS vendor, page_count, CAST(CASE WHEN good THEN 0.65 ELSE 0.2 END AS DOUBLE) AS confidence, code, severity, p AS page_no FROM
    (SELECT statement_id AS doc_id, vendor_id, max(page_no) AS page_count, bool_or(kind IN (0,1,4)) AS good FROM pk GROUP BY ALL) LEFT JOIN
    (SELECT DISTINCT statement_id AS doc_id, page_no AS p, CASE kind WHEN 3 THEN 'AMBIGUOUS_COLUMN' ELSE 'UNSUPPORTED_LAYOUT' END AS code, CASE kind WHEN 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM pk WHERE kind IN (2,3,5)) USING (doc_id)"""),
)
QUERIES, ORACLES = add.queries, add.oracles
