"""Scalar functions over fixture columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom import config
from tallyloom.functions import amounts, dates, texts
from tallyloom.operators import extraction, identity
from tallyloom.plans.oracles import FIXTURES, fixtures
from tallyloom.plans.register import Register
from tallyloom.plans.views import Views
from tallyloom.sources.tables import read_table

add = Register()
_NUM = r"CASE WHEN regexp_full_match(trim({0}),'[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(trim({0}) AS DOUBLE) END"


def _spell(k: Column, spellings: list[Column]) -> Column:
    out = F.when(F.lit(False), "")
    for n, s in enumerate(spellings):
        out = out.when(k % len(spellings) == n, s)
    return out


def _amounts(v: Views):
    t = F.format_number("outstanding_amount", 2)
    forms = [F.concat(F.lit("$"), t), F.concat(F.lit("("), t, F.lit(")")), F.concat(t, F.lit("-")), F.concat(F.lit("-"), t),
             F.concat(t, F.lit(" USD")), F.lit(""), F.lit("1e3"), F.lit("12d")]
    return v.lines.select("seq", _spell(F.col("seq"), forms).alias("text"))


_AMOUNTS = """am0 AS (SELECT seq, seq%8 AS k, format('{:,.2f}', CAST(outstanding_amount AS DOUBLE)) AS t FROM f_stmt),
am AS (SELECT seq, CASE k WHEN 0 THEN '$'||t WHEN 1 THEN '('||t||')' WHEN 2 THEN t||'-' WHEN 3 THEN '-'||t WHEN 4 THEN t||' USD' WHEN 5 THEN '' WHEN 6 THEN '1e3' ELSE '12d' END AS text FROM am0),
am1 AS (SELECT *, replace(replace(trim(text),',',''),'$','') AS s, regexp_replace(text,'[^0-9.\\-]','','g') AS kept FROM am),
am2 AS (SELECT *, regexp_replace(regexp_replace(s,'^[()]+|[()]+$','','g'),'-+$','') AS bare FROM am1)"""


def _amount_sql(value: str) -> str:
    return fixtures("SELECT 1").removesuffix(" SELECT 1") + f", {_AMOUNTS} SELECT seq, {value} AS value FROM am2"


add("parse_amount_a", lambda v: _amounts(v).select("seq", amounts.parse_a(F.col("text")).alias("value")),
    _amount_sql(f"CASE WHEN s LIKE '%-' OR (s LIKE '(%' AND s LIKE '%)') THEN -({_NUM.format('bare')}) ELSE {_NUM.format('bare')} END"))
add("parse_amount_b", lambda v: _amounts(v).select("seq", amounts.parse_b(F.col("text")).alias("value")), _amount_sql(_NUM.format("kept")))
add("parse_amount_c", lambda v: _amounts(v).select("seq", amounts.parse_c(F.col("text")).alias("value")), _amount_sql(_NUM.format("s")))
add("parse_amount_d", lambda v: _amounts(v).select("seq", amounts.parse_d(F.col("text")).alias("value")), _amount_sql(_NUM.format("text")))
_CONFIDENCE = ["0.95", "1.5", "-0.2", "high", ""]
add(
    "parse_confidence",
    lambda v: v.lines.select("seq", amounts.parse_confidence(_spell(F.col("seq"), [F.lit(c) for c in _CONFIDENCE])).alias("value")),
    fixtures("SELECT seq, CAST(CASE WHEN seq%5=0 THEN 0.95 ELSE 0.40 END AS DOUBLE) AS value FROM f_stmt"),
)
def _value() -> Column:
    return (F.col("outstanding_amount") - 200000).cast("double")


add(
    "money_format",
    lambda v: v.lines.select("seq", amounts.money(_value()).alias("money"), amounts.money_signed(_value()).alias("signed"), amounts.money_short(_value()).alias("short")),
    fixtures("""SELECT seq, CASE WHEN x<0 THEN '$-' ELSE '$' END||format('{:,.2f}',abs(x)) AS money, CASE WHEN x<0 THEN '−' ELSE '' END||'$'||format('{:,.2f}',abs(x)) AS signed,
    CASE WHEN abs(x)>=1000 THEN '$'||format('{:,.1f}',x/1000)||'K' ELSE '$'||format('{:,.0f}',x) END AS short
    FROM (SELECT seq, CAST(outstanding_amount-200000 AS DOUBLE) AS x FROM f_stmt)"""),
)
add("normalize_invoice", lambda v: v.raw.select("statement_id", "row_num", texts.normalize_invoice(F.col("invoice_number")).alias("invoice")),
    fixtures("SELECT statement_id, row_num, trim(invoice_number) AS invoice FROM f_raw"))
_NAMES_SQL = f"""{FIXTURES}, nm AS (SELECT seq AS id, CASE seq%3 WHEN 0 THEN vendor_id WHEN 1 THEN lower(vendor_id)||', Inc.' ELSE ' '||vendor_id||'  #7' END AS vendor_name FROM f_stmt)"""


def _names(v: Views):
    name, id_ = F.col("vendor_id"), F.col("seq")
    forms = [name, F.concat(F.lower(name), F.lit(", Inc.")), F.concat(F.lit(" "), name, F.lit("  #7"))]
    return v.lines.select(id_.alias("id"), _spell(id_, forms).alias("vendor_name"))


_ALIAS_KEYS = {"NATION1": "FIRST_SUPPLIER", "NATION2 INC": "SECOND_SUPPLIER"}
_ALIAS_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ALIAS_KEYS.items())
add(
    "vendor_identity", lambda v: identity.vendor_identity(_names(v), config.VENDOR_ALIASES),
    f"""WITH {_NAMES_SQL} SELECT id, vendor_name, coalesce(CASE trim(regexp_replace(upper(regexp_replace(vendor_name,'[^A-Za-z0-9 ]','','g')),' +',' ','g')) {_ALIAS_SQL} END,
    left(replace(replace(upper(vendor_name),' ','_'),',',''),50)) AS vendor_id FROM nm""",
)
add(
    "shop_owner", lambda v: identity.shop_owner(v.lines.select("seq", F.col("vendor_id").alias("shop")), config.SHOP_OWNERS),
    fixtures("""SELECT seq, vendor_id AS shop, CASE vendor_id WHEN 'NATION_1' THEN 'Shop Manager <shop@example.com>' WHEN 'NATION_2' THEN 'Owner' WHEN 'NATION_3' THEN 'owner@example.com' END AS owner FROM f_stmt"""),
)
_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce({0},'')),'[^a-z0-9]+','_','g'),'^_+|_+$','','g'),''),'unknown_vendor')"
add("vendor_slug", lambda v: _names(v).select("id", texts.vendor_slug(F.col("vendor_name")).alias("slug")), f"WITH {_NAMES_SQL} SELECT id, {_SLUG.format('vendor_name')} AS slug FROM nm")
add(
    "filename_slug", lambda v: v.lines.select("seq", texts.filename_slug(F.concat(F.lit("in/"), F.lower("vendor_id"), F.lit("_Statement12-"), "statement_period", F.lit(".pdf"))).alias("slug")),
    fixtures("SELECT seq, regexp_replace(lower(vendor_id),'_[0-9]+$','')||'_statement' AS slug FROM f_stmt"),
)
#: Two words of letters give their initials, one its first two letters, none the name's first two.
add(
    "initials", lambda v: _names(v).select("id", texts.initials(F.col("vendor_name")).alias("initials")),
    f"""WITH {_NAMES_SQL}, w AS (SELECT id, vendor_name, list_filter(regexp_split_to_array(translate(vendor_name,'/,','  '),'\\s+'), lambda x: regexp_full_match(x,'\\p{{L}}+')) AS w FROM nm)
    SELECT id, upper(CASE WHEN coalesce(vendor_name,'')='' THEN '??' WHEN len(w)>=2 THEN left(w[1],1)||left(w[2],1) WHEN len(w)=1 THEN left(w[1],2) ELSE left(vendor_name,2) END) AS initials FROM w""",
)
add(
    "blob_path",
    lambda v: v.lines.select("seq", texts.blob_path(F.col("vendor_id"), F.left("statement_period", F.lit(4)), F.right("statement_period", F.lit(2)), F.sha2("invoice_number", 256)).alias("path")),
    fixtures(f"SELECT seq, {_SLUG.format('vendor_id')}||'/'||left(statement_period,4)||'/'||right(statement_period,2)||'/'||sha256(invoice_number)||'.pdf' AS path FROM f_stmt"),
)


def _blob_parts(v: Views):
    container, blob, name = texts.url_parts(F.col("url"))
    return read_table(v.spark, v.sf_dir, "pages").select("page_id", container.alias("container"), blob.alias("blob"), name.alias("file_name"))


add(
    "blob_parts", _blob_parts,
    r"""SELECT page_id, CASE WHEN c<>'' AND b<>'' THEN c END AS container, CASE WHEN c<>'' AND b<>'' THEN b END AS blob, string_split(path,'/')[-1] AS file_name
    FROM (SELECT page_id, path, regexp_extract(path,'^([^/]+)/',1) AS c, regexp_extract(path,'^[^/]+/(.+)$',1) AS b
    FROM (SELECT page_id, regexp_replace(regexp_extract(url,'^[a-z]+://[^/?#]*([^?#]*)',1),'^/+','') AS path FROM pages))""",
)
add(
    "bill_number",
    lambda v: v.lines.select("seq", texts.bill_number(_spell(F.col("seq"), [F.concat(F.lit("Bill #"), "invoice_number"), F.concat(F.lit(" bill credit # "), "invoice_number"), F.lit("Payment")])).alias("bill")),
    fixtures("SELECT seq, CASE WHEN seq%3<2 THEN invoice_number END AS bill FROM f_stmt"),
)
add(
    "value_shape",
    lambda v: v.lines.select("seq", texts.value_shape(_spell(F.col("seq"), [F.col("invoice_number"), F.col("outstanding_amount").cast("string"), F.lit("12/31/2025"), F.lit("60 35 8923821"), F.lit("a b")])).alias("shape")),
    fixtures("SELECT seq, CASE seq%5 WHEN 0 THEN 'invoice' WHEN 1 THEN 'currency' WHEN 2 THEN 'date' WHEN 3 THEN 'account' ELSE 'other' END AS shape FROM f_stmt"),
)
add(
    "totals_rows",
    lambda v: v.lines.select("seq", texts.is_totals_row(_spell(F.col("seq"), [F.col("invoice_number"), F.lit("Sub-Total"), F.lit("BALANCE due"), F.lit(None).cast("string")])).alias("totals")),
    fixtures("SELECT seq, seq%4 IN (1,2) AS totals FROM f_stmt"),
)
add(
    "page_furniture",
    lambda v: v.lines.select("seq", extraction.is_page_furniture(
        _spell(F.col("seq"), [F.col("invoice_number"), F.lit("Transaction"), F.lit("12/31/25, 10:15 AM"), F.lit("https://x.example/r"), F.lit("3 / 7"), F.lit(""), F.concat(F.lit("Payment History by Payment "), "seq"), F.lit("https://a.NetSuite.com/x")]), F.lit("")).alias("furniture")),
    fixtures("""SELECT seq, t='' OR t IN ('transaction','bill type','date','document number','amount','bill','type') OR regexp_matches(t, '^\\d{1,2}/\\d{1,2}/\\d{2,4},?\\s*\\d{1,2}:\\d{2}')
    OR contains(t,'netsuite.com') OR contains(t,'reportrunner') OR contains(t,'payment history by payment') OR regexp_matches(t,'^\\d+\\s*/\\s*\\d+$') AS furniture FROM
    (SELECT seq, lower([invoice_number,'Transaction','12/31/25, 10:15 AM','https://x.example/r','3 / 7','','Payment History by Payment '||seq,'https://a.NetSuite.com/x'][CAST(seq%8 AS INT)+1]) AS t FROM f_stmt)"""),
)
add(
    "voucher_header",
    lambda v: v.lines.select("seq", *[c.alias(n) for c, n in zip(texts.voucher_header(_spell(F.col("seq"), [
        F.concat(F.lit("Payment Voucher\nDate\n1/2/2025\nPaid To\n "), "vendor_id", F.lit(" \nCheck #\n "), "seq", F.lit(" x")), F.concat(F.lit("Check # "), "invoice_number", F.lit("\nPaid To\n"), "vendor_id"), F.lit("Paid To "), F.lit("")])),
        ("vendor", "day", "check_number"), strict=True)]),
    fixtures("SELECT seq, CASE WHEN seq%4<2 THEN vendor_id END AS vendor, CASE WHEN seq%4=0 THEN '1/2/2025' END AS day, CASE seq%4 WHEN 0 THEN CAST(seq AS VARCHAR) WHEN 1 THEN invoice_number END AS check_number FROM f_stmt"),
)
add(
    "doc_routing", lambda v: v.jobs.select("job_id", extraction.document_routing(F.when(F.col("id") % 6 == 0, "VENDOR_STATEMENT").when(F.col("id") % 6 == 1, "PURCHASE_ORDER")).alias("route")),
    fixtures("SELECT job_id, CASE WHEN id%6=0 THEN 'RECONCILIATION' ELSE 'PARKED' END AS route FROM f_jobs"),
)
def _date() -> Column:
    return F.to_date("submitted_at")


def _iso(pattern: str) -> Column:
    return F.date_format("submitted_at", pattern)


add(
    "moment",
    lambda v: v.jobs.select("job_id", dates.moment(_spell(F.col("id"), [
        _iso("yyyy-MM-dd'T'HH:mm:ss'+00:00'"), _iso("yyyy-MM-dd HH:mm:ss"), _iso("yyyy-MM-dd"), F.lit("12:30"), F.lit(""), _iso("yyyy-MM-dd'T'HH:mm:ss'+02:00'")])).alias("at")),
    fixtures("""SELECT job_id, CASE id%6 WHEN 2 THEN date_trunc('day', s) WHEN 5 THEN s - INTERVAL 2 HOUR WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE s END AS at
    FROM (SELECT *, CAST(date_trunc('second', submitted_at) AS TIMESTAMP) AS s FROM f_jobs)"""),
)
add(
    "friendly_date",
    lambda v: v.jobs.select("job_id", dates.friendly_date(_spell(F.col("id"), [
        F.date_format(_date(), "yyyy-MM-dd"), F.date_format(_date(), "M/d/yyyy"), F.date_format(_date(), "MMMM d, yyyy"), F.date_format(_date(), "MMM d, yyyy"), F.lit("soon"), F.lit("")])).alias("shown")),
    fixtures("SELECT job_id, CASE id%6 WHEN 4 THEN 'soon' WHEN 5 THEN '—' ELSE strftime(submitted_at,'%d %b %Y') END AS shown FROM f_jobs"),
)
add(
    "friendly_dt", lambda v: v.jobs.select("job_id", dates.friendly_time(F.col("submitted_at"), F.lit("2024-01-02 00:00:00").cast("timestamp")).alias("shown")),
    fixtures("""SELECT job_id, CASE WHEN CAST(l AS DATE)=DATE '2024-01-02' THEN 'Today' ELSE strftime(l,'%b %d, %Y') END||', '||strftime(l,'%-I:%M %p') AS shown
    FROM (SELECT job_id, submitted_at+INTERVAL 330 MINUTE AS l FROM f_jobs)"""),
)
add(
    "voucher_date", lambda v: v.jobs.select("job_id", dates.voucher_date(_spell(F.col("id"), [F.date_format(_date(), "M/d/yyyy"), F.date_format(_date(), "yyyy-MM-dd"), F.lit("n/a")])).alias("date")),
    fixtures("SELECT job_id, CASE WHEN id%3<2 THEN strftime(submitted_at,'%Y-%m-%d') END AS date FROM f_jobs"),
)
add(
    "statement_period",
    lambda v: v.jobs.select("job_id", dates.statement_period(F.when(F.col("id") % 2 == 0, F.date_format(_date(), "yyyy-MM-dd")), F.lit("2024-03-05").cast("timestamp")).alias("period")).withColumn("label", dates.period_label(F.col("period"))),
    fixtures("SELECT job_id, CASE WHEN id%2=0 THEN strftime(submitted_at,'%Y-%m') ELSE '2024-03' END AS period, CASE WHEN id%2=0 THEN strftime(submitted_at,'%b %Y') ELSE 'Mar 2024' END AS label FROM f_jobs"),
)
add("path_segment", lambda v: v.lines.select("seq", texts.path_segment(F.concat("vendor_id", F.lit("/"), "statement_period")).alias("segment")),
    fixtures("SELECT seq, replace(vendor_id,' ','%20')||'%2F'||statement_period AS segment FROM f_stmt"))
add("normalize_email", lambda v: _names(v).select("id", texts.normalize_email(F.concat(F.lit("  "), "vendor_name", F.lit("@Example.COM "))).alias("email")),
    f"WITH {_NAMES_SQL} SELECT id, trim(lower('  '||vendor_name||'@Example.COM ')) AS email FROM nm")
QUERIES, ORACLES = add.queries, add.oracles
