"""Names, slugs and shapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom import config
from tallyloom.operators.quality import strip


def normalize_invoice(value: Column) -> Column:
    """White space goes at both ends and nothing else; empty values stay."""
    return strip(value)


def normalize_vendor(name: Column) -> Column:
    kept = F.upper(F.regexp_replace(name, "[^A-Za-z0-9 ]", ""))
    return F.trim(F.regexp_replace(kept, " +", " "))


def default_vendor_id(name: Column) -> Column:
    return F.left(F.replace(F.replace(F.upper(name), F.lit(" "), F.lit("_")), F.lit(","), F.lit("")), F.lit(50))


def vendor_slug(name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown_vendor"))


def filename_slug(path: Column) -> Column:
    """First two words of a file name without trailing digits, or null."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    tokens = F.filter(F.transform(F.split(stem, "[^A-Za-z0-9]+"), lambda t: F.regexp_replace(t, r"\d+$", "")), lambda t: t != "")
    return F.nullif(F.array_join(F.transform(F.slice(tokens, 1, 2), F.lower), "_"), F.lit(""))


def initials(name: Column) -> Column:
    words = F.filter(F.split(F.translate(name, "/,", "  "), r"\s+"), lambda w: w.rlike(r"^\p{L}+$"))
    two = F.concat(F.left(F.get(words, F.lit(0)), F.lit(1)), F.left(F.get(words, F.lit(1)), F.lit(1)))
    return F.upper(
        F.when(F.coalesce(name, F.lit("")) == "", "??").when(F.size(words) >= 2, two)
        .when(F.size(words) == 1, F.left(F.get(words, F.lit(0)), F.lit(2))).otherwise(F.left(name, F.lit(2)))
    )


def path_segment(value: Column) -> Column:
    """Percent-encoded, blanks and slashes included."""
    return F.replace(F.url_encode(F.coalesce(value, F.lit(""))), F.lit("+"), F.lit("%20"))


def blob_path(vendor: Column, year: Column, month: Column, digest: Column) -> Column:
    return F.concat_ws("/", vendor_slug(vendor), F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.concat(digest, F.lit(".pdf")))


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Container, blob and file name of a URL's path; nulls where it has no two segments."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), "^/+", "")
    container, blob = F.regexp_extract(path, "^([^/]+)/", 1), F.regexp_extract(path, "^[^/]+/(.+)$", 1)
    whole = (container != "") & (blob != "")
    return F.when(whole, container), F.when(whole, blob), F.element_at(F.split(path, "/"), -1)


def bill_number(description: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(strip(description), config.BILL_SHAPE, 1)), F.lit(""))


def voucher_header(text: Column) -> tuple[Column, Column, Column]:
    """Vendor, date and check number of a voucher's first page; null where they are not found."""
    vendor, day, check = (F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (config.VOUCHER_VENDOR, config.VOUCHER_DATE, config.VOUCHER_CHECK))
    return strip(vendor), day, check


def is_totals_row(invoice: Column) -> Column:
    return F.coalesce(F.lower(invoice).rlike("|".join(config.TOTALS_WORDS)), F.lit(False))


def is_currency(value: Column) -> Column:
    return F.coalesce(strip(value).rlike(config.CURRENCY_SHAPE), F.lit(False))


def is_invoice_like(value: Column) -> Column:
    s = strip(value)
    return F.coalesce(
        (F.length(s) >= 3) & ~s.rlike(config.DATE_SHAPE) & ~s.rlike(config.CURRENCY_SHAPE) & s.rlike(config.TOKEN_SHAPE), F.lit(False)
    )


def value_shape(value: Column) -> Column:
    s = strip(value)
    return (
        F.when(s.rlike(config.DATE_SHAPE), "date").when(s.rlike(config.CURRENCY_SHAPE), "currency")
        .when(s.rlike(config.ACCOUNT_PREFIX), "account").when(is_invoice_like(value), "invoice").otherwise("other")
    )


def normalize_email(value: Column) -> Column:
    return F.lower(strip(value))
