"""Four amount parsers that disagree on signs and junk, and the number helpers around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom import config
from tallyloom.operators.quality import strip


def _number(text: Column) -> Column:
    return F.when(strip(text).rlike(config.NUMBER_SHAPE), strip(text).try_cast("double"))


def parse_a(text: Column) -> Column:
    """Drops commas and dollar signs; brackets around or a minus behind make it negative."""
    s = F.translate(strip(text), ",$", "")
    negative = s.endswith("-") | (s.startswith("(") & s.endswith(")"))
    value = _number(F.regexp_replace(F.regexp_replace(s, r"^[()]+|[()]+$", ""), r"-+$", ""))
    return F.when(negative, -value).otherwise(value)


def parse_b(text: Column) -> Column:
    """Keeps digits, points and minus signs only, so brackets lose their meaning."""
    return _number(F.regexp_replace(text, r"[^0-9.\-]", ""))


def parse_c(text: Column) -> Column:
    """Drops commas and dollar signs."""
    return _number(F.translate(strip(text), ",$", ""))


def parse_d(text: Column) -> Column:
    """Takes plain numbers only."""
    return _number(text)


def parse_confidence(text: Column) -> Column:
    """A number from 0 to 1, or the fallback below the review threshold."""
    value = _number(text)
    return F.when((value >= 0) & (value <= 1), value).otherwise(config.FALLBACK_LINE_CONFIDENCE)


def money(value: Column) -> Column:
    return F.concat(F.when(value < 0, "$-").otherwise("$"), F.format_number(F.abs(F.coalesce(value, F.lit(0))), 2))


def money_signed(value: Column) -> Column:
    return F.concat(F.when(value < 0, "−").otherwise(""), F.lit("$"), F.format_number(F.abs(F.coalesce(value, F.lit(0))), 2))


def money_short(value: Column) -> Column:
    """Thousands as K with one decimal."""
    thousands = F.concat(F.lit("$"), F.format_number(value / 1000, 1), F.lit("K"))
    return F.when(value.isNull(), "$0").when(F.abs(value) >= 1000, thousands).otherwise(F.concat(F.lit("$"), F.format_number(value, 0)))
