"""Row sets of Spark and DuckDB results in one canonical form."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal


def _value(x):
    if x is None:
        return "null"
    if isinstance(x, bool | str):
        return str(x)
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, int | float | Decimal):
        return "nan" if x != x else repr(round(float(x), 6) + 0.0)
    if isinstance(x, list | tuple):
        return str([_value(v) for v in x])
    return str(x)


def canonical(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(_value(row[k]) for k in order) for row in rows)


def of_spark(df) -> tuple[list[str], list[tuple]]:
    return canonical(df.columns, df.collect())


def of_duck(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(sql)
    return canonical([c[0] for c in found.description], found.fetchall())
