"""Casts and ratios that stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill.spec import NULL_TOKENS


def null_tokens(column: Column) -> Column:
    """Text with the reader's null tokens turned into NULL."""
    return F.when(column.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(column)


def to_integer(column: Column) -> Column:
    """Integer from text, also when the text reads ``1.0``; anything else is NULL."""
    return column.try_cast("double").try_cast("int")


def to_money(column: Column, type_name: str) -> Column:
    """Decimal from text, NULL kept; NaN and unparseable text become NULL."""
    return column.try_cast(type_name)


def to_money_or_zero(column: Column, type_name: str) -> Column:
    """Decimal from text with 0 for NULL, NaN and unparseable text."""
    return F.coalesce(column.try_cast(type_name), F.lit(0).cast(type_name))


def to_flag(column: Column) -> Column:
    """Boolean from a 0/1 indicator or the words true/false."""
    return F.coalesce(to_integer(column) != 0, column.try_cast("boolean"))


def mean(column: Column) -> Column:
    """Exact decimal sum divided once as double; NULL for no rows."""
    return F.try_divide(F.sum(column).cast("double"), F.count(column).cast("double"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(numerator: Column, denominator: Column, digits: int | None = 4) -> Column:
    value = ratio(numerator, denominator) * 100
    return value if digits is None else F.round(value, digits)


def round_for_summary(df, columns: list[str], digits: int = 2):
    """Floats rounded; numeric text rounded and kept as text, other text unchanged."""
    kinds = dict(df.dtypes)
    out = {}
    for name in columns:
        if kinds[name] in ("double", "float"):
            out[name] = F.round(F.col(name), digits)
        elif kinds[name] == "string":
            out[name] = F.coalesce(F.round(F.col(name).try_cast("double"), digits).cast("string"), F.col(name))
    return df.withColumns(out)
