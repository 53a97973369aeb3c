"""Tag, category and display expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_tag(tag: Column, width: int) -> Column:
    return F.substring(F.regexp_replace(F.lower(tag), "[^a-z0-9_-]", ""), 1, width)


def clean_tags(tags: Column) -> Column:
    """Lower-case, strip, cut to 30, drop empties and repeats, order kept."""
    cleaned = F.transform(tags, lambda tag: clean_tag(tag, 30))
    return F.array_distinct(F.filter(cleaned, lambda tag: tag != ""))


def clean_category(category: Column) -> Column:
    """Lower-case, strip, cut to 50; nothing left means ``general``."""
    cleaned = clean_tag(category, 50)
    return F.when(cleaned.isNull() | (cleaned == ""), F.lit("general")).otherwise(cleaned)


def split_tags(text: Column) -> Column:
    """Tags typed in one string, separated by commas or blanks, ``#`` optional."""
    parts = F.split(F.trim(F.regexp_replace(text, r"[,\s]+", " ")), " ")
    return clean_tags(F.transform(parts, lambda part: F.regexp_replace(part, "^#+", "")))


def preview(text: Column, width: int = 200) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def title_case(text: Column) -> Column:
    """First letter of every run of letters in upper case, the others in lower case."""
    parts = F.split(text, "(?<=[^\\p{L}])")
    return F.array_join(F.transform(parts, lambda part: F.initcap(part)), "")


def source_label(category: Column, filename: Column, tags: Column) -> Column:
    """``Category - file #tag #tag``; private categories read ``Private``. The signs are fixed values."""
    shown = F.when(category.startswith("user:"), F.lit("🔒 Private")).otherwise(F.concat(F.lit("📘 "), title_case(category)))
    suffix = F.when(F.size(tags) > 0, F.concat(F.lit(" #"), F.array_join(tags, " #"))).otherwise(F.lit(""))
    return F.concat(shown, F.lit(" - "), filename, suffix)


def display_value(column: Column, kind: str) -> Column:
    """A column rendered for reading, by kind of column; NULL stays NULL."""
    if kind in ("year", "rawint"):
        return F.coalesce(column.try_cast("double").try_cast("bigint").cast("string"), column.cast("string"))
    if kind == "integer":
        whole = column.try_cast("double").try_cast("bigint")
        return F.coalesce(F.format_number(whole, 0), column.cast("string"))
    if kind == "currency":
        amount = column.try_cast("double")
        money = F.concat(F.when(amount < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(amount), 2))
        return F.coalesce(money, column.cast("string"))
    if kind == "weight":
        return F.coalesce(F.format_number(column.try_cast("double"), 4), column.cast("string"))
    if kind == "decimal":
        return F.coalesce(F.format_number(column.try_cast("double"), 2), column.cast("string"))
    if kind == "boolean":
        text = F.lower(column.cast("string"))
        return (
            F.when(text.isin("true", "1", "yes"), F.lit("Yes"))
            .when(text.isin("false", "0", "no"), F.lit("No"))
            .otherwise(column.cast("string"))
        )
    if kind == "datetime":
        stamp = F.date_format(column.try_cast("timestamp_ntz"), "yyyy-MM-dd HH:mm")
        return F.coalesce(stamp, F.substring_index(column.cast("string"), ".", 1))
    if kind == "default_float":
        whole = column == F.floor(column)
        return F.when(whole, F.format_number(column, 0)).otherwise(F.format_number(column, 2))
    if kind == "default_integer":
        return F.format_number(column, 0)
    return column.cast("string")
