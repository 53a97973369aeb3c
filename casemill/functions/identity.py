"""Deterministic ids built from column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHORT_ESCAPES = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def json_string(text: Column) -> Column:
    """The text as a JSON string literal, non-ASCII kept as is."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = plain
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(_SHORT_ESCAPES.get(code, f"\\u{code:04x}")))
    body = F.when(text.rlike("[\\x00-\\x1f]"), escaped).otherwise(plain)
    return F.concat(F.lit('"'), body, F.lit('"'))


def name_uuid(name: Column) -> Column:
    """Version 5 UUID of a name in the all-zero namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("00" * 16)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant.substr(nibble + 1, F.lit(1)),
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def content_id(content: Column, suffix: str) -> Column:
    """Id of a stored text: UUID of the text's SHA-256 plus a type suffix."""
    return F.concat(name_uuid(F.sha2(content, 256)), F.lit(f"-{suffix}"))


def pair_id(question: Column, sql: Column) -> Column:
    """Id of a question/SQL pair, stable across runs and engines."""
    body = F.concat(
        F.lit('{"question": '), json_string(question), F.lit(', "sql": '), json_string(sql), F.lit("}")
    )
    return content_id(body, "sql")
