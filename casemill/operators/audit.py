"""Audit of a statement log with the two read-only rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill import spec


def _first_match(tests: list[tuple[Column, Column]], otherwise: Column) -> Column:
    result = None
    for test, value in tests:
        result = F.when(test, value) if result is None else result.when(test, value)
    return result.otherwise(otherwise)


def strict_reason(sql: Column) -> Column:
    """Why the word-bounded rule blocks a statement; NULL when it allows it."""
    upper = F.upper(sql)
    # One pattern for all words; the word reported is the first of the list, found for blocked statements only.
    named = _first_match(
        [(upper.rlike(rf"\b{word}\b"), F.lit(f"forbidden keyword: {word}")) for word in spec.BLOCKED_WORDS],
        F.lit(None).cast("string"),
    )
    blocked = upper.rlike(rf"\b({'|'.join(spec.BLOCKED_WORDS)})\b")
    body = F.regexp_replace(sql, r"^\s+|\s+$", "")
    semicolons = F.length(sql) - F.length(F.replace(sql, F.lit(";")))
    several = (semicolons > 1) | ((semicolons == 1) & ~body.endswith(";"))
    rest = [
        (~F.upper(body).rlike(r"^(SELECT|WITH)"), F.lit("not a SELECT or WITH")),
        (several, F.lit("multiple statements")),
        (sql.contains("--") | sql.contains("/*") | sql.contains("*/"), F.lit("comment")),
    ]
    return _first_match([(blocked, named), *rest], F.lit(None).cast("string"))


def loose_reason(sql: Column) -> Column:
    """Why the substring rule blocks a statement; it also hits harmless names such as ``created_at``."""
    upper = F.upper(sql)
    tests = [(upper.contains(word), F.lit(f"contains {word}")) for word in spec.BLOCKED_SUBSTRINGS]
    return _first_match(tests, F.lit(None).cast("string"))


def classify_statements(log: DataFrame, column: str = "statement") -> DataFrame:
    """Both verdicts per statement and whether they disagree."""
    sql = F.col(column)
    out = log.withColumns({"strict_reason": strict_reason(sql), "loose_reason": loose_reason(sql)})
    allowed, loosely = F.col("strict_reason").isNull(), F.col("loose_reason").isNull()
    return out.withColumns({"allowed": allowed, "loosely_allowed": loosely, "disagree": allowed != loosely})


def audit_report(log: DataFrame, column: str = "statement") -> DataFrame:
    """Statements by verdict and reason with the number of disagreements."""
    return (
        classify_statements(log, column)
        .groupBy("allowed", "strict_reason")
        .agg(F.count(F.lit(1)).alias("statements"), F.count_if("disagree").alias("disagreements"))
    )
