"""Classification columns over households, members and codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill import spec


def age_group(age: Column) -> Column:
    return (
        F.when(age < 6, "Under 6")
        .when(age.between(6, 17), "6-17")
        .when(age.between(18, 24), "18-24")
        .when(age.between(25, 49), "25-49")
        .when(age.between(50, 59), "50-59")
        .when(age >= 60, "60+")
    )


def indicator(flag: Column, yes: str) -> Column:
    """``yes`` for 1 and ``Not yes`` for everything else, NULL included."""
    return F.when(flag == 1, yes).otherwise(f"Not {yes}")


def household_type() -> Column:
    elderly, children, size = F.col("num_elderly"), F.col("num_children"), F.col("certified_household_size")
    return (
        F.when((elderly > 0) & (children == 0) & (size == elderly), "Elderly Only")
        .when((children > 0) & (elderly == 0), "With Children (No Elderly)")
        .when((elderly > 0) & (children > 0), "Elderly and Children")
        .when((size == 1) & (elderly == 0), "Single Adult")
        .otherwise("Other Adult")
    )


def income_category() -> Column:
    gross, earned, unearned = F.col("gross_income"), F.col("earned_income"), F.col("unearned_income")
    return (
        F.when((gross == 0) | gross.isNull(), "Zero Income")
        .when((earned > 0) & (unearned == 0), "Earned Income Only")
        .when((earned == 0) & (unearned > 0), "Unearned Income Only")
        .when((earned > 0) & (unearned > 0), "Mixed Income")
        .otherwise("Unknown")
    )


def error_classification(threshold: Column) -> Column:
    status, above = F.col("status"), F.abs(F.col("amount_error")) > threshold
    return (
        F.when(status == 1, "No Error")
        .when((status == 2) & above, "Overissuance (Above Tolerance)")
        .when(status == 2, "Overissuance (Within Tolerance)")
        .when((status == 3) & above, "Underissuance (Above Tolerance)")
        .when(status == 3, "Underissuance (Within Tolerance)")
        .otherwise("Unknown")
    )


def keyword_category(
    text: Column, rules: Sequence[tuple[str, Sequence[str]]] = spec.NATURE_KEYWORDS, default: str | None = None
) -> Column:
    """Category of the first rule with a keyword in the text."""
    lowered = F.lower(text)
    result = None
    for category, words in rules:
        hit = lowered.contains(words[0])
        for word in words[1:]:
            hit = hit | lowered.contains(word)
        result = F.when(hit, category) if result is None else result.when(hit, category)
    return result.otherwise(F.lit(default))


def range_category(code: Column, ranges: Sequence[tuple[str, int, int]]) -> Column:
    result = None
    for category, low, high in ranges:
        hit = code.between(low, high)
        result = F.when(hit, category) if result is None else result.when(hit, category)
    return result


def with_set_category(df: DataFrame, code: str, sets: DataFrame, out: str = "category") -> DataFrame:
    """Category from code sets ``(category, codes array)``, none gives NULL.

    The first set that holds the code wins: by ``set_order`` where sets have it, else by name.
    """
    rank = [F.col("set_order")] if "set_order" in sets.columns else []
    first = F.min(F.struct(*[r.alias("_rank") for r in rank], F.col("category").alias("_name"))).alias("_first")
    lookup = sets.withColumn("_code", F.explode("codes")).groupBy("_code").agg(first).select("_code", F.col("_first._name").alias(out))
    return df.join(lookup, F.col(code) == F.col("_code"), "left").drop("_code")
