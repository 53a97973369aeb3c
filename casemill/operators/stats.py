"""Descriptive statistics and store counts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill import spec
from casemill.functions.money import mean, percent, ratio
from casemill.operators.enrich import KEY


def _where(households: DataFrame, fiscal_year: int | None, state_code: str | None) -> DataFrame:
    if fiscal_year is not None:
        households = households.filter(F.col("fiscal_year") == fiscal_year)
    if state_code is not None:
        households = households.filter(F.col("state_code") == state_code)
    return households


def _of_households(child: DataFrame, households: DataFrame, fiscal_year: int | None, state_code: str | None) -> DataFrame:
    """Child rows of the chosen households, matched on the full key."""
    if fiscal_year is not None:
        child = child.filter(F.col("fiscal_year") == fiscal_year)
    parents = _where(households, fiscal_year, state_code).select(*KEY)
    return child.join(parents, KEY, "left_semi")


def overview(
    households: DataFrame,
    members: DataFrame,
    fiscal_years: tuple[int, ...] = (),
    state_codes: tuple[str, ...] = (),
) -> DataFrame:
    """One row: households, members, benefits, sizes and households with elderly, children, disabled."""
    if fiscal_years:
        households = households.filter(F.col("fiscal_year").isin(*fiscal_years))
        members = members.filter(F.col("fiscal_year").isin(*fiscal_years))
    if state_codes:
        households = households.filter(F.col("state_code").isin(*state_codes))
        members = members.join(households.select(*KEY), KEY, "left_semi")
    # The member total is one value, so it enters as a scalar subquery instead of a join.
    total_members = members.agg(F.count(F.lit(1)).alias("n")).scalar()
    summary = households.agg(
        F.count(F.lit(1)).alias("total_households"),
        F.coalesce(F.sum("snap_benefit").cast("double"), F.lit(0.0)).alias("total_benefits"),
        F.coalesce(mean(F.col("snap_benefit")), F.lit(0.0)).alias("avg_benefit"),
        F.coalesce(mean(F.col("certified_household_size")), F.lit(0.0)).alias("avg_household_size"),
        F.count_if(F.col("num_elderly") > 0).alias("households_with_elderly"),
        F.count_if(F.col("num_children") > 0).alias("households_with_children"),
        F.count_if(F.col("num_disabled") > 0).alias("households_with_disabled"),
    )
    return summary.withColumn("total_members", total_members)


def by_state(households: DataFrame, fiscal_years: tuple[int, ...] = ()) -> DataFrame:
    if fiscal_years:
        households = households.filter(F.col("fiscal_year").isin(*fiscal_years))
    return (
        households.groupBy("state_code", "state_name")
        .agg(
            F.count(F.lit(1)).alias("household_count"),
            F.coalesce(F.sum("snap_benefit").cast("double"), F.lit(0.0)).alias("total_benefits"),
            F.coalesce(mean(F.col("snap_benefit")), F.lit(0.0)).alias("avg_benefit"),
            F.coalesce(mean(F.col("certified_household_size")), F.lit(0.0)).alias("avg_household_size"),
        )
        .orderBy("state_code", "state_name")
    )


def income_by_source(
    members: DataFrame, households: DataFrame, fiscal_year: int | None = None, state_code: str | None = None
) -> DataFrame:
    """Total, recipients, mean per recipient and share per income source, from one aggregate row."""
    base = _of_households(members, households, fiscal_year, state_code)
    aggregates: list[Column] = []
    for name in spec.INCOME_SOURCES:
        aggregates.append(F.sum(name).alias(f"{name}_total"))
        aggregates.append(F.count_if(F.col(name) > 0).alias(f"{name}_count"))
    wide = base.agg(*aggregates)
    rows = [
        F.struct(
            F.lit(name).alias("income_source"),
            F.coalesce(F.col(f"{name}_total").cast("decimal(38,2)"), F.lit(0).cast("decimal(38,2)")).alias("total"),
            F.col(f"{name}_count").alias("recipients"),
        )
        for name in spec.INCOME_SOURCES
    ]
    all_income = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{n}_total"), F.lit(0)) for n in spec.INCOME_SOURCES])
    long = wide.select(all_income.alias("_all"), F.inline(F.array(*rows)))
    return long.select(
        "income_source",
        "total",
        "recipients",
        F.coalesce(ratio(F.col("total"), F.col("recipients")), F.lit(0.0)).alias("average_per_recipient"),
        F.coalesce(percent(F.col("total"), F.col("_all")), F.lit(0.0)).alias("percent_of_total"),
    )


def demographics(
    members: DataFrame, households: DataFrame, fiscal_year: int | None = None, state_code: str | None = None
) -> DataFrame:
    """One row of member counts by age, sex, disability and employment."""
    base = _of_households(members, households, fiscal_year, state_code)
    age, sex = F.col("age"), F.col("sex")
    counts = base.agg(
        F.count(F.lit(1)).alias("total_members"),
        F.count_if(age.between(0, 17)).alias("children"),
        F.count_if(age.between(18, 64)).alias("adults"),
        F.count_if(age >= 65).alias("elderly"),
        F.count_if(sex == 1).alias("male"),
        F.count_if(sex == 2).alias("female"),
        F.count_if(F.col("disability_indicator") == 1).alias("with_disability"),
        F.count_if(F.col("working_indicator") == 1).alias("working"),
    )
    return counts.withColumns(
        {
            "without_disability": F.col("total_members") - F.col("with_disability"),
            "not_working": F.col("total_members") - F.col("working"),
        }
    )


def benefit_summary(households: DataFrame, fiscal_year: int | None = None, state_code: str | None = None) -> DataFrame:
    benefit = F.col("snap_benefit")
    zero = F.lit(0.0)
    return _where(households, fiscal_year, state_code).agg(
        F.coalesce(F.sum(benefit).cast("double"), zero).alias("total_benefits"),
        F.coalesce(mean(benefit), zero).alias("avg_benefit"),
        F.coalesce(F.min(benefit).cast("double"), zero).alias("min_benefit"),
        F.coalesce(F.max(benefit).cast("double"), zero).alias("max_benefit"),
        F.count(F.lit(1)).alias("households_receiving"),
    )


def benefit_histogram(
    households: DataFrame, fiscal_year: int | None = None, state_code: str | None = None
) -> DataFrame:
    """Households per closed benefit range; amounts between two ranges fall in none, as published."""
    benefit = F.col("snap_benefit")
    aggregates, rows = [], []
    for position, (low, high) in enumerate(spec.BENEFIT_RANGES):
        label = f"{low}+" if high is None else f"{low}-{high}"
        inside = benefit >= low if high is None else benefit.between(low, high)
        aggregates.append(F.count_if(inside).alias(f"_r{position}"))
        rows.append(F.struct(F.lit(label).alias("benefit_range"), F.col(f"_r{position}").alias("households")))
    return _where(households, fiscal_year, state_code).agg(*aggregates).select(F.inline(F.array(*rows)))


def benefit_by_size(households: DataFrame, fiscal_year: int | None = None, state_code: str | None = None) -> DataFrame:
    """Benefits per certified household size; NULL and 0 sizes are left out."""
    return (
        _where(households, fiscal_year, state_code)
        .filter("certified_household_size IS NOT NULL AND certified_household_size <> 0")
        .groupBy(F.col("certified_household_size").alias("household_size"))
        .agg(
            F.count(F.lit(1)).alias("households"),
            F.coalesce(mean(F.col("snap_benefit")), F.lit(0.0)).alias("avg_benefit"),
            F.coalesce(F.sum("snap_benefit").cast("double"), F.lit(0.0)).alias("total_benefits"),
        )
    )


def error_statistics(
    errors: DataFrame, households: DataFrame, fiscal_year: int | None = None, state_code: str | None = None
) -> DataFrame:
    """One row: errors, households with errors, their rate, dollars and mean."""
    base = _of_households(errors, households, fiscal_year, state_code)
    # Per case first: a case with very many errors shrinks to one row per task before any shuffle.
    per_case = base.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("error_amount").alias("_sum"), F.count("error_amount").alias("_amounts")
    )
    total_households = _where(households, fiscal_year, state_code).agg(F.count(F.lit(1)).alias("n")).scalar()
    totals = per_case.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_errors"),
        F.count(F.lit(1)).alias("households_with_errors"),
        F.coalesce(F.sum("_sum").cast("double"), F.lit(0.0)).alias("total_error_amount"),
        F.coalesce(ratio(F.sum("_sum"), F.sum("_amounts")), F.lit(0.0)).alias("average_error_amount"),
    )
    rate = F.coalesce(percent(F.col("households_with_errors"), F.col("total_households")), F.lit(0.0))
    return totals.withColumn("total_households", total_households).withColumn("error_rate_percent", rate)


def errors_by_element(
    errors: DataFrame, households: DataFrame, fiscal_year: int | None = None, state_code: str | None = None
) -> DataFrame:
    base = _of_households(errors, households, fiscal_year, state_code)
    return (
        base.filter("element_code IS NOT NULL AND element_code <> 0")
        .groupBy("element_code")
        .agg(
            F.count(F.lit(1)).alias("error_count"),
            F.sum("error_amount").alias("total_amount"),
            mean(F.col("error_amount")).alias("average_amount"),
        )
    )


def store_totals(households: DataFrame, members: DataFrame, errors: DataFrame) -> DataFrame:
    """Totals per table and households with and without errors, counted on the full key."""
    error_cases = errors.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    error_totals = error_cases.agg(F.count(F.lit(1)).alias("cases"), F.sum("_n").alias("rows"))
    out = households.agg(F.count(F.lit(1)).alias("total_households"))
    out = out.withColumns(
        {
            "total_household_members": members.agg(F.count(F.lit(1)).alias("n")).scalar(),
            "total_qc_errors": F.coalesce(error_totals.select("rows").scalar(), F.lit(0)),
            "households_with_errors": error_totals.select("cases").scalar(),
        }
    )
    without = F.col("total_households") - F.col("households_with_errors")
    return out.withColumn("households_without_errors", without)


def rows_by_year(table: DataFrame) -> DataFrame:
    return table.groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("row_count")).orderBy("fiscal_year")


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table and whether it is empty."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).withColumn("is_empty", F.col("row_count") == 0)


def empty_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    return table_counts(tables).filter("is_empty").select("table_name")


def filter_options(table: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a filter column, ordered."""
    return table.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


