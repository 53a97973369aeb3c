"""Survey-weighted error rates, roll-ups, profiles and trends.

Sums stay exact decimals until one division in double. Every roll-up aggregates on
the map side before its shuffle; ranks and trends run on the aggregated rows only,
whose number is bounded by states x years or codes x years.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions.money import mean, percent, ratio
from casemill.operators import classify
from casemill.operators.enrich import KEY, describe, with_threshold


def _weighted(column: str, when: Column | None = None) -> Column:
    value = F.col(column) * F.col("household_weight")
    return F.sum(value if when is None else F.when(when, value).otherwise(F.lit(0).cast("decimal(28,10)")))


def state_error_rates(households: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Payment, over-, underpayment and case error rates by state and year; only class 1 cases count."""
    return state_error_rates_of(state_error_sums(with_threshold(households.filter("case_classification = 1"), thresholds)))


def state_error_sums(base: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """The sums behind the rates, by state and year and what else is asked; sums of parts add up to those of the whole."""
    status, above = F.col("status"), F.col("amount_error") > F.col("tolerance_threshold")
    return base.groupBy(*also, "fiscal_year", "state_name", "state_code", "tolerance_threshold").agg(
        F.count(F.lit(1)).alias("total_sample_cases"),
        F.count_if(status != 1).alias("error_sample_cases"),
        F.count_if(status == 2).alias("overissuance_sample_cases"),
        F.count_if(status == 3).alias("underissuance_sample_cases"),
        F.sum("household_weight").alias("estimated_total_households"),
        _weighted("snap_benefit").alias("total_weighted_benefits"),
        _weighted("gross_income").alias("_gross"),
        _weighted("amount_error", status.isin(2, 3) & above).alias("total_weighted_error_dollars"),
        _weighted("amount_error", (status == 2) & above).alias("weighted_overpayment_dollars"),
        _weighted("amount_error", (status == 3) & above).alias("weighted_underpayment_dollars"),
    )


def state_error_rates_of(sums: DataFrame) -> DataFrame:
    benefits, weight = F.col("total_weighted_benefits"), F.col("estimated_total_households")
    return sums.select(
        "fiscal_year",
        "state_name",
        "state_code",
        "tolerance_threshold",
        "total_sample_cases",
        "error_sample_cases",
        "overissuance_sample_cases",
        "underissuance_sample_cases",
        "estimated_total_households",
        "total_weighted_benefits",
        ratio(benefits, weight).alias("avg_weighted_benefit"),
        ratio(F.col("_gross"), weight).alias("avg_weighted_gross_income"),
        percent(F.col("total_weighted_error_dollars"), benefits).alias("payment_error_rate"),
        percent(F.col("weighted_overpayment_dollars"), benefits).alias("overpayment_rate"),
        percent(F.col("weighted_underpayment_dollars"), benefits).alias("underpayment_rate"),
        percent(F.col("error_sample_cases"), F.col("total_sample_cases"), 2).alias("case_error_rate"),
        "total_weighted_error_dollars",
        "weighted_overpayment_dollars",
        "weighted_underpayment_dollars",
    )


def error_element_rollup(errors: DataFrame, households: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    """Errors and weighted dollars by year, state, element, finding and responsibility.

    Descriptions that several codes share join the facts, so one shuffle finishes the
    roll-up; the element's own text joins the result.
    """
    parent = households.filter("case_classification = 1").select(*KEY, "state_name", "household_weight")
    facts = errors.select(*KEY, "element_code", "error_finding", "responsible_agency", "error_amount")
    known = refs["ref_element"].select(F.col("code").alias("element_code"))
    facts = facts.join(known, "element_code", "left_semi")
    facts = describe(facts, "error_finding", refs["ref_error_finding"], description="finding_type")
    facts = describe(
        facts, "responsible_agency", refs["ref_agency_responsibility"], responsibility_type="responsibility_type"
    )
    rolled = (
        facts.join(parent, KEY)
        .groupBy("fiscal_year", "state_name", "element_code", "finding_type", "responsibility_type")
        .agg(
            F.count(F.lit(1)).alias("sample_error_count"),
            F.sum(F.col("error_amount") * F.col("household_weight")).alias("weighted_error_dollars"),
            mean(F.col("error_amount")).alias("avg_sample_error_amount"),
        )
    )
    return describe(
        rolled, "element_code", refs["ref_element"], description="element_description", category="element_category"
    )


def demographic_profile(members: DataFrame, households: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    """Eligible members by year, state, age, race, citizenship, education, work and disability."""
    eligible = members.filter(F.col("snap_affiliation_code").isin(1, 2)).select(
        *KEY,
        classify.age_group(F.col("age")).alias("age_group"),
        F.col("race_ethnicity").alias("_race"),
        F.col("citizenship_status").alias("_citizenship"),
        F.col("years_education").alias("_education"),
        classify.indicator(F.col("working_indicator"), "Working").alias("working_status"),
        classify.indicator(F.col("disability_indicator"), "Disabled").alias("disability_status"),
    )
    named = describe(eligible, "_race", refs["ref_race_ethnicity"], description="race_ethnicity")
    named = describe(named, "_citizenship", refs["ref_citizenship_status"], description="citizenship_status")
    named = describe(named, "_education", refs["ref_education_level"], description="education_level")
    return (
        named.join(households.select(*KEY, "state_name", "household_weight"), KEY)
        .groupBy(
            "fiscal_year",
            "state_name",
            "age_group",
            "race_ethnicity",
            "citizenship_status",
            "education_level",
            "working_status",
            "disability_status",
        )
        .agg(
            F.count(F.lit(1)).alias("sample_member_count"),
            F.sum("household_weight").alias("estimated_member_count"),
        )
    )


def error_summary_by_type(errors: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    facts = errors.select("fiscal_year", "element_code", "error_amount")
    named = describe(facts, "element_code", refs["ref_element"], category="error_category", description="error_type")
    return named.groupBy("fiscal_year", "error_category", "error_type").agg(
        F.count(F.lit(1)).alias("error_count"),
        F.sum("error_amount").alias("total_error_amount"),
        mean(F.col("error_amount")).alias("avg_error_amount"),
    )


def error_summary_by_responsibility(
    errors: DataFrame, households: DataFrame, refs: Mapping[str, DataFrame]
) -> DataFrame:
    """Errors and dollars by year, state and responsible party; errors without household keep a NULL state."""
    facts = errors.select(*KEY, "responsible_agency", "error_amount")
    named = describe(
        facts,
        "responsible_agency",
        refs["ref_agency_responsibility"],
        responsibility_type="responsibility_type",
        description="responsibility_detail",
    )
    joined = named.join(households.select(*KEY, "state_name"), KEY, "left")
    return joined.groupBy("fiscal_year", "state_name", "responsibility_type", "responsibility_detail").agg(
        F.count(F.lit(1)).alias("error_count"), F.sum("error_amount").alias("total_error_amount")
    )


def weighted_estimates(df: DataFrame, column: str, by: list[str], weight: str = "household_weight") -> DataFrame:
    """Survey-weighted total, mean and population of a column."""
    total, population = F.sum(F.col(column) * F.col(weight)), F.sum(weight)
    return df.groupBy(*by).agg(
        total.alias("weighted_total"),
        ratio(total, population).alias("weighted_mean"),
        population.alias("estimated_population"),
    )


def rolling_two_year_rates(rates: DataFrame) -> DataFrame:
    """Payment error rate over this and the previous fiscal year, each under its own threshold."""
    window = Window.partitionBy("state_name", "state_code").orderBy("fiscal_year").rangeBetween(-1, 0)
    dollars = F.sum("total_weighted_error_dollars").over(window)
    benefits = F.sum("total_weighted_benefits").over(window)
    return rates.select(
        "fiscal_year",
        "state_name",
        dollars.alias("rolling_error_dollars"),
        benefits.alias("rolling_benefits"),
        percent(dollars, benefits).alias("rolling_error_rate"),
    )


def expedited_late_rate(households: DataFrame, by: list[str]) -> DataFrame:
    service = F.col("expedited_service")
    late, entitled = F.count_if(service == 2), F.count_if(service.isin(1, 2))
    return households.groupBy(*by).agg(
        late.alias("late_cases"), entitled.alias("entitled_cases"), percent(late, entitled).alias("late_rate")
    )


def national_rates(rates: DataFrame) -> DataFrame:
    """National rate by year from the state totals."""
    dollars, benefits = F.sum("total_weighted_error_dollars"), F.sum("total_weighted_benefits")
    return rates.groupBy("fiscal_year").agg(
        dollars.alias("national_error_dollars"),
        benefits.alias("national_benefits"),
        percent(dollars, benefits).alias("national_rate"),
    )


def states_above_national(rates: DataFrame) -> DataFrame:
    """States whose rate exceeds the national rate of the year, joined on the year."""
    national = national_rates(rates).select("fiscal_year", "national_rate")
    return (
        rates.select("fiscal_year", "state_name", "payment_error_rate")
        .join(national, "fiscal_year")
        .filter("payment_error_rate > national_rate")
    )


def ranked_elements(rollup: DataFrame) -> DataFrame:
    """Elements ranked by weighted dollars within the year, with share and cumulative share."""
    totals = rollup.groupBy("fiscal_year", "element_code", "element_description").agg(
        F.sum("weighted_error_dollars").alias("weighted_error_dollars")
    )
    year = Window.partitionBy("fiscal_year")
    order = year.orderBy(F.desc("weighted_error_dollars"), "element_code")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dollars, total = F.col("weighted_error_dollars"), F.sum("weighted_error_dollars").over(year)
    return totals.select(
        "fiscal_year",
        "element_code",
        "element_description",
        "weighted_error_dollars",
        F.rank().over(year.orderBy(F.desc("weighted_error_dollars"))).alias("dollar_rank"),
        percent(dollars, total).alias("percent_of_total"),
        percent(F.sum(dollars).over(running), total).alias("cumulative_percent"),
    )


def rate_changes(rates: DataFrame) -> DataFrame:
    """Change of the payment error rate from the year before, only where that year is present."""
    order = Window.partitionBy("state_name", "state_code").orderBy("fiscal_year")
    rate = F.col("payment_error_rate")
    previous = F.when(F.lag("fiscal_year").over(order) == F.col("fiscal_year") - 1, F.lag(rate).over(order))
    change = F.round(rate - F.col("previous_rate"), 4)
    return (
        rates.select("fiscal_year", "state_name", "payment_error_rate", previous.alias("previous_rate"))
        .filter("previous_rate IS NOT NULL")
        .select("*", change.alias("rate_change"), (change < 0).alias("improved"))
    )


def top_elements(rollup: DataFrame, k: int = 3) -> DataFrame:
    """The k elements with the most weighted dollars over all years and states."""
    return (
        rollup.groupBy("element_code", "element_description")
        .agg(F.sum("weighted_error_dollars").alias("weighted_error_dollars"))
        .orderBy(F.desc("weighted_error_dollars"), "element_code")
        .limit(k)
    )


