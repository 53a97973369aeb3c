"""Code descriptions, enriched views and tolerance thresholds.

Lookup sides are inline tables or frames handed in by the caller. None is forced to
broadcast: Catalyst broadcasts a side whose size is under the session threshold and
shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill import spec
from casemill.codes import CODE_LISTS
from casemill.operators import classify

KEY = ["case_id", "fiscal_year"]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def code_table(spark: SparkSession, codes: Mapping[int, str]) -> DataFrame:
    """Inline ``(code, description)`` table; its exact size is known to the optimizer."""
    if not codes:
        return spark.sql("SELECT CAST(NULL AS INT) AS code, CAST(NULL AS STRING) AS description WHERE false")
    rows = ", ".join(f"({code}, {_quoted(text)})" for code, text in codes.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(code, description)")


class ReferenceTables(Mapping):
    """Reference tables by name, built when first used; lists not published are empty unless given."""

    def __init__(self, spark: SparkSession, extra: Mapping[str, Mapping[int, str]] | None = None) -> None:
        self._spark = spark
        self._lists = {**CODE_LISTS, **(extra or {})}
        self._built: dict[str, DataFrame] = {}

    def __iter__(self) -> Iterator[str]:
        return iter(spec.REFERENCE_TABLES)

    def __len__(self) -> int:
        return len(spec.REFERENCE_TABLES)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in spec.REFERENCE_TABLES:
            raise KeyError(name)
        if name not in self._built:
            table = code_table(self._spark, self._lists.get(name, {}))
            self._built[name] = _categorized(name, table)
        return self._built[name]


def _categorized(name: str, table: DataFrame) -> DataFrame:
    if name == "ref_element":
        return table.withColumn("category", classify.range_category(F.col("code"), spec.ELEMENT_CATEGORY_RANGES))
    if name == "ref_nature":
        return table.withColumn("category", classify.keyword_category(F.col("description")))
    if name == "ref_agency_responsibility":
        kind = classify.range_category(F.col("code"), spec.RESPONSIBILITY_RANGES)
        return table.withColumn("responsibility_type", kind)
    return table


def reference_tables(spark: SparkSession, extra: Mapping[str, Mapping[int, str]] | None = None) -> ReferenceTables:
    return ReferenceTables(spark, extra)


def threshold_table(spark: SparkSession, thresholds: Mapping[int, int] = spec.TOLERANCE_THRESHOLDS) -> DataFrame:
    rows = ", ".join(f"({year}, CAST({amount} AS DECIMAL(10,2)))" for year, amount in thresholds.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(fiscal_year, threshold_amount)")


def with_threshold(df: DataFrame, thresholds: DataFrame, out: str = "tolerance_threshold") -> DataFrame:
    """Dollar threshold of the row's year, 54 for years without one."""
    joined = df.join(thresholds.select("fiscal_year", "threshold_amount"), "fiscal_year", "left")
    value = F.coalesce(F.col("threshold_amount"), F.lit(spec.DEFAULT_THRESHOLD).cast("decimal(10,2)"))
    return joined.withColumn(out, value).drop("threshold_amount")


def describe(df: DataFrame, code: str, ref: DataFrame, **names: str) -> DataFrame:
    """Left join a reference table; ``names`` maps its columns to output names."""
    lookup = ref.select(F.col("code").alias("_code"), *[F.col(src).alias(out) for src, out in names.items()])
    return df.join(lookup, F.col(code) == F.col("_code"), "left").drop("_code")


def households_enriched(households: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    out = describe(households, "status", refs["ref_status"], description="status_description")
    out = describe(
        out,
        "categorical_eligibility",
        refs["ref_categorical_eligibility"],
        description="categorical_eligibility_description",
    )
    return describe(
        out, "expedited_service", refs["ref_expedited_service"], description="expedited_service_description"
    )


def errors_enriched(errors: DataFrame, households: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    """Errors with their household's state and all descriptions; errors without household drop out."""
    parent = households.select(*KEY, "state_name", "state_code", F.col("status").alias("household_status"))
    out = errors.join(parent, KEY)
    out = describe(
        out, "element_code", refs["ref_element"], description="element_description", category="element_category"
    )
    out = describe(
        out, "nature_code", refs["ref_nature"], description="nature_description", category="nature_category"
    )
    out = describe(
        out,
        "responsible_agency",
        refs["ref_agency_responsibility"],
        description="agency_description",
        responsibility_type="responsibility_type",
    )
    return describe(out, "error_finding", refs["ref_error_finding"], description="finding_description")


def members_enriched(members: DataFrame, households: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    """Members with state, sex and affiliation text; members without household stay, state NULL."""
    out = members.join(households.select(*KEY, "state_name"), KEY, "left")
    out = describe(out, "sex", refs["ref_sex"], description="sex_description")
    return describe(
        out, "snap_affiliation_code", refs["ref_snap_affiliation"], description="affiliation_description"
    )


def household_summary(households: DataFrame, refs: Mapping[str, DataFrame], thresholds: DataFrame) -> DataFrame:
    """Household segments: type, income category and error class against the year's threshold."""
    out = describe(households, "status", refs["ref_status"], description="status_description")
    out = with_threshold(out, thresholds, "_threshold")
    columns = {
        "household_type": classify.household_type(),
        "income_category": classify.income_category(),
        "error_classification": classify.error_classification(F.col("_threshold")),
    }
    return out.withColumns(columns).drop("_threshold")


def with_descriptions(
    df: DataFrame, refs: Mapping[str, DataFrame], code_columns: Mapping[str, str] | None = None
) -> DataFrame:
    """``{column}_desc`` (and category or type) for every coded column present; unknown codes give NULL."""
    out = df
    for column, table in (code_columns or spec.CODE_COLUMNS).items():
        if column not in df.columns or table not in refs:
            continue
        names = {"description": f"{column}_desc"}
        extra = spec.REFERENCE_EXTRA.get(table)
        if extra:
            names[extra] = f"{table.removeprefix('ref_')}_{extra}"
        out = describe(out, column, refs[table], **names)
    return out


def codes_in_result(
    result: DataFrame, refs: Mapping[str, DataFrame], code_columns: Mapping[str, str] | None = None
) -> DataFrame:
    """Each code a result contains with its description, or ``Unknown code X``."""
    mapping = {c: t for c, t in (code_columns or spec.CODE_COLUMNS).items() if c in result.columns and t in refs}
    if not mapping:
        raise ValueError("the result has no coded column")
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("code")) for c in mapping]
    present = result.select(F.inline(F.array(*pairs))).filter("code IS NOT NULL").distinct()
    lookup = None
    for column, table in mapping.items():
        part = refs[table].select(
            F.lit(column).alias("column_name"), F.col("code").cast("string").alias("code"), "description"
        )
        lookup = part if lookup is None else lookup.unionByName(part)
    unknown = F.concat(F.lit("Unknown code "), F.col("code"))
    joined = present.join(lookup, ["column_name", "code"], "left")
    return joined.withColumn("description", F.coalesce("description", unknown))


def computed_vs_official(rates: DataFrame, official: DataFrame) -> DataFrame:
    """Computed and published payment error rates side by side, either side may be missing."""
    ours = rates.select("fiscal_year", "state_name", F.col("payment_error_rate").alias("computed_rate"))
    theirs = official.select(
        "fiscal_year", "state_name", F.col("payment_error_rate").cast("double").alias("official_rate")
    )
    joined = ours.join(theirs, ["fiscal_year", "state_name"], "full")
    return joined.withColumn("difference", F.round(F.col("computed_rate") - F.col("official_rate"), 4))


