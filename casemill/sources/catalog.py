"""Table profile, data dictionary, relationships and code listings."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(name: str, df: DataFrame, distinct: str | None = None) -> DataFrame:
    """One row per column with type, row and null count, from a single aggregate pass.

    ``distinct`` adds distinct counts: ``approx`` keeps one small sketch per column and
    task, ``exact`` shuffles every distinct value and is meant for small tables.
    """
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    counters = {"approx": F.approx_count_distinct, "exact": F.count_distinct}
    for position, column in enumerate(df.columns):
        aggregates.append(F.count(F.col(f"`{column}`")).alias(f"_f{position}"))
        if distinct:
            aggregates.append(counters[distinct](F.col(f"`{column}`")).alias(f"_d{position}"))
    rows = [
        F.struct(
            F.lit(name).alias("table_name"),
            F.lit(position).alias("position"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            F.lit(field.nullable).alias("nullable"),
            F.col("_rows").alias("row_count"),
            (F.col("_rows") - F.col(f"_f{position}")).alias("null_count"),
            *([F.col(f"_d{position}").alias("distinct_count")] if distinct else []),
        )
        for position, field in enumerate(df.schema.fields)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def data_dictionary(
    tables: Mapping[str, DataFrame], descriptions: DataFrame | None = None, distinct: str | None = None
) -> DataFrame:
    """Profiles of all tables with column descriptions where there are any; the live schema decides the columns."""
    out = reduce(DataFrame.unionByName, [profile(name, df, distinct) for name, df in tables.items()])
    if descriptions is not None:
        out = out.join(descriptions, ["table_name", "column_name"], "left")
    return out


def relationships(keys: Mapping[str, tuple[str, str, tuple[str, ...]]], like: DataFrame) -> DataFrame:
    """``name -> (from, to, columns)`` as rows with the join condition."""
    rows = [
        (name, "many-to-one", child, parent, " AND ".join(f"{child}.{c} = {parent}.{c}" for c in columns))
        for name, (child, parent, columns) in keys.items()
    ]
    schema = "relationship STRING, type STRING, from_table STRING, to_table STRING, join_condition STRING"
    return like.sparkSession.createDataFrame(rows, schema)


def sorted_codes(codes: DataFrame, by: str = "lookup") -> DataFrame:
    """Code listing with numeric codes first in number order, then the others as text."""
    number = F.col("code").cast("string").try_cast("int")
    return codes.orderBy(by, F.asc_nulls_last(number), F.col("code").cast("string"))


def sample_codes(codes: DataFrame, count: int = 15) -> DataFrame:
    """The first codes of a reference table."""
    return codes.orderBy("code").limit(count)


def dictionary_lines(dictionary: DataFrame) -> DataFrame:
    """Dictionary rows as Markdown table lines."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("column_name", "data_type", "nullable")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return dictionary.select("table_name", "position", line.alias("line")).orderBy("table_name", "position")
