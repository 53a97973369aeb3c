"""Exports: described tables, any known table, capped results, CSV and Markdown."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill import spec
from casemill.functions.text import display_value
from casemill.operators.enrich import KEY, with_descriptions
from casemill.operators.filters import GlobalFilter, apply_filter

_LAYOUTS = {
    "households": spec.HOUSEHOLD_EXPORT,
    "household_members": spec.MEMBER_EXPORT,
    "qc_errors": spec.ERROR_EXPORT,
}


def stable_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Order by the keys and then by the other columns, so equal keys sort alike and spread over ranges."""
    kinds = dict(df.dtypes)
    rest = [c for c in df.columns if c not in keys and not kinds[c].startswith(("map", "variant"))]
    return df.orderBy(*keys, *rest)


def capped(df: DataFrame, limit: int = spec.DEFAULT_ROW_CAP, keys: list[str] | None = None) -> DataFrame:
    """The default row cap of a result, after an explicit order when keys are given."""
    return (stable_order(df, keys) if keys else df).limit(limit)


def described_export(
    table: str,
    df: DataFrame,
    refs: Mapping[str, DataFrame],
    chosen: GlobalFilter,
    parent: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Fixed columns with a description after each coded one, filtered and in key order.

    Children take the state of their household and leave with it when it is missing.
    """
    layout = _LAYOUTS[table]
    codes = {c: t for c, t in spec.CODE_COLUMNS.items() if c in layout and c != "case_classification"}
    base = df
    if table != "households":
        kept = apply_filter(parent, chosen).select(*KEY, "state_name")
        base = apply_filter(df, GlobalFilter(fiscal_years=chosen.fiscal_years)).join(kept, KEY)
    else:
        base = apply_filter(df, chosen)
    present = [c for c in layout if c in base.columns]
    described = with_descriptions(base.select(*present), refs, codes)
    columns: list[str] = []
    for name in present:
        columns.append(name)
        if name in codes:
            columns.append(f"{name}_desc")
            extra = spec.REFERENCE_EXTRA.get(codes[name])
            if extra:
                columns.append(f"{codes[name].removeprefix('ref_')}_{extra}")
    keys = [c for c in spec_keys(table) if c in columns]
    ordered = described.select(*columns).orderBy(*keys)  # the keys are unique
    return ordered.limit(limit) if limit else ordered


def spec_keys(table: str) -> tuple[str, ...]:
    return spec.QC_DATASET.child_keys[table]


def table_export(
    tables: Mapping[str, DataFrame], name: str, chosen: GlobalFilter = GlobalFilter(), limit: int | None = None
) -> DataFrame:
    """Any known table; filters apply only to columns it has, order to the keys of its layout or those it has."""
    if name not in tables:
        raise ValueError(f"Unknown table {name!r}. Available: {', '.join(sorted(tables))}")
    df = apply_filter(tables[name], chosen, without_parent=True)
    unique = [c for c in spec.QC_DATASET.child_keys.get(name, ()) if c in df.columns]
    keys = [c for c in KEY if c in df.columns]
    if unique and set(unique) == set(spec.QC_DATASET.child_keys[name]):
        df = df.orderBy(*unique)
    elif keys:
        df = stable_order(df, keys)
    return df.limit(limit) if limit else df


def first_columns(df: DataFrame, count: int = 10) -> DataFrame:
    return df.select(*df.columns[:count])


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header and empty NULLs, written by all tasks in parallel."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_tables(
    tables: Mapping[str, DataFrame],
    names: Sequence[str],
    path: str,
    chosen: GlobalFilter = GlobalFilter(),
    limit: int | None = None,
) -> None:
    """Several known tables, each as its own CSV folder; unknown names fail before anything is written."""
    chosen_tables = {name: table_export(tables, name, chosen, limit) for name in names}
    for name, df in chosen_tables.items():
        write_csv(df, f"{path}/{name}")


def display_frame(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Columns rendered for reading; a column without a kind is shown by its type."""
    defaults = {"double": "default_float", "float": "default_float", "int": "default_integer", "bigint": "default_integer"}
    shown = [display_value(F.col(c), kinds.get(c.lower(), defaults.get(kind, "text"))).alias(c) for c, kind in df.dtypes]
    return df.select(*shown)


def markdown_lines(df: DataFrame, keys: list[str], rows: int = 100) -> DataFrame:
    """Numbered lines of a Markdown table of the first rows in key order."""
    shown = stable_order(df, keys).limit(rows)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    body = shown.select(
        F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"), *keys
    )
    # The window sees at most ``rows`` lines.
    numbered = body.select((F.row_number().over(Window.orderBy(*keys)) + 1).alias("line_number"), "line")
    header = "| " + " | ".join(df.columns) + " |"
    rule = "| " + " | ".join(["---"] * len(df.columns)) + " |"
    head = df.sparkSession.sql(
        "SELECT * FROM VALUES (0, :header), (1, :rule) AS t(line_number, line)", args={"header": header, "rule": rule}
    )
    return head.unionByName(numbered).orderBy("line_number")
