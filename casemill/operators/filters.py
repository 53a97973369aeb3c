"""Global state and year filter over parent and child tables."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.spec import QC_DATASET, DatasetSpec

_STATE = re.compile(r"^[A-Za-z\s\-.]+$")


@dataclass(frozen=True)
class GlobalFilter:
    """States and fiscal years to keep; empty means all. Values are checked, never spliced into SQL."""

    states: tuple[str, ...] = ()
    fiscal_years: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        for state in self.states:
            if not _STATE.match(state):
                raise ValueError(f"Invalid state name: {state!r}")
        for year in self.fiscal_years:
            if not isinstance(year, int) or not 2000 <= year <= 2100:
                raise ValueError(f"Invalid fiscal year: {year!r}")

    def on(self, column: str, values: Iterable[object]) -> Column:
        values = list(values)
        return F.col(column) == values[0] if len(values) == 1 else F.col(column).isin(values)


def apply_filter(
    df: DataFrame,
    chosen: GlobalFilter,
    parent: DataFrame | None = None,
    dataset: DatasetSpec = QC_DATASET,
    without_parent: bool = False,
) -> DataFrame:
    """Keep matching rows; a table without the state column is semi-joined to its parent on the full key.

    A child handed in without its parent raises under a state filter, unless ``without_parent`` lets it
    pass by its year alone. Tables that are no children have no state to filter by and stay whole.
    """
    if chosen.fiscal_years and dataset.year_column in df.columns:
        df = df.filter(chosen.on(dataset.year_column, chosen.fiscal_years))
    if not chosen.states:
        return df
    if dataset.state_column in df.columns:
        return df.filter(chosen.on(dataset.state_column, chosen.states))
    if not set(dataset.key) <= set(df.columns):
        return df
    if parent is None:
        if not without_parent:
            raise ValueError("a state filter on a child table needs its parent")
        return df
    kept = apply_filter(parent, chosen, dataset=dataset).select(*dataset.key)
    return df.join(kept, list(dataset.key), "left_semi")


def filtered_views(
    tables: dict[str, DataFrame], chosen: GlobalFilter, dataset: DatasetSpec = QC_DATASET
) -> dict[str, DataFrame]:
    """Register every table filtered under its own name, ready for ``spark.sql``."""
    parent = tables.get(dataset.parent)
    out = {name: apply_filter(df, chosen, parent, dataset) for name, df in tables.items()}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out
