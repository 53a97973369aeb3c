"""Session history: last entries and packing into a size budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.operators.ranking import top_per_group

MAX_SESSION_ENTRIES = 20


def last_entries(df: DataFrame, session: str, order: list[str], n: int = MAX_SESSION_ENTRIES) -> DataFrame:
    """The newest ``n`` entries of each session, numbered newest first."""
    return top_per_group(df, [session], [F.desc(column) for column in order], n, "recency")


def within_budget(entries: DataFrame, session: str, size: str, budget: int) -> DataFrame:
    """Newest entries while their running size stays within the budget.

    Takes the output of ``last_entries``: sessions have at most twenty rows here.
    """
    window = Window.partitionBy(session).orderBy("recency").rowsBetween(Window.unboundedPreceding, 0)
    running = entries.withColumn("running_size", F.sum(size).over(window))
    return running.filter(F.col("running_size") <= budget)


def packed_entries(entries: DataFrame, session: str, full: str, short: str, budget: int) -> DataFrame:
    """Newest entries packed one by one: full form if it fits, else short form, else stop.

    Takes the output of ``last_entries``: the folded arrays have at most twenty items.
    """
    item = F.struct(
        F.col("recency"), F.col(full).cast("bigint").alias("full"), F.col(short).cast("bigint").alias("short")
    )
    ordered = entries.groupBy(session).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    start = F.struct(
        F.lit(0).cast("bigint").alias("used"),
        F.lit(False).alias("done"),
        F.array().cast("array<struct<recency:int,form:string,size:bigint>>").alias("packed"),
    )

    def step(state: Column, entry: Column) -> Column:
        fits = state["used"] + entry["full"] <= budget
        shrinks = state["used"] + entry["short"] <= budget
        size = F.when(fits, entry["full"]).otherwise(entry["short"])
        added = F.struct(
            entry["recency"].alias("recency"),
            F.when(fits, "full").otherwise("short").alias("form"),
            size.alias("size"),
        )
        taken = ~state["done"] & (fits | shrinks)
        return F.struct(
            F.when(taken, state["used"] + size).otherwise(state["used"]).alias("used"),
            (~taken).alias("done"),
            F.when(taken, F.concat(state["packed"], F.array(added))).otherwise(state["packed"]).alias("packed"),
        )

    folded = ordered.select(session, F.aggregate("_items", start, step).alias("_state"))
    return folded.select(session, F.inline("_state.packed"))
