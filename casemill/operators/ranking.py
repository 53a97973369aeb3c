"""Top rows per group without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SALTS = 64


def top_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], k: int, rank: str | None = None
) -> DataFrame:
    """The first ``k`` rows of every group.

    Each task keeps at most ``k`` rows per group before the shuffle (Spark pushes the
    row-number limit below it). The salt is the task's own number, so a group spread
    over every task meets in 64 places first and only 64 x k rows meet in one.
    """
    salted = df.withColumn("_salt", F.spark_partition_id() % _SALTS)
    first = Window.partitionBy(*groups, "_salt").orderBy(*order)
    kept = salted.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= k).drop("_rank", "_salt")
    final = kept.withColumn("_rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    final = final.filter(F.col("_rank") <= k)
    return final.withColumnRenamed("_rank", rank) if rank else final.drop("_rank")
