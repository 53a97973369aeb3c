"""Primary keys that hold over several loads.

Every load has a table of key digests beside its rows: a digest of 128 bits for each key and the number of rows that
have it, dealt into buckets by the digest. A load that is about to be committed compares its digests with those
of the live loads of its years, bucket by bucket; the wide tables are not read for that. Equal keys are counted
together before anything is shuffled, so a key that very many rows share is one row here.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators.enrich import KEY
from casemill.session import scratch_path, without_shuffles
from casemill.sources import files, tables

KEYS = {"households": KEY, "household_members": [*KEY, "member_number"], "qc_errors": [*KEY, "error_number"]}
BUCKETS = 64
_REPORT = "table_name string, fiscal_year int, repeated_keys bigint, taken_keys bigint, rows_in_load bigint"
_DIGESTS = "digest binary, rows bigint, bucket int, fiscal_year int, load_id string"


class KeyClash(ValueError):
    """A load holds keys that are taken, or holds a key more than once."""


def digest(columns: Iterable[str]) -> F.Column:
    """128 bits of a key; a missing part is told from an empty one."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts).cast("binary")))


def digests(rows: DataFrame, table: str) -> DataFrame:
    """One row for each key of each load and year."""
    found = rows.withColumn("digest", digest(KEYS[table])).groupBy("fiscal_year", "load_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    bucket = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int")
    return found.withColumn("bucket", bucket)


def _stored(spark: SparkSession, root: str, table: str) -> DataFrame:
    path = f"{root}/keys/{table}"
    return spark.read.schema(_DIGESTS).parquet(path) if files.exists(spark, path) else spark.createDataFrame([], _DIGESTS)


def write_digests(spark: SparkSession, root: str, table: str, loads: DataFrame) -> None:
    """Digests of the given ``(fiscal_year, load_id)``, from their key columns alone; written again, they stay the same."""
    # The driver makes the frame of loads from its rows, so it is small, which Spark can't tell: without the hint all rows are shuffled by load.
    rows = spark.read.parquet(f"{root}/{table}").select(*KEYS[table], "load_id").join(F.broadcast(loads), ["fiscal_year", "load_id"], "left_semi")
    # Grouped rows stay where they are: digests are dealt evenly, and a second shuffle would move each key again.
    out = digests(rows, table).sortWithinPartitions("fiscal_year", "load_id", "bucket", "digest")
    with without_shuffles(spark):
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fiscal_year", "load_id").parquet(f"{root}/keys/{table}")


def complete_digests(spark: SparkSession, root: str, table: str, loads: set[tuple[int, str]]) -> None:
    """Write the digests of those loads that have none yet, such as loads from before keys were kept."""
    missing = sorted(loads - _folders(spark, f"{root}/keys/{table}"))
    if missing:
        write_digests(spark, root, table, _frame(spark, missing))


def _folders(spark: SparkSession, path: str, load_id: str = "*") -> set[tuple[int, str]]:
    """``(fiscal_year, load_id)`` of the folders of a table; names only, no files are opened."""
    found = (place.rstrip("/").split("/")[-2:] for place in files.matching(spark, f"{path}/fiscal_year=*/load_id={load_id}"))
    return {(int(year.removeprefix("fiscal_year=")), load.removeprefix("load_id=")) for year, load in found}


def _frame(spark: SparkSession, loads) -> DataFrame:
    return spark.createDataFrame(sorted(loads), "fiscal_year int, load_id string")


def clashes(spark: SparkSession, root: str, table: str, incoming: DataFrame, live: DataFrame) -> DataFrame:
    """fiscal_year, digest, rows_in_load, rows_stored of the incoming digests that stand twice or are taken.

    ``incoming`` and ``live`` are ``(fiscal_year, load_id)``; digests meet by year, bucket and digest.
    """
    key = ["fiscal_year", "bucket", "digest"]
    loads = incoming.select("fiscal_year", "load_id").distinct().withColumn("_new", F.lit(True))
    others = live.join(F.broadcast(incoming.select("fiscal_year").distinct()), "fiscal_year", "left_semi").join(F.broadcast(incoming), ["fiscal_year", "load_id"], "left_anti")
    loads = loads.unionByName(others.select("fiscal_year", "load_id").distinct().withColumn("_new", F.lit(False)))
    # Both sides in one shuffle; the loads are few rows.
    found = _stored(spark, root, table).join(F.broadcast(loads), ["fiscal_year", "load_id"]).groupBy(*key).agg(
        F.sum(F.when(F.col("_new"), F.col("rows"))).alias("rows_in_load"), F.sum(F.when(~F.col("_new"), F.col("rows"))).alias("rows_stored")
    )
    found = found.filter("rows_in_load IS NOT NULL").withColumn("rows_stored", F.coalesce("rows_stored", F.lit(0)))
    return found.filter((F.col("rows_in_load") > 1) | (F.col("rows_stored") > 0)).drop("bucket")


def clashing_rows(spark: SparkSession, root: str, table: str, load_id: str, found: DataFrame) -> DataFrame:
    """The key columns of a load's rows whose digests are among ``found``."""
    rows = spark.read.parquet(f"{root}/{table}").filter(F.col("load_id") == load_id).select(*KEYS[table])
    return rows.withColumn("digest", digest(KEYS[table])).join(found, ["fiscal_year", "digest"]).drop("digest")


def report(spark: SparkSession, root: str, load_id: str, live: set[tuple[int, str]] | None = None) -> DataFrame:
    """Clashes of a written load by table and year: keys that it repeats, keys that live loads hold, and its rows of both.

    The driver holds a row for each live load of the years that the load writes. Tables are counted one after the other,
    so that disk holds the shuffled digests of one.
    """
    live = live_now(spark, root) if live is None else live
    parts = []
    for table in KEYS:
        written = _folders(spark, f"{root}/{table}", load_id)
        years = {year for year, _ in written}
        # A live load without rows of this table has no folder there, and no keys.
        others = {load for load in live if load[0] in years} & _folders(spark, f"{root}/{table}")
        complete_digests(spark, root, table, written | others)
        found = clashes(spark, root, table, _frame(spark, written), _frame(spark, others))
        counted = found.groupBy("fiscal_year").agg(
            F.count_if(F.col("rows_in_load") > 1).alias("repeated_keys"),
            F.count_if(F.col("rows_stored") > 0).alias("taken_keys"),
            F.sum("rows_in_load").alias("rows_in_load"),
        )
        path = scratch_path(spark, "clashes")
        with without_shuffles(spark):
            counted.select(F.lit(table).alias("table_name"), "*").coalesce(1).write.parquet(path)
        parts.append(spark.read.schema(_REPORT).parquet(path))
    return reduce(DataFrame.unionByName, parts)


def live_now(spark: SparkSession, root: str) -> set[tuple[int, str]]:
    return {(r.fiscal_year, r.load_id) for r in tables.live_loads(spark, root).collect()}


def _refuse(found: DataFrame) -> None:
    rows = found.orderBy("table_name", "fiscal_year").collect()  # tables x years
    if rows:
        text = ", ".join(f"{r.table_name} {r.fiscal_year}: {r.repeated_keys} repeated, {r.taken_keys} taken" for r in rows)
        raise KeyClash(f"keys clash: {text}")


def append_unique(
    spark: SparkSession, root: str, households: DataFrame, members: DataFrame, errors: DataFrame, load_id: str | None = None
) -> dict[str, int]:
    """Append a load whose keys are new; one with clashing keys raises ``KeyClash`` and stays invisible.

    Rows and digests are written first, then compared, then committed. Two such loads that hold a key in common and
    commit at once find each other afterwards and withdraw: never are both live, but both may be refused.
    A load id that was committed before is left as it is.
    """
    load_id = load_id or uuid.uuid4().hex
    known = tables.committed_load(spark, root, load_id)
    if known is not None:
        return known

    seen: set[tuple[int, str]] = set()

    def check() -> None:
        seen.update(live_now(spark, root))
        _refuse(report(spark, root, load_id, seen))

    written = tables.write_all(spark, root, households, members, errors, load_id=load_id, action="append", before_commit=check)
    late = {load for load in live_now(spark, root) - seen if load[1] != load_id}
    if late:
        try:
            _refuse(report(spark, root, load_id, late))
        except KeyClash:
            tables.withdraw(spark, root, load_id)
            raise
    return written
