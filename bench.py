"""Headline timings at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each job runs once to warm up and then three times; the median counts. Results go to
Spark's no-op sink, so the whole result is computed and nothing reaches the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from casemill import build_session, scratch_path  # noqa: E402
from casemill.operators import reshape  # noqa: E402
from casemill.plans import QUERIES  # noqa: E402
from casemill.plans import fixtures as fx  # noqa: E402
from casemill.sources import tables, wide_csv  # noqa: E402

HEADLINE = (
    "state_error_rates",
    "error_element_rollup",
    "demographic_profile",
    "errors_enriched",
    "error_statistics",
    "ranked_elements",
    "validation_report",
    "referential_report",
    "duplicate_keys",
    "codes_in_result",
    "document_chunks",
    "retrieve_sources",
    "feedback_store",
    "packed_entries",
    "statement_audit",
)
WIDE_COLUMNS = 804
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(job) -> float:
    job()
    seconds = []
    for _ in range(REPEATS):
        start = time.perf_counter()
        job()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": os.environ.get("BENCH_PARTITIONS", cpus),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    path = scratch_path(spark, "wide")
    rows = fx.wide(spark, sf_dir).withColumnRenamed("source_year", "FY")
    # Survey files have columns the tables do not use.
    unused = [f"CAST(pmod(hash(HHLDNO, {i}), 1000) AS STRING) AS UNUSED{i}" for i in range(max(0, WIDE_COLUMNS - len(rows.columns)))]
    rows.selectExpr("*", *unused).write.option("header", True).csv(path)
    wide = wide_csv.read_wide_csv(spark, path, clean=False)
    input_rows = wide.count()
    stage = scratch_path(spark, "stage")

    def reshape_both() -> None:
        staged = wide_csv.stage_wide(wide, "FY", stage)
        for frame in tables.staged_tables(staged):
            drain(frame)

    jobs = {
        "wide_csv_members": lambda: drain(reshape.members(wide, wide["FY"])),
        "wide_csv_errors": lambda: drain(reshape.errors(wide, wide["FY"])),
        "wide_csv_three_tables": reshape_both,
    }
    jobs.update({name: (lambda name=name: drain(QUERIES[name](spark, sf_dir))) for name in HEADLINE})
    seconds = {name: timed(job) for name, job in jobs.items()}
    output_rows = sum(frame.count() for frame in tables.staged_tables(spark.read.parquet(stage)))
    vectors = fx.table(spark, sf_dir, "embeddings").count()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline jobs (median of three runs each)",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
                "rates": {
                    "wide_input_rows_per_sec": round(input_rows / seconds["wide_csv_three_tables"]),
                    "wide_output_rows_per_sec": round(output_rows / seconds["wide_csv_three_tables"]),
                    "retrieval_pairs_per_sec": round(vectors * vectors / seconds["retrieve_sources"]),
                },
                "config": {"cpus": cpus, "spark": spark.version, "partitions": spark.conf.get("spark.sql.shuffle.partitions")},
            }
        )
    )


if __name__ == "__main__":
    main()
