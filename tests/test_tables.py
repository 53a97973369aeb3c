import os

import pytest
from conftest import rows
from pyspark.sql import Observation
from pyspark.sql import functions as F

from casemill import spec
from casemill.operators import enrich, quality, rates, reshape
from casemill.plans import fixtures
from casemill.session import scratch_path
from casemill.sources import keys, rollups, tables, wide_csv
from casemill.streaming import loads
from casemill.streaming.loads import start_file_loads


SMALL = "/root/testdata/sf0.001"


def frames(spark, year, cases=("CASE001", "CASE002", "CASE003")):
    h = spark.createDataFrame([(c, year, "CA") for c in cases], "case_id string, fiscal_year int, state_name string")
    m = spark.createDataFrame(
        [(c, year, n) for c, k in zip(cases, (2, 3, 1)) for n in range(1, k + 1)],
        "case_id string, fiscal_year int, member_number int",
    )
    e = spark.createDataFrame(
        [(c, year, 1, 111) for c in cases[1:]], "case_id string, fiscal_year int, error_number int, element_code int"
    )
    return h, m, e


def test_write_read_replace_delete(spark):
    root = scratch_path(spark, "t")
    assert tables.write_all(spark, root, *frames(spark, 2022), years=[2022]) == {
        "households": 3,
        "household_members": 6,
        "qc_errors": 2,
    }
    tables.write_all(spark, root, *frames(spark, 2023), years=[2023])
    assert sorted(r[0] for r in tables.loaded_years(spark, root).collect()) == [2022, 2023]
    # A new load of the year replaces the old one.
    tables.write_all(spark, root, *frames(spark, 2022, ("CASE009", "CASE010")), years=[2022])
    kept = rows(tables.read_table(spark, root, "households").filter("fiscal_year = 2022").select("case_id"), "case_id")
    assert kept == [("CASE009",), ("CASE010",)]
    removed = rows(tables.delete_years(spark, root, [2022, 1999]), "table_name")
    assert removed == [("household_members", 2022, 5), ("households", 2022, 2), ("qc_errors", 2022, 1)]
    left = {name: df.select("fiscal_year").distinct().collect()[0][0] for name, df in tables.read_tables(spark, root).items()}
    assert set(left.values()) == {2023}


def test_unfinished_load_stays_invisible(spark):
    root = scratch_path(spark, "t")
    tables.write_all(spark, root, *frames(spark, 2022), years=[2022])
    tables.write_table(frames(spark, 2022)[0], root, "households", "lost")
    assert tables.read_table(spark, root, "households").count() == 3


def test_repeated_load_id_does_not_add_rows(spark):
    root = scratch_path(spark, "t")
    for _ in range(2):
        tables.write_all(spark, root, *frames(spark, 2022), years=[2022], load_id="stream-0", action="append")
    tables.write_all(spark, root, *frames(spark, 2022, ("X", "Y")), years=[2022], load_id="stream-1", action="append")
    assert tables.read_table(spark, root, "households").count() == 5
    assert tables.compact_years(spark, root, [2022]) == {"households": 5, "household_members": 11, "qc_errors": 3}
    assert tables.live_loads(spark, root).count() == 1
    assert tables.read_table(spark, root, "household_members").count() == 11


def wide_file(folder, name, first, count, extra=""):
    folder.mkdir(exist_ok=True)
    header = "HHLDNO,STATE,YRMONTH,FSBEN,FSAFIL1,AGE1" + (",ELEMENT1" if extra else "")
    body = "".join(f"{i},6,202301,{i}.50,1,{-5 if i == 0 else 30}{extra}\n" for i in range(first, first + count))
    (folder / name).write_text(header + "\n" + body)


def test_load_file_audit_and_strict_mode(spark, tmp_path):
    root = scratch_path(spark, "t")
    wide_file(tmp_path / "in", "fy2023.csv", 1, 3)
    path = str(tmp_path / "in" / "fy2023.csv")
    assert tables.load_file(spark, root, path, 2023, scratch_path(spark, "s"))["households"] == 3
    wide_file(tmp_path / "in", "fy2022.csv", 0, 3)
    bad = str(tmp_path / "in" / "fy2022.csv")
    with pytest.raises(quality.ValidationError, match="invalid_age=1"):
        tables.load_file(spark, root, bad, 2022, scratch_path(spark, "s"), strict=True)
    assert [r[0] for r in tables.loaded_years(spark, root).collect()] == [2023]
    log = rows(tables.load_status(spark, root).select("fiscal_year", "total_rows_in_file", "rows_loaded", "percent_complete", "load_status"), "fiscal_year")
    assert log == [(2022, 3, 0, 0, "failed"), (2023, 3, 3, 100, "completed")]
    assert tables.load_history(spark, root).filter("load_status = 'in_progress'").count() == 4
    with pytest.raises(quality.ValidationError, match="ref_empty"):
        tables.load_file(spark, root, path, 2021, scratch_path(spark, "s"), references={"ref_empty": spark.range(0)})


def test_stream_picks_up_later_drops_with_other_columns(spark, tmp_path):
    folder, root, mark = tmp_path / "drops", scratch_path(spark, "t"), scratch_path(spark, "m")
    stage = scratch_path(spark, "s")
    wide_file(folder, "qc_fy2022.csv", 1, 4)
    start_file_loads(spark, str(folder), root, mark, stage).awaitTermination()
    wide_file(folder, "qc_fy2023.csv", 1, 2, extra=",311")
    wide_file(folder, "qc2_fy2022.csv", 10, 1)
    start_file_loads(spark, str(folder), root, mark, stage).awaitTermination()
    start_file_loads(spark, str(folder), root, mark, stage).awaitTermination()
    got = tables.read_tables(spark, root)
    assert rows(got["households"].groupBy("fiscal_year").count(), "fiscal_year") == [(2022, 5), (2023, 2)]
    assert rows(got["qc_errors"].select("fiscal_year", "element_code")) == [(2023, 311)] * 2
    assert got["household_members"].filter(F.col("age") == 30).count() == 7
    done = rows(tables.load_status(spark, root).select("load_id", "total_rows_in_file", "rows_loaded"), "rows_loaded")
    assert [(r[0][-2:], *r[1:]) for r in done] == [("-1", 3, 3), ("-0", 4, 4)]


def test_two_streams_and_a_new_checkpoint_share_a_store(spark, tmp_path):
    root, stage = scratch_path(spark, "t"), scratch_path(spark, "s")
    for name, count in (("a", 2), ("b", 1)):
        wide_file(tmp_path / name, "qc_fy2022.csv", 10 * count, count)
        start_file_loads(spark, str(tmp_path / name), root, scratch_path(spark, "m"), stage).awaitTermination()
    assert tables.read_table(spark, root, "households").count() == 3


def test_replay_after_compaction_and_after_deletion_adds_nothing(spark):
    root = scratch_path(spark, "t")
    load = {"years": [2022], "load_id": "stream-x-0", "action": "append"}
    tables.write_all(spark, root, *frames(spark, 2022), **load)
    tables.compact_years(spark, root, [2022])
    assert tables.write_all(spark, root, *frames(spark, 2022), **load)["households"] == 3
    assert tables.read_table(spark, root, "households").count() == 3
    tables.delete_years(spark, root, [2022])
    tables.write_all(spark, root, *frames(spark, 2022), **load)
    assert tables.read_table(spark, root, "households").count() == 0


def test_append_during_compaction_stays(spark, monkeypatch):
    root = scratch_path(spark, "t")
    tables.write_all(spark, root, *frames(spark, 2022), years=[2022])
    write, late = tables._write_and_commit, frames(spark, 2022, ("X", "Y"))

    def interrupted(*args):
        monkeypatch.setattr(tables, "_write_and_commit", write)
        tables.write_all(spark, root, *late, years=[2022], action="append")
        return write(*args)

    monkeypatch.setattr(tables, "_write_and_commit", interrupted)
    tables.compact_years(spark, root, [2022])
    assert tables.read_table(spark, root, "households").count() == 5
    assert tables.live_loads(spark, root).count() == 2


def test_years_that_were_not_stated_fail_the_load(spark):
    root = scratch_path(spark, "t")
    with pytest.raises(ValueError, match="2023"):
        tables.write_all(spark, root, *frames(spark, 2023), years=[2022])
    assert tables.live_loads(spark, root).count() == 0
    assert tables.write_all(spark, root, *frames(spark, 2023))["households"] == 3
    assert rows(tables.loaded_years(spark, root)) == [(2023,)]


def test_purge_frees_dead_loads_only(spark):
    root = scratch_path(spark, "t")
    tables.write_all(spark, root, *frames(spark, 2022), years=[2022], load_id="one")
    tables.write_all(spark, root, *frames(spark, 2022, ("Z",)), years=[2022], load_id="two")
    tables.write_table(frames(spark, 2022)[0], root, "households", "under-way")
    assert tables.purge(spark, root) == 3
    assert tables.purge(spark, root) == 0
    assert {r[0] for r in spark.read.parquet(f"{root}/households").select("load_id").distinct().collect()} == {"two", "under-way"}
    assert tables.read_table(spark, root, "households").count() == 1


def test_files_without_year_or_columns_are_rejected_with_a_reason(spark, tmp_path):
    folder, root = tmp_path / "drops", scratch_path(spark, "t")
    wide_file(folder, "qc_fy2022.csv", 1, 2)
    wide_file(folder, "no_year.csv", 1, 2)
    (folder / "bad_fy2021.csv").write_text("A,B\n1,2\n")
    (folder / "keyless_fy2022.csv").write_text("STATE,YRMONTH,FSBEN\n6,202201,5\n6,202201,6\n")
    start_file_loads(spark, str(folder), root, scratch_path(spark, "m"), scratch_path(spark, "s")).awaitTermination()
    log = rows(tables.load_status(spark, root).select("load_status", "fiscal_year", "rows_loaded", "error_message"), "load_status", "fiscal_year")
    assert [r[:3] for r in log] == [("completed", 2022, 4), ("rejected", None, 0), ("rejected", 2021, 0)]
    assert "no fiscal year" in log[1][3] and "Missing required columns: STATE" in log[2][3]
    assert tables.read_table(spark, root, "households").select("case_id").distinct().count() == 4


def test_failing_batch_leaves_an_audit_row(spark, tmp_path):
    folder, root = tmp_path / "drops", scratch_path(spark, "t")
    wide_file(folder, "qc_fy2022.csv", 0, 2)
    with pytest.raises(Exception, match="invalid_age"):
        start_file_loads(spark, str(folder), root, scratch_path(spark, "m"), scratch_path(spark, "s"), strict=True).awaitTermination()
    assert rows(tables.load_status(spark, root).select("load_status")) == [("failed",)]


def test_quotes_commas_and_column_orders(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text('HHLDNO,STATE,STATENAME,YRMONTH,FSBEN\nk1,6,"New ""X"" York, NY",202301,1.5\n')
    (folder / "b.csv").write_text("FSBEN,YRMONTH,STATE,HHLDNO\n2.5,202302,7,k2\n")
    got = rows(wide_csv.read_wide_csv(spark, str(folder)).select("HHLDNO", "STATE", "STATENAME", "YRMONTH", "FSBEN"), "HHLDNO")
    assert got == [("k1", "6", 'New "X" York, NY', "202301", "1.5"), ("k2", "7", None, "202302", "2.5")]
    for i in range(40):
        (folder / f"fy2022-{i}.csv").write_text(f"FSBEN,YRMONTH,STATE,HHLDNO\n1,202302,7,x{i}\n")
    plan = wide_csv.read_wide_csv(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan csv") == 2


def test_row_numbers_do_not_depend_on_the_splits(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, first in (("b", 500), ("a", 0)):
        (folder / f"{name}.csv").write_text("STATE\n" + "".join(f"{i}\n" for i in range(first, first + 500)))
    want = [(str(i + 1), str(i)) for i in range(1000)]
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = reshape.with_case_key(spark.read.option("header", True).csv(str(folder)))
            assert sorted((tuple(r) for r in df.select("HHLDNO", "STATE").collect()), key=lambda r: int(r[0])) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_year_that_lost_its_errors_has_no_stored_rollup(spark):
    from casemill.operators import enrich
    from casemill.plans import fixtures as fx

    root, d = scratch_path(spark, "t"), "/root/testdata/sf0.001"
    pick = [df.filter("fiscal_year IN (2019, 2020)") for df in (fx.households(spark, d), fx.members(spark, d), fx.errors(spark, d))]
    tables.write_all(spark, root, *pick)
    refs, thresholds = fx.refs(spark), enrich.threshold_table(spark)
    tables.refresh_aggregates(spark, root, refs, thresholds)
    assert {r[0] for r in tables.read_aggregate(spark, root, "error_element_rollup").select("fiscal_year").distinct().collect()} == {2019, 2020}
    again = [df.filter("fiscal_year = 2019") for df in pick]
    tables.write_all(spark, root, again[0], again[1], again[2].limit(0), years=[2019])
    tables.refresh_aggregates(spark, root, refs, thresholds, [2019])
    assert {r[0] for r in tables.read_aggregate(spark, root, "error_element_rollup").select("fiscal_year").distinct().collect()} == {2020}


def test_bucketed_tables_join_without_shuffle(spark):
    h, m, _ = frames(spark, 2022)
    tables.save_bucketed(h, "b_households", 4)
    tables.save_bucketed(m, "b_members", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("b_members").join(spark.table("b_households"), ["case_id", "fiscal_year"])
        assert joined.count() == 6
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE b_households")
        spark.sql("DROP TABLE b_members")


def cases(spark, root, year=2021):
    return rows(tables.read_table(spark, root, "households").filter(F.col("fiscal_year") == year).select("case_id"), "case_id")


@pytest.mark.parametrize("first", ["a", "z"])
def test_two_replacements_at_once_leave_one(spark, first):
    root = scratch_path(spark, "t")
    tables.write_all(spark, root, *frames(spark, 2021), years=[2021], load_id="old")
    tables.write_all(spark, root, *frames(spark, 2021, ("X",)), load_id="late-append", action="append")
    seen = tables.claimed_loads(spark, root)
    tables.write_all(spark, root, *frames(spark, 2021, ("A", "B")), years=[2021], load_id=first)
    tables.write_all(spark, root, *frames(spark, 2021, ("C", "D")), years=[2021], load_id="m", claimed=seen)
    kept = [("C",), ("D",)] if first == "a" else [("A",), ("B",)]
    assert cases(spark, root) == kept
    assert {r.load_id for r in tables.lost_loads(spark, root).collect()} == {first if first == "a" else "m"}
    # The lost one does not come back when the year is replaced, compacted, purged or deleted.
    tables.compact_years(spark, root, [2021])
    assert cases(spark, root) == kept
    tables.write_all(spark, root, *frames(spark, 2021, ("E", "F")), years=[2021])
    tables.purge(spark, root)
    assert cases(spark, root) == [("E",), ("F",)]
    tables.delete_years(spark, root)
    assert cases(spark, root) == []


def test_a_replacement_wins_over_a_compaction_that_missed_it(spark):
    root = scratch_path(spark, "t")
    tables.write_all(spark, root, *frames(spark, 2021, ("A", "B")), load_id="a1", action="append")
    seen = tables.claimed_loads(spark, root)
    tables.write_all(spark, root, *frames(spark, 2021, ("N", "O")), load_id="a2", action="append")
    tables.compact_years(spark, root, [2021])  # has read a1 and a2
    tables.write_all(spark, root, *frames(spark, 2021, ("R", "S")), years=[2021], load_id="0", claimed=seen)
    # The compaction counts as never committed: what it alone had named, an append the replacement did not see, is live.
    assert cases(spark, root) == [("N",), ("O",), ("R",), ("S",)]
    tables.purge(spark, root)
    assert cases(spark, root) == [("N",), ("O",), ("R",), ("S",)]


def test_keys_hold_over_loads(spark):
    root = scratch_path(spark, "t")
    tables.write_all(spark, root, *frames(spark, 2021), load_id="from-before", action="append")  # without digests
    with pytest.raises(keys.KeyClash, match="households 2021: 0 repeated, 1 taken"):
        keys.append_unique(spark, root, *frames(spark, 2021, ("NEW1", "CASE002", "NEW3")), load_id="x")
    assert len(cases(spark, root)) == 3 and tables.committed_load(spark, root, "x") is None
    again = keys.append_unique(spark, root, *frames(spark, 2021, ("NEW1", "NEW2", "NEW3")), load_id="y")
    assert again["households"] == 3 and keys.append_unique(spark, root, *frames(spark, 2021, ("CASE001",) * 3), load_id="y") == again
    keys.append_unique(spark, root, *frames(spark, 2022))  # the same cases in another year
    with pytest.raises(keys.KeyClash, match="1 repeated"):
        keys.append_unique(spark, root, *frames(spark, 2023, ("HOT",) * 3))
    # A deleted year frees its keys; a replaced one those it no longer has.
    tables.delete_years(spark, root, [2021])
    keys.append_unique(spark, root, *frames(spark, 2021, ("CASE002", "NEW2", "P")))
    tables.write_all(spark, root, *frames(spark, 2021, ("Q", "R")), years=[2021])
    tables.compact_years(spark, root, [2021])
    keys.append_unique(spark, root, *frames(spark, 2021, ("NEW2", "P", "S")))
    with pytest.raises(keys.KeyClash):
        keys.append_unique(spark, root, *frames(spark, 2021, ("T", "U", "Q")))
    assert len(cases(spark, root)) == 5


def test_two_appends_of_one_key_at_once_are_never_both_live(spark, monkeypatch):
    root = scratch_path(spark, "t")
    checked = keys.report

    def meanwhile(spark_, root_, load_id, live):
        found = checked(spark_, root_, load_id, live).collect()
        if load_id == "mine" and tables.committed_load(spark, root, "theirs") is None:
            tables.write_all(spark, root, *frames(spark, 2021, ("SAME", "V", "W")), load_id="theirs", action="append")
        schema = "table_name string, fiscal_year int, repeated_keys bigint, taken_keys bigint, rows_in_load bigint"
        return spark.createDataFrame(found, schema)

    monkeypatch.setattr(keys, "report", meanwhile)
    with pytest.raises(keys.KeyClash):
        keys.append_unique(spark, root, *frames(spark, 2021, ("K", "L", "SAME")), load_id="mine")
    assert cases(spark, root) == [("SAME",), ("V",), ("W",)]


def test_missing_parts_of_keys_are_told_apart(spark):
    data = [("a", None), ("a", ""), (None, "a"), ("", "a"), ("a", "b"), ("a\x1fvb", None)]
    frame = spark.createDataFrame(data, "x string, y string").select(keys.digest(["x", "y"]).alias("d"))
    assert frame.distinct().count() == len(data)


def summed(spark, root, refs, thresholds):
    found = (rollups.state_error_rates(spark, root), rollups.error_element_rollup(spark, root, refs), rollups.demographic_profile(spark, root, refs))
    return [sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr) for df in found]


def computed(spark, root, refs, thresholds):
    store = tables.read_tables(spark, root)
    h = store["households"]
    found = (rates.state_error_rates(h, thresholds), rates.error_element_rollup(store["qc_errors"], h, refs), rates.demographic_profile(store["household_members"], h, refs))
    return [sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr) for df in found]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test data not present")
def test_sums_of_loads_add_up_to_the_whole(spark):
    """Loads are appended, replaced, deleted and compacted; sums of every load equal a computation over all live rows."""
    root, refs, thresholds = scratch_path(spark, "t"), fixtures.refs(spark), enrich.threshold_table(spark)
    h, m, e = fixtures.households(spark, SMALL), fixtures.members(spark, SMALL), fixtures.errors(spark, SMALL)
    first = F.col("case_id").cast("bigint") % 2 == 0

    def load(where, load_id, action="append", **options):
        tables.write_all(spark, root, *(df.filter(where) for df in (h, m, e)), load_id=load_id, action=action, **options)

    load(first, "one")
    assert rollups.refresh(spark, root, thresholds)["households"] == h.filter(first).count()
    assert summed(spark, root, refs, thresholds) == computed(spark, root, refs, thresholds)
    # A second load, and children of the first load's cases in a third one without their households.
    load(~first & (F.col("fiscal_year") != 2020), "two")
    late = [h.filter("false"), *(df.filter(first & (F.col("fiscal_year") == 2021)).limit(50) for df in (m, e))]
    tables.write_all(spark, root, *late, load_id="late", action="append")
    read = rollups.refresh(spark, root, thresholds)
    assert read["households"] == h.filter(~first & (F.col("fiscal_year") != 2020)).count()
    assert rollups.refresh(spark, root, thresholds) == dict.fromkeys(tables.TABLES, 0)
    assert summed(spark, root, refs, thresholds) == computed(spark, root, refs, thresholds)
    tables.delete_years(spark, root, [2019])
    load(first & (F.col("fiscal_year") == 2018), "again", "replace", years=[2018])
    rollups.refresh(spark, root, thresholds)
    tables.purge(spark, root)
    assert summed(spark, root, refs, thresholds) == computed(spark, root, refs, thresholds)
    # Another threshold makes the sums of its year again, and no others.
    other = thresholds.filter("fiscal_year <> 2018").unionByName(spark.sql("SELECT 2018 AS fiscal_year, CAST(5 AS DECIMAL(10,2)) AS threshold_amount"))
    assert {r.fiscal_year for r in rollups.pending(spark, root, other).collect()} == {2018}
    rollups.refresh(spark, root, other)
    assert summed(spark, root, refs, other) == computed(spark, root, refs, other)


def test_staged_rows_are_counted_as_they_are_written(spark):
    """A count of the wide rows would keep the steps before it from becoming one."""
    seen = Observation("staged")
    wide = spark.createDataFrame([("1", 2020, "1", "30"), ("2", 2021, None, "31")], "HHLDNO string, source_year int, FSAFIL1 string, AGE1 string")
    staged = wide_csv.stage_wide(wide, "source_year", scratch_path(spark, "s"), seen)
    assert seen.get["rows"] == 2
    assert rows(staged.selectExpr("HHLDNO", "fiscal_year", "size(members)"), "HHLDNO") == [("1", 2020, 1), ("2", 2021, 0)]


def test_wide_slots_follow_their_rules_for_odd_keys(spark, tmp_path):
    """Also where a remainder is negative or missing; orders of one file are written as wide rows by several tasks."""
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    keys_of = [(k, c) for k in (-50, -7, 0, 1, 20, 9999999999, None) for c in (-13, 0, 8, None)] * 3
    orders = spark.createDataFrame([(k, c, "F", 1.5, None, None) for k, c in keys_of], schema).coalesce(1)
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0, "N_0", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    names = [f"{source}{n}" for source in ("REL", "DPCOST") for n in (1, 17)] + ["NATURE9"]
    rules = {**fixtures.WIDE_PERSON_RULES, **fixtures.WIDE_ERROR_RULES}
    plain = [f"{rules[name.rstrip('0123456789')].replace('{n}', name.lstrip('ABCDEFGHIJKLMNOPQRSTUVWXYZ'))} AS {name}" for name in names]
    want = sorted(orders.selectExpr(*plain).collect(), key=str)
    assert sorted(fixtures.wide(spark, str(tmp_path)).select(*names).collect(), key=str) == want
    fixtures.write_wide_csv(spark, str(tmp_path), f"{tmp_path}/wide")
    files_of = spark.read.option("header", True).csv(f"{tmp_path}/wide")
    assert sorted(files_of.select(*names).collect(), key=str) == want
    assert files_of.select(F.input_file_name()).distinct().count() > 1


def test_lines_are_staged_as_the_csv_reader_reads_them(spark, tmp_path):
    names = [*spec.HOUSEHOLD_VARIABLES][:8] + [f"{v}{n}" for v in spec.PERSON_VARIABLES for n in (1, 2)] + ["ELEMENT1", "it's`\\"]
    header = ",".join(names)
    at = {name: i for i, name in enumerate(names)}

    def line(**cells):
        row = [""] * len(names)
        for name, value in cells.items():
            row[at[name]] = value
        return ",".join(row)

    lines = [
        line(HHLDNO="1", STATENAME='"a, ""b"""', FSAFIL1="1", AGE1="7", WAGES1="5.50"), line(HHLDNO=" 2 ", FSAFIL1="NA", FSAFIL2="3", SEX2='""'),
        "", "   ", header, line(HHLDNO="3", ELEMENT1="311") + ",more,still more", "4,short", line(HHLDNO='"5', FSAFIL2="2"), line(), line(HHLDNO="6\t", FSAFIL1='é"x"'),
    ]
    paths = []
    for name, part in (("qc_pub_fy2021 a+b.csv", lines), ("qc_pub_fy2022.csv", lines[:3]), ("none.csv", lines[:1]), ("qc_pub_fy2023.csv", [])):
        (tmp_path / name).write_text("\n".join([header, *part]) + "\n", encoding="utf-8")
        paths.append(f"{tmp_path}/{name}")
    wide = wide_csv.scans_with_year(spark, {tuple(names): paths})[0]
    want, got = wide_csv.nested(wide, "source_year"), wide_csv.nested_years(spark, names, paths)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 11


def test_a_stream_takes_hundreds_of_columns_through_no_step(spark, tmp_path, monkeypatch):
    """Each step between the files and the staged rows would copy every column."""
    widest = []

    def watched(parts, path, seen=None):
        for part in parts:
            node = part._jdf.queryExecution().optimizedPlan()
            nodes = [node]
            while nodes:
                node = nodes.pop()
                widest.append(node.output().size())
                nodes += [node.children().apply(i) for i in range(node.children().size())]
        return wide_csv.stage(parts, path, seen)

    monkeypatch.setattr(loads, "stage_rows", watched)
    folder = f"{tmp_path}/drops"
    fixtures.write_wide_files(spark, "/root/testdata/sf0.001", folder, "source_year = 2018 AND o_orderkey < 700")
    loads.start_file_loads(spark, folder, f"{tmp_path}/store", f"{tmp_path}/mark", f"{tmp_path}/stage").awaitTermination()
    assert 0 < max(widest) < 100
    assert tables.read_table(spark, f"{tmp_path}/store", "households").count() == 100


def test_wide_files_hold_the_wide_rows(spark, tmp_path):
    few = "o_orderkey < 200"
    fixtures.write_wide_csv(spark, "/root/testdata/sf0.001", f"{tmp_path}/one.csv", few)
    fixtures.write_wide_files(spark, "/root/testdata/sf0.001", f"{tmp_path}/years", few)
    one, years = (wide_csv.scan_lines(spark, wide_csv.files_under(spark, f"{tmp_path}/{p}")) for p in ("one.csv", "years/*"))
    assert sorted(r.line for r in one.collect()) == sorted(r.line for r in years.collect())
    headers = wide_csv.by_header(spark, [f for p in ("one.csv", "years/*") for f in wide_csv.files_under(spark, f"{tmp_path}/{p}")])
    assert len(headers) == 1 and one.count() == 200


def test_digests_meet_in_one_shuffle_by_digest(spark):
    """Dealt by year and load instead, the keys of a year would all go to one task, and each join would move them again."""
    root = scratch_path(spark, "t")
    tables.write_all(spark, root, *frames(spark, 2021), load_id="a", action="append")
    tables.write_all(spark, root, *frames(spark, 2021, ("CASE002", "X", "X")), load_id="b", action="append")
    tables.write_all(spark, root, *frames(spark, 2022, ("CASE001",) * 3), load_id="c", action="append")
    loads_of = {x: spark.createDataFrame([(y, x)], "fiscal_year int, load_id string") for x, y in (("a", 2021), ("b", 2021), ("c", 2022))}
    for frame in loads_of.values():
        keys.write_digests(spark, root, "households", frame)
    new, live = loads_of["b"], loads_of["a"].unionByName(loads_of["b"]).unionByName(loads_of["c"])
    found = keys.clashes(spark, root, "households", new, live)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and sum("hashpartitioning(" in line and "digest" in line for line in plan.splitlines()) == 1
    assert rows(found.select("fiscal_year", "rows_in_load", "rows_stored"), "rows_in_load") == [(2021, 1, 1), (2021, 2, 0)]
    report = keys.report(spark, root, "b")
    assert [tuple(r) for r in report.filter("table_name = 'households'").collect()] == [("households", 2021, 1, 1, 3)]
    report = keys.report(spark, root, "c")
    assert [tuple(r) for r in report.filter("table_name = 'households'").collect()] == [("households", 2022, 1, 0, 3)]
