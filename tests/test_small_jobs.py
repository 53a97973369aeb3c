"""Feedback, sessions, filters, text, statement log, exports and lookups on small frames."""

import datetime as dt
import hashlib
import json
import random
import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from casemill.functions import text as tx
from casemill.functions.identity import pair_id
from casemill.operators import audit, enrich, feedback, filters, rates, sessions
from casemill.operators.ranking import top_per_group
from casemill.plans import fixtures as fx
from casemill.sources import catalog, export, lookups, wide_csv


@pytest.mark.parametrize("question", ["plain", 'say "x" \\ /', "tab\tline\nend\r", "é ü 漢  ", "bell\x07 esc\x1b"])
def test_pair_id_equals_the_uuid_of_the_json(spark, question):
    body = json.dumps({"question": question, "sql": "SELECT 'a'"}, ensure_ascii=False)
    want = str(uuid.uuid5(uuid.UUID(int=0), hashlib.sha256(body.encode()).hexdigest())) + "-sql"
    df = spark.createDataFrame([(question, "SELECT 'a'")], "q string, s string")
    assert df.select(pair_id(F.col("q"), F.col("s"))).first()[0] == want


def test_feedback_adds_removes_and_repeats(spark):
    store = feedback.with_pair_id(spark.createDataFrame([("q1", "s1"), ("q2", "s2")], "question string, sql string"))
    votes = [("q1", "s1", 0, 5, 1), ("q3", "s3", 1, 1, 2), ("q3", "s3", 1, 2, 3), ("q4", "s4", 1, 1, 4), ("q4", "s4", 0, 1, 5), ("q9", "s9", 0, 1, 6)]
    df = spark.createDataFrame(votes, "question string, sql string, value int, ts int, event_id int")
    once = feedback.apply_feedback(store, df)
    assert rows(once.select("question"), "question") == [("q2",), ("q3",)]
    twice = feedback.apply_feedback(once, df)
    assert rows(twice, "pair_id") == rows(once, "pair_id")


def test_packing_shrinks_then_stops(spark):
    data = [("s", i, full, short) for i, (full, short) in enumerate([(50, 10), (5, 5), (90, 30), (40, 10)])]
    df = spark.createDataFrame(data, "session string, seq int, full int, short int")
    last = sessions.last_entries(df, "session", ["seq"])
    packed = sessions.packed_entries(last, "session", "full", "short", 100)
    assert rows(packed.drop("session"), "recency") == [(1, "full", 40), (2, "short", 30), (3, "full", 5), (4, "short", 10)]
    tight = sessions.packed_entries(last, "session", "full", "short", 60)
    assert rows(tight.drop("session"), "recency") == [(1, "full", 40)]
    assert rows(sessions.within_budget(last, "session", "full", 130).select("seq"), "seq") == [(2,), (3,)]


def test_top_per_group_with_a_hot_group(spark):
    hot = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('g', id % 500) END AS g", "id * 7919 % 9001 AS v")
    got = top_per_group(hot.repartition(16), ["g"], [F.desc("v")], 4, "n")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") >= 2 and "WindowGroupLimit" in plan
    pdf = hot.toPandas().sort_values("v", ascending=False).groupby("g").head(4)
    assert sorted(map(tuple, got.select("g", "v").collect())) == sorted(map(tuple, pdf[["g", "v"]].to_numpy().tolist()))


def test_hot_join_key_is_split(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        # As on a cluster, one partition is a small part of the data.
        "spark.sql.shuffle.partitions": "64",
    }
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        errors = spark.range(0, 120_000, 1, 16).selectExpr(
            "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS case_id", "2023 AS fiscal_year",
            "311 AS element_code", "2 AS error_finding", "1 AS responsible_agency", "CAST(pmod(hash(id), 90000) / 100 AS DECIMAL(10,2)) AS error_amount",
        )
        parents = errors.select("case_id", "fiscal_year").distinct().selectExpr(
            "*", "'CA' AS state_name", "1 AS case_classification", "CAST(2 AS DECIMAL(18,8)) AS household_weight"
        )
        total = errors.agg(F.sum("error_amount")).first()[0]
        out = rates.error_element_rollup(errors, parents, enrich.reference_tables(spark))
        found = out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
        assert [(r.sample_error_count, float(r.weighted_error_dollars)) for r in found] == [(120_000, float(2 * total))]
    finally:
        for key in conf:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_filters_check_values_and_match_the_full_key(spark):
    with pytest.raises(ValueError):
        filters.GlobalFilter(states=("x'; DROP",))
    with pytest.raises(ValueError):
        filters.GlobalFilter(fiscal_years=(1999,))
    parent = spark.createDataFrame([("1", 2022, "Ohio"), ("1", 2023, "Utah")], "case_id string, fiscal_year int, state_name string")
    child = spark.createDataFrame([("1", 2022, 1), ("1", 2023, 2)], "case_id string, fiscal_year int, n int")
    kept = filters.apply_filter(child, filters.GlobalFilter(states=("Ohio",)), parent)
    assert rows(kept.select("n")) == [(1,)]
    with pytest.raises(ValueError, match="parent"):
        filters.apply_filter(child, filters.GlobalFilter(states=("Ohio",)))
    filters.filtered_views({"households": parent, "qc_errors": child}, filters.GlobalFilter(("Utah",)))
    assert spark.sql("SELECT n FROM qc_errors").first()[0] == 2


def test_tags_and_categories(spark):
    df = spark.createDataFrame([(["SNAP!", "snap", "a b", "", "x" * 40, "é"], "My Policy #1", "#One, two  #ONE")], "t array<string>, c string, s string")
    r = df.select(tx.clean_tags(F.col("t")), tx.clean_category(F.col("c")), tx.clean_category(F.lit("!!")), tx.split_tags(F.col("s"))).first()
    assert tuple(r) == (["snap", "ab", "x" * 30], "mypolicy1", "general", ["one", "two"])


@pytest.mark.parametrize(
    ("value", "kind", "shown"),
    [("2023.0", "year", "2023"), ("20230115", "rawint", "20230115"), ("1234567.9", "integer", "1,234,567"), ("-100.5", "currency", "-$100.50"),
     ("1234.5", "currency", "$1,234.50"), ("1234.56789", "weight", "1,234.5679"), ("x", "integer", "x"), ("true", "boolean", "Yes"),
     ("0", "boolean", "No"), ("maybe", "boolean", "maybe"), ("2024-01-02 03:04:05.6", "datetime", "2024-01-02 03:04"), (None, "currency", None)],
)
def test_display_values(spark, value, kind, shown):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(tx.display_value(F.col("v"), kind)).first()[0] == shown


@pytest.mark.parametrize(
    ("sql", "strict", "loose"),
    [
        ("SELECT 1", None, None),
        (" with a as (select 1) select * from a ; ", None, None),
        ("SELECT created_at FROM t", None, "contains CREATE"),
        ("DROP TABLE t; DELETE FROM t", "forbidden keyword: DROP", "contains DELETE"),
        ("EXPLAIN SELECT 1", "not a SELECT or WITH", None),
        ("SELECT 1; SELECT 2", "multiple statements", None),
        ("SELECT 1 -- x", "comment", None),
        ("MERGE INTO t", "not a SELECT or WITH", "contains MERGE"),
    ],
)
def test_statement_rules(spark, sql, strict, loose):
    r = audit.classify_statements(spark.createDataFrame([(sql,)], "statement string")).first()
    assert (r.strict_reason, r.loose_reason) == (strict, loose)


def test_unknown_table_and_unknown_codes(spark):
    with pytest.raises(ValueError, match="Available: households"):
        export.table_export({"households": spark.range(1)}, "nope")
    df = spark.createDataFrame([(311, 2), (999, None)], "element_code int, status int")
    got = rows(enrich.codes_in_result(df, enrich.reference_tables(spark)), "column_name", "code")
    assert got == [("element_code", "311", "Wages and salaries"), ("element_code", "999", "Unknown code 999"), ("status", "2", "Overissuance")]


def test_lookup_documents(spark):
    text = json.dumps({"code_lookups": {"a_codes": {"description": "d", "source_field": "A", "1": "one", "x": "bad", " 2": "two"}, "state_codes": {"6": {"name": "California", "abbr": "CA"}, "48": "Texas"}, "sets": {"s": [1, 2], "note": "n"}}})
    df = spark.createDataFrame([(text,)], "value string")
    got = rows(lookups.lookup_rows(df).filter("lookup <> 'sets'"), "lookup", "code")
    assert got == [("a_codes", 1, "one", None), ("a_codes", 2, "two", None), ("state_codes", 6, "California", "CA"), ("state_codes", 48, "Texas", None)]
    assert rows(lookups.category_sets(df, "sets")) == [("s", [1, 2], 0)]


def test_documents_are_accepted_or_rejected_with_reason(spark):
    data = [("a.md", "x"), ("b.TXT", "y"), ("c.pdf", "z"), ("d.txt", " \n "), ("e.txt", None)]
    df = spark.createDataFrame(data, "filename string, text string")
    assert rows(lookups.accepted_documents(df).select("filename"), "filename") == [("a.md",), ("b.TXT",)]
    reasons = rows(lookups.rejected_documents(df).select("filename", "reason"), "filename")
    assert [r[1].split(".")[0] for r in reasons] == ["Invalid file type", "File is empty", "File is empty"]


def test_rates_of_one_state(spark):
    from decimal import Decimal as D

    data = [("1", 2023, "Ohio", 1, 2, D(100), D(60), D(2)), ("2", 2023, "Ohio", 1, 3, D(50), D(54), D(1)), ("3", 2023, "Ohio", 1, None, D(50), None, D(1)), ("4", 2023, "Ohio", 2, 2, D(9), D(99), D(1))]
    schema = "case_id string, fiscal_year int, state_name string, case_classification int, status int, snap_benefit decimal(10,2), amount_error decimal(10,2), household_weight decimal(18,8)"
    df = spark.createDataFrame(data, schema).withColumns({"state_code": F.lit("39"), "gross_income": F.lit(None).cast("decimal(12,2)")})
    r = rates.state_error_rates(df, enrich.threshold_table(spark)).first()
    assert (r.total_sample_cases, r.error_sample_cases, r.overissuance_sample_cases) == (3, 2, 1)
    # 54 is not above the 2023 threshold of 54; 60 x 2 of 300 weighted benefit dollars is 40 percent.
    assert (r.payment_error_rate, r.overpayment_rate, r.underpayment_rate, r.case_error_rate) == (40.0, 40.0, 0.0, 66.67)
    assert r.avg_weighted_gross_income is None


def test_dictionary_relationships_and_code_order(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (2, "x")], "a int, b string")
    notes = spark.createDataFrame([("t", "a", "the a"), ("t", "gone", "no")], "table_name string, column_name string, description string")
    got = catalog.data_dictionary({"t": df}, notes, distinct="exact").select("column_name", "data_type", "row_count", "null_count", "distinct_count", "description")
    assert rows(got, "column_name") == [("a", "int", 3, 0, 2, "the a"), ("b", "string", 3, 1, 1, None)]
    lines = rows(catalog.dictionary_lines(catalog.profile("t", df)).select("line"))
    assert lines == [("| a | int | true |",), ("| b | string | true |",)]
    made = catalog.relationships({"members_to_households": ("m", "h", ("case_id", "fiscal_year"))}, df).first()
    assert made.join_condition == "m.case_id = h.case_id AND m.fiscal_year = h.fiscal_year"
    codes = spark.createDataFrame([("l", c) for c in ("b", "10", "9", "a")], "lookup string, code string")
    assert [r[1] for r in rows(catalog.sorted_codes(codes))] == ["9", "10", "a", "b"]


def test_markdown_and_csv_exports(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, 'say "a, b"')], "k int, v string")
    assert rows(export.markdown_lines(df, ["k"])) == [
        (0, "| k | v |"), (1, "| --- | --- |"), (2, '| 1 | say "a, b" |'), (3, "| 2 |  |"),
    ]
    path = str(tmp_path / "out")
    export.write_csv(df, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert rows(back, "k") == [("1", 'say "a, b"'), ("2", None)]
    assert export.first_columns(df, 1).columns == ["k"]
    assert rows(export.capped(df, 1, ["k"]).select("k")) == [(1,)]


def test_several_tables_and_display_frame(spark, tmp_path):
    known = {"a": spark.createDataFrame([(1, 2022), (2, 2023)], "n int, fiscal_year int"), "b": spark.range(3)}
    export.write_tables(known, ["a", "b"], str(tmp_path), filters.GlobalFilter(fiscal_years=(2023,)))
    assert rows(spark.read.option("header", True).csv(f"{tmp_path}/a")) == [("2", "2023")]
    assert spark.read.option("header", True).csv(f"{tmp_path}/b").count() == 3
    with pytest.raises(ValueError):
        export.write_tables(known, ["a", "c"], str(tmp_path))
    df = spark.createDataFrame([(2023, 1500, -2.5, 3.0, True)], "fiscal_year int, n int, paid double, f double, ok boolean")
    shown = export.display_frame(df, {"fiscal_year": "year", "paid": "currency", "ok": "boolean"})
    assert rows(shown) == [("2023", "1,500", "-$2.50", "3", "Yes")]


def test_files_of_lookups_pairs_and_documents(spark, tmp_path):
    for name, body in {
        "codes/map.json": json.dumps({"code_lookups": {"sex_codes": {"1": "Male", "source_field": "SEX"}}}, indent=2),
        "pairs/a.json": json.dumps({"example_queries": [{"question": "q", "sql": "s", "explanation": "e"}, {"question": "only"}]}, indent=2),
        "pairs/b.json": json.dumps({"something": 1}),
        "docs/x.md": "# A\ntext",
        "docs/deep/y.txt": "body",
        "docs/z.pdf": "no",
        "docs/empty.txt": " \n",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    assert rows(lookups.read_lookups(spark, f"{tmp_path}/codes")) == [("sex_codes", 1, "Male", None)]
    assert rows(lookups.read_example_pairs(spark, f"{tmp_path}/pairs")) == [("q (e)", "s")]
    assert rows(lookups.read_documents(spark, f"{tmp_path}/docs"), "filename") == [("x.md", "# A\ntext"), ("y.txt", "body")]


def test_stream_and_batch_feedback_agree_when_a_batch_repeats(spark):
    from casemill.session import scratch_path
    from casemill.streaming.feedback import compact, current_pairs, start_feedback

    schema = "question string, sql string, value int, ts int, event_id bigint"
    votes = [("q", f"s{i % 7}", (i // 7) % 2, i % 11, i) for i in range(90)]
    df = spark.createDataFrame(votes, schema)
    drop, path, mark = (scratch_path(spark, n) for n in ("drop", "fold", "mark"))
    df.repartition(3).write.parquet(drop)
    store = feedback.with_pair_id(spark.createDataFrame([("q", "s1"), ("q", "old")], "question string, sql string"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(drop)
    start_feedback(stream, path, mark).awaitTermination()
    want = rows(feedback.apply_feedback(store, df), "pair_id")
    assert rows(current_pairs(spark, store, path), "pair_id") == want
    # A new checkpoint sends every batch again.
    start_feedback(stream, path, scratch_path(spark, "mark")).awaitTermination()
    assert rows(current_pairs(spark, store, path), "pair_id") == want
    compact(spark, path, f"{path}-one")
    assert rows(current_pairs(spark, store, f"{path}-one"), "pair_id") == want


def test_stateful_feedback_is_the_same_for_any_order_of_batches(spark, monkeypatch):
    from casemill.operators import feedback as fold
    from casemill.session import scratch_path
    from casemill.streaming import feedback as stream

    monkeypatch.setattr(stream, "FOLD_EVERY", 3)
    rng = random.Random(6)
    moments = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(30)) for _ in range(160)]
    votes = [(f"q{rng.choice((0, 0, 0, 1, 2, 3))}", "s", rng.randrange(2), moments[i], i) for i in range(160)]
    schema = "question string, sql string, value int, ts timestamp, event_id bigint"
    store = fold.with_pair_id(spark.createDataFrame([("q1", "s"), ("kept", "s")], "question string, sql string"))
    want = rows(fold.apply_feedback(store, spark.createDataFrame(votes, schema)), "pair_id")
    written = []
    for seed in (0, 1):
        shuffled = random.Random(seed).sample(votes, len(votes))
        drop, path, mark = (scratch_path(spark, n) for n in ("drop", "votes", "mark"))
        for k in range(8):
            spark.createDataFrame(shuffled[k * 20 : (k + 1) * 20], schema).coalesce(1).write.mode("append").parquet(drop)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(drop)
        stream.start_feedback(source, path, mark).awaitTermination()
        assert rows(stream.current_pairs(spark, store, path), "pair_id") == want
        live = [p for found in stream._folders(spark, path).values() for p in found["live"]]
        written.append(stream._read(spark, live).count())
        # A second stream over the same votes changes nothing.
        stream.start_feedback(source, path, scratch_path(spark, "mark")).awaitTermination()
        assert rows(stream.current_pairs(spark, store, path), "pair_id") == want
    # A read costs the pairs and the changes of the batches since the last fold, of 160 votes.
    assert all(n <= 4 + 3 * 4 for n in written)
    assert stream.newest_votes(spark, scratch_path(spark, "none")).count() == 0


def test_compressed_drops_are_read_and_listed(spark, tmp_path):
    folder = str(tmp_path / "drops")
    fx.write_wide_files(spark, "/root/testdata/sf0.001", folder, "source_year IN (2018, 2020)")
    parts = [p for p in (tmp_path / "drops").rglob("part-*") if p.is_file()]
    assert parts and all(p.name.endswith(".csv.gz") for p in parts)
    named = tmp_path / "drops" / "qc_pub_fy2022.csv.gz"
    named.write_bytes(parts[0].read_bytes())
    listed = {(r.filename, r.fiscal_year) for r in wide_csv.file_catalog(spark, folder).collect()}
    assert listed == {("qc_pub_fy2018.csv", 2018), ("qc_pub_fy2020.csv", 2020), ("qc_pub_fy2022.csv.gz", 2022)}
    years = {r.source_year: r["count"] for r in wide_csv.read_years(spark, folder, (2018, 2020)).groupBy("source_year").count().collect()}
    want = {r.source_year: r["count"] for r in fx.wide(spark, "/root/testdata/sf0.001").groupBy("source_year").count().collect()}
    assert years == {year: want[year] for year in (2018, 2020)}


def test_a_batch_gives_only_newer_votes_and_meets_tables_only(spark):
    from casemill.streaming.feedback import changes

    schema = "question string, sql string, value int, ts timestamp, event_id bigint"
    day = [dt.datetime(2024, 1, n) for n in (1, 2, 3)]
    known = spark.createDataFrame([("q", "old", 1, day[1], 5), ("q", "same", 1, day[1], 5), (None, "s", 1, day[1], 5)], schema)
    batch = [("q", "old", 0, day[0], 9), ("q", "same", 1, day[1], 5), (None, "s", 0, day[1], 6), ("q", "new", 1, day[0], 1), ("q", "new", 0, day[2], 0)]
    found = changes(spark.createDataFrame(batch, schema), known)
    assert rows(found.coalesce(1), "sql") == [("q", "new", 0, day[2], 0), (None, "s", 0, day[1], 6)]
    assert "Pandas" not in found._jdf.queryExecution().toString()


def test_texts_are_cut_some_hundred_at_a_time(spark):
    from casemill.functions.chunking import chunks_of

    texts = spark.createDataFrame([("a " * 400, "x.md"), (None, "y.txt"), ("b", None)], "text string, filename string")
    cut = texts.select(chunks_of(texts["text"], texts["filename"]).alias("c"))
    assert "ArrowEvalPython" not in cut._jdf.queryExecution().toString()
    assert sorted(-1 if r.c is None else len(r.c) for r in cut.collect()) == [-1, 1, 2]


def test_unique_rows_are_chosen_before_they_become_wide(spark, tmp_path):
    line = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(1)
    twice = [line.selectExpr(f"* EXCEPT (l_orderkey, l_partkey, l_linenumber)", f"CAST({k} AS BIGINT) AS l_orderkey", f"CAST({p} AS BIGINT) AS l_partkey", "1 AS l_linenumber")
             for k, p in ((7, 1), (7, 2), (8, 1), (8, 97))]
    twice[0].unionByName(twice[1]).unionByName(twice[2]).unionByName(twice[3]).write.parquet(f"{tmp_path}/lineitem.parquet")
    for make in (fx.members, fx.errors):
        every, kept = make(spark, str(tmp_path)), make(spark, str(tmp_path), unique=True)
        assert kept.columns == every.columns and kept.dtypes == every.dtypes
        assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in every.collect()}
        # The key of line 97 has a shifted year.
        assert sorted((r.case_id, r.fiscal_year) for r in kept.collect()) == [("7", 2017), ("8", 2018), ("8", 2019)]
        moved = [n for n in kept._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in n]
        assert moved and not any("verification_status" in n or "dependent_care_cost" in n for n in moved)


def test_a_session_built_elsewhere_keeps_generated_methods_small(spark):
    from casemill.plans import QUERIES

    key, before = "spark.sql.codegen.hugeMethodLimit", spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        for given, want in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(key, given)
            QUERIES["table_counts"](spark, "/root/testdata/sf0.001")
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)
