import base64
import gzip
import hashlib
import math
import random

import pytest

from casemill.llm import topk, warc
from casemill.llm.common import shared_folder, store_of
from casemill.session import scratch_path

PAGES = "page_id bigint, url string, html string, key string, digest int, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "p") for r in rows], PAGES)


def awkward_pages():
    rng = random.Random(1)
    rows = [(i, f"http://Host{i % 3}.Example.org:80/p/{i % 9}?q={i}#f", f"<p>{i % 7} é{'x' * rng.randrange(50)}</p>") for i in range(60)]
    rows += [(100 + i, "https://user@one.example/same", "<same>" * 50) for i in range(40)]
    rows += [(200, None, None), (201, "no scheme/and blanks\r\nX: y", ""), (202, "", "\r\n\r\nbody\r\n\r\n"), (203, "http://é.example/ü", "z" * 300_000)]
    return rows + [(204, "http://a/", "twice"), (204, "http://a/", "twice"), (None, "http://a/", "twice"), (None, None, "lone")]


def expected(rows, least):
    largest = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if i is not None:
            largest[body] = max(largest.get(body, i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        to = largest.get(body) if len(body) >= least else None
        refers = None if to is None or to == i else to
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if refers is None else "revisit", refers))
    return out


@pytest.mark.parametrize("least", [0, 10])
def test_archives_read_back_equal_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "TASK_RECORDS", 16)
    rows = awkward_pages()
    folder = scratch_path(spark, "warc")
    captures = warc.write_archive(pages(spark, rows).repartition(5), folder, least)
    shards = warc.write_index(captures, f"{folder}/index", 4)
    asked = captures.select("key", "page_id")
    got = warc.read_records(warc.look_up(asked, shards, 5), folder, 5, with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(
        expected(rows, least), key=repr
    )
    bodies = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert bodies[203] == b"z" * 300_000 and bodies[202] == b"\r\n\r\nbody\r\n\r\n"


def test_round_trip_and_empty_table(spark):
    rows = awkward_pages()
    got = warc.round_trip(pages(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(expected(rows, 0), key=repr)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_keys_sort_by_reversed_host_and_unknown_keys_find_nothing(spark):
    df = spark.createDataFrame([("https://u:p@B.Example.org:443/x?y#z",), ("b.example.org",), (None,)], "url string")
    assert [r[0] for r in df.select(warc.url_key(df.url)).collect()] == ["org,example,b)/x?y", "org,example,b)/", ")/"]
    folder = scratch_path(spark, "warc")
    shards = warc.write_index(warc.write_archive(pages(spark, awkward_pages()), folder), f"{folder}/index", 4)
    asked = spark.createDataFrame([("zz)/", 1), ("", 1), ("example,one)/same", 999)], "key string, page_id bigint")
    assert warc.look_up(asked, shards, 2).count() == 0


def test_records_are_members_of_their_own_and_damage_raises():
    member = warc.record_bytes(7, "http://a/b c\r\nX: 1", "täxt".encode(), None, "2020-01-01T00:00:00Z")
    text = gzip.decompress(member).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and "http://a/b%20c%0D%0AX:%201\r\n" in text
    assert warc.parse_record(member)["payload"].decode() == "täxt"
    changed = warc._member(gzip.decompress(member).replace("täxt".encode(), "tüxt".encode()))
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(changed)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    rng = random.Random(2)
    hot = [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, [rng.gauss(0, 1 + i % 3) for _ in range(6)]) for i in range(300)] + [(300 + i, hot) for i in range(150)]
    rows += [(500, None), (520, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (540, [math.nan] * 6), (560, [math.inf] * 6), (580, []), (600, [3.0, 4.0])]
    rows += [(None, hot), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id bigint, embedding array<double>, vector int, near string")
    got = topk.top_k(df.repartition(4), "vec_id % 20 = 0", 20)
    assert sorted(map(tuple, got.collect())) == sorted(best_scores(rows))


def best_scores(rows, k=20):
    whole = [
        (i, [math.floor(64 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    want = []
    for q in {i for i, _ in whole if i % 20 == 0}:
        pairs = [(a, i, b) for j, a in whole if j == q for i, b in whole if i != q]
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for a, i, b in pairs)[:k]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return want


def test_top_k_keeps_rows_that_share_an_id_and_wide_components(spark):
    rng = random.Random(3)
    rows = [(i % 60, [rng.gauss(0, 1) for _ in range(4)]) for i in range(150)] + [(7, [9.0, 9.0, 9.0, 9.0])] * 30
    schema = "vec_id bigint, embedding array<double>"
    got = topk.top_k(spark.createDataFrame(rows, schema).repartition(3), "vec_id % 20 = 0")
    assert sorted(map(tuple, got.collect())) == sorted(best_scores(rows))
    wide = rows + [(61, [4e7, -4e7, 0.5, 1.0]), (62, [1e12, 1.0, 0.0, 0.0]), (80, [3.0, -2e4, 0.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(wide, schema).repartition(3), "vec_id % 20 = 0")
    assert sorted(map(tuple, got.collect())) == sorted(best_scores(wide))


def test_top_k_with_few_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), "vec_id % 20 = 0").count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], schema)
    assert [tuple(r) for r in topk.top_k(two, "vec_id % 20 = 0").collect()] == [(0, 1, 1, 64 * 32)]
    assert topk.top_k(two, "vec_id = 9").count() == 0


def test_folders_mean_to_tasks_what_they_mean_to_spark(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert shared_folder(spark, str(tmp_path)) == f"file:{tmp_path}"
    conf.set("fs.viewfs.mounttable.elsewhere.link./lake", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://elsewhere")
    try:
        # A path without scheme is on the default file system, not on the disk of a task.
        assert shared_folder(spark, "/lake/warc") == "viewfs://elsewhere/lake/warc"
    finally:
        conf.set("fs.defaultFS", before)
    assert shared_folder(spark, "file:///a/b") == "file:///a/b"
    for scheme in ("s3", "s3a", "s3n"):
        assert shared_folder(spark, f"{scheme}://bucket/a b") == "s3://bucket/a b"
    assert shared_folder(spark, "hdfs://name:8020/a") == "hdfs://name:8020/a"
    with pytest.raises(ValueError, match="dbfs"):
        shared_folder(spark, "dbfs:/a")
    for write in (lambda: warc.write_archive(pages(spark, []), "unknown://a/b"), lambda: warc.write_index(pages(spark, []), "unknown://a/b")):
        with pytest.raises(ValueError, match="unknown"):
            write()
    with pytest.raises(ValueError, match="no file system"):
        store_of("/a/b")
