"""Registered queries over whole given tables against SQL or brute force."""

import hashlib
import os
import zlib

import check
import pytest
from llm_data import groups, shingles
from test_llm_archive import expected as expected_records
from test_llm_dedup import removed
from test_llm_tokens import PATH, library

from casemill.llm.queries import CHECKS, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR) or not os.path.exists(PATH), reason="test data not present")


def documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "source").collect()
    return sorted((r.doc_id, r.text or "", r.source) for r in rows)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_equals_its_sql(spark, name):
    status, count, note = check.compare(spark, check.connect(SF_DIR), name, SF_DIR)
    assert status == "ok" and count > 0, note


def test_op2(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url", "html").collect()]
    got = [tuple(r) for r in QUERIES["op2_warc_archive"](spark, SF_DIR).collect()]
    assert sorted(got, key=repr) == sorted(expected_records(pages, 0), key=repr)


def test_op4(spark):
    docs, want = documents(spark), []
    for (doc_id, _, _), ids in zip(docs, library([d[1] for d in docs], 0), strict=True):
        want += [(doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    got = QUERIES["op4_best_fit_packing"](spark, SF_DIR).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == want
    lengths = got.groupby("sequence_id").length
    assert (lengths.cumsum() - got.length == got.offset).all() and lengths.sum().max() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_op5(spark):
    docs = documents(spark)
    sets = [shingles(t) for _, t, _ in docs]
    want = [(d[0], len(s), docs[g][0], docs[g][0] == d[0]) for d, s, g in zip(docs, sets, groups(sets), strict=True)]
    got = QUERIES["op5_minhash_near_dedup"](spark, SF_DIR).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == want


def test_op8(spark):
    docs, start, want = documents(spark), 0, []
    for (doc_id, _, _), ids in zip(docs, library([d[1] for d in docs], 1), strict=True):
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = QUERIES["op8_token_files"](spark, SF_DIR).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_op9(spark):
    docs = documents(spark)
    want = removed(docs)
    got = QUERIES["op9_line_dedup"](spark, SF_DIR).collect()
    assert {r.doc_id: r.text for r in got} == {d[0]: want[d[0], d[1]] for d in docs} and len(got) == len(docs)
    assert any(r.removed_chunks for r in got) and all((r.removed_chars > 0) == (r.removed_chunks > 0) for r in got)


def test_op10(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in QUERIES["op10_document_fingerprints"](spark, SF_DIR).collect()}
    wrong = 0
    for k, (doc_id, text, _) in enumerate(docs):
        after, cut, r = docs[(k + 1) % len(docs)][1], len(text) // 4, got[doc_id]
        edited = text[: len(text) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = shingles(text), shingles(other)
            wrong += abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) > 0.1
    assert len(got) == len(docs) and wrong <= 0.02 * 2 * len(docs)


def test_op1_on_held_out_rows(spark):
    # Few labelled rows here: the lexicon carries most. Clean rows are left alone.
    got = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in held)
    assert sum(got[r.doc_id].predicted for r in held if not r.toxic) <= 0.02 * len(held)
    assert sum(got[r.doc_id].predicted for r in held if r.toxic) >= 0.5 * sum(r.toxic for r in held)
