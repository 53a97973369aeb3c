import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import awkward, frame

from casemill.llm import ans, packing, tokens
from casemill.llm.queries import tokenizer_path
from casemill.session import scratch_path

try:
    PATH = tokenizer_path()
except ImportError:
    PATH = ""
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="tokenizer files not present")


def library(texts, end):
    from tokenizers import Tokenizer

    got = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*g.ids, end], "<u4") for g in got]


@given(st.lists(st.text(alphabet=st.sampled_from("aB'é <|>.s\n\t\x0b\x1c　İßΣς9日!"), max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_word_route_equals_the_library(texts):
    encoder = tokens.encoder_of(tokens.read_tokenizer(PATH))
    assert encoder.by_word
    ids, counts = encoder.column(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    want = [list(x[:-1]) for x in library(texts, 0)]
    assert [list(ids[e - n : e]) for n, e in zip(counts, ends, strict=True)] == want


def test_another_tokenizer_encodes_whole_texts():
    from tokenizers import Tokenizer

    path = os.path.join(os.path.dirname(PATH), "byte_bpe_50k.json")
    encoder = tokens.Encoder(tokens.read_tokenizer(path))
    texts = ["Hello  there", None, "", "tab\tand\nline"]
    ids, counts = encoder.column(pa.array(texts))
    want = [g.ids for g in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert not encoder.by_word and ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_packing_equals_brute_force_pieces_and_fills_bins(spark):
    rows = awkward()
    got = packing.pack_documents(frame(spark, rows).repartition(4), PATH, 64, 0).toPandas()
    want = []
    for (doc_id, _, _), ids in zip(rows, library([r[1] for r in rows], 0), strict=True):
        want += [(doc_id, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    key = [tuple(None if x != x else int(x) for x in r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(key, key=repr) == sorted(want, key=repr)
    bins = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (bins.length.cumsum() - got.sort_values(["sequence_id", "offset"]).length == got.sort_values(["sequence_id", "offset"]).offset).all()
    assert bins.length.sum().max() <= 64 and len(bins) <= -(-got.length.sum() // 64) + 1
    assert packing.pack_documents(frame(spark, []), PATH, 64, 0).count() == 0


def test_places_of_ranks_start_no_python_on_executors(spark):
    pieces = spark.range(9).selectExpr("id as doc_id", "10 + id % 3 as length", "0 as block", "id div 3 as rank_in_block")
    got = packing.pack(pieces, 64)
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 9 and got.agg({"sequence_id": "max"}).first()[0] == 1


def test_fullest_combination_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randrange(1, 20): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(0, 40)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        uses = packing.fullest(counts, room)
        assert sum(n * u for n, u in uses.items()) == max(s for s in sums if s <= room)
        assert all(u <= counts[n] for n, u in uses.items())


def test_places_use_every_piece_once():
    rng = random.Random(5)
    counts = {rng.randrange(1, 101): rng.randrange(1, 5000) for _ in range(60)}
    bins = packing.combinations(counts, 100)
    used = dict.fromkeys(counts, 0)
    for uses, times in bins:
        assert sum(n * u for n, u in uses.items()) <= 100
        for n, u in uses.items():
            used[n] += u * times
    assert used == counts
    # No more than two bins a hundred over the bound of the lengths above half and of the total.
    bound = max(-(-sum(n * c for n, c in counts.items()) // 100), sum(c for n, c in counts.items() if n > 50))
    assert sum(t for _, t in bins) <= bound * 1.02 + 1


@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_coder_round_trip(ids, skew):
    ids = np.array(ids, np.uint32) // skew
    table = ans.Table(*ans.scaled(np.bincount(ids, minlength=301)))
    if len(ids):
        state, streams = table.encode(ids)
        assert (table.decode(state, streams, len(ids)) == ids).all()


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(ans, "FRAME_TOKENS", 500)
    monkeypatch.setattr(ans, "FILE_TOKENS", 2000)
    rows = awkward()
    got = ans.round_trip(frame(spark, rows).repartition(3), PATH, 1, with_ids=True).orderBy("start").collect()
    ids = library([r[1] for r in rows], 1)
    want = sorted(((r[0] is not None, r[0] or 0), x.tolist()) for r, x in zip(rows, ids, strict=True))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids) for r in got) == want
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[0] for w in want]
    total = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (total, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        total += r.n_tokens
    assert ans.round_trip(frame(spark, []), PATH, 1).count() == 0


def test_damaged_token_files_raise(spark):
    folder = scratch_path(spark, "tokens")
    manifest = ans.encode_documents(frame(spark, awkward()), PATH, folder, 1)
    path = manifest.first().path
    name = path.removeprefix("file:")
    raw = bytearray(open(name, "rb").read())
    raw[len(raw) // 3] ^= 1
    open(name, "wb").write(raw)
    with pytest.raises(Exception, match="damaged"):
        ans.decode_files(manifest, folder).collect()
