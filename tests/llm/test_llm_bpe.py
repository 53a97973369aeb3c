"""Merge replay against the tiktoken library, and the round trip of ids."""

import base64
import hashlib
import os
import random

import pytest
from llm_data import EXTRA, SCHEMA

from casemill.llm import bpe
from casemill.llm.queries import QUERIES, rank_file

SF_DIR = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = rank_file()


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(2)
    alphabet = "abcdeABC éüß日本語 123'\n\t  .,!?ś  😀"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(400)]
    out += ["", None, " ", "\n\n", "a" * 3000, " " * 2000 + "x", "it's we'll I'd", "<|endoftext|>", "no-blank" * 900]
    return out + ["word and other words, again. " * 20_000]


def test_ids_are_those_of_the_library(spark, library):
    rows = [(i, t, "en", "s", 0, *EXTRA) for i, t in enumerate(texts())] + [(3, None, None, None, None, *EXTRA), (3, "twice", None, None, None, *EXTRA)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = bpe.encode(docs, PATH, PATTERN, decoded="bytes").collect()
    assert len(got) == len(rows)
    for row in got:
        assert row.ids == library.encode_ordinary(row.text or "") and bytes(row.bytes) == (row.text or "").encode()
    assert all(row["copy"] == 9 for row in got)
    back = bpe.decode(bpe.encode(docs, PATH, PATTERN).drop("text"), PATH, PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((r[1] or "").encode() for r in rows)


def test_new_columns_take_free_names_and_empty_tables_stay_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "mine")], "doc_id int, text string, IDS string")
    out = bpe.encode(docs, PATH, PATTERN)
    assert out.columns[:3] == docs.columns and out.columns[3].startswith("ids_")
    assert bpe.encode(docs.filter("false"), PATH, PATTERN).count() == 0


def test_windows_of_a_text_have_its_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW_CHARS", 5)
    coder = bpe.Coder(bpe.read_ranks(PATH), PATTERN)
    for text in filter(None, texts()[:400]):
        assert [p for part in coder.pieces(text) for p in part] == coder.pattern.findall(text)


def rank_lines(tokens):
    return b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens))


def test_a_merge_that_makes_a_pair_of_lower_rank(library):
    """With 'abc' before 'ab', merging a and b makes a pair of a lower rank, which the piece itself would merge at once."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bca", b"ab", b"cab", b"ca"]
    merger = bpe.Merger(rank_lines(tokens))
    rng = random.Random(3)
    pieces = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 14))) for _ in range(300)} - set(merger.ranks))
    ids, bounds = merger.replay(pieces)
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=merger.ranks, special_tokens={})
    for k, piece in enumerate(pieces):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == own.encode_ordinary(piece.decode()) == merger.alone(piece)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
def test_registered_query(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        digests = (",".join(map(str, ids)).encode(), (text or "").encode())
        want.append((doc_id, len(ids), *(hashlib.sha256(d).hexdigest() for d in digests)))
    got = QUERIES["op12_byte_bpe"](spark, SF_DIR).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
