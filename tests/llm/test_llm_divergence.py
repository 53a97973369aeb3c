"""Divergences of sources against whole-number arithmetic over every term."""

import random
import re
from collections import Counter, defaultdict

import pytest
from llm_data import awkward

from casemill.llm import divergence
from casemill.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, term string, item string, k int, p string, part string"
EXTRA = (1, "t", "i", 2, "p", "x")


def expected(rows, least=3, most=200):
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    found = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    docs, counts, every = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for (_, lang, source), terms in zip(rows, found, strict=True):
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        every[lang].update(terms)
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def share(counter, kept=kept):
            total = sum(counter[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counter[t] + 1) // total for t in kept}

        groups = {s: share(counts[key]) for key in counts if key[0] == lang for s in [key[1]]}
        q = share(every[lang])
        for source, p in groups.items():
            parts = {"pair": [(sum((p[t] - o[t]) ** 2 // o[t] for t in kept), s) for s, o in groups.items() if s != source]}
            parts["term"] = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
            for part, values in parts.items():
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < most]
    return sorted(out)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, lang, s, *EXTRA) for i, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(5)
    return sorted(map(tuple, divergence.audit(frame, **options).collect()))


def documents():
    rng = random.Random(4)
    rows = [(t, rng.choice(("en", "de")), s) for _, t, s in awkward(long=3000)]
    rows += [("Äpfel und ÄPFEL und Öl x-ray, it's 日本 日本", "fr", f"s{i}") for i in range(4)] * 2
    rows += [(None, "xx", "only"), ("", "yy", "a"), ("one two", "yy", "b"), ("1 2 3", "zz", None), ("word " * 9, None, None), ("word", "", "")]
    return rows + [(" ".join(rng.choice("abcdefgh") * 2 for _ in range(40)), "en", f"many{i % 40}") for i in range(120)]


@pytest.mark.parametrize("blocks", [(32, 4096), (3, 5)])
def test_audit_is_exact(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "GROUP_BLOCK", blocks[0])
    monkeypatch.setattr(divergence, "TERM_BLOCK", blocks[1])
    rows = documents()
    assert run(spark, rows) == expected(rows)


def test_terms_are_given_out_in_parts_and_cut_to_the_asked_ranks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES_HELD", 10)
    monkeypatch.setattr(divergence, "WINDOW_BYTES", 16)
    rows = documents()
    assert run(spark, rows, least_docs=1, most_terms=3) == expected(rows, 1, 3)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_shares_of_counts_near_the_range_of_longs(spark):
    from pyspark.sql import functions as F

    many = [(0, 10**15, 7), (10**15 - 1, 10**15, 10**9), (123456789012345, 9 * 10**14, 12345)]
    frame = spark.createDataFrame(many, "n long, total long, size long")
    got = [r[0] for r in frame.select(divergence.share(F.col("n"), F.col("total"), F.col("size"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // (total + size) for n, total, size in many]


def test_registered_query_names_every_pair(spark):
    found = QUERIES["op11_source_divergence"](spark, "/root/testdata/sf0.001").filter("part = 'pair'")
    assert found.groupBy("lang", "source").count().distinct().count() >= 1
