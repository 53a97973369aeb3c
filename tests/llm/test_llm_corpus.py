import itertools
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_data import awkward, frame, groups, shingles, words
from pyspark.sql import functions as F

from casemill.llm import chat, linededup, mixing, toxicity
from casemill.llm.queries import QUERIES
from casemill.llm.words import Powers

SF_DIR = "/root/testdata/sf0.001"


# Role repair


def cheapest(roles):
    """Least cost over all legal sequences of choices, found one turn at a time from every state."""
    best = {None: 0}
    for role in roles:
        after = {}
        for state, cost in best.items():
            for target in chat.ROLES:
                named = 0 if role == target else chat.RELABEL if role in chat.ROLES else chat.NAME_UNKNOWN
                options = [named + chat.MERGE] if state == target else []
                for k in range(4):
                    for inserted in itertools.product(("user", "assistant"), repeat=k):
                        at, legal = state, True
                        for step in (*inserted, target):
                            legal &= step in chat.FOLLOWS[at]
                            at = step
                        if legal:
                            options.append(named + chat.INSERT * k)
                if options:
                    after[target] = min(after.get(target, 10**9), cost + min(options))
        best = after
    ends = {None: 0, "system": 2, "user": 1, "assistant": 0}
    return min(cost + chat.INSERT * ends[state] for state, cost in best.items())


TURNS = "conv_id bigint, turn int, role string, text string, place int, kind string, mark string"


def test_repaired_conversations_are_legal_and_cheapest(spark):
    rng = random.Random(1)
    roles = {c: [rng.choice(("system", "user", "assistant", "User ", "bot", None)) for _ in range(rng.randrange(1, 9))] for c in range(40)}
    roles[77] = [rng.choice(("user", "assistant", "user", "system")) for _ in range(900)]
    rows = [(c, t, r, None if t % 4 == 3 else f"t{c}-{t} <|end|>", 1, "k", "m") for c, rs in roles.items() for t, r in enumerate(rs)]
    again = [r for r in rows if r[0] == 3] * 3
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat.repair(spark.createDataFrame(rows + again, TURNS).repartition(6)).orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows + again)
    # Each turn of conversation 3 comes four times, one behind the other.
    roles[3] = [r for r in roles[3] for _ in range(4)]
    shape = re.compile(r"(<\|system\|>\n((?!<\|).|\n)*<\|end\|>\n)?(<\|user\|>\n((?!<\|).|\n)*<\|end\|>\n<\|assistant\|>\n((?!<\|).|\n)*<\|end\|>\n)+")
    for c, rs in roles.items():
        mine = [r for r in got if r.conv_id == c]
        times = 4 if c == 3 else 1
        assert [r.turn for r in mine] == [k // times for k in range(len(rs))]
        cost = 0
        for r, said in zip(mine, map(chat.known_role, rs), strict=True):
            cost += chat.INSERT * (len(r.inserted_before) + len(r.inserted_after)) + (chat.MERGE if r.action == "merge" else 0)
            cost += 0 if r.out_role == said else chat.RELABEL if said else chat.NAME_UNKNOWN
        assert cost == cheapest([chat.known_role(r) for r in rs])
        text = "".join(r.rendered for r in mine)
        if len(rs) < 50:
            assert shape.fullmatch(text)
        assert text.count("< |end|>") == sum(1 for k in range(len(rs)) if k // times % 4 != 3)


def test_repair_of_awkward_turns(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (1, None, "assistant", ""), (1, None, "user", "late"), (2, 5, "SYSTEM", "only")]
    got = chat.repair(spark.createDataFrame([(*r, 1, "k", "m") for r in rows], TURNS)).orderBy("place").collect()
    assert len(got) == 5
    lone = next(r for r in got if r.conv_id == 2)
    assert (lone.out_role, lone.action) in {("system", "keep"), ("user", "relabel"), ("assistant", "relabel")}
    assert chat.repair(spark.createDataFrame([], TURNS)).count() == 0


# Mixing


def mixed(spark, rows, **settings):
    got = mixing.mix(frame(spark, rows).repartition(3), **settings)
    return got, [r.asDict() for r in got.collect()]


def test_mix_keeps_every_row_and_the_limit_of_repeats(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(1, 60)), "hot" if i % 3 else f"s{i % 7}") for i in range(400)] + awkward()
    got, found = mixed(spark, rows, most_repeat=2.0)
    assert got.columns[:16] == frame(spark, []).columns and len(set(got.columns)) == 20
    tokens = {}
    for i, text, source in rows:
        tokens[source] = tokens.get(source, 0) + len((text or "").split())
    copies, taken = {}, {}
    for r in found:
        copies[r["doc_id"], r["text"], r["source"]] = copies.get((r["doc_id"], r["text"], r["source"]), 0) + 1
        taken[r["source"]] = taken.get(r["source"], 0) + r["mix_tokens"]
    plain = {}
    for i, text, source in rows:
        plain[i, text, source] = plain.get((i, text, source), 0) + 1
    assert copies.keys() == plain.keys() and all(plain[k] <= n <= 2 * plain[k] for k, n in copies.items())
    most, least = max(tokens.values()), min(n for n in tokens.values() if n)
    exponent = 1 - math.log(2) / math.log(most / least)
    for source, n in tokens.items():
        longest = max((len((t or "").split()) for _, t, s in rows if s == source), default=0)
        want = n * (most / n) ** (1 - exponent) if n else 0
        assert want - longest - 1 <= taken.get(source, 0) <= want + 1


def test_mix_meets_an_entropy(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 3), ("a" * 80 + "b" * 15 + "c" * 5)[i % 100]) for i in range(3000)]
    for target in (0.3, 0.9, 1.05):
        _, found = mixed(spark, rows, most_repeat=None, entropy=target, budget=1.0)
        shares = np.array([sum(r["source"] == s for r in found) for s in "abc"]) / len(found)
        assert abs(-(shares * np.log(shares)).sum() - target) < 0.02
        assert abs(sum(r["mix_tokens"] for r in found) - 9000) < 30


def test_every_stretch_of_the_mix_has_the_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MIX_BLOCK_TOKENS", 2000)
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 16)
    rng = random.Random(5)
    rows = [(i, words(rng, 4), "a" if i % 4 else "b") for i in range(4000)]
    got, found = mixed(spark, rows, most_repeat=1.5)
    blocks = {}
    for r in found:
        blocks.setdefault(r[got.columns[17]], []).append(r["source"])
    total = sum(r["source"] == "b" for r in found) / len(found)
    assert len(blocks) > 5 and all(abs(b.count("b") / len(b) - total) < 0.06 for b in blocks.values())


def test_mix_of_tables_without_tokens(spark):
    assert mixed(spark, [])[1] == []
    rows = [(1, None, "a"), (2, "", "b"), (3, " ", None)]
    assert sorted(r["doc_id"] for r in mixed(spark, rows)[1]) == [1, 2, 3]


# Toxicity


def test_word_marks_equal_a_plain_reading():
    texts = ["Idiot! idiot_é IDIOTS", "", None, "a\tbb ccc dddd eeeee ffffff ggggggg", "x" * 3000 + " Ä"]
    marks, owner = toxicity.word_marks(pa.array(texts), Powers())
    flat = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\W\d_]+", (t or "").lower())]
    assert owner.tolist() == [i for i, _ in flat]
    seen = {}
    for (_, word), row in zip(flat, marks, strict=True):
        raw = word.encode()
        for size, value in zip((None, *toxicity.BEGINNINGS), row, strict=True):
            if size is None or len(raw) > size:
                assert seen.setdefault((size, raw[:size]), value) == value
            else:
                assert value == 0
    assert len(set(seen.values())) == len(seen)


def test_label_model_posterior_equals_enumeration():
    rng = np.random.default_rng(2)
    voters = 5
    rate = rng.uniform(0.1, 0.9, (2, voters))
    parent = np.array([-1, 0, 0, 2, -1])
    up = np.where(parent >= 0, parent, 0)
    low, high = np.maximum(0, rate + rate[:, up] - 1), np.minimum(rate, rate[:, up])
    model = toxicity.LabelModel(0.3, rate, parent, low + 0.5 * (high - low), np.array([0.1, 0.9]))
    votes = np.array(list(itertools.product((False, True), repeat=voters)))
    labels = np.array([-1, 0, 1] * 11)[: len(votes)]
    for vote, label, got in zip(votes, labels, model.posterior(votes, labels), strict=True):
        chance = []
        for y, prior in ((0, 0.7), (1, 0.3)):
            p = prior * {-1: 1.0, 1: model.label_rate[y], 0: 1 - model.label_rate[y]}[int(label)]
            for j in range(voters):
                r = rate[y, j]
                if parent[j] >= 0:
                    q, both = rate[y, parent[j]], model.joint[y, j]
                    r = np.clip(both / q if vote[parent[j]] else (rate[y, j] - both) / (1 - q), 1e-4, 1 - 1e-4)
                p *= r if vote[j] else 1 - r
            chance.append(p)
        assert abs(got - chance[1] / sum(chance)) < 1e-9


def rude_corpus(spark, rows=1200, seed=6):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(rows):
        toxic = i % 8 == 0
        text = words(rng, rng.randrange(20, 60)).split(" ")
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(len(text))] = rng.choice(("moron", "idiot.", "Zworkel" + rng.choice("abcdef"), "zworkelnde"))
        if i % 11 == 0:
            text = [t.upper() + "!!" for t in text]
        docs.append((i, " ".join(text), f"s{i % 3}"))
        if i % 2 == 0:
            labels.append((i, int(toxic), 1))
    docs += [(5000, None, "s"), (5001, "", "s"), (None, "moron moron idiot", "s"), (5002, words(rng, 20000), "s")]
    return frame(spark, docs), spark.createDataFrame(labels + [(None, 1, 1), (7, None, 1), (0, 1, 1)], "doc_id bigint, toxic int, quality int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = rude_corpus(spark)
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 1204 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1200]
    right = sum(r.predicted == int(r.doc_id % 8 == 0) for r in held)
    assert right >= 0.98 * len(held)
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    assert [r.predicted for r in sorted(got, key=lambda r: r.doc_id or 0) if (r.doc_id or 0) >= 5000] == [0, 0, 0]


def test_toxicity_without_labels_and_without_documents(spark):
    docs, labels = rude_corpus(spark, 200)
    got = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert len(got) == 204 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    assert toxicity.score_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_held_out_labels_do_not_matter(spark):
    docs, labels = rude_corpus(spark, 400)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    two = {r.doc_id: r.score for r in toxicity.score_documents(docs, flipped).collect()}
    assert all(abs(one[i] - two[i]) < 1e-6 for i in one)


# Pipeline


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline as pipeline

    rows = awkward()
    rng = random.Random(9)
    shared = "\n".join(words(rng, 60) for _ in range(3))
    rows += [(600 + i, words(rng, 30) + "\n" + shared, "s0") for i in range(3)] + [(700, "you are a moron and an idiot " + words(rng, 20), "s1")]
    docs = frame(spark, rows)
    columns = docs.columns

    left = pipeline.drop_toxic(spark, docs, SF_DIR)
    assert left.columns == columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in left.collect()} <= {700}

    cut = pipeline.drop_repeated_lines(spark, docs, SF_DIR)
    assert cut.columns == columns
    texts = {r.doc_id: r for r in cut.collect() if r.doc_id and 600 <= r.doc_id < 700}
    assert shared in texts[600].text and all(not set(shared.split("\n")) & set(texts[i].text.split("\n")) for i in (601, 602))
    assert all(len(r.text) == r.n_chars for r in texts.values())
    assert 301 in {r.doc_id for r in cut.collect()} and 300 in {r.doc_id for r in cut.collect()}

    kept = pipeline.drop_near_copies(spark, docs, SF_DIR)
    assert kept.columns == columns
    known = [(i, t) for i, t, _ in rows if i is not None]
    sets = [shingles(t) for _, t in known]
    least = {}
    for (i, _), g in zip(known, groups(sets), strict=True):
        least[g] = min(least.get(g, i), i)
    stay = {i for (i, _), s, g in zip(known, sets, groups(sets), strict=True) if not s or least[g] == i}
    found = kept.collect()
    assert {r.doc_id for r in found if r.doc_id is not None} == stay
    assert len({(r.doc_id, r.text) for r in found}) == len(found)

    mixed_docs = pipeline.mix_sources(spark, docs, SF_DIR)
    assert mixed_docs.columns == columns and {r.doc_id for r in mixed_docs.collect()} == {r[0] for r in rows}

    packed = pipeline.pack_sequences(spark, docs, SF_DIR)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert packed.select("doc_id").distinct().count() == len({r[0] for r in rows})


@pytest.mark.parametrize("stage", ["drop_repeated_lines", "drop_near_copies", "pack_sequences"])
def test_pipeline_holds_the_size_of_batches(spark, stage):
    import corpus_pipeline as pipeline

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = frame(spark, [(i, words(random.Random(i), 3000), "s") for i in range(900)]).coalesce(1)
    getattr(pipeline, stage)(spark, docs, "")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    met = [r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
    assert sum(met) > 12 << 20 and max(met) < 5 << 20


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
def test_pipeline_runs_over_an_empty_table(spark, tmp_path):
    import corpus_pipeline as pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
@pytest.mark.parametrize("name", ["op1_toxicity", "op3_role_repair", "op7_source_mix", "op9_line_dedup"])
def test_registered_queries_cover_their_tables(spark, name):
    got = QUERIES[name](spark, SF_DIR)
    whole = spark.read.parquet(f"{SF_DIR}/{'conversations' if name.startswith('op3') else 'documents'}.parquet")
    key = "conv_id" if name.startswith("op3") else "doc_id"
    assert {r[0] for r in got.select(key).distinct().collect()} == {r[0] for r in whole.select(key).distinct().collect()}
    assert got.count() >= whole.count()


def test_chunks_cover_text_in_order():
    rng = random.Random(1)
    text = "\n".join(words(rng, rng.randrange(0, 70)) for _ in range(80))
    found = linededup.chunks(text)
    assert all(a[1] < b[0] for a, b in itertools.pairwise(found)) and sum(b - a for a, b, _ in found) > 0.8 * len(text)
