import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import awkward, frame, groups, shingles, words

from casemill.llm import fingerprints, linededup, neardup
from casemill.llm import words as w
from casemill.llm.components import components

TEXT = st.text(alphabet=st.sampled_from("aAb \n\té日Z."), max_size=60)


@given(st.lists(TEXT, max_size=8))
@settings(max_examples=200, deadline=None)
def test_shingle_sets_have_the_right_sizes_and_identities(texts):
    sets, sizes = neardup.distinct_sets(pa.array(texts, pa.string()), w.Powers())
    want = [shingles(t) for t in texts]
    assert sizes.tolist() == [len(s) for s in want]
    ids = neardup.identities(sets, sizes)
    for i in range(len(texts)):
        for j in range(i):
            assert (ids[i] == ids[j]) == (want[i] == want[j])


def test_windows_do_not_cut_words(monkeypatch):
    monkeypatch.setattr(w, "WINDOW", 7)
    texts = pa.array(["a bcdefghijklmnop q", "", "rs tuvwxyz" * 9, None, " x "])
    small = w.shingles(texts, w.Powers())
    monkeypatch.setattr(w, "WINDOW", 1 << 20)
    big = w.shingles(texts, w.Powers())
    assert (small[0] == big[0]).all() and (small[1] == big[1]).all()


def expected(rows):
    known = [(i, t) for i, t, _ in rows if i is not None]
    sets = [shingles(t) for _, t in known]
    top = groups(sets)
    least = {}
    for (i, _), g in zip(known, top, strict=True):
        least[g] = min(least.get(g, i), i)
    return sorted((i, len(s), least[g] if s else i) for (i, _), s, g in zip(known, sets, top, strict=True))


def test_near_duplicates_equal_brute_force(spark):
    rows = awkward()
    got = neardup.near_duplicates(frame(spark, rows).repartition(4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == expected(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_family_without_a_common_center_loses_no_link(spark, monkeypatch):
    # A chain of edits: only neighbours are linked, and blocks of a few rows have to meet.
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    rng = random.Random(2)
    text, rows = words(rng, 90).split(" "), []
    for i in range(60):
        rows.append((i, " ".join(text), "s"))
        text = [*text]
        for _ in range(2):
            text[rng.randrange(90)] = f"edit{rng.randrange(10**6)}"
    rows += [(1000 + i, " ".join([*words(rng, 30).split(" "), *text[:60]]), "s") for i in range(40)]
    rng.shuffle(rows)
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected(rows)


def test_common_counts_equal_set_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 3000)).astype(np.uint64)) for _ in range(12)]
    rows, columns = np.arange(0, 8), np.arange(5, 12)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in columns] for i in rows]
    got = neardup.common_counts(sets, rows, columns).tolist()
    assert all(got[i][j] == want[i][j] for i in range(8) for j in range(7) if rows[i] != columns[j])


def test_components_of_a_path_a_star_and_a_pair(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(-7, 900), (5, 5)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b")
    found = {r.node: r.root for r in got.collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, -7: -7, 900: -7}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def removed(rows):
    """Texts after line dedup, documents in order of id and text hash unknown: keyed by (doc_id, text)."""
    seen, out = set(), {}
    for doc_id, text in sorted({(i, t) for i, t, _ in rows if i is not None and t is not None}):
        kept, at = [], 0
        for start, stop, _ in linededup.chunks(text):
            if text[start:stop] in seen:
                kept.append(text[at:start])
                at = stop + 1
            seen.add(text[start:stop])
        out[doc_id, text] = "".join(kept) + text[at:]
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    passage = "\n".join(words(rng, 9) for _ in range(12))
    lone = words(rng, 60)
    rows = []
    for i in range(25):
        parts = [words(rng, 8) for _ in range(rng.randrange(1, 6))] + [passage] * (i % 3) + [lone] * (i % 2)
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts) + "\n" * (i % 4), "s"))
    rows += [(50, None, "s"), (51, "", "s"), (52, "\n\n\n", "s"), (53, passage, "s"), (53, passage, "s"), (54, "\n".join([words(rng, 9)] * 2000), "s")]
    got = linededup.remove_repeats(frame(spark, rows).repartition(4))
    assert got.columns[:16] == frame(spark, []).columns and len(got.columns) == 17
    want = removed(rows)
    found = [(r.doc_id, r.n_chars, r.text) for r in got.collect()]
    assert len(found) == len(rows)
    by_input = {(i, len(t or "")): want.get((i, t), t) for i, t, _ in rows}
    assert sorted(found, key=repr) == sorted(((i, len(t or ""), by_input[i, len(t or "")]) for i, t, _ in rows), key=repr)
    assert all(len(r[2]) < len(passage) / 2 for r in found if r[0] == 53)
    assert linededup.remove_repeats(frame(spark, [])).count() == 0


def spared(rows, many=50):
    """Words that stay by brute force: those in no run of ``many`` words that has occurred before."""
    seen, out = set(), {}
    for doc_id, text in sorted({(i, t) for i, t, _ in rows if t}):
        spans = [m.span() for m in re.finditer("[^ \\t-\\r]+", text)]
        gone = set()
        for i in range(len(spans) - many + 1):
            window = text[spans[i][0] : spans[i + many - 1][1]]
            if window in seen:
                gone |= set(range(i, i + many))
            seen.add(window)
        out[doc_id] = [text[a:b] for i, (a, b) in enumerate(spans) if i not in gone]
    return out


def test_passages_within_lines_go_whole(spark):
    rng = random.Random(11)
    passage, longer = words(rng, 50), words(rng, 140)
    short = words(rng, 49)
    rows = [(i, f"{words(rng, 20 + i)} {passage} {words(rng, 30)}\n{words(rng, 5)}", "s") for i in range(6)]
    # The first text shares less with the last than the second does.
    cut = " ".join(longer.split(" ")[:70])
    rows += [(10, f"{words(rng, 60)} {cut} {words(rng, 60)}", "s"), (11, f"{words(rng, 8)} {longer}", "s"), (12, f"{words(rng, 9)} {longer}\nnext line", "s")]
    rows += [(20, f"{words(rng, 40)} {short} {words(rng, 3)}", "s"), (21, f"{words(rng, 50)} {short} {words(rng, 2)}", "s")]
    rows += [(30, rows[0][1], "s"), (31, None, "s"), (32, "", "s"), (33, passage, "s"), (33, passage, "s"), (34, " ".join(["again"] * 120), "s")]
    got = {r.doc_id: r.text for r in linededup.remove_repeats(frame(spark, rows).repartition(3), passages=True).collect()}
    want = spared(rows)
    assert {i: t.split() for i, t in got.items() if t} == {i: w for i, w in want.items() if w}
    assert got[33] == "" and got[30] == "" and got[31] is None and got[32] == "" and short in got[21] and got[12].endswith("\nnext line")
    assert all(passage not in got[i] and "\n" in got[i] for i in range(1, 6)) and passage in got[0]


def test_runs_of_few_short_lines_go_whole(spark):
    rng = random.Random(13)
    rows, runs = [], {}
    for many in range(2, 9):
        runs[many] = "\n".join(words(rng, -(-50 // many)) for _ in range(many))
        for i in range(3):
            around = ["\n".join(words(rng, rng.randrange(3, 20)) for _ in range(2 + i)) for _ in range(2)]
            rows.append((10 * many + i, f"{around[0]}\n{runs[many]}\n{around[1]}", "s"))
    got = {r.doc_id: r.text for r in linededup.remove_repeats(frame(spark, rows).repartition(3), passages=True).collect()}
    for doc_id, text, _ in rows:
        run = runs[doc_id // 10]
        assert got[doc_id] == (text if doc_id % 10 == 0 else text.replace(run + "\n", ""))


def test_passages_of_random_texts_equal_brute_force(spark):
    rng = random.Random(12)
    pool = [words(rng, rng.randrange(30, 160)) for _ in range(12)]
    rows = []
    for i in range(80):
        parts = [rng.choice(pool) if rng.random() < 0.5 else words(rng, rng.randrange(1, 70)) for _ in range(rng.randrange(1, 7))]
        text = "".join(p + rng.choice(" \n") for p in parts)
        cut = text.split(" ")
        rows.append((i, " ".join(cut[rng.randrange(0, 40) :] or cut), "s"))
    spans = {r.doc_id: r.passages for r in linededup.repeats(frame(spark, rows).repartition(5)).collect()}
    want = spared(rows)
    for i, text, _ in rows:
        left = "".join(" " if any(s.start <= k <= s.stop for s in spans.get(i) or ()) else c for k, c in enumerate(text))
        assert left.split() == want[i]


def test_seeds_do_not_depend_on_the_size_of_batches(monkeypatch):
    monkeypatch.setattr(linededup, "SLICE_BYTES", 5000)
    texts = [f"{words(random.Random(i), i % 90)} {'word ' * 54}" for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(200), "tie": range(200), "text": texts})
    whole = pa.Table.from_batches(linededup._seed([batch])).to_pylist()
    assert len(whole) == 200
    for many in (1, 7, 64):
        cut = [batch.slice(at, many) for at in range(0, 200, many)]
        assert pa.Table.from_batches(linededup._seed(iter([batch.slice(0, 0), *cut]))).to_pylist() == whole


def most_memory(run, batch):
    tracemalloc.start()
    found = sum(b.num_rows for b in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found, most


def test_batches_are_read_a_part_at_a_time():
    texts = [words(random.Random(i), 700) for i in range(3000)]
    size = sum(map(len, texts))
    batch = pa.RecordBatch.from_pydict({"doc_id": range(3000), "tie": range(3000), "text": texts})
    found, most = most_memory(linededup._chunk(64), batch)
    assert found == 3000 and most < size / 2
    ends = [{"low": 20 * i, "high": 20 * i + 600} for i in range(150)]
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
    lists = pa.array([None] * 2000, kinds[0]), pa.array([ends] * 2000, kinds[1])
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(range(2000)), *lists], names=["doc_id", "tie", "lines", "ends"])
    found, most = most_memory(linededup._merge, batch)
    assert found == 2000 and most < 100 * 2000 * 150 / 10


def test_chunk_boundaries_resist_shifts():
    rng = random.Random(6)
    shared = "\n".join(words(rng, 8) for _ in range(60))
    before = {shared[a:b] for a, b, _ in linededup.chunks(shared)}
    shifted = words(rng, 8) + "\n" + words(rng, 5) + "\n" + shared
    after = {shifted[a:b] for a, b, _ in linededup.chunks(shifted)}
    assert len(before & after) >= 0.8 * len(before)


def test_other_bytes_under_one_hash_stay(spark):
    rng = random.Random(7)
    lines = [words(rng, 60) for _ in range(4)]
    rows = [(i, f"{lines[i % 4]}\n{words(rng, 3)}", "s") for i in range(8)] + [(8, lines[0], "s")]
    # Without any bits all chunks collide: only those equal to the first one of all go.
    spans = {r.doc_id: r.lines for r in linededup.repeats(frame(spark, rows).repartition(3), bits=0).collect()}
    assert {i for i, found in spans.items() if found} == {4, 8}
    whole = {r.doc_id: r.lines for r in linededup.repeats(frame(spark, rows).repartition(3)).collect()}
    assert {i for i, found in whole.items() if found} == {4, 5, 6, 7, 8}
    assert all(rows[i][1][s.start : s.stop] == lines[i % 4] for i, found in whole.items() for s in found or ())


def test_fingerprints_equal_the_exact_edit_and_come_near(spark):
    rng = random.Random(8)
    rows = [(i, t, s) for i, t, s in awkward() if i not in (400, 20, None)] + [(500 + i, words(rng, 300), "s") for i in range(10)]
    got = {r.doc_id: r for r in fingerprints.compare_with_next(frame(spark, rows).repartition(5)).collect()}
    ordered = sorted((i, t or "") for i, t, _ in rows)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(ordered):
        after, cut = ordered[(k + 1) % len(ordered)][1], len(text) // 4
        edited, r = text[: len(text) - cut] + after[:cut], got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = shingles(text), shingles(other)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.17
    texts = {}
    for i, text in ordered:
        assert texts.setdefault(text, got[i].fingerprint) == got[i].fingerprint


def test_fingerprints_of_awkward_tables(spark):
    assert fingerprints.compare_with_next(frame(spark, [])).count() == 0
    alone = fingerprints.compare_with_next(frame(spark, [(3, "only one text here", "s")])).first()
    assert (alone.near_next, alone.n_chars) == (1.0, 18)
    rows = awkward()
    assert fingerprints.compare_with_next(frame(spark, rows)).count() == len(rows)
    plain = {(r.doc_id, bytes(r.fingerprint)) for r in fingerprints.fingerprint(frame(spark, [(1, None, "s"), (2, "a b", "s")])).collect()}
    assert (1, b"") in plain and len(plain) == 2


def test_hashes_of_runs_and_spans_tell_contents_apart(monkeypatch):
    monkeypatch.setattr(w, "WINDOW", 64)
    rng = np.random.default_rng(3)
    values = rng.integers(0, 9, 200).astype(np.uint64)
    for size in (1, 2, 5, 7, 16, 31):
        found = w.run_hashes(values, size)
        runs = [tuple(values[i : i + size]) for i in range(len(found))]
        assert len(found) == 201 - size and len({*zip(runs, found.tolist(), strict=True)}) == len(set(runs)) == len(set(found.tolist()))
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 2900, 2500))
    stops = starts + rng.integers(1, 99, 2500)
    found = w.span_hashes(data, starts, stops, w.Powers()).tolist()
    spans = [data[a:b].tobytes() for a, b in zip(starts, stops, strict=True)]
    assert len({*zip(spans, found, strict=True)}) == len(set(spans)) == len(set(found))
    # Capitals count.
    pair = np.frombuffer(b"aA", np.uint8)
    assert len(set(w.span_hashes(pair, np.array([0, 1]), np.array([1, 2]), w.Powers()).tolist())) == 2
