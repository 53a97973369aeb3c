import numpy as np
import pandas as pd
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casemill.functions.chunking import chunk_text
from casemill.operators import balls, knowledge

WORDS = st.text(alphabet=st.sampled_from("ab é.?!\n#-"), min_size=0, max_size=900)


def stripped(text):
    return "".join(text.split())


@given(WORDS, st.booleans())
@settings(max_examples=150, deadline=None)
def test_chunks_fit_and_keep_the_text(text, markdown):
    chunks = chunk_text(text, markdown, size=60, overlap=12)
    if len(text) <= 60:
        assert chunks == [text]
        return
    assert all(0 < len(c) <= 60 for c in chunks)
    # Dropping what a chunk repeats from the one before rebuilds the text up to blanks.
    whole, position = stripped(text), 0
    for chunk in chunks:
        body = stripped(chunk)
        starts = [p for p in range(max(0, position - 12), position + 1) if whole.startswith(body, p)]
        assert starts, (chunk, position)
        position = max(position, max(starts) + len(body))
    assert position == len(whole)


def test_chunk_separators_and_overlap():
    assert chunk_text("aaaa\n\nbbbb\n\ncccc", size=11, overlap=0) == ["aaaa\n\nbbbb", "cccc"]
    assert chunk_text("one two three four five", size=10, overlap=4) == ["one two", "two three", "four five"]
    assert chunk_text("x" * 25, size=10, overlap=3) == ["x" * 10, "x" * 10, "x" * 10, "x" * 4]
    # The heading opens its own piece; at 23 characters that piece is cut again at its line break.
    text = "intro text here\n# Head\nbody text of it"
    assert chunk_text(text, True, 20, 0) == ["intro text here", "# Head", "body text of it"]


def documents(spark):
    long = " ".join(f"word{i}" for i in range(300))
    return spark.createDataFrame(
        [("a.txt", "short", "policy", ["x"], "u1", False), ("b.md", long, "policy", None, "u2", True)],
        "filename string, text string, category string, tags array<string>, user_id string, is_private boolean",
    )


def test_chunk_rows_listing_and_deletion(spark):
    chunks = knowledge.chunk_documents(documents(spark)).cache()
    one = chunks.filter("filename = 'a.txt'").first()
    assert (one.parent_id, one.chunk_index, one.category, one.visibility) == (None, None, "policy", "shared")
    many = chunks.filter("filename = 'b.md'").orderBy("chunk_index").collect()
    assert [r.chunk_index for r in many] == list(range(len(many))) and many[0].total_chunks == len(many) > 1
    assert {r.category for r in many} == {"user:u2"} and {r.visibility for r in many} == {"private"}
    listed = knowledge.list_documents(chunks, 10).collect()
    assert sorted(r.content_preview.endswith("...") for r in listed) == [False, True]
    assert knowledge.statistics(chunks).first() == (2, len(many) + 1)
    assert knowledge.delete_document(chunks, many[0].parent_id).count() == 1
    again = knowledge.replace_documents(chunks, knowledge.chunk_documents(documents(spark).filter("filename = 'b.md'")))
    assert again.count() == chunks.count()


def vectors(spark, n, copies=0, seed=3):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, 8))
    if copies:
        data[n - copies :] = data[0]
    made = [
        (f"c{i:04d}", None if i % 3 else f"p{i % 7}", f"f{i % 5}", f"cat{i % 2}", [f"t{i % 3}"], f"u{i % 4}",
         "private" if i % 5 == 0 else "shared", f"text {i}", [float(x) for x in data[i]])
        for i in range(n)
    ]
    schema = "chunk_id string, parent_id string, filename string, category string, tags array<string>, user_id string, visibility string, text string, embedding array<float>"
    return spark.createDataFrame(made, schema).repartition(5), made


def brute(made, question, allowed, k):
    q = np.asarray(question, dtype=np.float32).astype(float)
    found = []
    for row in made:
        if allowed(row):
            v = np.asarray(row[8], dtype=np.float32).astype(float)
            found.append((round(1 - float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 9), row[0], row[1] or row[2]))
    return sorted(found)[:k]


@pytest.mark.parametrize(("cell", "lane", "chosen"), [(4096, 65536, (0, 5, 9, 33)), (7, 2, (0, 5, 9, 33)), (16, 5, range(0, 130))])
def test_nearest_matches_brute_force_with_copies(spark, monkeypatch, cell, lane, chosen):
    # A third of all chunks are copies of one vector, a ball of several cells; cells are copied for few or no visitors.
    for name, value in (("CELL_ROWS", cell), ("LANE_QUESTIONS", lane), ("LEAST_ROWS", 9), ("QUESTION_BATCH", 3 if cell < 10 else 512)):
        monkeypatch.setattr(balls, name, value)
    chunks, made = vectors(spark, 120, copies=40)
    asked = [(i, made[i % 120][8]) for i in chosen]
    questions = spark.createDataFrame(asked, "question_id bigint, embedding array<float>")
    found = knowledge.nearest_chunks(chunks, questions, 6).orderBy("question_id", "distance", "chunk_id").collect()
    for number, vector in asked:
        got = [(r.distance, r.chunk_id) for r in found if r.question_id == number]
        want = [(d, c) for d, c, _ in brute(made, vector, lambda row: True, 6)]
        assert [c for _, c in got] == [c for _, c in want]
        assert np.allclose([d for d, _ in got], [d for d, _ in want], atol=1e-8)


@pytest.mark.parametrize("zeros", [0, 20000])
def test_chunks_beyond_a_right_angle_from_every_centre_are_found(spark, zeros):
    """They are no zeros, whose ball only holds distances of one; nor are they lost when the sample has zeros alone."""
    data = [("n1", "a", [-1.0, 0.02]), ("n2", "b", [-1.0, -0.03])] + [(f"p{i:02d}", "c", [1.0, i / 100]) for i in range(30)]
    schema = "chunk_id string, parent_id string, embedding array<float>"
    chunks = spark.createDataFrame(data[: 2 if zeros else None], schema)
    many = spark.range(zeros).select(F.concat(F.lit("z"), "id").alias("chunk_id"), F.lit("z").alias("parent_id"), F.expr("array(0f, 0f)").alias("embedding"))
    chunks = chunks.unionByName(many).withColumn("filename", F.lit("f"))
    asked = spark.createDataFrame([(1, [-1.0, 0.0]), (2, [0.0, 0.0])], "question_id bigint, embedding array<float>")
    found = knowledge.nearest_chunks(chunks, asked, 2).orderBy("question_id", "distance").collect()
    assert {r.chunk_id for r in found if r.question_id == 1} == {"n1", "n2"} and [r.question_id for r in found] == [1, 1, 2, 2]


def test_no_more_than_k_hits_of_a_question_leave_a_lane(spark, monkeypatch):
    monkeypatch.setattr(balls, "CELL_ROWS", 5)
    chunks, made = vectors(spark, 120)
    questions = chunks.select(F.substring("chunk_id", 2, 9).cast("bigint").alias("question_id"), "embedding")
    seen, meet = [], balls.BallIndex._meeting
    monkeypatch.setattr(balls.BallIndex, "_meeting", lambda *a: seen.append(meet(*a)) or seen[-1])
    assert knowledge.nearest_chunks(chunks, questions, 30).count() == 120 * 30
    assert [df.count() <= 120 * 30 for df in seen] == [True, True]


def test_no_questions_give_no_sources(spark):
    chunks, made = vectors(spark, 20)
    schema = "question string, question_id bigint, embedding array<float>, user_id string"
    none = knowledge.parse_questions(spark.createDataFrame([], schema))
    assert knowledge.route_questions(chunks, {"sql": chunks}, none).count() == 0
    one = knowledge.parse_questions(spark.createDataFrame([("plain", 1, made[2][8], "u1"), ("no vector", 2, None, "u1")], schema))
    got = knowledge.route_questions(chunks, {"sql": chunks}, one)
    assert {r.question_id for r in got.collect()} == {1} and all(r.text.startswith("text ") for r in got.collect())
    assert knowledge.retrieve(chunks.limit(0), one.select("question_id", "embedding")).count() == 0


def test_threshold_uses_the_distance_itself(spark):
    angle = np.arccos(1 - 0.6000000004)
    chunks, _ = vectors(spark, 1)
    chunks = chunks.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    asked = spark.createDataFrame([(1, [float(np.cos(angle)), float(np.sin(angle))])], "question_id bigint, embedding array<double>")
    assert knowledge.retrieve(chunks, asked).count() == 0


def test_blank_and_repeated_documents(spark):
    data = [("a.txt", "word" + " " * 600, "c", None, None, None), ("b.txt", " " * 700, "c", None, None, None)]
    schema = "filename string, text string, category string, tags array<string>, user_id string, is_private boolean"
    chunks = knowledge.chunk_documents(spark.createDataFrame(data, schema))
    assert rows(chunks.select("filename", "char_count"), "filename") == [("a.txt", 604), ("b.txt", 700)]
    assert chunks.filter("created_at IS NULL").count() == 0
    twice = chunks.withColumn("n", F.lit(1)).unionByName(chunks.withColumns({"text": F.lit("new"), "n": F.lit(2)}))
    merged = knowledge.replace_documents(chunks.withColumn("n", F.lit(0)), twice, ["n"])
    assert rows(merged.select("filename", "text"), "filename") == [("a.txt", "new"), ("b.txt", "new")]


def test_markdown_headings_fences_and_rules():
    text = "# One\nalpha beta gamma\n## Two\ndelta epsilon zeta\n```\ncode block here\n```\n---\nlast words of all"
    assert chunk_text(text, True, 30, 0) == [
        "# One\nalpha beta gamma", "## Two\ndelta epsilon zeta", "```\ncode block here", "```\n---\nlast words of all",
    ]


def test_filtered_retrieval_cuts_before_threshold_and_dedup(spark):
    chunks, made = vectors(spark, 90)
    asked = [(1, made[2][8], "u1", "private", None, []), (2, made[4][8], "u2", "all", "cat0", ["t0", "t1"])]
    schema = "question_id bigint, embedding array<float>, user_id string, user_scope string, category string, tags array<string>"
    got = knowledge.retrieve(chunks, spark.createDataFrame(asked, schema), 3, 0.9)
    rules = {
        1: lambda r: r[5] == "u1",
        2: lambda r: (r[6] == "shared" or r[5] == "u2") and r[3] == "cat0" and r[4][0] in ("t0", "t1"),
    }
    for number, vector, *_ in asked:
        best = {}
        for d, c, key in brute(made, vector, rules[number], 9):
            if d <= 0.9:
                best.setdefault(key, (d, c))
        want = [c for _, c in sorted(best.values())[:3]]
        assert [r.chunk_id for r in got.filter(F.col("question_id") == number).orderBy("result_rank").collect()] == want


@pytest.mark.parametrize(
    ("question", "path", "collections", "scope", "category", "tags", "text"),
    [
        ("What are the rules?", "kb", ["kb"], "all", None, [], "What are the rules?"),
        ("snap_qc What tables", "snap_qc", ["ddl", "documentation", "sql"], "all", None, [], "What tables"),
        ("snap_qc:SQL  joins", "snap_qc", ["sql"], "all", None, [], "joins"),
        ("ALL anything", "all", ["kb", "ddl", "documentation", "sql"], "all", None, [], "anything"),
        ("@me #Research what did I note", "kb", ["kb"], "private", None, ["research"], "what did I note"),
        ("income category:Policy limits #a #b_1", "kb", ["kb"], "all", "policy", ["a", "b_1"], "income limits"),
        ("kbx stays", "kb", ["kb"], "all", None, [], "kbx stays"),
    ],
)
def test_question_directives(spark, question, path, collections, scope, category, tags, text):
    df = knowledge.parse_questions(spark.createDataFrame([(question,)], "question string"))
    r = df.first()
    assert (r.collection_path, r.collections, r.user_scope, r.category, r.tags, r.question_text) == (
        path, collections, scope, category, tags, text,
    )


def test_source_names_lists_three_and_counts_the_rest(spark):
    data = [(1, i, f"Policy - {f}") for i, f in enumerate(["a", "b #t", "a", "c", "d", "e"], 1)] + [(2, 1, "z")]
    out = knowledge.source_names(spark.createDataFrame(data, "question_id bigint, result_rank int, source_display string"))
    assert rows(out, "question_id") == [(1, 5, "a, b #t, c (+2 more)"), (2, 1, "z")]


def test_source_labels(spark):
    from casemill.functions.text import source_label

    data = [("business-rules_2x", "a.md", ["x", "y"]), ("user:me@x.org", "b.txt", [])]
    df = spark.createDataFrame(data, "c string, f string, t array<string>")
    got = [r[0] for r in df.select(source_label(F.col("c"), F.col("f"), F.col("t"))).collect()]
    assert got == ["📘 Business-Rules_2X - a.md #x #y", "🔒 Private - b.txt"]


def clustered(spark, clusters=12, each=40, width=16, spread=0.15, seed=5):
    """Chunks around a few directions, one all zeros, and a question near each direction."""
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(clusters, width))
    heads /= np.linalg.norm(heads, axis=1, keepdims=True)
    data = np.repeat(heads, each, axis=0) + spread / np.sqrt(width) * rng.normal(size=(clusters * each, width))
    data[17] = 0.0
    made = [(f"c{i:04d}", None, f"f{i}", [float(x) for x in v]) for i, v in enumerate(data)]
    chunks = spark.createDataFrame(made, "chunk_id string, parent_id string, filename string, embedding array<double>").repartition(4)
    asked = [(i, [float(x) for x in v]) for i, v in enumerate(heads + 0.02 * rng.normal(size=heads.shape))]
    asked += [(100, [0.0] * width), (101, [float(x) for x in -heads[0]])]
    return chunks, made, spark.createDataFrame(asked, "question_id bigint, embedding array<double>"), asked


def full_search(made, vector, k, within=np.inf):
    data = np.array([r[3] for r in made])
    lengths = np.linalg.norm(data, axis=1) * (np.linalg.norm(vector) or 1.0)
    distances = np.round(1 - data @ np.array(vector) / np.where(lengths == 0, 1.0, lengths), 12)
    return [(made[i][0], d) for i in np.lexsort((np.arange(len(made)), distances))[:k] if (d := distances[i]) <= within]


@pytest.mark.parametrize(("k", "within"), [(5, None), (60, None), (60, 0.2), (1000, None)])
def test_balls_give_what_a_full_search_gives(spark, monkeypatch, k, within):
    monkeypatch.setattr(balls, "CELL_ROWS", 40)
    chunks, made, questions, asked = clustered(spark)
    got = knowledge.nearest_chunks(chunks, questions, k, within).collect()
    for number, vector in asked:
        found = sorted([(r.distance, r.chunk_id) for r in got if r.question_id == number])
        want = full_search(made, vector, k, np.inf if within is None else within)
        assert len(found) == len(want) and np.allclose([d for d, _ in found], [d for _, d in want], atol=1e-9)
        inner = [c for c, d in want if abs(d - want[-1][1]) > 1e-9]
        assert set(inner) <= {c for _, c in found}


def test_few_balls_are_visited_and_chunks_move_as_often_whatever_is_asked(spark, monkeypatch):
    monkeypatch.setattr(balls, "CELL_ROWS", 40)
    chunks, _, questions, _ = clustered(spark)
    index = balls.BallIndex(chunks)
    visits = index.visits(questions.filter("question_id < 100"), 5).collect()
    assert len(visits) == 12 and visits[0].cells >= 8
    assert sum(v.visited_first + v.visited_later for v in visits) < 0.4 * sum(v.cells for v in visits)

    def moved(times):
        copies = questions.filter("question_id < 100").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times))))
        many = copies.withColumn("question_id", F.col("copy") * 1000 + F.col("question_id"))
        _, first, _ = index._rounds(many, 5, None)
        busy = first.select("cell").distinct()
        return index.chunks.join(busy, "cell").count()

    assert moved(0) == moved(40) <= 12 * 40


def test_an_index_of_nothing_and_of_one_chunk(spark):
    chunks, made, questions, _ = clustered(spark)
    assert balls.BallIndex(chunks.limit(0)).nearest(questions, 3).count() == 0
    assert balls.BallIndex(chunks.limit(0)).visits(questions, 3).count() == 0
    one = balls.BallIndex(chunks.filter("chunk_id = 'c0003'")).nearest(questions, 3)
    assert one.count() == 14 and {r.chunk_id for r in one.collect()} == {"c0003"}


def test_store_statistics_count_all_types(spark):
    from casemill.plans import knowledge as plans
    from casemill.plans.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    chunks = set()
    for row in plans.documents(spark, folder).select("text", "filename").collect():
        chunks.update(chunk_text(row.text or "", row.filename.endswith(".md"), 500, 50))
    others = {r.training_type: r.entries for r in QUERIES["store_pair_statistics"](spark, folder).collect()}
    got = {r.training_type: r.entries for r in QUERIES["store_statistics"](spark, folder).collect()}
    assert set(others) == {"sql", "ddl"} and len(chunks) > 100
    assert got == {**others, "documentation": len(chunks)}


def _meeting_tables(n_chunks, n_asked, seed):
    random = np.random.default_rng(seed)
    base = random.normal(size=(40, 16))
    # Near copies that single precision can't tell apart, equal ones, zeros and what is no number.
    vectors = base[random.integers(0, 40, n_chunks)] * (1 + random.integers(0, 3, (n_chunks, 16)) * 1e-9)
    vectors[:3], vectors[3] = 0.0, np.nan
    some = lambda values, n: [values[i] for i in random.integers(0, len(values), n)]
    chunks = pd.DataFrame({
        "id": [f"c{i}" for i in random.permutation(n_chunks)], "document_key": some(["a", "b", None], n_chunks), "embedding": list(vectors),
        "user_id": some(["u1", "u2", None], n_chunks), "category": some(["x", "y", "", None], n_chunks),
        "tags": some([["s", "t"], ["t"], [], None], n_chunks), "shared": some([True, False], n_chunks),
    })
    asked = pd.DataFrame({
        "id": [str(i) for i in range(n_asked)], "embedding": list(base[random.integers(0, 40, n_asked)] + random.choice([0.0, 0.3], (n_asked, 1))),
        "user_id": some(["u1", "u3", None], n_asked), "category": some(["x", "", None], n_asked), "tags": some([["s"], ["q", "t"], [], None], n_asked),
        "own_only": some([True, False, None], n_asked), "beat": some([0.2, None, 1.7], n_asked),
    })
    return chunks, asked


def test_pairs_are_allowed_as_whole_tables_are():
    chunks, asked = _meeting_tables(300, 60, 1)
    found = np.indices((60, 300)).reshape(2, -1)
    assert (balls.allowed_pairs(asked, chunks, *found).reshape(60, 300) == balls.allowed(asked, chunks)).all()


@pytest.mark.parametrize("filtered, k, within", [(False, 5, None), (True, 3, 0.6), (True, 40, None), (False, 700, 1.1)])
def test_single_precision_chooses_pairs_and_settles_none(filtered, k, within):
    chunks, asked = _meeting_tables(2500, 70, k)
    block = balls._Block(asked, k, within)
    for at in range(0, 2500, 1100):
        block.meet(balls._Passing(chunks.iloc[at : at + 1100]), filtered)
    got = block.found()
    points, theirs = balls.unit(asked["embedding"]), balls.unit(chunks["embedding"])
    near = np.round(1.0 - np.einsum("ik,jk->ij", points, theirs), balls.DISTANCE_DIGITS)
    open_ = balls.allowed(asked, chunks) if filtered else np.ones(near.shape, bool)
    for i, beat in enumerate(asked["beat"]):
        most = min(np.inf if beat is None or np.isnan(beat) else beat, np.inf if within is None else within)
        ids = chunks["id"].to_numpy(object)
        want = sorted((near[i, j], ids[j]) for j in np.flatnonzero(open_[i] & (near[i] <= most)))[:k]
        mine = got[got["question_id"] == i]
        assert sorted(zip(mine["distance"], mine["chunk_id"])) == want
    assert block.rough.dtype == np.float32
