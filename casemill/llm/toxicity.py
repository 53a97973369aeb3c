"""Toxicity by weak supervision.

Voters are single words of a lexicon, words and word beginnings that stand out in labelled rows, and
patterns. Each votes or keeps silent. A generative label model over all documents' votes has a hidden class,
the accuracy of each voter, and a tree of correlated voters within a class; expectation
maximisation estimates all of them, with human labels as one more voter. The posterior labels of a bounded sample
train a linear classifier on word features, which alone scores texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm import words
from casemill.llm.common import settled, slices

# Plain insults.
LEXICON = (
    "ass", "bastard", "bitch", "clown", "coward", "crap", "creep", "cretin", "damn", "disgusting", "dumb", "fool",
    "freak", "garbage", "idiot", "imbecile", "jerk", "liar", "loser", "moron", "pathetic", "pig", "scum", "shit",
    "stupid", "trash", "ugly", "vermin", "worthless",
)
PATTERNS = ("shouts", "exclaims", "two lexicon words")
SAMPLE_ROWS = 16384  # labelled rows at most that voters are mined from and the classifier is trained on
FEATURES, VOTERS, LEAST_ROWS, LEAST_Z, LEAST_BOUND = 512, 48, 3, 1.645, 1.0
BEGINNINGS = (4, 5, 6)  # bytes of a word
ROUNDS = 8
SLICE_BYTES = 1 << 20
THRESHOLD = 0.3


def _blank_table():
    """Bytes that are not letters; a byte of a longer code counts as a letter."""
    blank = np.ones(256, bool)
    blank[65:91] = blank[97:123] = False
    blank[128:] = False
    return blank


_NOT_LETTER = _blank_table()


def word_marks(texts: pa.Array, powers: words.Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes [words, 1 + BEGINNINGS] of lower-cased words and of their beginnings, and each word's text."""
    data, bounds = words.raw_bytes(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    opens = np.zeros(len(data) + 1, bool)
    opens[bounds] = True
    inside = ~_NOT_LETTER[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | opens[1 : len(data)]
    last[:-1] &= ~inside[1:] | opens[1 : len(data)]
    first, last = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    up, down = powers.to(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words._VALUE[data] * up[: len(data)], dtype=np.uint64)])
    out = np.empty((len(first), 1 + len(BEGINNINGS)), np.uint64)
    out[:, 0] = words.mix((sums[last] - sums[first]) * down[first])
    for k, size in enumerate(BEGINNINGS):
        stop = first + size
        cut = words.mix((sums[np.minimum(stop, last)] - sums[first]) * down[first] + np.uint64(k + 1))
        out[:, k + 1] = np.where(stop < last, cut, np.uint64(0))  # a beginning is shorter than the word
    return out, np.searchsorted(bounds, first, side="right") - 1


def lexicon_hashes() -> np.ndarray:
    return word_marks(pa.array(LEXICON), words.Powers())[0][:, 0]


def patterns_of(texts: pa.Array, lexicon_hits: np.ndarray) -> np.ndarray:
    """[texts, PATTERNS] of booleans."""
    data, bounds = words.raw_bytes(texts)

    def count(flags):
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    upper, letters = count((data >= 65) & (data < 91)), count(~_NOT_LETTER[data])
    return np.stack([(letters >= 20) & (2 * upper > letters), count(data == 33) >= 5, lexicon_hits >= 2], axis=1)


def features_of(texts: pa.Array, hashes: np.ndarray, powers: words.Powers) -> np.ndarray:
    """[texts, hashes + PATTERNS] of booleans: which features occur in each whole text."""
    rank = np.argsort(hashes)
    ordered = hashes[rank]
    maybe = np.zeros(1 << 16, bool)
    maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
    lexicon, rows = lexicon_hashes(), []
    for a, b in slices(texts, SLICE_BYTES):
        part = texts.slice(a, b - a)
        marks, owner = word_marks(part, powers)
        found = np.zeros((len(part), len(hashes)), bool)
        for column in range(marks.shape[1]):
            at = np.nonzero(maybe[(marks[:, column] & np.uint64(0xFFFF)).astype(np.int64)])[0]
            value = marks[at, column]
            where = np.minimum(np.searchsorted(ordered, value), len(ordered) - 1)
            hit = ordered[where] == value
            found[owner[at[hit]], rank[where[hit]]] = True
        rude = found[:, np.isin(hashes, lexicon)].sum(axis=1)
        rows.append(np.hstack([found, patterns_of(part, rude)]))
    return np.concatenate(rows) if rows else np.zeros((0, len(hashes) + len(PATTERNS)), bool)


def _mine(batches):
    """Per feature: rows of either label that have it; repeats within a text count once."""
    powers, met = words.Powers(), []
    for batch in batches:
        texts, toxic = batch.column("text"), np.asarray(batch.column("toxic")).astype(bool)
        for a, b in slices(texts, SLICE_BYTES):
            marks, owner = word_marks(texts.slice(a, b - a), powers)
            owners = np.repeat(owner, marks.shape[1])
            order = np.lexsort((marks.ravel(), owners))
            value, own = marks.ravel()[order], owners[order]
            once = np.ones(len(value), bool)
            once[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
            once &= value != 0
            value, rude = value[once], toxic[a:b][own[once]]
            kinds, at = np.unique(value, return_inverse=True)
            met.append((kinds, np.bincount(at, rude, len(kinds)), np.bincount(at, ~rude, len(kinds))))
    if met:
        kinds, at = np.unique(np.concatenate([m[0] for m in met]), return_inverse=True)
        toxic, clean = (np.bincount(at, np.concatenate([m[i] for m in met]), len(kinds)) for i in (1, 2))
        columns = kinds.view(np.int64), toxic.astype(np.int64), clean.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "toxic", "clean"])


def mined(sample: DataFrame) -> np.ndarray:
    """Hashes of the features with the largest lower bounds of the log odds ratio, ``FEATURES`` at most."""
    rows, rude = sample.agg(F.count("*"), F.sum("toxic")).first()
    rude = rude or 0
    if not rude or rude == rows:
        return np.empty(0, np.uint64)
    counts = sample.select("text", "toxic").mapInArrow(_mine, "hash long, toxic long, clean long")
    counts = counts.groupBy("hash").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).filter(F.col("t") >= LEAST_ROWS)
    a, b = F.col("t") + 0.5, F.lit(rude + 0.5) - F.col("t")
    c, d = F.col("c") + 0.5, F.lit(rows - rude + 0.5) - F.col("c")
    bound = F.log(a * d / (b * c)) - LEAST_Z * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    best = counts.withColumn("bound", bound).filter(F.col("bound") >= LEAST_BOUND).orderBy(F.desc("bound"), "hash").limit(FEATURES).collect()
    return np.array([r["hash"] for r in best], np.int64).view(np.uint64)


@dataclass
class LabelModel:
    """Class prior, voters' rates by class, a parent voter of each (or -1) with the pair's joint rates, the label's rates."""

    prior: float
    rate: np.ndarray  # [2, voters]
    parent: np.ndarray
    joint: np.ndarray  # [2, voters]: both the voter and its parent vote
    label_rate: np.ndarray  # [2]: a human label is 1

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Probability of class 1; labels are 1, 0 or -1 for none."""
        out = np.empty((2, len(votes)))
        has = self.parent >= 0
        up = votes[:, np.where(has, self.parent, 0)]
        for y in (0, 1):
            rate, over = self.rate[y], self.rate[y][np.where(has, self.parent, 0)]
            given_on = np.clip(self.joint[y] / over, 1e-4, 1 - 1e-4)
            given_off = np.clip((rate - self.joint[y]) / (1 - over), 1e-4, 1 - 1e-4)
            chance = np.where(has, np.where(up, given_on, given_off), rate)
            total = np.log(np.where(votes, chance, 1 - chance)).sum(axis=1)
            seen = self.label_rate[y]
            total += np.where(labels == 1, np.log(seen), np.where(labels == 0, np.log(1 - seen), 0.0))
            out[y] = total + np.log(self.prior if y else 1 - self.prior)
        return 1 / (1 + np.exp(np.clip(out[0] - out[1], -500, 500)))


def unpacked(masks: np.ndarray, voters: int) -> np.ndarray:
    return (masks[:, None] >> np.arange(voters)) & 1 == 1


def first_guess(votes: np.ndarray, labels: np.ndarray, labelled: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the estimation starts: probabilities of class 1 and weights of the rows.

    With human labels the labelled rows start alone; else whoever gets a vote is held for toxic.
    """
    if labelled:
        return np.where(labels == 1, 0.97, 0.03), (labels >= 0).astype(np.float64)
    return np.where(votes.any(axis=1), 0.8, 0.02), np.ones(len(votes))


def _gather(model: LabelModel | None, voters: int, rows: int, labelled: int):
    """Expected counts by class: of rows, of votes, of pairs of votes, of labels.

    Rows without a label weigh no more together than those with one, or they would drift to another class.
    """

    def run(batches):
        total = np.zeros((2, voters + 1, voters + 1))
        judged = np.zeros((2, 2))
        for batch in batches:
            votes, labels = unpacked(np.asarray(batch.column("mask")), voters), np.asarray(batch.column("label"))
            count = np.asarray(batch.column("many")).astype(np.float64)
            if model is None:
                share, weight = first_guess(votes, labels, labelled > 0)
                count = count * weight
            else:
                share = model.posterior(votes, labels)
                count = count * np.where(labels >= 0, 1.0, min(1.0, labelled / max(1, rows - labelled)) if labelled else 1.0)
            wide = np.hstack([votes, np.ones((len(votes), 1), bool)]).astype(np.float64)
            for y, weight in ((0, (1 - share) * count), (1, share * count)):
                total[y] += wide.T @ (wide * weight[:, None])
                judged[y] += [weight[labels == 0].sum(), weight[labels == 1].sum()]
        flat = np.concatenate([total.ravel(), judged.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["at", "value"])

    return run


def _expected(patterns: DataFrame, model: LabelModel | None, voters: int, rows: int, labelled: int):
    sums = patterns.mapInArrow(_gather(model, voters, rows, labelled), "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    flat = np.zeros(2 * (voters + 1) ** 2 + 4)
    for row in sums.collect():  # two numbers for each pair of voters
        flat[row["at"]] = row["value"]
    return flat[:-4].reshape(2, voters + 1, voters + 1), flat[-4:].reshape(2, 2)


def correlated(total: np.ndarray, least: float = 0.002) -> np.ndarray:
    """Parent of each voter in the tree of largest mutual information within the classes; -1 where it is below ``least``."""
    voters = total.shape[1] - 1
    gain = np.zeros((voters, voters))
    for y in (0, 1):
        n = total[y, -1, -1] + 1.0
        on = (np.diag(total[y])[:-1] + 0.1) / n
        both = (total[y][:-1, :-1] + 0.01) / n
        for p, a, b in ((both, on[:, None], on[None]), (on[:, None] - both, on[:, None], 1 - on[None]),
                        (on[None] - both, 1 - on[:, None], on[None]), (1 - on[:, None] - on[None] + both, 1 - on[:, None], 1 - on[None])):
            p = np.maximum(p, 1e-12)
            gain += n / (total[:, -1, -1].sum() + 2) * p * np.log(p / (a * b))
    np.fill_diagonal(gain, 0)
    parent, reached = np.full(voters, -1), np.zeros(voters, bool)
    for _ in range(voters):
        best, at = -1.0, int(np.argmin(reached))
        if reached.any():
            open_gain = np.where(reached[:, None] & ~reached[None], gain, -1.0)
            up, down = np.unravel_index(open_gain.argmax(), gain.shape)
            best = open_gain[up, down]
        if best >= least:
            parent[down], at = up, down
        reached[at] = True
    return parent


def fit_label_model(patterns: DataFrame, voters: int) -> LabelModel:
    """Estimate the label model from all documents' vote patterns (mask, label, many)."""
    model, parent = None, None
    rows, labelled = patterns.agg(F.sum("many"), F.sum(F.when(F.col("label") >= 0, F.col("many")).otherwise(0))).first()
    for _ in range(ROUNDS):
        total, judged = _expected(patterns, model, voters, rows, labelled)
        if parent is None:
            parent = correlated(total)
        n = total[:, -1, -1] + 1.0
        rate = np.clip((np.stack([np.diag(t)[:-1] for t in total]) + np.array([[0.01], [0.1]])) / n[:, None], 1e-6, 1 - 1e-4)
        up = np.where(parent >= 0, parent, 0)
        joint = np.stack([t[np.arange(voters), up] for t in total]) / n[:, None]
        label_rate = np.clip((judged[:, 1] + [0.05, 0.95]) / (judged.sum(axis=1) + 1.0), [0.01, 0.8], [0.2, 0.99])
        model = LabelModel(float(np.clip(n[1] / n.sum(), 1e-4, 0.5)), rate, parent, joint, label_rate)
    return model


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float = 0.05, rounds: int = 25) -> np.ndarray:
    """Weights and intercept of a logistic regression on soft targets, by Newton steps."""
    wide = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    weights = np.zeros(wide.shape[1])
    ridge = np.full(wide.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(wide @ weights, -30, 30)))
        slope = wide.T @ (p - target) + ridge * weights
        curve = (wide * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ wide + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        weights -= step * min(1.0, 8.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return weights


@dataclass
class ToxicityModel:
    hashes: np.ndarray
    weights: np.ndarray

    def score(self, text: Column) -> Column:
        """Probability that a text is toxic, 0 to 1; a null text scores as an empty one."""
        hashes, weights = self.hashes, self.weights

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            found = features_of(texts, hashes, words.Powers())
            return pa.array(1 / (1 + np.exp(-np.clip(found @ weights[:-1] + weights[-1], -30, 30))))

        return scored(F.coalesce(text.cast("string"), F.lit("")))


def choose_voters(x: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Columns that vote: patterns and lexicon words that occur, then mined features unlike those already chosen."""
    sure = np.concatenate([np.isin(hashes, lexicon_hashes()), np.ones(len(PATTERNS), bool)])
    chosen = [i for i in range(x.shape[1]) if sure[i] and x[:, i].any()][:VOTERS]
    for i in sorted(np.nonzero(~sure)[0], key=lambda i: (-x[:, i].sum(), i)):
        if len(chosen) == VOTERS:
            break
        both, either = (x[:, chosen] & x[:, [i]]).sum(axis=0), (x[:, chosen] | x[:, [i]]).sum(axis=0)
        if x[:, i].any() and not (both > 0.8 * either).any():
            chosen.append(i)
    return np.array(chosen, np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _vote(hashes: np.ndarray, columns: np.ndarray):
    def run(batches):
        powers = words.Powers()
        for batch in batches:
            found = features_of(batch.column("text"), hashes, powers)[:, columns]
            masks = (found.astype(np.int64) << np.arange(len(columns))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(masks, pa.int64())], names=["doc_id", "mask"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Mine voters, estimate the label model and train the classifier.

    ``labels`` has doc_id and toxic (1, 0; others do not count); rows of ``held_out`` doc_ids are not used.
    At most ``SAMPLE_ROWS`` labelled rows serve for mining and training; votes are counted over all
    documents. Rows without doc_id vote but have no label; of labels that repeat a doc_id, or of equal texts
    in the sample, the largest counts.
    Without labels, the lexicon and the patterns vote alone and documents chosen by hash are the sample.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("of_doc"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("of_doc is not null and toxic in (0, 1)").filter(~held_out(F.col("of_doc")))
    known = known.groupBy("of_doc").agg(F.max("toxic").alias("toxic"))
    picked = settled(known.orderBy(F.xxhash64("of_doc"), "of_doc").limit(SAMPLE_ROWS), "labels")
    # SAMPLE_ROWS rows of two numbers at most.
    sample = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("of_doc")).select("text", "toxic")
    sample = settled(sample.groupBy("text").agg(F.max("toxic").alias("toxic")), "sample")
    hashes = np.unique(np.concatenate([lexicon_hashes(), mined(sample)]))
    if not sample.head(1):
        drawn = texts.select(F.col("doc_id").alias("of_doc")).dropDuplicates().orderBy(F.xxhash64("of_doc"), "of_doc").limit(SAMPLE_ROWS)
        drawn = settled(drawn, "drawn")
        sample = settled(texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("of_doc")).select("text", F.lit(-1).alias("toxic")).dropDuplicates(["text"]), "sample")

    def bits(batches):
        powers = words.Powers()
        for batch in batches:
            rows = np.packbits(features_of(batch.column("text"), hashes, powers), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), batch.column("toxic")], names=["bits", "toxic"])

    # SAMPLE_ROWS rows of about FEATURES bits at most.
    drawn = sample.mapInArrow(bits, "bits binary, toxic int").collect()
    width = len(hashes) + len(PATTERNS)
    x = np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8))[:width] for r in drawn]).reshape(len(drawn), width).astype(bool)
    labels_of = np.array([r["toxic"] for r in drawn], np.int64)
    columns = choose_voters(x, hashes)
    if not len(columns):
        weights = np.zeros(width + 1)
        weights[np.nonzero(np.isin(hashes, lexicon_hashes()))[0]], weights[-1] = 4.0, -4.0
        return ToxicityModel(hashes, weights)
    votes = texts.mapInArrow(_vote(hashes, columns), "doc_id long, mask long")
    voted = votes.join(known, F.col("doc_id") == F.col("of_doc"), "left")
    patterns = voted.groupBy("mask", F.coalesce("toxic", F.lit(-1)).alias("label")).agg(F.count("*").alias("many"))
    model = fit_label_model(settled(patterns, "patterns"), len(columns))
    target = model.posterior(x[:, columns], labels_of)
    return ToxicityModel(hashes, fit_linear(x, target))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; see ``fit`` for what the scores rest on.

    Empty and null texts are scored like any other. A row without doc_id is not held out. An empty table
    gives no rows.
    """
    model = fit(docs, labels)
    scored = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
