"""Small documents with every awkward case, and brute-force forms of what the operators compute."""

import random
import re

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, spans int, node string, component_id int,"
    " copy int, mix_key int, removed_spans string, `key` string, of_doc int, tie string, line_doc int"
)
EXTRA = ("x", 7, "n", 8, 9, 10, "r", "k", 11, "t", 12)


def words(rng, n):
    return " ".join(rng.choice(("alpha", "Beta", "gamma,", "delta.", "é", "ñu", "ßx", "zeta")) + str(rng.randrange(400)) for _ in range(n))


def awkward(seed=1, long=4000):
    """(doc_id, text, source): near and exact copies, nulls, blanks, ties, repeated rows, ids and very long texts."""
    rng = random.Random(seed)
    base = words(rng, 60)
    rows = [(i, words(rng, rng.randrange(1, 80)), f"s{i % 3}") for i in range(20)]
    rows += [(100 + i, " ".join([*base.split(" ")[: 60 - i], *words(rng, i).split(" ")]) if i else base, "hot") for i in range(8)]
    rows += [(200, base, "hot"), (201, base.upper(), None), (202, base.replace(" ", "\n"), "hot")]
    rows += [(300, None, "s1"), (301, "", "s1"), (302, " \n\t ", None), (303, "one", "s2"), (304, "one two three four", "s2")]
    rows += [(None, base, "s1"), (None, None, "s1"), (400, words(rng, long), "big"), (400, "another text of this id", "big")]
    rows += [(-5, "negative id <|endoftext|> 日本語 😀", "s0"), (20, rows[19][1], "s1"), (20, rows[19][1], "s1")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *EXTRA) for i, t, s in rows], SCHEMA)


def shingles(text, size=5):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def groups(sets, share=75):
    """Least index reachable for each of a list of sets."""
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= share * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return [top(i) for i in range(len(sets))]
