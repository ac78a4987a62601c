"""Near-copy classes against all pairs: a large group around one original, members that link to each other only, odd rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from reelwright.llm import nearcopies


def plain_classes(texts):
    sets = [nearcopies.shingles((t or "").encode()) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if not len(sets[i]) or not len(sets[j]):
            alike = len(sets[i]) == len(sets[j])
        else:
            alike = nearcopies.linked(sets[i], sets[j])
        if alike:
            parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind < 0.7:
            del words[at]
        else:
            words.insert(at, f"more{rng.randrange(10**6)}")
    return words


@pytest.mark.parametrize("seed,edits", [(1, 8), (2, 14), (3, 4)])
def test_classes_of_a_hot_group_equal_all_pairs(spark, seed, edits):
    """Copies of one text, many below 0.8 to it and to each other; copies of copies; a passage shared by unlike texts."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    copies = [edited(rng, base, rng.randint(0, edits)) for _ in range(120)]
    copies += [edited(rng, rng.choice(copies), rng.randint(0, 3)) for _ in range(120)]
    passage = [f"p{i}" for i in range(80)]
    unlike = [passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(5, 40))] for _ in range(60)]
    texts = [" ".join(w) for w in copies + unlike] + ["", None, "a b", "a b", "A B"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_key", F.col("doc_id"))
    got = {r.doc_id: r.label for r in nearcopies.classes(docs).collect()}
    want = plain_classes(texts)
    groups = lambda label: sorted(sorted(i for i in range(len(texts)) if label[i] == x) for x in set(label.values()))
    assert groups(got) == groups(dict(enumerate(want)))
    assert len(set(want)) > 3


def test_any_column_names_stay(spark):
    rows = [(1, "a b c d e f", "x", 5, "p"), (2, "a b c d e f", "y", 6, "q"), (None, "z", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_key` string, `a.b` int, row string")
    kept = nearcopies.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[2]], key=repr)
