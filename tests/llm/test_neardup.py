import random

import numpy as np
import pytest

from loomwork.llm import neardup
from loomwork.llm.shingles import shingle_set, words

SCHEMA = "doc_id long, text string, node int, label int, band string"


def brute(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


def corpus(seed):
    """Families of texts whose members are alike to all degrees around the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    passage = rng.choices(vocabulary, k=60)
    for _ in range(10):
        base = rng.choices(vocabulary, k=rng.choice([7, 12, 40, 150]))
        for _ in range(12):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text))
    rows += [" ".join(passage + rng.choices(vocabulary, k=rng.choice([3, 10, 20, 60]))) for _ in range(40)]
    rows += ["", "one", "One", "one two three four", " \n", "A b c d e", "a B c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert found == brute(rows)


def test_blocks_smaller_than_bands(spark, monkeypatch):
    """Pairs that stars leave open are all compared, however the blocks are cut."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "STARS", 0)
    rows = corpus(3)
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert found == brute(rows)


def test_one_large_group_makes_few_rows(spark, monkeypatch):
    """A group of near copies gives a star row for each node and round and a spanning forest, never its pairs."""
    rng = random.Random(8)
    base = rng.choices([f"w{k}" for k in range(400)], k=80)
    texts = []
    for k in range(2500):
        text = list(base)
        for _ in range(rng.choice([1, 1, 1, 2, 4])):
            text[rng.randrange(len(text))] = f"c{k}"
        texts.append(" ".join(text))
    made = []
    confirmed, rest = neardup._confirmed, neardup._rest
    monkeypatch.setattr(neardup, "_confirmed", lambda stars, *a: (made.append(stars.count()), confirmed(stars, *a))[1])
    monkeypatch.setattr(neardup, "_rest", lambda *a: (lambda found: (made.append(found.count()), found)[1])(rest(*a)))
    rows = list(enumerate([" ".join(base), *texts]))
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    sets = [set(shingle_set(t).tolist()) for _, t in rows]
    alike = [i for i, _ in rows if 100 * len(sets[0] & sets[i]) >= 75 * len(sets[0] | sets[i])]
    assert len(alike) > 1500 and all(found[i] == 0 for i in alike)
    assert max(made) <= len(rows)


def test_one_doc_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a + " end"), (1, b + " end"), (2, a), (3, b), (4, a)]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect())
    assert found == [(1, 57, 1), (1, 57, 1), (2, 56, 1), (3, 56, 1), (4, 56, 1)]


def test_estimate_is_corrected():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for share in (0.0, 0.5, 0.75, 0.9):
        k = int(2 * 1000 * share / (1 + share))
        a, b = pool[:1000], np.r_[pool[:k], pool[1000 : 2000 - k]]
        same = (neardup.registers(a) == neardup.registers(b)).mean()
        assert abs(float(neardup.estimate(np.array(same), np.array(1000), np.array(1000))) - share) < 0.16
    assert 0 < float(neardup.chance(np.array(1000), np.array(1000))) < 0.001


def test_nulls_repeats_long_and_empty(spark):
    long = " ".join(f"t{k % 977}x{k}" for k in range(30_000))
    rows = [(1, None), (2, None), (3, long), (4, long + " end"), (3, long), (None, "x"), (5, "")]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    n = len(shingle_set(long))
    assert found == [(1, 0, 1, True), (2, 0, 2, True), (3, n, 3, True), (3, n, 3, True), (4, n + 1, 3, False), (5, 0, 5, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["label"] for r in neardup.components(links).collect()}
    assert found == {**{k: 0 for k in range(51)}, 100: 100, 101: 100}
