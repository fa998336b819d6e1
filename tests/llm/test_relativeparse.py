import hashlib
import random
import re

import numpy as np

from loomwork.llm import relativeparse

SCHEMA = "doc_id long, text string, name string, tag long, first long, anchors string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1, 2, "a") for i, t in rows], SCHEMA)


def brute(rows, window=13):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            if i is not None:
                first[run] = min(first.get(run, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(7)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "w%d" % rng.randrange(4000)
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (12, 13, 14, 20, 55, 300)]
    rows = []
    for k in range(120):
        parts = [prose(rng.randrange(0, 60))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages).split()
            a = rng.randrange(0, max(1, len(p) - 12))
            parts += [" ".join(p[a : a + rng.randrange(10, 80)]), prose(rng.randrange(0, 9))]
        rows.append((k * 3 - 50, "\n".join(parts)))
    rows += [(1000 + k, rows[5][1]) for k in range(8)] + [(2000, rows[5][1] + " and more"), (7, rows[5][1].replace(" ", "\t\x0b"))]
    half = passages[5].split()
    rows += [(3000, " ".join(half[:150])), (3001, " ".join(half[140:]) + " x"), (3002, " ".join(half)), (3003, "the " * 400), (3004, "the " * 90), (3005, ("the " * 13).strip())]
    rows += [(4000, None), (4001, ""), (4002, " \n "), (4003, "twelve " * 12), (None, passages[4]), (None, None), (5000, prose(40_000)), (5001, "é🎈 " * 30), (5002, "é🎈 " * 14)]
    rows += [rows[5], rows[9], (rows[9][0], passages[5]), (rows[9][0], passages[5]), (6000, "x" * 200_000 + " " + passages[4])]
    rng.shuffle(rows)
    return rows


def test_removed_words_against_brute_force(spark):
    rows = corpus()
    found = relativeparse.without_repeats(table(spark, rows))
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept", "factors"]
    assert sorted(map(tuple, relativeparse.digest(found).collect()), key=repr) == brute(rows)


def test_other_windows_and_joins_without_broadcast(spark):
    rows = [r for r in corpus() if len(r[1] or "") < 5000]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = relativeparse.without_repeats(table(spark, rows), window=8, shingle=3)
        assert sorted(map(tuple, relativeparse.digest(found).collect()), key=repr) == brute(rows, 8)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_factors_stand_in_the_reference(spark):
    rows = [r for r in corpus() if r[0] is not None]
    by = {}
    for i, t in rows:
        by.setdefault(i, []).append((t or "").split())
    n = 0
    for r in relativeparse.without_repeats(table(spark, rows)).collect():
        for f in r["factors"]:
            assert f["length"] >= 13 and f["reference"] < r["doc_id"]
            mine = [w[f["start"] : f["start"] + f["length"]] for w in by[r["doc_id"]]]
            assert any(m in [w[f["place"] : f["place"] + f["length"]] for w in by[f["reference"]]] for m in mine)
            n += 1
    assert n > 50


def test_a_factor_goes_on_past_the_place_where_the_first_reference_ends():
    pos, first, ref = np.arange(10), np.array([1] * 6 + [2] * 4), np.array([4, 5, 6, 7, 8, 9, 0, 1, 2, 3])
    assert relativeparse.factors(pos, first, ref) == [(0, 18, 1, 4), (6, 16, 2, 0)]
    assert relativeparse.factors(pos[:0], first[:0], ref[:0]) == []


def test_empty_table(spark):
    assert relativeparse.without_repeats(table(spark, [(1, "a")]).limit(0)).count() == 0
