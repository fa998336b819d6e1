"""Work of operators that go in rounds."""

import random

from loomwork.operators import graphs


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    tables = []
    for name in ("written", "checkpointed"):
        monkeypatch.setattr(graphs, name, lambda df, *rest, make=getattr(graphs, name): tables.append(name) or make(df, *rest))
    ring = [(k, (k + 1) % 60) for k in range(60)] + [(59, 100), (100, 101)]
    got = graphs.strong_components(spark.createDataFrame(ring, "src long, dst long"))
    assert {tuple(r) for r in got.collect()} == {(k, 0) for k in range(60)}
    assert len(tables) < 60


def test_large_sides_of_a_round_are_not_broadcast(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(graphs.F, "broadcast", lambda df, make=graphs.F.broadcast: sent.append(df.count()) or make(df))
    pairs = spark.range(200_000).selectExpr("id AS src", "id ^ 1 AS dst")
    got = graphs.strong_components(pairs)
    assert got.count() == 200_000 and got.where("component <> node - node % 2").isEmpty()
    assert max(sent, default=0) < 80_000  # the driver holds each of them several times


def test_labels_that_wait_are_sent_in_the_end(spark, monkeypatch):
    for name, value in (("EARLY_NODES", 10), ("EARLY_SHARE", 8), ("EARLY_ROUNDS", 3)):
        monkeypatch.setattr(graphs, name, value, raising=False)
    draw = random.Random(5)
    edges = {(draw.randrange(60), draw.randrange(60)) for _ in range(90)} | {(100 + k, 100 + (k + 1) % 6) for k in range(6)}
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reached(start):
        found, todo = set(), [start]
        while todo:
            for b in after.get(todo.pop(), set()) - found:
                found.add(b)
                todo.append(b)
        return found

    reach = {a: reached(a) for a in after}
    same = {a: [b for b in reach[a] if a in reach.get(b, ())] for a in reach}
    expected = {(a, min(same[a])) for a in same if len(same[a]) > 1}
    assert len(expected) > 20
    assert {tuple(r) for r in graphs.strong_components(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()} == expected
