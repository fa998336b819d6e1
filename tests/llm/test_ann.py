from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, leaf int, id string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v], 0, 1, "x") for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def truth(ids, vectors, q, k):
    score = (vectors * vectors[list(ids).index(q)]).sum(axis=1)
    score[list(ids).index(q)] = -np.inf
    return [ids[j] for j in np.lexsort((ids, -score))[:k]]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(9)
    vectors = np.float32(rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 2 + rng.normal(size=(3000, 16))).astype(float)
    found = ann.neighbours(table(spark, vectors), F.col("vec_id") % 20 == 0).toPandas()
    assert len(found) == 150 * 20
    hits = 0
    for q, rows in found.groupby("query_id"):
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, 21))
        assert (rows["score"].to_numpy() == (vectors[rows["vec_id"]] * vectors[q]).sum(axis=1)).all()
        hits += len(set(rows["vec_id"]) & set(truth(np.arange(3000), vectors, q, 20)))
    assert hits / len(found) >= 0.9


def test_ties_and_few_and_unusable(spark):
    rows = [[1, 0]] * 60 + [None, [0, 0], [float("nan"), 1], [float("inf"), 1], [1, None], [1, 2, 3]]
    found = ann.neighbours(table(spark, rows), F.col("vec_id") % 20 == 0).toPandas().sort_values(["query_id", "rank"])
    assert set(found["query_id"]) == {0, 20, 40}
    assert found[found["query_id"] == 20]["vec_id"].tolist() == list(range(20))
    few = ann.neighbours(table(spark, [[1, 0], [0, 1], [1, 1]]), F.col("vec_id") == 0).toPandas().sort_values("rank")
    assert few["vec_id"].tolist() == [2, 1]
    assert ann.neighbours(table(spark, []), F.col("vec_id") == 0).count() == 0
    assert ann.neighbours(table(spark, [[0, 0]]), F.col("vec_id") == 0).count() == 0


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(10)
    vectors = np.float32(rng.normal(size=(500, 8))).astype(float)
    want = ann.neighbours(table(spark, vectors), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").toPandas()
    monkeypatch.setattr(ann, "VECTORS", 7)
    monkeypatch.setattr(ann, "QUERIES", 2)
    got = ann.neighbours(table(spark, vectors), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").toPandas()
    assert got.equals(want)


def test_wider_visits_meet_more():
    rng = np.random.default_rng(11)
    tree = ann.grow(rng.normal(size=(2000, 8)), 10.0)
    order = list(tree.visits(tree.away(rng.normal(size=(1, 8)))[0]))
    assert sorted(order) == list(range(tree.leaves))


def test_recall_on_the_given_vectors(spark):
    path = Path("/root/testdata/sf0.1/embeddings.parquet")
    if not path.exists():
        pytest.skip("no test data")
    found = ann.neighbours(spark.read.parquet(f"file://{path}"), F.col("vec_id") % 20 == 0).toPandas()
    table = spark.read.parquet(f"file://{path}").where("embedding IS NOT NULL").toPandas()
    ids, vectors = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_list()).astype(float)
    hits = sum(len(set(rows["vec_id"]) & set(truth(ids, vectors, q, 20))) for q, rows in found.groupby("query_id"))
    assert hits / len(found) >= 0.9


def test_many_ties_are_scored_in_parts():
    vectors = np.ones((70_000, 2))
    queries = np.ones((2, 2))
    of, at, score = ann._chosen(queries @ vectors.T, queries, vectors, np.arange(70_000)[::-1], 3)
    assert of.tolist() == [0, 0, 0, 1, 1, 1] and at.tolist() == [69_999, 69_998, 69_997] * 2 and (score == 2).all()
