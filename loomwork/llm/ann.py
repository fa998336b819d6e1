"""Approximate nearest neighbours by inner product, with a hierarchical k-means tree.

Vectors get one more component that makes their lengths equal, so that the largest
inner product is the least distance.  A tree of k-means centres is grown on a
bounded sample; every vector goes to one leaf.  A query walks the tree best bin
first, with a priority queue of nodes by distance, and scores the vectors of the
leaves that it visits exactly, and no others.  How many leaves is calibrated: some
queries are searched by brute force, and visits widen until enough of their
neighbours are met; recall is then measured on other queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from loomwork.sized import join_small
from loomwork.storage import checkpointed, written

#: Vectors that the tree is grown on, children of a node, and sample vectors of a leaf at most.
SAMPLE, BRANCH, LEAF = 20_000, 8, 48
#: Queries searched by brute force, half to calibrate on and half to measure; the share of neighbours to meet on the first half, and on the second at least.
CALIBRATION, RECALL, FLOOR = 256, 0.93, 0.91
#: Rows of vectors and of queries in a block, and queries of it that are scored at a time.
VECTORS, QUERIES, AT_ONCE = 8192, 4096, 256
NEIGHBOURS = 20


@dataclass
class Tree:
    """centre: of each node; first, children: the node's children stand in a row; leaf: its number, or -1."""

    centre: np.ndarray
    first: np.ndarray
    children: np.ndarray
    leaf: np.ndarray
    longest: float

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors with the component that makes their length the longest one's."""
        rest = np.sqrt(np.maximum(self.longest**2 - (vectors * vectors).sum(axis=1), 0))
        return np.hstack([vectors, rest[:, None]])

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the tree, to the nearest child each time."""
        lifted, node = self.lifted(vectors), np.zeros(len(vectors), np.int64)
        while True:
            inner = np.unique(node[self.children[node] > 0])
            if not len(inner):
                return self.leaf[node]
            for n in inner:
                rows = np.flatnonzero(node == n)
                kids = np.arange(self.first[n], self.first[n] + self.children[n])
                node[rows] = kids[_distance(lifted[rows], self.centre[kids]).argmin(axis=1)]

    def away(self, queries: np.ndarray) -> np.ndarray:
        """The distance (less what is the same for all nodes) of each query to each node's centre."""
        return _distance(np.hstack([queries, np.zeros((len(queries), 1))]), self.centre)

    def visits(self, away: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first walk of one query: the nearest open node of the whole tree comes next."""
        queue = [(0.0, 0)]
        far, first, children, leaf = away.tolist(), *self._lists
        while queue:
            n = heapq.heappop(queue)[1]
            if not children[n]:
                yield leaf[n]
                continue
            for k in range(first[n], first[n] + children[n]):
                heapq.heappush(queue, (far[k], k))

    @cached_property
    def _lists(self) -> tuple[list, list, list]:
        return self.first.tolist(), self.children.tolist(), self.leaf.tolist()


def _distance(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres * centres).sum(axis=1) - 2 * x @ centres.T


def grow(sample: np.ndarray, longest: float, seed: int = 5) -> Tree:
    """A tree over a sample of vectors."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.empty((0, 0)), np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1), longest)
    lifted = tree.lifted(sample)
    centre, first, children, leaf = [lifted.mean(axis=0)], [0], [0], [-1]
    open_ = [(0, np.arange(len(lifted)))]
    leaves = 0
    while open_:
        node, rows = open_.pop(0)
        part = lifted[rows]
        distinct = np.unique(part, axis=0) if len(rows) > LEAF else part
        if len(distinct) <= LEAF:
            leaf[node], leaves = leaves, leaves + 1
            continue
        means = distinct[rng.choice(len(distinct), BRANCH, replace=False)]
        for _ in range(8):
            of = _distance(part, means).argmin(axis=1)
            means = np.stack([part[of == k].mean(axis=0) if (of == k).any() else means[k] for k in range(len(means))])
        of = _distance(part, means).argmin(axis=1)
        used = [k for k in range(len(means)) if (of == k).any()]
        if len(used) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        first[node], children[node] = len(centre), len(used)
        for k in used:
            open_.append((len(centre), rows[of == k]))
            centre.append(means[k])
            first.append(0)
            children.append(0)
            leaf.append(-1)
    return Tree(np.stack(centre), np.array(first), np.array(children), np.array(leaf), longest)


def usable(vector: str) -> Column:
    """Vectors that take part: not null, not zero, all components present and finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


_FOUND = "query_id long, vec_id long, score double, leaf int"


def _rows(query_id: np.ndarray, ids: np.ndarray, score: np.ndarray, leaf: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": score, "leaf": leaf})


def _chosen(scores: np.ndarray, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, vector rows and exact scores of the k best of each row of scores; -inf marks what is no candidate.

    scores only narrow the choice, with room for their rounding.
    """
    n = min(k, scores.shape[1])
    edge = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
    room = 1e-12 * (1 + np.abs(queries).sum(axis=1) * np.abs(vectors).max(initial=0))
    of, at = np.nonzero((scores >= (edge - room)[:, None]) & (scores > -np.inf))
    exact = np.empty(len(at))
    for x in range(0, len(at), 2**16):  # ties may be very many
        exact[x : x + 2**16] = (vectors[at[x : x + 2**16]] * queries[of[x : x + 2**16]]).sum(axis=1)
    order = np.lexsort((ids[at], -exact, of))
    of, at, exact = of[order], at[order], exact[order]
    begin = np.searchsorted(of, np.arange(len(queries)))
    best = np.arange(len(of)) - begin[of] < k
    return of[best], at[best], exact[best]


def _block(k: int):
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        """The k best that each query of the block finds in it; a leaf is multiplied with the queries that visit it only."""
        asked, held = rows[rows["is_query"]], rows[~rows["is_query"]].sort_values("leaf", kind="stable")
        out = [_rows(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        if len(asked) and len(held):
            ids, vectors, leaf = held["id"].to_numpy(), _matrix(held["vector"]), held["leaf"].to_numpy().astype(np.int64)
            leaves, begin = np.unique(leaf, return_index=True)
            end = np.r_[begin[1:], len(leaf)]
            for x in range(0, len(asked), AT_ONCE):
                part = asked.iloc[x : x + AT_ONCE]
                q, queries = part["id"].to_numpy(), _matrix(part["vector"])
                visitor = np.repeat(np.arange(len(part)), [len(v) for v in part["leaves"]])
                visited = np.concatenate(part["leaves"].to_list())
                order = np.argsort(visited, kind="stable")
                visitor, visited = visitor[order], visited[order]
                scores = np.full((len(part), len(ids)), -np.inf)
                low, high = np.searchsorted(visited, leaves, "left"), np.searchsorted(visited, leaves, "right")
                for n in np.flatnonzero(high > low):
                    who = visitor[low[n] : high[n]]
                    scores[who, begin[n] : end[n]] = queries[who] @ vectors[begin[n] : end[n]].T
                scores[ids[None, :] == q[:, None]] = -np.inf
                of, at, score = _chosen(scores, queries, vectors, ids, k)
                out.append(_rows(q[of], ids[at], score, leaf[at]))
        return pd.concat(out, ignore_index=True)

    return search


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _brute(indexed: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of some queries over all rows, exactly: each task keeps its own best."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vec_ids, vectors, leaf = batch["id"].to_numpy(), _matrix(batch["vector"]), batch["leaf"].to_numpy()
                scores = queries @ vectors.T
                scores[vec_ids[None, :] == ids[:, None]] = -np.inf
                of, at, score = _chosen(scores, queries, vectors, vec_ids, k)
                yield _rows(ids[of], vec_ids[at], score, leaf[at])

    return _top(indexed.select("id", "vector", "leaf").mapInPandas(scan, _FOUND), k).toPandas()


def _met_at(tree: Tree, truth: pd.DataFrame, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For each true neighbour the number of leaf visits at which its query meets it, ascending."""
    when, away = [], dict(zip(ids.tolist(), tree.away(queries), strict=True))
    for q, rows in truth[truth["query_id"].isin(ids)].groupby("query_id"):
        order = {leaf: k for k, leaf in enumerate(tree.visits(away[q]), 1)}
        when += [order[leaf] for leaf in rows["leaf"]]
    return np.sort(np.array(when, np.int64))


def calibrate(tree: Tree, truth: pd.DataFrame, ids: np.ndarray, queries: np.ndarray, recall: float = RECALL) -> int:
    """The least number of leaf visits that meets so large a share of the true neighbours of one half of the queries, and FLOOR of the other's."""
    width = 0
    for half, share in ((slice(0, None, 2), recall), (slice(1, None, 2), min(recall, FLOOR))):
        met = _met_at(tree, truth, ids[half], queries[half])
        if len(met):
            width = max(width, int(met[max(int(np.ceil(share * len(met))) - 1, 0)]))
    return width or tree.leaves


def _buckets(per_leaf: dict[int, int]) -> dict[int, int]:
    """Neighbouring leaves as buckets of about VECTORS rows; a larger leaf has one of its own."""
    out, now, size = {}, 0, 0
    for leaf in sorted(per_leaf):
        if size and size + per_leaf[leaf] > VECTORS:
            now, size = now + 1, 0
        out[leaf] = now
        size += per_leaf[leaf]
    return out


def neighbours(
    embeddings: DataFrame, queries: Column, k: int = NEIGHBOURS, recall: float = RECALL, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each row that queries holds for.

    Rows with the query's own id are no candidates.  Vectors that are null or zero or
    hold null or non-finite components, of another dimension than most, or without
    an id take no part.  With fewer candidates than k all are given.  Ties go to the
    smaller id; a repeated row is a candidate each time, as a query it counts once.  Other columns are
    not read.  An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    # single precision travels as it is; tasks compute in double
    kind = "array<float>" if embeddings.schema[vector].dataType == ArrayType(FloatType(), embeddings.schema[vector].dataType.containsNull) else "array<double>"
    numbers = F.col(vector).cast(kind)
    rows = embeddings.where(usable(vector) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), numbers.alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(
        F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).alias("longest")
    )
    most = sizes.orderBy(F.desc("n"), "d").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == most["d"])
    sample = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas().sort_values("id", kind="stable")
    tree = grow(_matrix(sample["vector"]), most["longest"])
    shared = spark.sparkContext.broadcast(tree)  # at most SAMPLE centres

    @F.pandas_udf("int")
    def leaf_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.leaf_of(_matrix(batch)) if len(batch) else [], dtype="int32")

    indexed = written(rows.withColumn("leaf", leaf_of("vector")), "leaves")
    asking = indexed.where("asks").select("id", "vector").dropDuplicates(["id"])
    some = asking.orderBy(F.xxhash64(F.lit(1), "id")).limit(CALIBRATION).toPandas()
    if some.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    truth = _brute(indexed, some["id"].to_numpy(), _matrix(some["vector"]), k)
    width = calibrate(tree, truth, some["id"].to_numpy(), _matrix(some["vector"]), recall)
    per_leaf = {r["leaf"]: r["n"] for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row for each leaf

    bucket = _buckets(per_leaf)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            visits = []
            parts = (_matrix(batch["vector"].iloc[x : x + AT_ONCE]) for x in range(0, len(batch), AT_ONCE))
            for away in (row for part in parts for row in shared.value.away(part)):
                seen, met = {}, 0
                for n, leaf in enumerate(shared.value.visits(away)):
                    if n >= width and met > k:
                        break
                    if leaf in bucket:
                        seen.setdefault(bucket[leaf], []).append(leaf)
                        met += per_leaf[leaf]
                visits.append([{"bucket": b, "leaves": leaves} for b, leaves in seen.items()])
            yield batch.assign(visits=visits)

    parts = max(1, -(-asking.count() // 256))  # walks cost time rather than bytes, so they are dealt by count
    walked = asking.repartition(parts, "id").mapInPandas(walk, f"id long, vector {kind}, visits array<struct<bucket:int,leaves:array<int>>>")
    walked = written(walked, "walks").select("id", "vector", F.explode("visits").alias("v"))
    visits = walked.select("id", "vector", F.lit(None).cast("int").alias("leaf"), "v.leaves", F.lit(True).alias("is_query"), "v.bucket")
    in_bucket: dict[int, int] = {}
    for leaf, n in per_leaf.items():
        in_bucket[bucket[leaf]] = in_bucket.get(bucket[leaf], 0) + n
    of_leaf = spark.createDataFrame(sorted(bucket.items()), "leaf int, bucket int")
    sizes = spark.createDataFrame([(b, -(-n // VECTORS)) for b, n in sorted(in_bucket.items())], "bucket int, nb int")
    asked = visits.groupBy("bucket").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qb"))
    blocks = checkpointed(sizes.join(asked, "bucket"))

    def dealt(part: DataFrame, own: str, other: str) -> DataFrame:
        """Rows in blocks: one of their own kind by hash, all of the other kind."""
        part = join_small(part, blocks, "bucket")
        mine = F.pmod(F.xxhash64(F.lit(2), "id"), F.col(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        columns = {own: mine, other: each}
        return part.select("id", "vector", "leaf", "leaves", "is_query", "bucket", columns["nb"].alias("i"), columns["qb"].alias("j"))

    held = join_small(indexed.select("id", "vector", "leaf"), of_leaf, "leaf")
    held = held.withColumns({"is_query": F.lit(False), "leaves": F.lit(None).cast("array<int>")})
    every = dealt(held, "nb", "qb").unionByName(dealt(visits, "qb", "nb"))
    found = every.groupBy("bucket", "i", "j").applyInPandas(_block(k), _FOUND)
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
