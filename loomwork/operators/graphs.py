"""Operators on graphs that stand in tables of nodes and edges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.sized import join_small
from loomwork.storage import checkpointed, written

PROOFS = 20
#: Bytes of numbers that a join in rounds sends to every task, at most: a round has four such joins at once, each several times over in the driver.
ROUND_BYTES = 4 * 2**20
#: Of more nodes than EARLY_NODES, only labels under about an EARLY_SHARE-th of the ids are sent in the first rounds: most others would be replaced soon.
EARLY_NODES, EARLY_SHARE, EARLY_ROUNDS = 2**16, 1024, 8


def block_edges(edges: DataFrame, block_of: DataFrame, node: str, block: str, proofs: int = PROOFS) -> DataFrame:
    """kind, from_block, to_block, n and the first proofs of the edges between blocks.

    edges: kind, src, dst, proof.  Proofs are kept as the least so many by an aggregate
    of two steps, so that no pair of blocks gathers all its proofs.
    """
    of = lambda end: block_of.select(F.col(node).alias(end), F.col(block).alias(f"{end}_block"))
    lifted = edges.join(of("src"), "src").join(of("dst"), "dst").where("src_block <> dst_block")
    keys = ["kind", "src_block", "dst_block"]
    slot = F.pmod(F.xxhash64("proof"), F.lit(64))
    least = lambda: F.slice(F.array_sort(F.collect_set("proof")), 1, proofs)
    part = lifted.groupBy(*keys, slot.alias("slot")).agg(F.count("*").alias("n"), least().alias("p"))
    return part.groupBy(*keys).agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, proofs).alias("proofs"))


def uses_all(edges: DataFrame) -> DataFrame:
    """Relational division: blocks with an edge to all other blocks, and those with one from all others."""
    pairs = edges.select("src", "dst").where("src <> dst").distinct()
    nodes = pairs.select("src").union(pairs.select("dst")).distinct()
    others = nodes.count() - 1
    out = pairs.groupBy(F.col("src").alias("block")).agg(F.count("*").alias("n")).withColumn("direction", F.lit("uses-all"))
    into = pairs.groupBy(F.col("dst").alias("block")).agg(F.count("*").alias("n")).withColumn("direction", F.lit("used-by-all"))
    return out.union(into).where(F.col("n") == others).select("block", "direction", "n")


def fan(edges: DataFrame, least: int) -> DataFrame:
    """Nodes with so many distinct neighbours or more, by direction."""
    pairs = edges.select("src", "dst").distinct()
    out = pairs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).withColumn("direction", F.lit("uses-many"))
    into = pairs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).withColumn("direction", F.lit("used-by-many"))
    return out.union(into).where(F.col("n") >= least)


def reachable(edges: DataFrame, starts: DataFrame, stops: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """node, depth: what the start nodes reach, at the least number of steps; nodes in stops are reached but not left.

    Breadth first, over edges that are written once: each round joins the newest nodes only, and is checkpointed.  Rounds
    go on until nothing is new; where most is given and more are needed, it raises.
    """
    found = checkpointed(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    newest = found
    links = written(edges.select("src", "dst").distinct(), "edges")
    for depth in count(1):
        leaving = newest if stops is None else newest.join(stops.select("node"), "node", "left_anti")
        reached = links.join(leaving.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        newest = checkpointed(reached.join(found, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if newest.isEmpty():
            break
        if most is not None and depth > most:
            raise RuntimeError(f"nodes more than {most} steps away")
        found = checkpointed(found.union(newest))
    return found


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, id of an edge's ends, and the edges as src, dst of ids.  Ids are in the order of hashes: none runs along a path.

    An id is the place in a partition, then the partition, so that the least ids come from all partitions.
    """
    pairs = written(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    ends = ends.repartition("node").sortWithinPartitions(F.xxhash64("node")).select("node", F.monotonically_increasing_id().alias("at"))
    nodes = written(ends.select("node", F.shiftleft("at", 31).bitwiseOR(F.shiftrightunsigned("at", 33)).alias("id")), "nodes")
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
    links = pairs.join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    return nodes, written(links, "links")


def _joined(big: DataFrame, small: DataFrame, rows: int, on: str | list[str]) -> DataFrame:
    """big joined with so many rows of numbers: broadcast if they are few."""
    return big.join(F.broadcast(small) if rows * (24 + 16 * len(small.columns)) <= ROUND_BYTES else small, on)


def _least_both_ways(links: DataFrame) -> DataFrame:
    """node, above, below: the least node that reaches a node and the least one that it reaches, itself included.

    Only labels that got less and were not sent since are sent on, at first only the least.  Each third round a node
    also takes the label of its label, so that long ways take few rounds.
    """
    fewer = F.least("src", "dst")
    ends = links.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.col("src").alias("above"), fewer.alias("below")), F.struct(F.col("dst").alias("node"), fewer.alias("above"), F.col("dst").alias("below"))
    )).alias("e")).select("e.*")
    first = ends.groupBy("node").agg(F.min("above").alias("above"), F.min("below").alias("below"))
    at = written(first.select("node", "above", "below", (F.col("above") < F.col("node")).alias("above_new"), (F.col("below") < F.col("node")).alias("below_new")), "labels")
    none = F.lit(None).cast("long")
    size, top = at.agg(F.count("*"), F.max("node")).first()
    most = top // EARLY_SHARE if size > EARLY_NODES else top
    for k in count(2):
        if k > EARLY_ROUNDS + 1:
            most = top
        above_due, below_due = F.col("above_new") & (F.col("above") <= most), F.col("below_new") & (F.col("below") <= most)
        new = at.agg(F.count_if(above_due), F.count_if(below_due), F.count_if(F.col("above") < F.col("node")), F.count_if(F.col("below") < F.col("node"))).first()
        if new[0] + new[1] == 0:
            if most == top:
                return at.select("node", "above", "below")
            most = top
            continue
        sent = _joined(links, at.where(above_due).select(F.col("node").alias("src"), "above"), new[0], "src").select(F.col("dst").alias("node"), "above", none.alias("below"))
        sent = sent.union(_joined(links, at.where(below_due).select(F.col("node").alias("dst"), "below"), new[1], "dst").select(F.col("src").alias("node"), none, "below"))
        if k % 3 == 0:
            for label, rows, less in (("above", new[2], lambda c: (c, none)), ("below", new[3], lambda c: (none, c))):
                labelled = at.where(f"{label} < node").select("node", label)
                of = labelled.select(F.col("node").alias(label), F.col(label).alias("less"))
                sent = sent.union(_joined(labelled, of, rows, label).select("node", *less(F.col("less"))))
        got = sent.groupBy("node").agg(F.min("above").alias("a"), F.min("below").alias("b"))
        less_above, less_below = F.coalesce(F.col("a") < F.col("above"), F.lit(False)), F.coalesce(F.col("b") < F.col("below"), F.lit(False))
        at = written(at.join(got, "node", "left").select(
            "node", F.least("above", "a").alias("above"), F.least("below", "b").alias("below"),
            (less_above | (F.col("above_new") & ~above_due)).alias("above_new"), (less_below | (F.col("below_new") & ~below_due)).alias("below_new"),
        ), "labels")


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node): the cycles, as components of two nodes or more that reach one another.

    Each node learns the least node that reaches it and the least one that it reaches.  Where they
    are the same, it is in a cycle with that one (or is it), and so is all of that component.  Nodes of one
    component agree in both, so only edges between nodes that do are looked at again.
    """
    nodes, links = _numbered(edges)
    every = None
    while not links.isEmpty():
        at = _least_both_ways(links)
        part = at.where("above = below").select(F.col("node").alias("id"), F.col("above").alias("first"))
        every = part if every is None else every.union(part)
        rest = at.where("above <> below")
        rows = rest.count()
        of = lambda end: rest.select(F.col("node").alias(end), "above", "below")  # noqa: B023, E731
        links = written(_joined(_joined(links, of("src"), rows, "src"), of("dst"), rows, ["dst", "above", "below"]).select("src", "dst"), "links")
    if every is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).where(F.lit(False))
    found = written(every.join(nodes, "id").select("node", "first"), "components")
    large = written(found.groupBy("first").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1").select("first", "component"), "large")
    return join_small(found, large, "first", most=ROUND_BYTES).select("node", "component")


def dependency_depth(edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, depth: 0 for what depends on nothing, else one more than the deepest it depends on; edges on cycles count for nothing.

    Where most is given and depths are over it, it raises.
    """
    cyclic = strong_components(edges)
    of = lambda end: cyclic.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
    marked = edges.select("src", "dst").distinct().join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    links = checkpointed(marked.where("src <> dst AND (src_c IS NULL OR dst_c IS NULL OR src_c <> dst_c)").select("src", "dst"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    depth = checkpointed(nodes.withColumn("depth", F.lit(0)))
    for k in count():
        deeper = links.join(depth.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg((F.max("depth") + 1).alias("d"))
        step = checkpointed(depth.join(deeper, "node", "left").select("node", F.coalesce("d", F.lit(0)).alias("d"), "depth"))
        depth = step.select("node", F.col("d").alias("depth"))
        if step.where("d <> depth").isEmpty():
            break
        if most is not None and k >= most:
            raise RuntimeError(f"depths over {most}")
    return depth


def unused(nodes: DataFrame, edges: DataFrame, node: str, end: str) -> DataFrame:
    """Nodes that no edge has at that end."""
    return nodes.join(edges.select(F.col(end).alias(node)), node, "left_anti")


def merged(graphs: list[DataFrame], key: str, order: str = "reader") -> DataFrame:
    """Nodes of several readers as one table: the first reader's row wins, the proofs of all are united."""
    rows = graphs[0]
    for g in graphs[1:]:
        rows = rows.unionByName(g, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (key, order, "proof")]
    return rows.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.col(order)).alias("__n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("proof")))).alias("proof")
    ).select(key, *[F.col(f"__n.{c}").alias(c) for c in rest], "proof")
