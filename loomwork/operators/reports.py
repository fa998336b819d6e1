"""Operators of reports: catalogues, traces on a graph, verdicts, coverage and badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overridden(base: DataFrame, own: DataFrame) -> DataFrame:
    """A catalogue (id, name, category, hosts) with a user's entries.

    Names are replaced and hosts added; the category of a known entry stays.
    """
    b = base.select("id", F.struct("name", "category", "hosts").alias("b"))
    o = own.select("id", F.struct("name", "category", "hosts").alias("o"))
    none = F.array().cast("array<string>")
    return b.join(o, "id", "full_outer").select(
        "id", F.coalesce("o.name", "b.name").alias("name"), F.coalesce("b.category", "o.category").alias("category"),
        F.concat(F.coalesce("b.hosts", none), F.coalesce("o.hosts", none)).alias("hosts"),
    )


def lit_edges(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, n, known: the moves of traces (trace, at, node) from node to node, and whether the graph has the edge."""
    w = Window.partitionBy("trace").orderBy("at")
    moves = steps.withColumn("dst", F.lead("node").over(w)).where("dst IS NOT NULL").groupBy(F.col("node").alias("src"), "dst").agg(F.count("*").alias("n"))
    known = edges.select("src", "dst").distinct().withColumn("known", F.lit(True))
    return moves.join(known, ["src", "dst"], "left").select("src", "dst", "n", F.coalesce("known", F.lit(False)).alias("known"))


def coverage(rows: DataFrame, group: str, kind: Column) -> DataFrame:
    """Per group: all rows, those of each kind (translated, generic, unknown), and the translated per cent, rounded."""
    marked = rows.withColumn("__kind", kind)
    n = F.count("*")
    translated = F.count_if(F.col("__kind") == "translated")
    return marked.groupBy(group).agg(
        n.alias("n"), translated.alias("translated"), F.count_if(F.col("__kind") == "generic").alias("generic"),
        F.count_if(F.col("__kind") == "unknown").alias("unknown"), F.round(100 * translated / n).cast("long").alias("per_cent"),
    )


def debt(opened: DataFrame, carried: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    """Open and carried items less the reviewed ones, each once."""
    return opened.select(key).union(carried.select(key)).distinct().join(reviewed.select(key), key, "left_anti")


def round_robin(rows: DataFrame, kind: str, order: list[str], kinds: list[str], most: int) -> DataFrame:
    """The first of each kind in turn, then the second of each, up to so many rows."""
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind))
    w = Window.partitionBy(kind).orderBy(*order)
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", place, *order).limit(most)


def one_true(choices: DataFrame, question: str, true: str) -> DataFrame:
    """Questions that have exactly one true choice."""
    return choices.groupBy(question).agg(F.count("*").alias("n"), F.count_if(F.col(true)).alias("n_true")).where("n_true = 1")
