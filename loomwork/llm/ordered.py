"""Rows in ascending doc_id order, as blocks of consecutive ids that tasks work on alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.storage import checkpointed

#: Blocks are added up in groups of so many.
SPAN = 512
#: Bytes of texts in a block, and blocks in a task.
BLOCK_BYTES, TASK_BLOCKS = 2**20, 12
#: Blocks at most, so that the driver and the broadcast hold 8 MiB of first ids at any input size: over a tebibyte of texts blocks grow with them.
MOST_BLOCKS = 2**20


def identified(documents: DataFrame) -> DataFrame:
    """doc_id, text ("" for null) of the documents that have a doc_id."""
    doc_id = F.col("doc_id").cast("long")
    rows = documents.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.where("doc_id IS NOT NULL")


def identified_by_size(documents: DataFrame, size: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """As identified, with the number of blocks, but a block ends where the bytes of all texts up to it pass a multiple of size, whatever the ids' spacing.

    Blocks are numbered from 0 without gaps; rows of one doc_id stand in one block.
    The running sums are of one row for each doc_id, dealt by range and summed in two
    levels; the driver gets the first doc_id of each block, of MOST_BLOCKS at most:
    where so many blocks of size don't hold all texts, each holds as much more.
    """
    rows = identified(documents)
    amounts = checkpointed(rows.groupBy("doc_id").agg(F.sum(F.octet_length("text") + 1).alias("amount")))
    dealt = checkpointed(amounts.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    size = max(size, -(-(dealt.agg(F.sum("amount")).first()[0] or 0) // MOST_BLOCKS))
    inner = F.coalesce(F.sum("amount").over(before(Window.partitionBy("part").orderBy("doc_id"))), F.lit(0))
    tops = dealt.groupBy("part").agg(F.sum("amount").alias("total"), F.min("doc_id").alias("first"))
    tops = tops.select("part", F.coalesce(F.sum("total").over(before(Window.orderBy("first"))), F.lit(0)).alias("outer"))
    starts = dealt.withColumn("inner", inner).join(F.broadcast(tops), "part").select("doc_id", F.floor((F.col("inner") + F.col("outer")) / size).alias("k"))
    firsts = np.sort(starts.groupBy("k").agg(F.min("doc_id").alias("first")).toPandas()["first"].to_numpy(np.int64))
    shared = documents.sparkSession.sparkContext.broadcast(firsts)

    @F.pandas_udf("long")
    def block(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in ids:
            yield pd.Series(np.searchsorted(shared.value, batch.to_numpy(np.int64), side="right") - 1)

    return rows.select(block("doc_id").alias("block"), "doc_id", "text"), len(firsts)


def in_blocks(rows: DataFrame, n_blocks: int, *order: str) -> DataFrame:
    """Rows dealt out by block, ascending by order (or doc_id) within each; the one shuffle of texts.

    A task gets TASK_BLOCKS blocks, however large the input.
    """
    return rows.repartition(-(-n_blocks // TASK_BLOCKS) or 1, "block").sortWithinPartitions("block", *(order or ("doc_id", "text")))


def with_next_block(blocks: DataFrame) -> DataFrame:
    """Adds next_block to a table of distinct blocks: the block that follows, or the first one after the last.

    Two levels, so that no task sees more than SPAN blocks or one row for each SPAN blocks.
    """
    group = F.floor(F.col("block") / SPAN)
    rows = blocks.withColumn("super", group)
    inner = rows.withColumn("following", F.lead("block").over(Window.partitionBy("super").orderBy("block")))
    tops = rows.groupBy("super").agg(F.min("block").alias("first"))
    order = Window.orderBy("super")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select("super", F.coalesce(F.lead("first").over(order), F.first("first").over(everything)).alias("after"))
    return inner.join(tops, "super").select("block", F.coalesce("following", "after").alias("next_block"))


def with_start(blocks: DataFrame, amount: str) -> DataFrame:
    """Adds start to a table of distinct blocks: the sum of amount over all blocks before it, at the same two levels."""
    rows = blocks.withColumn("super", F.floor(F.col("block") / SPAN))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum(amount).over(before(Window.partitionBy("super").orderBy("block"))), F.lit(0))
    rows = rows.withColumn("inner", inner)
    tops = rows.groupBy("super").agg(F.sum(amount).alias("total"))
    tops = tops.select("super", F.coalesce(F.sum("total").over(before(Window.orderBy("super"))), F.lit(0)).alias("outer"))
    return rows.join(tops, "super").withColumn("start", F.col("inner") + F.col("outer")).drop("super", "inner", "outer")
