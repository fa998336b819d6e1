"""Joins that broadcast a side only after its size was counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: Bytes of a side that is sent to every task, at most.
BROADCAST_BYTES = 64 * 2**20


def _bytes(small: DataFrame) -> tuple[int, list]:
    """Bytes of a row that don't depend on its values, and sums of those that do."""
    sums = []
    for field in small.schema.fields:
        name = F.col(f"`{field.name}`")
        if isinstance(field.dataType, StringType | BinaryType):
            sums.append(F.coalesce(F.sum(F.octet_length(name)), F.lit(0)))
        elif isinstance(field.dataType, ArrayType):
            sums.append(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(name)))), F.lit(0)))
    return 24 + 16 * len(small.columns), sums


def join_small(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """big joined with small, whose bytes are counted first: broadcast up to so many, shuffled beyond.

    small is read twice; callers pass written or checkpointed rows.
    """
    fixed, sums = _bytes(small)
    rows = most // fixed
    found = small.limit(rows + 1).agg(F.count("*"), *[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
    if found[0] <= rows and fixed * found[0] + sum(found[1:]) <= most:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)
