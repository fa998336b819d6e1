"""Operators over event streams that stand in tables: order, runs, pairs, sessions and retention."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def micros(at: str) -> Column:
    """Microseconds since 1970 of a time with or without a zone."""
    return F.unix_micros(F.col(at).cast("timestamp"))


def runs(events: DataFrame, by: Names, order: Names, signature: str, least: int = 1) -> DataFrame:
    """Adjacent events with one signature as one row: run, n, first and last of the first order column.

    Runs are numbered from 1 within by; those of fewer than least events are left out.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.when(F.col(signature).eqNullSafe(F.lag(signature).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = events.withColumn("run", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = marked.groupBy(*by, "run", signature).agg(
        F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last")
    )
    return grouped.where(F.col("n") >= least)


def islands_where(events: DataFrame, by: Names, order: Names, member: Column, counted: Column, least: int) -> DataFrame:
    """Stretches of adjacent member events, at least so long and with half or more of them counted."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = events.withColumn("__in", F.coalesce(member, F.lit(False))).withColumn(
        "island", F.sum(F.when(F.col("__in"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    rows = rows.where("__in").withColumn("__counted", F.coalesce(counted, F.lit(False)).cast("long"))
    grouped = rows.groupBy(*by, "island").agg(
        F.count("*").alias("n"), F.sum("__counted").alias("n_counted"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last")
    )
    return grouped.where((F.col("n") >= least) & (F.col("n_counted") * 2 >= F.col("n")))


def first_wins(rows: DataFrame, key: Names, order: Names) -> DataFrame:
    """Insert-or-ignore: of the rows with one key the first in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_wins(rows: DataFrame, key: Names, order: Names) -> DataFrame:
    """Insert-or-replace: of the rows with one key the last in order, in one aggregation without a sort."""
    rest = [c for c in rows.columns if c not in key]
    kept = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return kept.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def merged_fields(rows: DataFrame, key: Names, order: Names, fields: Names) -> DataFrame:
    """The last value of each field that isn't null."""
    at = F.struct(*order)
    return rows.groupBy(*key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields])


def newest(rows: DataFrame, by: Names, order: Sequence[Column], keep: int) -> DataFrame:
    """Retention: the first keep rows of each group in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def paired(starts: DataFrame, ends: DataFrame, key: Names) -> DataFrame:
    """Start rows with their end row by key; finished tells whether there is one."""
    return starts.join(ends.withColumn("__end", F.lit(True)), list(key), "left").withColumn(
        "finished", F.coalesce("__end", F.lit(False))
    ).drop("__end")


def next_event(events: DataFrame, by: Names, order: Names, columns: Names, prefix: str = "next_") -> DataFrame:
    """Each event with columns of the one after it."""
    w = Window.partitionBy(*by).orderBy(*order)
    return events.withColumns({f"{prefix}{c}": F.lead(c).over(w) for c in columns})


def later_match(events: DataFrame, by: Names, order: Names, start: Column, end: Column, end_value: str) -> DataFrame:
    """Each start event with the value of the first end event that follows it, before any other event of its kind is skipped."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return events.withColumn("end_value", F.first(F.when(end, F.col(end_value)), ignorenulls=True).over(w)).where(start)


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, left_id: str, right_id: str, within: int) -> DataFrame:
    """Each left row with the right row of its key that is nearest in time, not over so many seconds away.

    Time is cut in bins as long as the reach; a right row goes to its own bin and both
    neighbours, so the join is one of equal keys and no row meets more than three bins.
    Ties go to the earlier row, then to the smaller id.
    """
    lhs = left.select(F.col(key).alias("key"), F.col(left_id).alias("left_id"), F.col(at).alias("left_at"), F.floor(micros(at) / 1e6 / within).alias("bin"))
    own = F.floor(micros(at) / 1e6 / within)
    rhs = right.select(F.col(key).alias("key"), F.col(right_id).alias("right_id"), F.col(at).alias("right_at"), F.explode(F.array(own - 1, own, own + 1)).alias("bin"))
    met = lhs.join(rhs, ["key", "bin"]).withColumn("gap", F.abs(micros("left_at") - micros("right_at")))
    met = met.where(F.col("gap") <= within * 1_000_000)
    best = met.groupBy("key", "left_id", "left_at").agg(F.min(F.struct("gap", "right_at", "right_id")).alias("b"))
    return best.select("key", "left_id", "left_at", "b.right_id", "b.right_at", (F.col("b.gap") / 1e6).alias("gap_seconds"))


_CLAIM = "key long, left_id long, right_id long, gap double"


def _claims(reach: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A walk over rows in the order of key, stretch and time that holds only what is within reach of the present row."""
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, waiting, free, out = None, deque(), deque(), []

        def settle(now: int | None) -> None:
            while waiting and (now is None or waiting[0][0] + reach < now):
                t, left = waiting.popleft()
                while free and free[0][0] < t - reach:
                    free.popleft()
                if free:
                    gap, x, right = min((abs(x - t), x, right) for x, right in free)
                    free.remove((x, right))
                    out.append((here[0], left, right, gap / 1e6))

        for batch in batches:
            for key, stretch, t, side, id_ in zip(batch["key"], batch["stretch"], batch["t"], batch["side"], batch["id"], strict=True):
                if (key, stretch) != here:
                    settle(None)
                    free.clear()
                    here = (key, stretch)
                settle(t)
                (free if side else waiting).append((t, id_))
                while free and free[0][0] < (waiting[0][0] if waiting else t) - reach:
                    free.popleft()
            yield pd.DataFrame(out, columns=["key", "left_id", "right_id", "gap"])
            out.clear()
        settle(None)
        yield pd.DataFrame(out, columns=["key", "left_id", "right_id", "gap"])

    return walk


def claimed(left: DataFrame, right: DataFrame, key: str, at: str, left_id: str, right_id: str, within: int) -> DataFrame:
    """As nearest, but each right row goes to one left row at most: claims go in the order of the left rows' time, then id.

    Nothing is claimed over a time as long as the reach without a row, so each key is dealt
    out in the stretches between such times; a stretch is walked in order, and of it only
    the rows within reach are held.  Rows without a key or time claim nothing.
    """
    reach = within * 1_000_000

    def rows(df: DataFrame, id_: str, side: int) -> DataFrame:
        known = df.select(F.col(key).cast("long").alias("key"), micros(at).alias("t"), F.lit(side).alias("side"), F.col(id_).cast("long").alias("id"))
        return known.where("key IS NOT NULL AND t IS NOT NULL").withColumn("bin", F.floor(F.col("t") / reach))

    both = rows(left, left_id, 0).unionByName(rows(right, right_id, 1))
    stretch = F.col("bin") - F.row_number().over(Window.partitionBy("key").orderBy("bin"))  # the same along adjacent bins
    stretches = both.select("key", "bin").distinct().select("key", "bin", stretch.alias("stretch"))
    dealt = both.join(stretches, ["key", "bin"]).select("key", "stretch", "t", "side", "id").repartition("key", "stretch")
    return dealt.sortWithinPartitions("key", "stretch", "t", "id").mapInPandas(_claims(reach), _CLAIM)


def sessions(events: DataFrame, by: str, at: str, gap: int, cap: int | None = None) -> DataFrame:
    """Sessions of each key: a new one begins after gap seconds of quiet, and after cap seconds from a session's start.

    The cap cuts each quiet-bounded session in pieces of cap seconds from its start.
    """
    w = Window.partitionBy(by).orderBy(at)
    since = (micros(at) - F.lag(micros(at)).over(w)) / 1e6
    numbered = events.withColumn("session", F.sum(F.when(since.isNull() | (since >= gap), 1).otherwise(0)).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    keys = [by, "session"]
    if cap is not None:
        start = F.min(micros(at)).over(Window.partitionBy(*keys))
        numbered = numbered.withColumn("piece", F.floor((micros(at) - start) / (cap * 1_000_000)))
        keys.append("piece")
    return numbered.groupBy(*keys).agg(F.count("*").alias("n"), F.min(at).alias("started"), F.max(at).alias("ended"))


def around(rows: DataFrame, by: str, at: str, pivot: str, columns: Names) -> DataFrame:
    """For each key the last row before a moment and the first one from it on."""
    moment = F.lit(pivot).cast("timestamp")
    before, after = F.col(at) < moment, F.col(at) >= moment
    order = F.struct(at, *columns)
    agg = []
    for c in (at, *columns):
        agg += [F.max(F.when(before, order))[c].alias(f"before_{c}"), F.min(F.when(after, order))[c].alias(f"after_{c}")]
    return rows.groupBy(by).agg(*agg)


_BLOCKS = "parent long, at int, size int, times int, steps string"


def repeated_blocks(steps: DataFrame, parent: str, order: Names, step: str, smallest: int = 2, largest: int = 6) -> DataFrame:
    """Blocks of adjacent steps that come twice or more in a row: where, how long, how often.

    At each place the block that covers most steps wins (the shorter of equals); the scan
    goes on after it.  One parent's children are one group: they are one trace's siblings.
    """
    def scan(group: pd.DataFrame) -> pd.DataFrame:
        seq = group.sort_values(list(order))[step].tolist()
        at, out = 0, []
        while at < len(seq):
            best = (0, 0, 0)
            for size in range(smallest, largest + 1):
                block, times = seq[at : at + size], 1
                while len(block) == size and seq[at + times * size : at + (times + 1) * size] == block:
                    times += 1
                if times >= 2 and len(set(block)) > 1 and times * size > best[0]:
                    best = (times * size, size, times)
            if best[0]:
                out.append((group[parent].iloc[0], at, best[1], best[2], ">".join(map(str, seq[at : at + best[1]]))))
            at += best[0] or 1
        return pd.DataFrame(out, columns=["parent", "at", "size", "times", "steps"])

    return steps.groupBy(parent).applyInPandas(scan, _BLOCKS)


def keyed_totals(rows: DataFrame, by: Names, amount: str) -> DataFrame:
    """Counts and totals by key; a total is unknown (null) if any amount is."""
    unknown = F.bool_or(F.col(amount).isNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.when(~unknown, F.sum(amount)).alias("total"))
