"""Differences between two versions: manifests, graphs, lines and predictions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = 3
MAX_EDITS = 4000


#: Keys of one part of a large manifest.
SPAN = 512


def _hashed(rows: DataFrame, by: list[str], key: str, line: Column) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), line.alias("line"))))
    grouped = rows.groupBy(*by).agg(F.count("*").alias("n"), pairs.alias("p"))
    return grouped.select(*by, "n", F.sha2(F.array_join(F.transform("p", lambda x: x["line"]), "\n"), 256).alias("content_hash"))


def content_hashes(rows: DataFrame, by: str, key: str, content: str, span: int | None = None) -> DataFrame:
    """n and content_hash of each group: SHA-256 of its sorted lines of key and content hash.

    span: for groups of any size, with whole numbers as keys.  Each range of so many keys
    is hashed alone, then the lines of ranges and their hashes; a range holds as many rows
    as it has keys, so no task gets a whole group.  Without it a group is one manifest
    of a project, and one value of the result.
    """
    line = F.concat(F.col(key).cast("string"), F.lit("\0"), F.col(content))
    if span is None:
        return _hashed(rows, [by], key, line)
    parts = _hashed(rows.withColumn("part", F.floor(F.col(key) / span)), [by, "part"], key, line)
    parts = parts.withColumnRenamed("n", "m").withColumn("super", F.floor(F.col("part") / span))
    for level in (["super"], []):  # ranges of ranges, then the group
        of = "part" if level else "super"
        line = F.concat(F.col(of).cast("string"), F.lit("\0"), F.col("content_hash"))
        summed = parts.groupBy(by, *level).agg(F.sum("m").alias("m"), F.array_sort(F.collect_list(F.struct(F.col(of).alias("key"), line.alias("line")))).alias("p"))
        parts = summed.select(by, *level, "m", F.sha2(F.array_join(F.transform("p", lambda x: x["line"]), "\n"), 256).alias("content_hash"))
    return parts.select(by, F.col("m").alias("n"), "content_hash")


def manifest_diff(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """key and change (added, removed, changed) of the rows that differ between two manifests."""
    b, a = before.select(key, F.col(content).alias("b"), F.lit(1).alias("in_b")), after.select(key, F.col(content).alias("a"), F.lit(1).alias("in_a"))
    both = b.join(a, key, "full_outer")
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def moved(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """content, old_key, new_key: removed and added rows of equal content, paired one to one in the order of their keys."""
    def ranked(rows: DataFrame, other: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(content).orderBy(key))
        return rows.join(other, key, "left_anti").select(content, F.col(key).alias(name), place.alias("place"))

    gone, new = ranked(before, after.select(key), "old_key"), ranked(after, before.select(key), "new_key")
    return gone.join(new, [content, "place"]).drop("place")


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, change, field, before, after: a row for each field that differs, one for each added or removed key."""
    b = before.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("b"))
    a = after.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("a"))
    both = b.join(a, key, "full_outer")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").alias("before"), F.col(f"a.{f}").alias("after")) for f in fields])
    unlike = F.filter(each, lambda x: ~x["before"].eqNullSafe(x["after"]))
    none = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    rows = both.select(key, change.alias("change"), F.explode(F.when(change == "changed", unlike).otherwise(none)).alias("c"))
    return rows.select(key, "change", "c.field", "c.before", "c.after")


def prediction_score(predicted: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each predicted or actual row as hit, missed (only actual) or wrong (only predicted)."""
    both = predicted.select(*keys).distinct().withColumn("p", F.lit(1)).join(actual.select(*keys).distinct().withColumn("a", F.lit(1)), list(keys), "full_outer")
    return both.select(*keys, F.when(F.col("p").isNull(), "missed").when(F.col("a").isNull(), "wrong").otherwise("hit").alias("status"))


def edit_script(before: list[str], after: list[str], most: int = MAX_EDITS) -> list[tuple[str, str]]:
    """(op, line) of a shortest edit from one list of lines to another; ops are " ", "-" and "+".

    Greedy search by edit distance; of equal ways a deletion comes before an insertion.
    Beyond so many edits everything goes and everything comes.
    """
    head = 0
    while head < min(len(before), len(after)) and before[head] == after[head]:
        head += 1
    tail = 0
    while tail < min(len(before), len(after)) - head and before[-1 - tail] == after[-1 - tail]:
        tail += 1
    a, b = before[head : len(before) - tail], after[head : len(after) - tail]
    frame = [(" ", x) for x in before[:head]], [(" ", x) for x in before[len(before) - tail :]]
    reach: dict[int, int] = {1: 0}
    history: list[dict[int, int]] = []
    limit = min(len(a) + len(b), most)
    for d in range(limit + 1):
        history.append(dict(reach))
        for k in range(-d, d + 1, 2):
            insert = k == -d or (k != d and reach[k - 1] < reach[k + 1])
            x = reach[k + 1] if insert else reach[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= len(a) and x - k >= len(b):
                return frame[0] + _walked(a, b, history) + frame[1]
    return frame[0] + [("-", x) for x in a] + [("+", x) for x in b] + frame[1]


def _walked(a: list[str], b: list[str], history: list[dict[int, int]]) -> list[tuple[str, str]]:
    """The edit script that a finished search went, read from its end."""
    x, y, out = len(a), len(b), []
    for d in range(len(history) - 1, -1, -1):
        reach, k = history[d], x - y
        insert = d > 0 and (k == -d or (k != d and reach[k - 1] < reach[k + 1]))
        from_x = 0 if d == 0 else reach[k + 1] if insert else reach[k - 1]
        from_y = 0 if d == 0 else from_x - (k + 1 if insert else k - 1)
        while x > from_x and y > from_y:
            x, y = x - 1, y - 1
            out.append((" ", a[x]))
        if d > 0 and insert:
            y -= 1
            out.append(("+", b[y]))
        elif d > 0:
            x -= 1
            out.append(("-", a[x]))
    return out[::-1]


_OPS = "pair string, at int, op string, line string"


def line_diff(pairs: DataFrame, pair: str, before: str, after: str) -> DataFrame:
    """pair, at, op, line: the edit script of each pair of texts."""
    def split(text: str | None) -> list[str]:
        lines = (text or "").split("\n")
        return [x.removesuffix("\r") for x in (lines[:-1] if lines[-1] == "" else lines)]

    def scripts(batches):
        for batch in batches:
            rows = [
                (str(p), at, op, line)
                for p, b, a in zip(batch["pair"], batch["before"], batch["after"], strict=True)
                for at, (op, line) in enumerate(edit_script(split(b), split(a)))
            ]
            yield pd.DataFrame(rows, columns=["pair", "at", "op", "line"])

    return pairs.select(F.col(pair).cast("string").alias("pair"), F.col(before).alias("before"), F.col(after).alias("after")).mapInPandas(scripts, _OPS)


def hunks(script: DataFrame, context: int = CONTEXT) -> DataFrame:
    """pair, hunk, first, last, added, removed, before_start, after_start: changes with lines of context around them.

    Changes with no more than twice the context between them share a hunk.
    """
    w = Window.partitionBy("pair").orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = script.withColumns({
        "old": F.sum(F.when(F.col("op") != "+", 1).otherwise(0)).over(so_far), "new": F.sum(F.when(F.col("op") != "-", 1).otherwise(0)).over(so_far),
        "total": F.max("at").over(Window.partitionBy("pair")),
    })
    changed = rows.where("op <> ' '").withColumn("since", F.col("at") - F.lag("at").over(w))
    changed = changed.withColumn("hunk", F.sum(F.when(F.col("since") <= 2 * context + 1, 0).otherwise(1)).over(so_far))
    return changed.groupBy("pair", "hunk").agg(
        F.greatest(F.min("at") - context, F.lit(0)).alias("first"), F.least(F.max("at") + context, F.max("total")).alias("last"),
        F.count_if(F.col("op") == "+").alias("added"), F.count_if(F.col("op") == "-").alias("removed"),
        F.min("old").alias("before_start"), F.min("new").alias("after_start"),
    )


def severity_order(rows: DataFrame, severity: str, rank: dict[str, int]) -> Column:
    """A column to sort findings by: the place of their severity."""
    out = F.lit(len(rank))
    for name, place in rank.items():
        out = F.when(F.col(severity) == name, place).otherwise(out)
    return out
