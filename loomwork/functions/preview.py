"""A readable part of a JSON value, bounded in depth, length, nodes and text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels, items of a list, keys of an object, nodes in all, and characters of a text that are shown.
DEPTH, ITEMS, KEYS, NODES, TEXT = 4, 20, 30, 300, 2000


def shown(value: object) -> object:
    """What is shown of a value: one budget of nodes for all of it, spent in the order of reading."""
    left = NODES

    def walk(item: object, depth: int) -> object:
        nonlocal left
        left -= 1
        if left < 0:
            return "[…]"
        if isinstance(item, str):
            return item if len(item) <= TEXT else f"{item[:TEXT]}[TRUNCATED {len(item)}]"
        if not isinstance(item, (list, dict)):
            return item
        if depth >= DEPTH:
            return {"$type": f"list ({len(item)})" if isinstance(item, list) else "object", "$summarised": True}
        if isinstance(item, list):
            out = [walk(x, depth + 1) for x in item[:ITEMS]]
            return [*out, {"$more": len(item) - ITEMS}] if len(item) > ITEMS else out
        out = {k: walk(item[k], depth + 1) for k in list(item)[:KEYS]}
        return out | {"$more": len(item) - KEYS} if len(item) > KEYS else out

    return walk(value, 0)


def _previewed(values: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(shown(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return '{"$type":"unreadable"}'

    return pd.Series([one(v) for v in values], dtype=object)


def preview(value: Column) -> Column:
    """shown() of a column of JSON texts, as JSON; what isn't JSON, or is nested too deep to read, is unreadable."""
    return F.pandas_udf(_previewed, "string")(value)
