import json

import pytest
from pyspark.sql import functions as F

from loomwork.functions import preview


@pytest.mark.parametrize("value, want", [
    (None, None), (True, True), (1.5, 1.5), ("x" * 2000, "x" * 2000), ("y" * 2001, "y" * 2000 + "[TRUNCATED 2001]"), (list(range(20)), list(range(20))), (list(range(25)), [*range(20), {"$more": 5}]),
    ({"a": {"b": {"c": {"d": [1, 2]}}}}, {"a": {"b": {"c": {"d": {"$type": "list (2)", "$summarised": True}}}}}), ([[[[{}]]]], [[[[{"$type": "object", "$summarised": True}]]]]),
    ({f"k{n}": n for n in range(33)}, {**{f"k{n}": n for n in range(30)}, "$more": 3}), ([], []), ({}, {}),
])
def test_what_is_shown(value, want):
    assert preview.shown(value) == want


def test_one_budget_of_nodes_for_all():
    value = [[n] * 19 for n in range(20)]  # 1 + 20 * 20 nodes
    found = preview.shown(value)
    flat = json.dumps(found, ensure_ascii=False)
    assert flat.count("[…]") == 401 - 300 - 19 * 0 - sum(1 for x in found if x == "[…]") * 19 and found[0] == [0] * 19 and found[-1] == "[…]"


def test_preview_of_a_column(spark):
    rows = [('{"a": [1, "é"]}',), ("not json",), (None,), ("[" * 100_000,), ("3",)]
    got = [r["o"] for r in spark.createDataFrame(rows, "v string").select(preview.preview(F.col("v")).alias("o")).collect()]
    assert got == ['{"a":[1,"é"]}', '{"$type":"unreadable"}', None, '{"$type":"unreadable"}', "3"]
