from itertools import product
from random import Random

from loomwork.operators import structure


def plainly(point, symbols):
    _, path, name, line = point
    found = []
    for p, n, at, end, kind in symbols:
        if p == path and line is not None and at is not None:
            rank = 0 if n == name and at == line else 1 if at == line and kind not in ("variable", None) else 2 if at <= line <= (at if end is None else end) else None
            if rank is not None:
                found.append((rank, -at, n))
    return (min(found)[2], ("key", "line", "enclosing")[min(found)[0]]) if found else (path, "file")


def test_located_as_plain_comparison_says(spark, monkeypatch):
    monkeypatch.setattr(structure, "_LINES", 8)
    r = Random(5)
    kinds = ["function", "variable", None]
    symbols = [(r.choice("ab"), r.choice(["f", "g", "h", "k"]), at := r.choice([None, *range(30)]), at and r.choice([None, at - 1, at, at + 3, at + 20]), r.choice(kinds)) for _ in range(60)]
    points = [(k, *p) for k, p in enumerate(product(["a", "b", "c", None], ["f", "h", "x", None], [None, *range(34)]))]
    frame = spark.createDataFrame(points, "point_id int, path string, name string, line int")
    known = spark.createDataFrame(symbols, "path string, name string, line int, end_line int, kind string")
    got = {row["point_id"]: (row["symbol"], row["via"]) for row in structure.located(frame, known).collect()}
    assert got == {p[0]: plainly(p, symbols) for p in points}


def test_located_pairs_no_position_with_all_symbols(spark):
    plan = structure.located(
        spark.createDataFrame([(1, "a", "f", 1)], "point_id int, path string, name string, line int"),
        spark.createDataFrame([("a", "f", 1, 9, "function")], "path string, name string, line int, end_line int, kind string"),
    )._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
