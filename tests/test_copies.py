from loomwork.operators import structure


def test_windows_that_stand_once_are_left_out(spark):
    shared = [f"s{k}" for k in range(6)]
    rows = [(1, [*(f"a{k}" for k in range(50)), *shared]), (2, [*shared, *(f"b{k}" for k in range(50))]), (3, ["c"] * 3)]
    sources = spark.createDataFrame(rows, "doc long, tokens array<string>")
    kept = structure._repeated_windows(sources, 5)
    assert sorted((r["doc"], r["at"]) for r in kept.collect()) == [(1, 50), (1, 51), (2, 0), (2, 1)]
    assert [tuple(r) for r in structure.copied_stretches(sources, 5).collect()] == [(1, 50, 2, 0, 6)]
