"""Work of the rounds that follow names."""

from loomwork.operators import names


def test_names_whose_end_is_known_are_not_written_again(spark, monkeypatch):
    rows = []

    def counting(make):
        def run(df, *rest):
            made = make(df, *rest)
            rows.append(made.count())
            return made

        return run

    for name in ("written", "checkpointed"):
        if hasattr(names, name):
            monkeypatch.setattr(names, name, counting(getattr(names, name)))
    exports = [(f"short{k}", "x", None, "end", None) for k in range(300)] + [(f"f{k}", "x", None, f"f{k + 1}", None) for k in range(33)] + [("f33", "x", None, "end", None)]
    got = names.export_ends(
        spark.createDataFrame([("end", "x")], "path string, name string"), spark.createDataFrame(exports, "path string, name string, local string, source string, source_name string"),
        spark.createDataFrame([], "path string, local string, imported string, target string"),
    )
    assert {tuple(r) for r in got.collect()} == {(e[0], "x", "end", "x") for e in exports}
    assert sum(rows) < 4 * len(exports)
