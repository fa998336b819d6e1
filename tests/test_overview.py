from pyspark.sql import functions as F

from loomwork.operators import overview


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_search(spark):
    nodes = spark.createDataFrame([("1", "file", "user.ts", "src/user.ts"), ("2", "table", "user", None), ("3", "env", "USER", None), ("4", "route", "x", "/users")], "id string, kind string, name string, path string")
    assert [r["id"] for r in overview.search(nodes, "User", ["file", "table", "route"]).collect()] == ["2", "1", "4"]


def test_tools(spark):
    df = spark.createDataFrame([("Bash", None, "x" * 700, "Exit code 2\nno"), ("Edit", "a/b", None, "fine")], "t string, p string, c string, r string")
    got = df.select(overview.compact_input(F.col("t"), F.col("p"), F.col("c")).alias("i"), overview.exit_code(F.col("r")).alias("e")).collect()
    assert (len(got[0]["i"]), got[0]["e"], got[1]["i"], got[1]["e"]) == (601, 2, "a/b", None)
    cut = overview.clipped(spark.createDataFrame([("y" * 200, [1, 2, 3])], "a string, b array<int>"), ["a"], {"b": 2}).first()
    assert len(cut["a"]) == 120 and cut["b"] == [1, 2]


def test_leaks_and_arrows(spark):
    calls = spark.createDataFrame([("h1", "s", ["a"], "f1", "server"), ("h2", "s", ["b", "a"], "f2", "server"), ("h3", None, [], "f1", "client")], "host string, service string, fields array<string>, file string, runs_on string")
    services = spark.createDataFrame([("s", "ai")], "service string, category string")
    got = overview.leaks(calls, services).collect()
    assert [(r["service"], r["category"], r["n"], r["fields"]) for r in got] == [("host:h3", "unknown", 1, []), ("s", "ai", 2, ["a", "b"])]
    assert rows(overview.observed_only(spark.createDataFrame([("h1",), ("h9",)], "host string"), calls)) == [("h9", 1)]
    edges = spark.createDataFrame([("a", "b", "imports", "client", True, False, 3), ("a", "b", "calls", "server", False, True, 1), ("a", "b", "imports", "client", False, False, 2)], "src string, dst string, kind string, runs_on string, added boolean, removed boolean, proof int")
    one = overview.plan_arrows(edges, 2).first()
    assert (one["n"], one["kinds"], one["runs_on"], one["change"], one["proofs"]) == (3, {"imports": 2, "calls": 1}, "client+server", "changed", [1, 2])


def test_cards_and_comparison(spark):
    files = spark.createDataFrame([("x/a", "B", "r", 5), ("x/b", "B", "q", 9), ("y/c", "C", "r", 1)], "path string, block string, rule string, lines long")
    card = {r["block"]: r for r in overview.block_cards(files, spark.createDataFrame([("x/a", "f")], "path string, name string"), spark.createDataFrame([("B", "C", 4)], "src_block string, dst_block string, n long"), 1).collect()}
    assert (card["B"]["n_files"], card["B"]["largest"], card["B"]["folders"], card["B"]["n_exports"], card["B"]["uses"], card["C"]["used_by"]) == (2, ["x/b"], 1, 1, 4, 4)
    assert rows(overview.fact_rows(files, 1)) == [("B", "2 files: x/a and 1 more"), ("C", "1 files: y/c")]
    e = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    a = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "id int, v string")
    assert rows(overview.compared(e, a, "id", ["v"])) == [(1, "same", []), (2, "different", ["v"]), (3, "missing", []), (4, "extra", [])]
    assert rows(overview.union_graph(e, a, "id"))[2] == (3, None, True)


def test_schema_replay(spark):
    log = [("create", "a", None, None), ("add", "a", "x", None), ("add", "a", "y", None), ("drop-column", "a", "x", None), ("create", "b", None, None), ("drop", "b", None, None), ("create", "c", None, None), ("add", "c", "z", None), ("rename", "c", None, "d"), ("add", "d", "w", None)]
    df = spark.createDataFrame([("p", k, *r) for k, r in enumerate(log)], "project string, seq int, action string, table string, name string, to string")
    assert rows(overview.replayed_schema(df)) == [("p", "a", ["y"]), ("p", "d", ["z", "w"])]


def test_words_answers_and_settings(spark):
    known = spark.createDataFrame([("src/a.ts",), ("save_user",)], "name string")
    said = spark.createDataFrame([(1, "It calls save_user() in src/a.ts and drop_all() via API_KEY"), (2, "All is well")], "sentence_id int, text string")
    assert rows(overview.unsupported_words(said, known)) == [(1, ["API_KEY", "drop_all"])]
    answer = spark.createDataFrame([("./a", "add"), ("b", "remove"), ("new/c", "add"), ("../x", "add"), ("gone", "remove")], "path string, wanted string")
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    assert rows(overview.interpretation(answer, files)) == [("a", "changed"), ("b", "removed"), ("new/c", "added")]
    defaults = spark.createDataFrame([("x", "on"), ("y", "off")], "kind string, value string")
    assert rows(overview.settings(spark.createDataFrame([("y", "on"), ("z", "on")], "kind string, value string"), defaults)) == [("x", "on", False), ("y", "on", True)]
    routes = spark.createDataFrame([(1, "POST", "save()"), (2, "get", "show()"), (3, "POST", "requireAuth()")], "route_id int, method string, text string")
    assert rows(overview.unguarded_routes(routes)) == [(1, "warning"), (2, "info")]
    points = spark.createDataFrame([("s1", "a", 1), ("s2", "b", 2)], "id string, label string, created int")
    assert overview.resolved_point(points, "latest").first()["id"] == "s2" and overview.resolved_point(points, "a").first()["id"] == "s1"


def test_summaries(spark):
    events = [("r", "p1", "request", "q", None, None, None, None), ("r", "p1", "enter", "q", "f", "g", 1, None), ("r", "p1", "enter", "q", "f", "g", 1, None), ("r", "p2", "process", None, None, None, None, "supervisor"), ("r", "p2", "enter", None, "f", "h", 2, None)]
    df = spark.createDataFrame(events, "run string, process string, type string, requestId string, file string, function string, line int, role string")
    assert rows(overview.recording_summary(df)) == [("r", 1, 1, 1, 0, 0)]
    assert [r["project"] for r in overview.projects(spark.createDataFrame([("a", 1), ("b", 5), ("a", 2)], "project string, started int")).collect()] == ["b", "a"]
    keys = overview.alert_keys(spark.createDataFrame([("k", "f")], "kind string, file string"), ["kind", "file"]).first()["key"]
    assert len(keys) == 16
