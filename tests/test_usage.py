from pyspark.sql import functions as F

from loomwork.operators import usage


def values(spark, column, rows):
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string")
    return [r["o"] for r in frame.select("k", column.alias("o")).orderBy("k").collect()]


def test_members_of_a_workspace(spark):
    patterns = [(1, "apps/*"), (1, "packages/**"), (1, "!apps/old"), (1, "tools/"), (1, "x*"), (1, "*"), (2, "apps/web"), (3, None)]
    folders = [(p, f) for p in (1, 2) for f in ("apps/web", "apps/web/deep", "packages/a", "tools", "xy", "apps")] + [(3, None), (None, "apps/web")]
    got = usage.workspace_members(spark.createDataFrame(patterns, "project int, pattern string"), spark.createDataFrame(folders, "project int, folder string"))
    assert sorted(map(tuple, got.collect())) == [(1, "apps/web"), (1, "packages/a"), (1, "tools"), (2, "apps/web")]


def test_place_of_a_tag(spark):
    note = "<!-- " + "x " * 20_000 + "-->"
    pages = ["<html><head lang='x'><title>", "<header><p>", "<p><BODY class=a>", f"{note}\n<!doctype html>\n<html lang='a'><p>", "<!doctype html><p>", "", None]
    rows = [(p, None) for p in pages]
    assert values(spark, usage.tag_position(F.col("a")), rows) == [21, -1, 3, len(note) + 1 + 15 + 1 + 15, 15, -1, None]
    assert values(spark, usage.tag_position(F.col("a"), final=False), rows) == [21, None, None, None, None, None, None]


def test_requests_of_other_origins(spark):
    rows = [("http://a.test:3000", "b.test"), ("https://A.test:443/", "a.test"), ("http://a.test:443", "a.test"), ("null", "a"), ("file:///x", "a"), (None, "a"), ("http://a", None)]
    assert values(spark, usage.cross_origin(F.col("a"), F.col("b")), rows) == ["http://a.test:3000", None, "http://a.test:443", None, None, None, None]


def test_first_places_and_hosts(spark):
    uses = spark.createDataFrame([("t", "f", n % 20) for n in range(60)] + [(None, "g", 1)], "k string, file string, line int")
    got = {r["k"]: r["proof"] for r in usage.with_proofs(uses, ["k"]).collect()}
    assert got == {"t": [f"f:{n}" for n in range(12)], None: ["g:1"]}
    calls = spark.createDataFrame([(1, "127.0.0.1", None, None, None), (2, "x.test", "E", None, None), (3, None, "E", "p", "n"), (4, None, None, "p", "n"), (5, None, None, "q", "n")], "i int, host string, env string, package string, name string")
    hosts = spark.createDataFrame([], "host string, service string, category string")
    kits = spark.createDataFrame([("p", "n", "P", "ai")], "package string, name string, service string, category string")
    assert sorted((r["i"], r["service"], r["category"]) for r in usage.service_calls(calls, hosts, kits).collect()) == [(2, "x.test", "http"), (3, "env:E", "http"), (4, "P", "ai")]
