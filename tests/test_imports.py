from loomwork.operators import structure

FILES = ["a.ts", "a.tsx", "a/index.ts", "b/index.js", "c.mts", "c.d.ts", "d.js", "d.ts", "e.json", "f.cts", "g", "g.ts", "lib/a.css", "lib/g.mjs", "two/h.ts"]


def test_endings_in_their_order(spark):
    want = {
        "./a": "a.ts", "./a.js": "a.ts", "./a/": "a/index.ts", "./b": "b/index.js", "./c.mjs": "c.mts", "./c.d": "c.d.ts", "./d": "d.ts", "./d.js": "d.js", "./d.cjs": "d.ts", "./e": "e.json", "./f.js": "f.cts",
        "./g": "g", "/g.ts": "g.ts", "@/a": "lib/a.css", "@/g": "lib/g.mjs", "@/h": "two/h.ts", "@/none": None, "./none.js": None, "p/x": None, "./": None, "": None, None: None,
    }
    files = spark.createDataFrame([(p,) for p in [*FILES, "a.ts"]], "path string")
    imports = spark.createDataFrame([("x.ts", s, k) for k, s in enumerate(want)], "from string, specifier string, line int")
    aliases = [("@/*", "lib/*"), ("@/*", "two/*")]
    want["./a/"] = None  # a folder's slash is part of the path
    found = structure.with_targets(imports, files, aliases)
    assert found.columns == ["from", "specifier", "line", "target", "package"]
    assert {r["specifier"]: r["target"] for r in found.collect()} == want
    assert structure.resolved_imports(imports.union(imports), files, aliases).count() == len(want)
    got = structure.imported(imports.union(imports), files, aliases)
    assert sorted(r["target"] for r in got.collect()) == sorted({t for t in want.values() if t})


def test_imports_have_no_row_for_each_ending(spark):
    rows = structure._rooted(spark.createDataFrame([("x.ts", "./a.js")], "from string, specifier string"), [("@/*", "*")])
    assert rows.first()["roots"] == ["a.js"]
    known = structure._known_roots(spark.createDataFrame([("a.ts",)], "path string"))
    assert sorted((r["root"], r["place"]) for r in known.collect()) == [("a", 1), ("a.cjs", 25), ("a.js", 25), ("a.mjs", 25), ("a.ts", 0)]
