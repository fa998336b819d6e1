import random

import pytest

from loomwork.operators import matching, names, structure


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


EXPORTS = "path string, name string, local string, source string, source_name string, common_js boolean"
BINDINGS = "path string, local string, imported string, target string"


def resolve(spark, uses, symbols, exports, bindings):
    found = names.resolved_names(
        frame(spark, uses, "use_id int, path string, name string, object string"), frame(spark, symbols, "path string, name string"),
        frame(spark, exports, EXPORTS), frame(spark, bindings, BINDINGS),
    )
    return {r["use_id"]: (r["path"], r["symbol"], r["via"]) for r in found.collect()}


def test_a_name_through_forty_files_and_round_in_circles(spark):
    """Files f0 to f39 export x again from the next one; g0 to g4 do so in a circle."""
    exports = [(f"f{k}", "x", None, f"f{k + 1}", None, False) for k in range(40)] + [("f40", "x", "inner", None, None, False)]
    exports += [(f"g{k}", "x", None, f"g{(k + 1) % 5}", None, False) for k in range(5)] + [("tail", "x", None, "g0", None, False)]
    symbols = [("f40", "inner"), ("main", "mine")]
    bindings = [("main", "a", "x", "f0"), ("main", "b", "x", "g0"), ("main", "c", "x", "f37"), ("main", "mine", "x", "f0"), ("main", "d", "x", "tail")]
    uses = [(1, "main", "a", None), (2, "main", "b", None), (3, "main", "c", None), (4, "main", "mine", None), (5, "main", "nothing", None), (6, "main", "d", None)]
    assert resolve(spark, uses, symbols, exports, bindings) == {1: ("f40", "inner", "imported"), 3: ("f40", "inner", "imported"), 4: ("main", "mine", "own")}


def test_names_by_every_rule(spark):
    symbols = [("lib", "one"), ("lib", "two"), ("cjs", "f"), ("deep", "z"), ("lib", "default")]
    exports = [("lib", "renamed", "one", None, None, False), ("cjs", "f", None, None, None, True), ("again", "y", "z2", None, None, False), ("lib", "gone", "lost", None, None, False), ("star", "q", None, "lib", "two", False)]
    bindings = [
        ("m", "r", "renamed", "lib"), ("m", "two", "two", "lib"), ("m", "ns", "*", "lib"), ("m", "cjs", "default", "cjs"), ("m", "dflt", "default", "lib"), ("m", "pkg", "thing", None),
        ("again", "z2", "z", "deep"), ("m", "y", "y", "again"), ("m", "g", "gone", "lib"), ("m", "q", "q", "star"), ("m", "other", "default", "lib"),
    ]
    uses = [
        (1, "m", "r", None), (2, "m", "two", None), (3, "m", "one", "ns"), (4, "m", "f", "cjs"), (5, "m", "dflt", None), (6, "m", "pkg", None), (7, "m", "y", None), (8, "m", "g", None),
        (9, "m", "renamed", "ns"), (10, "m", "q", None), (11, "m", "f", "other"), (12, "m", "ns", None), (None, "m", "r", None), (14, None, "r", None),
    ]
    got = resolve(spark, uses, symbols, exports, bindings)
    assert got == {
        1: ("lib", "one", "imported"), 2: ("lib", "two", "imported"), 3: ("lib", "one", "namespace"), 4: ("cjs", "f", "namespace"), 7: ("deep", "z", "imported"),
        9: ("lib", "one", "namespace"), 10: ("lib", "two", "imported"), None: ("lib", "one", "imported"),
    }
    empty = names.resolved_names(frame(spark, [], "use_id int, path string, name string, object string"), frame(spark, symbols, "path string, name string"), frame(spark, exports, EXPORTS), frame(spark, bindings, BINDINGS))
    assert empty.count() == 0


def test_calls_link_to_functions_only(spark):
    calls = frame(spark, [("h", "m", "r", None), ("h", "m", "r", None), ("h", "m", "v", None)], "caller string, path string, name string, object string")
    symbols = frame(spark, [("lib", "one", "function"), ("lib", "v", "variable")], "path string, name string, kind string")
    bindings = frame(spark, [("m", "r", "one", "lib"), ("m", "v", "v", "lib")], BINDINGS)
    assert [tuple(r) for r in names.linked_calls(calls, symbols, frame(spark, [], EXPORTS), bindings).collect()] == [("h", "lib", "one", 2)]


def visit(routes, method, path):
    """Routes that answer a path, walked one by one: the cheapest, all ties."""
    parts = [p for p in path.split("/") if p]
    found = []
    for i, verb, pattern in routes:
        if method is not None and verb not in (method, "ANY"):
            continue
        want, cost, k = [p for p in pattern.split("/") if p], 0, 0
        for w in want:
            if w.startswith(":") and w.endswith("*"):
                found.append((cost + 1, i))
                k = None
                break
            if k >= len(parts) or (not w.startswith(":") and (parts[k] != w or parts[k] == ":param")):
                k = None
                break
            cost += w.startswith(":")
            k += 1
        if k is not None and k == len(parts):
            found.append((cost, i))
    return {(i, c) for c, i in found if c == min(found)[0]}


def test_routes_of_a_tree_against_each_route(spark):
    rng = random.Random(3)
    segments = ["api", "api", "users", "me", ":id", ":x"]
    routes = [(k, rng.choice(["GET", "POST", "ANY"]), "/" + "/".join(rng.choices(segments, k=rng.randrange(5)) + rng.choice([[], [], [":rest*"]]))) for k in range(150)]
    asked = [(k, rng.choice(["GET", "POST", None]), "/" + "/".join(rng.choices(["api", "users", "me", "7", ":param"], k=rng.randrange(6)))) for k in range(200)]
    got = matching.match_routes(frame(spark, asked, "request_id int, method string, path string"), frame(spark, routes, "route_id int, method string, path string"))
    assert {tuple(r) for r in got.collect()} == {(k, i, c) for k, m, p in asked for i, c in visit(routes, m, p)}


def test_answers_of_other_readers(spark):
    routes = [(1, "js", "GET", "/a/:id"), (2, "py", "GET", "/a/:id"), (3, "py", "POST", "/b"), (4, "go", "POST", "/b"), (5, "go", "ANY", "/:all*")]
    asked = [(1, "js", "GET", "/a/3"), (2, "py", "GET", "/zzz"), (3, "js", "POST", "/b"), (4, "js", None, "/b"), (5, "go", "GET", "/a/1"), (6, "js", "GET", None)]
    got = matching.answered_elsewhere(frame(spark, asked, "request_id int, reader string, method string, path string"), frame(spark, routes, "route_id int, reader string, method string, path string"))
    assert {tuple(r) for r in got.collect()} == {(2, 5, 1, "sure"), (3, 3, 0, "sure"), (3, 4, 0, "sure"), (4, 3, 0, "possible"), (4, 4, 0, "possible")}


@pytest.mark.parametrize("width", [1.0, 7.0, 1000.0])
def test_innermost_ranges_of_a_busy_key(spark, width):
    rng = random.Random(5)
    ranges = [(0 if k % 3 else k % 5, k, float(a := rng.randrange(-50, 200)), float(a + rng.randrange(-2, 40))) for k in range(600)]
    points = [(k, 0 if k % 3 else k % 5, float(rng.randrange(-60, 260)) / 2) for k in range(500)] + [(900, 0, None), (901, None, 1.0)]
    got = matching.innermost(frame(spark, points, "point_id int, key int, x double"), frame(spark, ranges, "key int, range_id int, start double, end double"), "key", "x", width)
    want = set()
    for i, key, x in points:
        met = [(s, -r) for k, r, s, e in ranges if x is not None and k == key and s <= x <= e]
        if met:
            want.add((i, -max(met)[1], max(met)[0]))
    assert {tuple(r) for r in got.collect()} == want


def test_where_files_run_against_recursion(spark):
    from loomwork.operators import placing

    rng = random.Random(8)
    names_ = [f"{'pages/' if k % 11 == 0 else ''}f{k}" for k in range(120)]
    kind = {n: rng.choice(["ts", "ts", "tsx", "js", "html", "css"]) for n in names_}
    says = {n: [d for d in ("use client", "use server") if rng.random() < 0.12] for n in names_}
    links = [(a, rng.choice([*names_, None]), rng.random() < 0.1) for a in names_ for _ in range(rng.randrange(3))]
    after = {n: [t for f, t, only in links if f == n and t and not only] for n in names_}
    client, server, rendered = set(), set(), set()

    def visit(p):
        if p in client or kind[p] not in placing.CODE or "use server" in says[p]:
            return
        client.add(p)
        for t in after[p]:
            visit(t)

    def serve(p):
        if p in server or "use client" in says[p]:
            return
        server.add(p)
        for t in after[p]:
            serve(t)

    for n in names_:
        if kind[n] == "html":
            for t in after[n]:
                visit(t)
        if "use client" in says[n]:
            visit(n)
        if n.startswith("pages/") and kind[n] in placing.CODE:
            rendered.add(n)
            visit(n)
    for n in names_:
        if kind[n] in placing.CODE and (n not in client or n in rendered):
            serve(n)
    want = {n: "client" if kind[n] == "html" else "both" if n in client and n in server else "client" if n in client else "server" for n in names_ if kind[n] != "css"}
    files = frame(spark, [(n, kind[n], says[n]) for n in names_], "path string, language string, directives array<string>")
    got = placing.where_files_run(files, frame(spark, links, "from string, target string, type_only boolean"), pages_router=True)
    assert {r["path"]: r["runs_on"] for r in got.collect()} == want


def test_sums_below_every_step_of_deep_and_broad_trees(spark):
    rng = random.Random(9)
    steps = [("deep", k, k - 1 if k else None, "boundary" if k % 3 == 0 else "function", k % 7 == 0) for k in range(10_000)]
    steps += [("broad", k, 0 if k else None, "function", None) for k in range(500)] + [("lost", 1, 99, None, False), (None, 1, None, "boundary", True), ("deep", None, 5, "function", False)]
    steps += [("random", k, rng.randrange(k) if k and rng.random() < 0.95 else None, rng.choice(["boundary", "function"]), rng.random() < 0.3) for k in range(800)]
    want = {}
    for trace in {s[0] for s in steps if s[0] is not None}:
        mine = {s[1]: s for s in steps if s[0] == trace and s[1] is not None}
        below = {i: [0, 0, 0] for i in mine}
        for i in sorted(mine, reverse=True):  # parents have smaller numbers
            up = mine[i][2]
            if up in mine and up != i:
                add = [mine[i][3] != "boundary", mine[i][3] == "boundary", bool(mine[i][4])]
                below[up] = [a + b + int(c) for a, b, c in zip(below[up], below[i], add)]
        want |= {(trace, i): tuple(v) for i, v in below.items()}
    got = structure.collected(frame(spark, [s for s in steps if s[0] is not None and s[1] is not None], "trace string, id int, parent int, type string, error boolean"))
    assert {(r["trace"], r["id"]): (r["functions"], r["boundaries"], r["errors"]) for r in got.collect()} == want
    assert structure.collected(frame(spark, [], "trace string, id int, parent int, type string, error boolean")).count() == 0
    with pytest.raises(ValueError):
        structure.collected(frame(spark, [("c", 1, 2, "function", False), ("c", 2, 1, "function", False)], "trace string, id int, parent int, type string, error boolean"))


def test_what_python_files_are(spark):
    from loomwork.functions import code
    from loomwork.operators import placing

    texts = {
        "pkg/__init__.py": '"""Only words."""\n', "pkg/sub/__init__.py": "x = 1\n", "test_a.py": "def test(): pass", "web/main.py": "from fastapi import FastAPI\napp = FastAPI()",
        "web/pages.py": "@app.get('/x')\ndef x(): ...", "web/hooks.py": "@bp.before_request\ndef f(): ...", "cmd.py": "import click", "web/bp.py": "import flask\nbp = flask.Blueprint('a', __name__)",
        "store/tables.py": "from sqlalchemy.orm import DeclarativeBase\nclass A(Base):\n    __tablename__ = 'a'", "store/sql.py": "from sqlmodel import SQLModel\nclass A(SQLModel, table=True): ...",
        "store/client.py": "import sqlalchemy\nengine = sqlalchemy.create_engine('x')", "store/use.py": "from store.client import engine", "store/routes.py": "from store.client import engine\n@r.post('/y')\ndef y(): ...",
        "deep/use.py": "import json", "conf/settings.py": "A = 1", "call.py": "import requests", "mailer.py": "", "find.py": "current_app.elasticsearch.index(1)", "bad.py": "def (", "plain.py": "print(1)",
        "back/services/x.py": "def f(): ...", "back/scripts/x.py": "def f(): ...", "string_utils.py": "def f(): ...", "migrations/1.py": "def up(): ...",
    }
    files = frame(spark, list(texts.items()), "path string, text string")
    links = frame(spark, [("store/use.py", "store/client.py"), ("store/routes.py", "store/client.py"), ("deep/use.py", "store/use.py")], "from string, target string")
    profile = placing.python_profile(files, code.read_python(files))
    got = {r["path"]: (r["block"], r["rule"], r["runs_on"]) for r in placing.python_layers(profile, links, ["back"]).collect()}
    rule = {p: r[1] for p, r in got.items()}
    assert rule == {
        "pkg/__init__.py": "python:package-marker", "pkg/sub/__init__.py": "no-rule", "test_a.py": "test-file", "web/main.py": "python:app-entry", "web/pages.py": "python:routes",
        "web/hooks.py": "python:request-hooks", "cmd.py": "python:cli", "web/bp.py": "python:blueprint", "store/tables.py": "python:models", "store/sql.py": "python:models",
        "store/client.py": "database-client", "store/use.py": "database-queries", "store/routes.py": "python:routes", "deep/use.py": "no-rule", "conf/settings.py": "python:settings",
        "call.py": "outgoing-call", "mailer.py": "python:email", "find.py": "python:search", "bad.py": "unreadable", "plain.py": "no-rule", "back/services/x.py": "folder:services",
        "back/scripts/x.py": "folder:scripts", "string_utils.py": "utilities", "migrations/1.py": "python:alembic-migration",
    }
    assert got["pkg/__init__.py"][2] is None and got["store/use.py"] == ("data", "database-queries", "server")


def test_all_places_of_copied_stretches(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    own = lambda n: [word() for _ in range(n)]
    a, b, c = own(30), own(25), own(12)
    texts = {1: own(9) + a + own(5) + b, 2: own(3) + a + b, 3: a + own(4) + c, 4: own(2) + b + own(6) + b, 5: c[:9] + own(3), 6: ["x", "y"] * 40, 7: ["x", "y"] * 40, 8: own(4), 9: a[:20] + own(2)}
    rows = [(d, w, [k // 2 + 1 for k in range(len(w))]) for d, w in texts.items()]
    got = structure.duplicated(frame(spark, rows, "doc long, tokens array<string>, lines array<int>"), n=10, least_lines=4)
    found = {}
    for r in got.collect():
        assert texts[r["doc"]][r["at"] : r["at"] + r["length"]] and r["line"] == r["at"] // 2 + 1
        found.setdefault(r["stretch"], set()).add((r["doc"], r["at"], r["length"]))
    assert sorted(found.values(), key=sorted) == sorted([
        {(1, 9, 20), (2, 3, 20), (3, 0, 20), (9, 0, 20)},  # the part of a that four places have
        {(1, 20, 19), (2, 14, 19), (3, 11, 19)},  # and what goes on in three of them
        {(1, 44, 25), (2, 33, 25), (4, 2, 25), (4, 33, 25)},
    ], key=sorted)
    for places in found.values():
        assert len({tuple(texts[d][p : p + n]) for d, p, n in places}) == 1
    assert structure.duplicated(frame(spark, [], "doc long, tokens array<string>, lines array<int>")).count() == 0
