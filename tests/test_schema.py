import random

from loomwork.operators import schema


def test_statements_are_cut_outside_of_quotes_and_comments():
    text = "-- a;b\ncreate table x (a int); /* ; */\n\ninsert into y values ('it''s; \n x');\ndo $f$ begin; end $f$;\n\n  select \"a;b\" ;;"
    assert schema.statements(text) == [(2, "create table x (a int)"), (4, "insert into y values ('it''s; \n x')"), (6, "do $f$ begin; end $f$"), (8, 'select "a;b"')]
    assert schema.statements("") == [] and schema.statements("a") == [(1, "a")] and schema.statements("x" * 300_000 + ";") == [(1, "x" * 300_000)]


def test_what_statements_say():
    text = """create table if not exists public."Users" (
  id bigint generated always as identity primary key, name varchar(20) not null default 'a,b', age int references other(k) unique,
  constraint p primary key (id, name), foreign key (age) references t2 (x), unique (age), check (age > 0), like y including all);
alter table only users add column if not exists a.b text, drop column c cascade, drop constraint q, rename column d to e, add constraint z unique (f);
create temp table q as select 1; drop table if exists a, "B" cascade; alter table x rename to y"""
    found = [(r[1], r[2], r[3], *r[4:7], r[7], *r[8:]) for r in schema.ddl(text)]
    assert found == [
        ("create", "Users", None, *[None] * 8),
        ("column", "Users", None, "add", "id", None, "bigint", True, False, False, None),
        ("column", "Users", None, "add", "name", None, "varchar(20)", False, False, False, None),
        ("column", "Users", None, "add", "age", None, "int", False, True, True, "other.k"),
        ("column", "Users", None, "set", "id", None, None, True, False, None, None), ("column", "Users", None, "set", "name", None, None, True, False, None, None),
        ("column", "Users", None, "set", "age", None, None, None, None, None, "t2.x"), ("column", "Users", None, "set", "age", None, None, None, None, True, None),
        ("column", "users", None, "add", "a.b", None, "text", False, True, False, None), ("column", "users", None, "drop", "c", None, *[None] * 5),
        ("column", "users", None, "rename", "d", "e", *[None] * 5), ("column", "users", None, "set", "f", None, None, None, None, True, None),
        ("create", "q", None, *[None] * 8), ("drop", "a", None, *[None] * 8), ("drop", "B", None, *[None] * 8), ("rename", "x", "y", *[None] * 8),
    ]


def in_turn(files):
    """Tables after all statements, run one after the other."""
    tables = {}
    for _, text in sorted(files):
        for _, what, table, to, action, name, new, kind, key, nullable, unique, references in schema.ddl(text):
            if what == "create":
                tables[table] = []
            elif what == "drop":
                tables.pop(table, None)
            elif table not in tables:
                continue
            elif what == "rename":
                tables[to] = tables.pop(table)
            elif action == "add":
                tables[table] = [c for c in tables[table] if c[0] != name] + [[name, kind, key, nullable, unique, references]]
            elif action == "drop":
                tables[table] = [c for c in tables[table] if c[0] != name]
            else:
                for c in tables[table]:
                    if c[0] == name:
                        if action == "rename":
                            c[0] = new
                        else:
                            c[2], c[3], c[4] = c[2] or bool(key), c[3] and nullable is not False, c[4] or bool(unique)
                            c[5] = references or c[5]
                        break
    return tables


def test_replay_against_running_in_turn(spark):
    rng = random.Random(12)
    t = lambda: f"t{rng.randrange(4)}"
    c = lambda: f"c{rng.randrange(4)}"
    serial = iter(range(10_000))
    kinds = [
        lambda: f"create table {t()} (id int primary key, {c()} text not null)", lambda: f"create table {t()} ({c()} int references x(y), {c()} int, unique ({c()}))", lambda: f"alter table {t()} add {c()} int default 3",
        lambda: f"alter table {t()} rename to {t()}", lambda: f"alter table {t()} rename {c()} to r{next(serial)}", lambda: f"drop table {t()}", lambda: f"alter table {t()} drop {c()}",
        lambda: f"alter table {t()} add primary key ({c()}), add foreign key ({c()}) references z", lambda: f"alter table {t()} rename to u{next(serial)}, add {c()} text unique", lambda: "select 1",
    ]
    projects = {f"p{k}": [(f"f{n:03}", ";\n".join(rng.choice(kinds)() for _ in range(rng.randrange(1, 6)))) for n in range(rng.randrange(1, 12))] for k in range(40)}
    projects["none"] = [("a", None), ("b", "")]
    sources = spark.createDataFrame([(p, path, text, "x") for p, files in projects.items() for path, text in files], "project string, path string, text string, name string")
    got = {}
    for r in schema.replayed(schema.schema_statements(sources)).collect():
        got.setdefault(r["project"], {})[r["table"]] = [list(x) for x in r["columns"]]
    want = {p: tables for p, files in projects.items() if (tables := in_turn([(a, b or "") for a, b in files]))}
    # In a row of its own definition a column stands once: of two in one table the later one counts.
    want = {p: {n: [x for k, x in enumerate(cols) if x[0] not in [y[0] for y in cols[k + 1 :]]] for n, cols in tables.items()} for p, tables in want.items()}
    assert got == want
    assert schema.replayed(schema.schema_statements(sources.limit(0))).count() == 0


def test_only_scopes_with_renamings_of_nothing_are_followed_anew(spark, monkeypatch):
    rows = [("p", k, "open", f"t{k}", None) for k in range(20)]
    rows += [("q", 0, "rename", "x", "a"), ("q", 1, "open", "a", None), ("q", 2, "rename", "x", "a"), ("q", 3, "rename", "a", "b"), ("q", 4, "rename", "y", "b")]
    events = spark.createDataFrame(rows, "project string, k long, kind string, name string, to string")
    sizes, plainly = [], schema.written
    monkeypatch.setattr(schema, "written", lambda df, name: (kept := plainly(df, name), sizes.append((name, kept.count())))[0])
    found, final = schema.followed_names(events, ["project"], ["k"])
    assert {(r["project"], r["identity"]["k"], r["name"]) for r in final.collect()} == {("p", k, f"t{k}") for k in range(20)} | {("q", 1, "b")}
    assert {r["k"]: r["identity"] and r["identity"]["k"] for r in found.where("project = 'q'").collect()} == {0: None, 1: 1, 2: None, 3: 1, 4: None}
    rounds = [n for name, n in sizes if name == "named"]
    assert len(rounds) > 2 and rounds[0] > 20 and max(rounds[1:-1]) < 10
