"""Queries about modules: names, routes, places where files run, trees of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import sqltext
from loomwork.operators import matching, names, placing, schema, structure
from loomwork.plans.graph_queries import _FOLLOWED, _followed
from loomwork.plans.registry import query, table
from loomwork.storage import written

# Orders as files: each exports its customer's names again from the customer's next order, the last one has
# the symbols (unless it is pending), and some customers' last order takes them from the first, in a circle.
_CHAIN_SQL = """o AS (SELECT o_orderkey AS path, o_custkey AS c, o_orderstatus AS s, lead(o_orderkey) OVER w AS following, first_value(o_orderkey) OVER w AS head
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
chain AS (SELECT path, c, CASE WHEN following IS NOT NULL THEN following WHEN c % 9 = 0 THEN head END AS source, following IS NULL AND c % 9 <> 0 AND s <> 'P' AS defines FROM o)"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"), F.lead("o_orderkey").over(w).alias("following"), F.first("o_orderkey").over(w).alias("head")
    )
    source = F.when(F.col("following").isNotNull(), F.col("following")).when(F.col("c") % 9 == 0, F.col("head"))
    return orders.select("path", "c", source.alias("source"), (F.col("following").isNull() & (F.col("c") % 9 != 0) & (F.col("s") != "P")).alias("defines"))


@query(f"""
WITH RECURSIVE {_CHAIN_SQL},
u AS (SELECT l_orderkey * 10 + l_linenumber AS use_id, l_orderkey AS target, l_linenumber % 3 AS k FROM lineitem),
walk AS (SELECT path AS start, path AS place FROM chain UNION SELECT start, source FROM walk JOIN chain ON path = place WHERE source IS NOT NULL)
SELECT DISTINCT use_id, place AS path, 'f' || k AS symbol, CASE WHEN k = 2 THEN 'namespace' ELSE 'imported' END AS via
FROM u JOIN walk ON start = target JOIN chain ON path = place WHERE defines""")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = _chain(spark, sf_dir)
    three = F.explode(F.array(F.lit("f0"), F.lit("f1"), F.lit("f2")))
    exports = chain.select("path", three.alias("name"), F.lit(None).cast("string").alias("local"), "source", F.lit(None).cast("string").alias("source_name"))
    symbols = chain.where("defines").select("path", three.alias("name"))
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("use_id"), F.col("l_orderkey").alias("target"), (F.col("l_linenumber") % 3).alias("k"))
    lines = written(lines.distinct(), "lines")
    user = -F.col("use_id")  # each line is a file of its own that imports from its order
    bindings = lines.select(user.alias("path"), F.lit("x").alias("local"), F.when(F.col("k") == 2, "*").otherwise(F.concat(F.lit("f"), "k")).alias("imported"), "target")
    uses = lines.select("use_id", user.alias("path"), F.when(F.col("k") == 2, F.lit("f2")).otherwise("x").alias("name"), F.when(F.col("k") == 2, "x").alias("object"))
    return names.resolved_names(uses, symbols, exports, bindings)


_ROUTES = [
    ("js", 1, "GET", "/"), ("js", 2, "GET", "/en/:page"), ("js", 3, "POST", "/en/:page"), ("py", 4, "GET", "/en/:page"), ("py", 5, "ANY", "/:lang/:page"), ("py", 6, "GET", "/:all*"),
    ("go", 7, "GET", "/en/:other"), ("go", 8, "GET", "/:all*"), ("go", 9, "POST", "/fr/:id/:rest*"), ("js", 10, "GET", "/es/:a/:b"),
]


@query("""
WITH q AS (SELECT page_id, ['js', 'py', 'go'][1 + page_id % 3] AS reader, CASE WHEN page_id % 4 <> 0 THEN 'GET' END AS method,
  coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/') AS path FROM pages),
r(of_reader, id, verb, pattern, params) AS (VALUES ('js', 1, 'GET', '^/$', 0), ('js', 2, 'GET', '^/en/[^/]+/?$', 1), ('js', 3, 'POST', '^/en/[^/]+/?$', 1), ('py', 4, 'GET', '^/en/[^/]+/?$', 1),
  ('py', 5, 'ANY', '^/[^/]+/[^/]+/?$', 2), ('py', 6, 'GET', '^/.*$', 1), ('go', 7, 'GET', '^/en/[^/]+/?$', 1), ('go', 8, 'GET', '^/.*$', 1), ('go', 9, 'POST', '^/fr/[^/]+(/.*)?$', 2), ('js', 10, 'GET', '^/es/[^/]+/[^/]+/?$', 2)),
m AS (SELECT * FROM q JOIN r ON regexp_matches(path, pattern) AND (method IS NULL OR verb = method OR verb = 'ANY')),
e AS (SELECT *, rank() OVER (PARTITION BY page_id ORDER BY params) AS k FROM m WHERE reader <> of_reader AND page_id NOT IN (SELECT page_id FROM m WHERE reader = of_reader))
SELECT page_id AS request_id, CAST(id AS BIGINT) AS route_id, CAST(params AS INT) AS params, CASE WHEN method IS NULL THEN 'possible' ELSE 'sure' END AS confidence FROM e WHERE k = 1""")
def routes_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.functions.text import path_of

    routes = spark.createDataFrame(_ROUTES, "reader string, route_id long, method string, path string")
    reader = F.get(F.array(F.lit("js"), F.lit("py"), F.lit("go")), (F.col("page_id") % 3).cast("int"))
    requests = table(spark, sf_dir, "pages").select(F.col("page_id").alias("request_id"), reader.alias("reader"), F.when(F.col("page_id") % 4 != 0, "GET").alias("method"), path_of(F.col("url")).alias("path"))
    return matching.answered_elsewhere(requests, routes)


# Parts as files: a language and directives by key; a part imports the part of an order's next line (as graph_queries has it).
@query(f"""
WITH RECURSIVE {_FOLLOWED},
f AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 41 = 0 THEN 'html' WHEN p_partkey % 10 = 1 THEN 'css' ELSE 'ts' END AS language,
  p_partkey % 53 = 3 AS wants_client, p_partkey % 9 = 4 AS wants_server FROM part),
l AS (SELECT src, dst FROM e WHERE (src + dst) % 7 <> 0),
c AS (SELECT path FROM f WHERE language = 'ts' AND NOT wants_server AND (wants_client OR path IN (SELECT dst FROM l JOIN f h ON h.path = src AND h.language = 'html'))
  UNION SELECT dst FROM c JOIN l ON src = c.path JOIN f ON f.path = dst WHERE language = 'ts' AND NOT wants_server),
s AS (SELECT path FROM f WHERE language = 'ts' AND NOT wants_client AND path NOT IN (SELECT path FROM c)
  UNION SELECT dst FROM s JOIN l ON src = s.path JOIN f ON f.path = dst WHERE NOT wants_client)
SELECT path, CASE WHEN language = 'html' THEN 'client' WHEN path IN (SELECT path FROM c) THEN CASE WHEN path IN (SELECT path FROM s) THEN 'both' ELSE 'client' END ELSE 'server' END AS runs_on
FROM f WHERE language <> 'css'""")
def where_files_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    language = F.when(key % 41 == 0, "html").when(key % 10 == 1, "css").otherwise("ts")
    directives = F.array_compact(F.array(F.when(key % 53 == 3, "use client"), F.when(key % 9 == 4, "use server")))
    files = table(spark, sf_dir, "part").select(key.alias("path"), language.alias("language"), directives.alias("directives"))
    links = _followed(spark, sf_dir).select(F.col("src").alias("from"), F.col("dst").alias("target"), ((F.col("src") + F.col("dst")) % 7 == 0).alias("type_only"))
    return placing.where_files_run(files, links)


# Events of a user as a tree: heaps for even users, chains for odd ones.
@query("""
WITH RECURSIVE n AS (SELECT user_id AS trace, event_id AS id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
t AS (SELECT a.trace, a.id, b.id AS parent, a.event_type IN ('view', 'click') AS is_function, a.value > 20 AS error FROM n a
  LEFT JOIN n b ON a.trace = b.trace AND b.k = CASE WHEN a.trace % 2 = 0 THEN a.k // 2 ELSE a.k - 1 END),
d AS (SELECT trace, parent AS top, id FROM t WHERE parent IS NOT NULL UNION ALL SELECT d.trace, t.parent, d.id FROM d JOIN t ON t.trace = d.trace AND t.id = d.top WHERE t.parent IS NOT NULL),
s AS (SELECT d.trace, top, count_if(is_function) AS functions, count_if(NOT is_function) AS boundaries, count_if(coalesce(error, false)) AS errors FROM d JOIN t ON t.trace = d.trace AND t.id = d.id GROUP BY ALL)
SELECT t.trace, t.id, coalesce(functions, 0) AS functions, coalesce(boundaries, 0) AS boundaries, coalesce(errors, 0) AS errors FROM t LEFT JOIN s ON s.trace = t.trace AND top = t.id""")
def collected_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    ranked = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), F.col("event_id").alias("id"), "event_type", "value", F.row_number().over(w).alias("k"))
    above = ranked.select("trace", F.col("k").alias("above"), F.col("id").alias("parent"))
    place = F.when(F.col("trace") % 2 == 0, F.floor(F.col("k") / 2)).otherwise(F.col("k") - 1)
    steps = ranked.withColumn("above", place).join(above, ["trace", "above"], "left")
    kind = F.when(F.col("event_type").isin("view", "click"), "function").otherwise("boundary")
    return structure.collected(steps.select("trace", "id", "parent", kind.alias("type"), (F.col("value") > 20).alias("error")))


_FOLDERS = ["app/x", "app/models", "api/routers", "core", "db", "pkg", "tests", "migrations", "services"]
_TOPS = ["json", "sqlalchemy", "requests", "click", "os", "flask_mail", "redis"]
_CALLS = ["print", "sqlalchemy.create_engine", "FastAPI", "app.get", "Blueprint", "client.elasticsearch.index"]


# Orders as Python files, each importing the customer's next one.
@query(f"""
WITH o AS (SELECT o_orderkey, o_custkey, {_FOLDERS}[1 + o_orderkey % 9] AS folder, {_TOPS}[1 + o_custkey % 7] AS top, {_CALLS}[1 + o_orderkey % 6] AS called, o_orderkey % 4 = 0 AS decorated,
  o_orderkey % 50 = 7 AS broken, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS target FROM orders),
r AS (SELECT *, CASE WHEN broken THEN 'unreadable' WHEN folder = 'tests' THEN 'test-file' WHEN folder = 'migrations' THEN 'python:alembic-migration' WHEN called = 'FastAPI' THEN 'python:app-entry'
  WHEN decorated AND called = 'app.get' THEN 'python:routes' WHEN top = 'click' THEN 'python:cli' WHEN called = 'Blueprint' THEN 'python:blueprint' WHEN folder = 'api/routers' THEN 'folder:routers'
  WHEN folder = 'app/models' THEN 'python:models' WHEN top IN ('sqlalchemy', 'redis') AND called = 'sqlalchemy.create_engine' THEN 'database-client' END AS early FROM o),
q AS (SELECT r.*, CASE WHEN r.early IS NOT NULL THEN r.early WHEN t.early IN ('database-client', 'python:models') THEN 'database-queries' WHEN r.folder = 'db' THEN 'folder:data'
  WHEN r.folder = 'services' THEN 'folder:services' WHEN r.top = 'requests' THEN 'outgoing-call' WHEN r.top = 'flask_mail' THEN 'python:email' WHEN contains(r.called, 'elasticsearch') THEN 'python:search'
  WHEN r.folder = 'core' THEN 'folder:lib' ELSE 'no-rule' END AS rule FROM r LEFT JOIN r t ON t.o_orderkey = r.target)
SELECT folder || '/m' || o_orderkey || '.py' AS path, CASE WHEN rule IN ('unreadable', 'no-rule') THEN 'unknown' WHEN rule = 'test-file' THEN 'tests' WHEN rule IN ('python:app-entry', 'python:routes', 'python:blueprint', 'folder:routers') THEN 'routes'
  WHEN rule = 'python:cli' THEN 'config' WHEN rule IN ('folder:services', 'folder:lib') THEN 'logic' WHEN rule IN ('outgoing-call', 'python:email', 'python:search') THEN 'external' ELSE 'data' END AS block,
  rule, CASE WHEN rule <> 'python:alembic-migration' THEN 'server' END AS runs_on FROM q""")
def python_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, name: F.get(F.array(*[F.lit(v) for v in values]), (F.col(name) % len(values)).cast("int"))
    path = lambda: F.concat(pick(_FOLDERS, "o_orderkey"), F.lit("/m"), "o_orderkey", F.lit(".py"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", path().alias("path"))
    decorators = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("app.get"))).otherwise(F.array().cast("array<string>"))
    profile = orders.select(
        "path", F.array(pick(_TOPS, "o_custkey")).alias("top"), F.array(pick(_CALLS, "o_orderkey")).alias("calls"), F.array().cast("array<string>").alias("bases"), decorators.alias("decorators"),
        F.lit(False).alias("tables"), F.lit(False).alias("is_empty"), (F.col("o_orderkey") % 50 == 7).alias("is_error"),
    )
    following = F.lead("path").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    links = orders.select(F.col("path").alias("from"), following.alias("target")).where("target IS NOT NULL")
    return placing.python_layers(profile, links)


# Orders as files of statements on their customer's tables; the SQL runs them in turn.
@query("""
WITH RECURSIVE o AS (SELECT o_custkey AS project, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey % 8 AS what,
  't' || (o_orderkey // 8) % 3 AS t, 't' || (o_orderkey // 5) % 3 AS t2, 'c' || (o_orderkey // 3) % 3 AS c FROM orders),
run AS (SELECT DISTINCT project, 0::BIGINT AS n, []::STRUCT(name VARCHAR, cols VARCHAR[])[] AS state FROM o
UNION ALL
SELECT run.project, o.n, CASE
  WHEN what <= 2 THEN list_append(list_filter(state, lambda x: x.name <> t), {'name': t, 'cols': ['id', c]})
  WHEN what = 3 THEN list_transform(state, lambda x: CASE WHEN x.name = t THEN {'name': x.name, 'cols': list_append(list_filter(x.cols, lambda y: y <> c), c)} ELSE x END)
  WHEN what = 4 AND t <> t2 AND len(list_filter(state, lambda x: x.name = t)) > 0 THEN list_transform(list_filter(state, lambda x: x.name <> t2), lambda x: CASE WHEN x.name = t THEN {'name': t2, 'cols': x.cols} ELSE x END)
  WHEN what = 5 THEN list_transform(state, lambda x: CASE WHEN x.name = t THEN {'name': x.name, 'cols': list_transform(x.cols, lambda y: CASE WHEN y = c THEN 'd' || o.k ELSE y END)} ELSE x END)
  WHEN what = 6 THEN list_filter(state, lambda x: x.name <> t)
  WHEN what = 7 THEN list_transform(state, lambda x: CASE WHEN x.name = t THEN {'name': x.name, 'cols': list_filter(x.cols, lambda y: y <> c)} ELSE x END)
  ELSE state END
FROM run JOIN o ON o.project = run.project AND o.n = run.n + 1),
ended AS (SELECT project, unnest(state) AS s FROM run QUALIFY n = max(n) OVER (PARTITION BY project))
SELECT CAST(project AS VARCHAR) AS project, s.name AS "table", array_to_string(s.cols, ',') AS columns FROM ended""")
def replayed_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    t, t2, c = (F.concat(F.lit(p), (F.floor(key / d) % 3).cast("string")) for p, d in (("t", 8), ("t", 5), ("c", 3)))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    what = key % 8
    statement = (
        F.when(what <= 2, text("-- a table; of two\ncreate table if not exists public.", t, " (id int primary key, ", c, " varchar(20) not null default 'a,b;', constraint u unique (", c, "));"))
        .when(what == 3, text("ALTER TABLE ", t, " ADD COLUMN ", c, " int;")).when((what == 4) & (t != t2), text("alter table \"", t, "\" rename to ", t2))
        .when(what == 5, text("select ';'; alter table ", t, " rename column ", c, " to d", key.cast("string"))).when(what == 6, text("drop table if exists ", t, " cascade;"))
        .when(what == 7, text("alter table ", t, " drop column if exists ", c, ", add check (id > 0)")).otherwise("select 1")
    )
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.lpad(key.cast("string"), 12, "0").alias("path"), statement.alias("text"))
    found = schema.replayed(schema.schema_statements(files))
    return found.select("project", "table", F.array_join(F.transform("columns", lambda x: x["name"]), ",").alias("columns"))


# The tables that statements made of an order's parts write and read.
@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, 't' || o_custkey % 7 AS t, 's' || o_orderkey % 5 AS s FROM orders),
a AS (SELECT o_orderkey, t AS "table", CASE k WHEN 0 THEN 'select' WHEN 1 THEN 'upsert' WHEN 2 THEN 'update' WHEN 3 THEN 'delete' WHEN 4 THEN 'insert' ELSE 'select' END AS operation FROM o
UNION ALL SELECT o_orderkey, s, 'select' FROM o WHERE k <> 5)
SELECT "table", operation, count(*) AS n, min(o_orderkey) AS "first" FROM a GROUP BY ALL""")
def sql_table_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t, s = F.col("o_orderkey") % 6, F.concat(F.lit("t"), F.col("o_custkey") % 7), F.concat(F.lit("s"), F.col("o_orderkey") % 5)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    statement = (
        F.when(k == 0, text("select extract(year from d), 'from x' from public.", t, " join \"", s, "\" using (id) -- from y"))
        .when(k == 1, text("with w as (select * from ", s, ") insert into ", t, " select * from w on conflict (id) do update set a = 1"))
        .when(k == 2, text("UPDATE ONLY ", t, " SET a = (SELECT max(b) FROM ", s, ")")).when(k == 3, text("delete from ", t, " using ", s, " where a is distinct from b"))
        .when(k == 4, text("insert into ", t, " select * from ", s, ", generate_series(1, 2) /* from z */")).otherwise(text("select count(*) from ", t, " where b in (select * from unnest(x))"))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(sqltext.sql_tables(statement)).alias("a"))
    return rows.groupBy("a.table", "a.operation").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
