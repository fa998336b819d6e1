"""Queries about the structure of a project, on parts as files and order lines as imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.operators import store, structure, usage
from loomwork.plans.registry import query, table


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Parts as files, and how a line's part names the one of its supplier's number: relative, with another ending, by an alias, absolute, or as a package.
_FILES = """f AS (SELECT p_partkey AS k, ['src', 'lib/api', 'src/pages', 'test'][1 + p_partkey % 4] || '/f' || p_partkey || ['.ts', '.tsx', '/index.ts'][1 + p_partkey % 3] AS path FROM part),
i AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS q, l_linenumber % 5 AS how, l_linenumber AS line FROM lineitem),
s AS (SELECT i.*, f.path AS "from", ['src', 'lib/api', 'src/pages', 'test'][1 + q % 4] || '/f' || q AS stem, t.path AS found FROM i JOIN f ON f.k = i.k LEFT JOIN f t ON t.k = i.q),
r AS (SELECT "from", line, q, how, CASE how WHEN 0 THEN repeat('../', len(string_split("from", '/')) - 1) || stem WHEN 1 THEN '/' || stem || '.js' WHEN 2 THEN '@/' || stem WHEN 3 THEN '@scope/p' || q % 9 || '/deep' ELSE 'p' || q % 9 || '/x' END AS specifier,
  CASE WHEN how IN (0, 2) OR how = 1 AND q % 3 <> 2 THEN found END AS target, CASE how WHEN 3 THEN '@scope/p' || q % 9 WHEN 4 THEN 'p' || q % 9 WHEN 2 THEN CASE WHEN found IS NULL THEN '@/' || string_split(stem, '/')[1] END END AS package FROM s)"""


def _path(key: Column) -> Column:
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (key % n).cast("int"))
    return _text(pick(["src", "lib/api", "src/pages", "test"], 4), "/f", key, pick([".ts", ".tsx", "/index.ts"], 3))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), _path(F.col("p_partkey")).alias("path"))


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, how = F.col("q"), F.col("line") % 5
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("q"), F.col("l_linenumber").alias("line"))
    lines = lines.repartition("k").distinct()  # one shuffle by part serves the distinct lines, their files and distinct imports of a file
    rows = lines.join(_files(spark, sf_dir), "k").withColumnRenamed("path", "from")
    stem = _text(F.get(F.array(*[F.lit(v) for v in ["src", "lib/api", "src/pages", "test"]]), (q % 4).cast("int")), "/f", q)
    up = F.repeat(F.lit("../"), F.size(F.split("from", "/")) - 1)
    specifier = (
        F.when(how == 0, F.concat(up, stem)).when(how == 1, _text("/", stem, ".js")).when(how == 2, F.concat(F.lit("@/"), stem))
        .when(how == 3, _text("@scope/p", q % 9, "/deep")).otherwise(_text("p", q % 9, "/x"))
    )
    return rows.select("k", "from", specifier.alias("specifier"), "line", "q")


_ALIASES = [("@/*", "*")]


@query(f"""WITH {_FILES} SELECT DISTINCT "from", specifier, target, package FROM r""")
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = _imports(spark, sf_dir).select("k", "from", "specifier").distinct()
    return structure.with_targets(imports, _files(spark, sf_dir), _ALIASES).drop("k")


@query(f"""
WITH {_FILES} SELECT "from" AS src, target AS dst, count(*) AS n, array_to_string(list_sort(list_distinct(list('n' || q % 4))), ',') AS names, array_to_string(list_sort(list_distinct(list(line))), ',') AS lines
FROM r WHERE target IS NOT NULL GROUP BY ALL""")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.with_targets(_imports(spark, sf_dir), _files(spark, sf_dir), _ALIASES).withColumn("names", F.array(_text("n", F.col("q") % 4)))
    found = structure.import_edges(rows)
    return found.select("src", "dst", "n", F.array_join("names", ",").alias("names"), F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query(f"""
WITH {_FILES} SELECT path, CASE WHEN regexp_matches(path, '^src/pages/|^lib/api/|(^|/)index[.]') THEN 'possible' ELSE 'sure' END AS certainty
FROM f WHERE path NOT IN (SELECT target FROM r WHERE target IS NOT NULL) AND NOT starts_with(path, 'test/')""")
def dead_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return structure.dead_files(files, structure.imported(_imports(spark, sf_dir), files, _ALIASES).withColumnRenamed("target", "dst"))


@query(f"""
WITH {_FILES}, e AS (SELECT path, 'n' || n AS name FROM f, range(4) AS x(n)), t AS (SELECT DISTINCT target AS path, CASE WHEN line = 6 THEN '*' ELSE 'n' || q % 4 END AS name FROM r WHERE target IS NOT NULL)
SELECT path, name FROM e WHERE path IN (SELECT path FROM t) AND path NOT IN (SELECT path FROM t WHERE name = '*') AND NOT EXISTS (SELECT 1 FROM t WHERE t.path = e.path AND t.name = e.name)""")
def unused_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("line") == 6, F.array().cast("array<string>")).otherwise(F.array(_text("n", F.col("q") % 4)))
    exports = _files(spark, sf_dir).select("path", F.explode(F.array(*[F.lit(f"n{n}") for n in range(4)])).alias("name"))
    imports = _imports(spark, sf_dir).withColumn("names", names)
    return structure.unused_exports(exports, structure.imported(imports, _files(spark, sf_dir), _ALIASES, ["names"]))


@query("""
SELECT o_custkey AS path, 'n' || o_orderkey % 3 AS name, o_orderkey AS line, o_custkey || '#n' || o_orderkey % 3 || CASE WHEN n > 1 THEN '~' || n ELSE '' END AS stable_id
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) AS n FROM orders)""")
def stable_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), _text("n", F.col("o_orderkey") % 3).alias("name"), F.col("o_orderkey").alias("line"))
    return structure.stable_symbols(rows)


# Orders as symbols of their customer's file, a tenth of their keys long; lines of orders as positions.
@query("""
WITH s AS (SELECT o_custkey AS path, 'o' || o_orderkey AS symbol, o_orderkey % 500 AS a, o_orderkey % 500 + o_orderkey % 90 AS b, CASE WHEN o_orderkey % 5 = 0 THEN 'variable' ELSE 'function' END AS kind FROM orders),
p AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS point_id, o_custkey AS path, 'o' || (l_orderkey + l_linenumber % 2) AS name, l_orderkey % 500 + l_linenumber % 3 * 20 AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT p.point_id, p.path, symbol, a, CASE WHEN symbol = name AND a = line THEN 0 WHEN a = line AND kind <> 'variable' THEN 1 WHEN a <= line AND line <= b THEN 2 END AS k FROM p LEFT JOIN s USING (path)),
n AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY k NULLS LAST, a DESC, symbol) AS place FROM m)
SELECT point_id, CASE WHEN k IS NULL THEN CAST(path AS VARCHAR) ELSE symbol END AS symbol, coalesce(['key', 'line', 'enclosing'][k + 1], 'file') AS via FROM n WHERE place = 1""")
def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    symbols = orders.select(
        F.col("o_custkey").cast("string").alias("path"), _text("o", key).alias("name"), (key % 500).alias("line"), (key % 500 + key % 90).alias("end_line"),
        F.when(key % 5 == 0, "variable").otherwise("function").alias("kind"),
    )
    line = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").distinct()
    points = rows.select(
        (F.col("l_orderkey") * 10 + line).alias("point_id"), F.col("o_custkey").cast("string").alias("path"), _text("o", F.col("l_orderkey") + line % 2).alias("name"),
        (F.col("l_orderkey") % 500 + line % 3 * 20).alias("line"),
    )
    return structure.located(points, symbols)


@query("""
WITH m AS (SELECT 'r' || n_regionkey AS holder, 'n' || n_nationkey AS child, '/n' || n_nationkey AS prefix FROM nation UNION ALL SELECT 'app', 'r' || r_regionkey, 'v1//' || r_name FROM region
  UNION ALL SELECT 'app', 'n' || n_nationkey, '/alt/[lang]' FROM nation WHERE n_nationkey % 5 = 0)
SELECT DISTINCT c_custkey AS route_id, CASE WHEN c_nationkey < 0 THEN '' ELSE '/' || regexp_replace(x, '^/+', '') END AS path FROM (
  SELECT c_custkey, c_nationkey, 'v1/' || r_name || '/n' || n_nationkey || '/c' || c_custkey || '/:id' AS x FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_custkey, c_nationkey, 'alt/:lang/c' || c_custkey || '/:id' FROM customer WHERE c_nationkey % 5 = 0)""")
def composed_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    of_nation = _text("n", F.col("n_nationkey"))
    mounts = nation.select(_text("r", F.col("n_regionkey")).alias("holder"), of_nation.alias("child"), _text("/n", F.col("n_nationkey")).alias("prefix"))
    mounts = mounts.union(region.select(F.lit("app"), _text("r", F.col("r_regionkey")), _text("v1//", F.col("r_name"))))
    mounts = mounts.union(nation.where("n_nationkey % 5 = 0").select(F.lit("app"), of_nation, F.lit("/alt/[lang]")))
    routes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("route_id"), _text("n", F.col("c_nationkey")).alias("router"), _text("/c", F.col("c_custkey"), "/{id}").alias("path"))
    return structure.composed_routes(mounts, routes)


@query("""
WITH RECURSIVE n AS (SELECT user_id AS trace, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
t AS (SELECT a.trace, a.id, b.id AS parent FROM n a LEFT JOIN n b ON a.trace = b.trace AND b.k = CASE WHEN a.trace % 2 = 0 THEN a.k // 2 ELSE a.k - 1 END),
d AS (SELECT trace, id, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.trace, t.id, depth + 1 FROM d JOIN t ON t.trace = d.trace AND t.parent = d.id)
SELECT trace, id, depth FROM d""")
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    ranked = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), F.col("event_id").alias("id"), F.row_number().over(w).alias("k"))
    above = ranked.select("trace", F.col("k").alias("above"), F.col("id").alias("parent"))
    place = F.when(F.col("trace") % 2 == 0, F.floor(F.col("k") / 2)).otherwise(F.col("k") - 1)
    return structure.tree_depth(ranked.withColumn("above", place).join(above, ["trace", "above"], "left"))


@query("""
WITH v AS (SELECT DISTINCT ['NEXT_PUBLIC_', 'VITE_', '', 'APP_'][1 + p_partkey % 4] || ['API_SECRET', 'ANON_KEY', 'PORT', 'SERVICE_ROLE_KEY', 'TOKEN'][1 + p_partkey % 5] || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '_' || p_partkey % 50 END AS name FROM part),
s AS (SELECT name FROM v WHERE contains(name, 'SERVICE_ROLE') OR (contains(name, 'SECRET') OR contains(name, 'KEY') OR contains(name, 'TOKEN')) AND NOT regexp_matches(name, '(^|_)ANON_KEY$')),
r AS (SELECT name FROM v WHERE length(name) % 3 = 0)
SELECT name, CASE WHEN starts_with(name, 'NEXT_PUBLIC_') OR starts_with(name, 'VITE_') THEN 'public-secret' ELSE 'secret-in-browser' END AS kind FROM s
WHERE starts_with(name, 'NEXT_PUBLIC_') OR starts_with(name, 'VITE_') OR name IN (SELECT name FROM r)""")
def env_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))
    name = F.concat(pick("NEXT_PUBLIC_", "VITE_", "", "APP_"), pick("API_SECRET", "ANON_KEY", "PORT", "SERVICE_ROLE_KEY", "TOKEN"), F.when(k % 3 == 0, "").otherwise(_text("_", k % 50)))
    names = table(spark, sf_dir, "part").select(name.alias("name"))
    reads = names.select("name", F.when(F.length("name") % 3 == 0, F.when(F.length("name") % 2 == 0, "client").otherwise("both")).otherwise("server").alias("runs_on"))
    return structure.env_exposure(names, reads, ["NEXT_PUBLIC_", "VITE_"])


@query("""
WITH t AS (SELECT s_suppkey AS "table", CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS rls FROM supplier WHERE s_suppkey % 10 <> 7),
u AS (SELECT l_suppkey AS "table", bool_or(l_returnflag IN ('R', 'A')) AS browser FROM lineitem WHERE l_quantity > 45 AND l_suppkey % 6 <> 5 GROUP BY ALL)
SELECT coalesce(t."table", u."table") AS "table", CASE WHEN t."table" IS NULL THEN 'used-not-defined' WHEN u."table" IS NULL THEN 'defined-never-used' WHEN rls IS NULL THEN 'rls-unknown' ELSE 'no-rls-browser' END AS kind,
  CASE WHEN t."table" IS NULL THEN 'yellow' WHEN u."table" IS NULL THEN 'info' WHEN rls IS NULL THEN 'yellow' ELSE 'red' END AS level
FROM t FULL JOIN u ON t."table" = u."table" WHERE t."table" IS NULL OR u."table" IS NULL OR browser AND rls IS NOT true""")
def data_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    tables = table(spark, sf_dir, "supplier").where(k % 10 != 7).select(k.alias("table"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("rls"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45 AND l_suppkey % 6 <> 5")
    where = F.when(F.col("l_returnflag") == "R", "client").when(F.col("l_returnflag") == "A", "both").otherwise("server")
    return structure.data_findings(tables, lines.select(F.col("l_suppkey").alias("table"), where.alias("runs_on")))


@query("""
WITH f AS (SELECT o_orderkey AS k, ['app/.env.local', '.env', '.env.production', 'x.txt'][1 + o_orderkey % 4] AS kind FROM orders)
SELECT k || '/' || kind AS path, line, variable, fact AS kind FROM f, LATERAL (VALUES
  (2, 'PAY_KEY', CASE WHEN k % 3 = 0 THEN 'live-key' END), (3, 'DATABASE_URL', CASE WHEN k % 5 <> 0 THEN 'remote-database' END),
  (4, 'NODE_ENV', CASE WHEN k % 7 < 3 THEN 'production-mode' END), (5, 'MY_SUPABASE_URL', 'remote-supabase')) AS v(line, variable, fact)
WHERE kind IN ('app/.env.local', '.env') AND fact IS NOT NULL""")
def environment_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.get(F.array(*[F.lit(v) for v in ["app/.env.local", ".env", ".env.production", "x.txt"]]), (k % 4).cast("int"))
    address = F.when(k % 5 == 0, "localhost").otherwise(_text("db", k % 9, ".example.com"))
    value = _text(
        "# notes\nexport PAY_KEY=\"", F.when(k % 3 == 0, "sk_live_").otherwise("sk_test_"), k, "\"\nDATABASE_URL=postgres://u:p@", address, "/x\nNODE_ENV=",
        F.when(k % 7 < 3, "production").otherwise("test"), " # mode\r\nMY_SUPABASE_URL='https://", k, ".supabase.co'\nnot an assignment",
    )
    return structure.environment_facts(table(spark, sf_dir, "orders").select(_text(k, "/", kind).alias("path"), value.alias("text")))


# Parts as modules of packages of packages; each order line imports its supplier's number from its part's module.
@query("""
WITH m AS (SELECT p_partkey AS k, 'app/p' || p_partkey % 5 || '/m' || p_partkey || CASE WHEN p_partkey % 6 = 0 THEN '/__init__.py' ELSE '.py' END AS path FROM part),
i AS (SELECT DISTINCT 'app/p' || l_partkey % 5 || '/m' || l_partkey || '.py' AS "from", l_suppkey AS q, l_linenumber % 4 AS how FROM lineitem)
SELECT "from", CASE how WHEN 0 THEN '..p' || q % 5 WHEN 1 THEN 'app.p' || q % 5 || '.m' || q WHEN 2 THEN '..p' || q % 5 || '.m' || q ELSE 'json' || q % 3 END AS module,
  CASE how WHEN 0 THEN 'm' || q WHEN 3 THEN 'loads' ELSE 'f' END AS name, CASE WHEN how < 3 THEN path END AS target FROM i LEFT JOIN m ON m.k = q
WHERE how < 3 UNION SELECT "from", 'json' || q % 3, 'loads', NULL FROM i WHERE how = 3""")
def python_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, q, how = F.col("p_partkey"), F.col("l_suppkey"), F.col("l_linenumber") % 4
    files = table(spark, sf_dir, "part").select(_text("app/p", k % 5, "/m", k, F.when(k % 6 == 0, "/__init__.py").otherwise(".py")).alias("path"))
    module = F.when(how == 0, _text("..p", q % 5)).when(how == 1, _text("app.p", q % 5, ".m", q)).when(how == 2, _text("..p", q % 5, ".m", q)).otherwise(_text("json", q % 3))
    name = F.when(how == 0, _text("m", q)).when(how == 3, "loads").otherwise("f")
    importer = _text("app/p", F.col("l_partkey") % 5, "/m", F.col("l_partkey"), ".py")
    imports = table(spark, sf_dir, "lineitem").select(importer.alias("from"), module.alias("module"), name.alias("name"))
    return store.python_modules(imports, files)


@query("""
WITH p(k, pattern) AS (VALUES (0, 'apps/*'), (0, '!apps/a3'), (1, 'libs/**'), (2, 'apps/a1'), (2, 'libs/l2/')),
f AS (SELECT s_suppkey AS project, x AS folder FROM supplier, (SELECT 'apps/a' || n AS x FROM range(5) AS r(n) UNION ALL SELECT 'libs/l' || n FROM range(4) AS r(n) UNION ALL SELECT 'apps/a1/deep'))
SELECT project, folder FROM f WHERE CASE project % 3 WHEN 0 THEN regexp_matches(folder, '^apps/[^/]+$') WHEN 1 THEN starts_with(folder, 'libs/') ELSE folder IN ('apps/a1', 'libs/l2') END""")
def workspace_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    projects = table(spark, sf_dir, "supplier").select(k.alias("project"))
    sets = [["apps/*", "!apps/a3"], ["libs/**"], ["apps/a1", "libs/l2/"]]
    chosen = F.get(F.array(*[F.array(*[F.lit(p) for p in s]) for s in sets]), (F.col("project") % 3).cast("int"))
    folders = [f"apps/a{n}" for n in range(5)] + [f"libs/l{n}" for n in range(4)] + ["apps/a1/deep"]
    return usage.workspace_members(projects.select("project", F.explode(chosen).alias("pattern")), projects.select("project", F.explode(F.array(*[F.lit(f) for f in folders])).alias("folder")))

