"""Queries over graphs, versions and findings, on the star schema's keys as nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.operators import diffs, graphs, matching
from loomwork.plans.registry import query, table


@query("""
WITH e AS (SELECT l_returnflag AS kind, s_nationkey AS a, c_nationkey AS b, l_orderkey * 10 + l_linenumber AS proof
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey)
SELECT kind, a AS src_block, b AS dst_block, count(*) AS n, array_to_string(list_sort(list_distinct(list(proof)))[1:20], ',') AS proofs FROM e GROUP BY ALL""")
def block_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    edges = lines.join(orders, "l_orderkey").select(
        F.col("l_returnflag").alias("kind"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey")).alias("dst"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("proof"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"), F.col("s_nationkey").alias("block"))
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.col("c_nationkey").alias("block"))
    found = graphs.block_edges(edges, suppliers.union(customers), "node", "block")
    return found.withColumn("proofs", F.array_join(F.transform("proofs", lambda x: x.cast("string")), ","))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nations: from a supplier's to a customer's."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    return lines.join(orders, "l_orderkey").join(suppliers, "l_suppkey").join(customers, "c_custkey").select("src", "dst")


_TRADE = """e AS (SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query(f"""
WITH {_TRADE}, p AS (SELECT * FROM e WHERE src <> dst), n AS (SELECT count(*) - 1 AS others FROM (SELECT src FROM p UNION SELECT dst FROM p))
SELECT src AS block, 'uses-all' AS direction, count(*) AS n FROM p GROUP BY src HAVING count(*) = (SELECT others FROM n)
UNION ALL SELECT dst, 'used-by-all', count(*) FROM p GROUP BY dst HAVING count(*) = (SELECT others FROM n)""")
def coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.uses_all(_trade(spark, sf_dir))


@query("""
WITH p AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)
SELECT src AS node, count(*) AS n, 'uses-many' AS direction FROM p GROUP BY src HAVING count(*) >= 25
UNION ALL SELECT dst, count(*), 'used-by-many' FROM p GROUP BY dst HAVING count(*) >= 25""")
def fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.fan(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), 25)


@query("""
SELECT 'customer' AS kind, c_custkey AS node FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'part', p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)""")
def dead_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = graphs.unused(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")), table(spark, sf_dir, "orders"), "node", "o_custkey")
    sold = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    parts = graphs.unused(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), sold, "node", "l_partkey")
    return customers.select(F.lit("customer").alias("kind"), "node").union(parts.select(F.lit("part"), "node"))


def _followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of parts: from the part of an order's line to the next line's, if both have one return flag and the next was shipped later."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_returnflag")
    following = [F.lead(c).over(w).alias(n) for c, n in (("l_partkey", "dst"), ("l_returnflag", "flag"), ("l_shipdate", "shipped"))]
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), "l_returnflag", "l_shipdate", *following)
    return lines.where("flag = l_returnflag AND shipped > l_shipdate").select("src", "dst").distinct()


_FOLLOWED = """e AS (SELECT DISTINCT src, dst FROM (
  SELECT l_partkey AS src, l_returnflag AS a, l_shipdate AS b, lead(l_partkey) OVER w AS dst, lead(l_returnflag) OVER w AS flag, lead(l_shipdate) OVER w AS shipped
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_returnflag)) WHERE flag = a AND shipped > b)"""


@query(f"""
WITH RECURSIVE {_FOLLOWED}, r AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT CAST(2 AS BIGINT) UNION SELECT dst FROM r JOIN e ON src = node)
SELECT node FROM r""")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = spark.range(1, 3).select(F.col("id").alias("node"))
    return graphs.reachable(_followed(spark, sf_dir), starts).select("node")


@query(f"""
WITH RECURSIVE {_FOLLOWED}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM r JOIN e ON src = b)
SELECT x.a AS node, min(least(x.a, x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a""")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.strong_components(_followed(spark, sf_dir))


@query("""
WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
d AS (SELECT DISTINCT dst AS node, 0 AS depth FROM e WHERE dst NOT IN (SELECT src FROM e) UNION ALL SELECT src, depth + 1 FROM d JOIN e ON dst = node)
SELECT node, CAST(max(depth) AS INT) AS depth FROM d GROUP BY node""")
def dependency_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    def edge(name: str, a: str, key: str, b: str, of: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(key)).alias("src"), F.concat(F.lit(b), F.col(of)).alias("dst"))

    edges = edge("nation", "n", "n_nationkey", "r", "n_regionkey").union(edge("customer", "c", "c_custkey", "n", "c_nationkey"))
    return graphs.dependency_depth(edges.union(edge("supplier", "s", "s_suppkey", "n", "s_nationkey")))


_ROUTES = [(1, "GET", "/"), (2, "ANY", "/:lang/:page"), (3, "GET", "/en/:page"), (4, "GET", "/fr/:id"), (5, "GET", "/en/:rest*"), (6, "POST", "/en/:page"), (7, "ANY", "/:all*"), (8, "GET", "/en/:other")]


@query("""
WITH q AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/') AS path FROM pages),
r(id, pattern, params) AS (VALUES (1, '^/$', 0), (2, '^/[^/]+/[^/]+/?$', 2), (3, '^/en/[^/]+/?$', 1), (4, '^/fr/[^/]+/?$', 1), (5, '^/en(/.*)?$', 1), (7, '^/.*$', 1), (8, '^/en/[^/]+/?$', 1)),
m AS (SELECT page_id, id, params, rank() OVER (PARTITION BY page_id ORDER BY params) AS k FROM q JOIN r ON regexp_matches(path, pattern))
SELECT page_id AS request_id, CAST(id AS BIGINT) AS route_id, CAST(params AS INT) AS params FROM m WHERE k = 1""")
def route_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.functions.text import path_of

    routes = spark.createDataFrame(_ROUTES, "route_id long, method string, path string")
    requests = table(spark, sf_dir, "pages").select(F.col("page_id").alias("request_id"), F.lit("GET").alias("method"), path_of(F.col("url")).alias("path"))
    return matching.match_routes(requests, routes)


@query("""
SELECT l_orderkey * 10 + l_linenumber AS point_id, range_id FROM (
  SELECT l.*, e.event_id AS range_id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY e.event_id % 300 DESC, e.event_id) AS n
  FROM lineitem l JOIN events e ON l_suppkey % 50 = e.user_id % 50 AND l_quantity * 7 BETWEEN e.event_id % 300 AND e.event_id % 300 + 10) WHERE n = 1""")
def enclosing_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), (F.col("l_suppkey") % 50).alias("key"), (F.col("l_quantity") * 7).alias("at")
    )
    start = (F.col("event_id") % 300).cast("double")
    ranges = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("key"), F.col("event_id").alias("range_id"), start.alias("start"), (start + 10).alias("end")
    )
    return matching.innermost(points, ranges, "key", "at", 10.0).select("point_id", "range_id")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two manifests of documents: some rows left out of either, some with other content, some under other keys."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    before = docs.where("doc_id % 10 <> 3")
    after = docs.where("doc_id % 10 <> 7").select(
        F.when(F.col("doc_id") % 10 == 5, F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("doc_id") % 10 == 1, F.lit("new")).otherwise(F.col("hash")).alias("hash"),
    )
    return before, after


_VERSIONS = """
WITH d AS (SELECT doc_id, sha256(text) AS hash FROM documents), b AS (SELECT * FROM d WHERE doc_id % 10 <> 3),
a AS (SELECT CASE WHEN doc_id % 10 = 5 THEN doc_id + 1000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 10 = 1 THEN 'new' ELSE hash END AS hash FROM d WHERE doc_id % 10 <> 7)"""


@query(f"""{_VERSIONS}
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM b FULL JOIN a ON a.doc_id = b.doc_id WHERE a.hash IS DISTINCT FROM b.hash""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.manifest_diff(*_versions(spark, sf_dir), "doc_id", "hash")


@query(f"""{_VERSIONS}
SELECT hash, old_key, new_key FROM (SELECT hash, doc_id AS old_key, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS n FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a))
JOIN (SELECT hash, doc_id AS new_key, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS n FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)) USING (hash, n)""")
def moved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.moved(*_versions(spark, sf_dir), "doc_id", "hash")


@query("""
WITH b AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders WHERE o_orderkey % 11 <> 1),
a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_custkey FROM orders WHERE o_orderkey % 11 <> 2),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS k, a.o_orderkey AS ak, b.o_orderkey AS bk, a.o_orderstatus AS s2, b.o_orderstatus AS s1, a.o_orderpriority AS p2, b.o_orderpriority AS p1 FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey)
SELECT k AS o_orderkey, CASE WHEN bk IS NULL THEN 'added' ELSE 'removed' END AS change, NULL AS field, NULL AS before, NULL AS after FROM j WHERE bk IS NULL OR ak IS NULL
UNION ALL SELECT k, 'changed', 'o_orderstatus', s1, s2 FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND s1 IS DISTINCT FROM s2
UNION ALL SELECT k, 'changed', 'o_orderpriority', p1, p2 FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND p1 IS DISTINCT FROM p2""")
def graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    before = orders.where("o_orderkey % 11 <> 1")
    after = orders.where("o_orderkey % 11 <> 2").withColumns({
        "o_orderstatus": F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")),
        "o_orderpriority": F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")),
    })
    return diffs.field_changes(before, after, "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("""
WITH p AS (SELECT DISTINCT l_suppkey AS src, l_returnflag AS dst FROM lineitem WHERE l_quantity > 48), a AS (SELECT DISTINCT l_suppkey AS src, l_returnflag AS dst FROM lineitem WHERE l_discount > 0.09)
SELECT coalesce(p.src, a.src) AS src, coalesce(p.dst, a.dst) AS dst, CASE WHEN p.src IS NULL THEN 'missed' WHEN a.src IS NULL THEN 'wrong' ELSE 'hit' END AS status
FROM p FULL JOIN a ON p.src = a.src AND p.dst = a.dst""")
def prediction_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lambda cond: table(spark, sf_dir, "lineitem").where(cond).select(F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("dst"))
    return diffs.prediction_score(pairs("l_quantity > 48"), pairs("l_discount > 0.09"), ["src", "dst"])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and its text with one line taken out and one put in."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair"), F.col("text").alias("before"))
    parts = F.split("before", "\n", -1)
    edited = F.concat(F.slice(parts, 1, 1), F.array(F.lit("a new line")), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))))
    return docs.withColumn("after", F.array_join(edited, "\n"))


@query()
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.line_diff(_pairs(spark, sf_dir), "pair", "before", "after")


@query()
def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.hunks(diffs.line_diff(_pairs(spark, sf_dir), "pair", "before", "after"))


@query("""
SELECT c_custkey AS id, level, CAST(row_number() OVER (ORDER BY CASE level WHEN 'red' THEN 0 WHEN 'yellow' THEN 1 ELSE 2 END, c_acctbal, c_custkey) AS INT) AS place FROM (
  SELECT *, CASE WHEN c_acctbal < -500 THEN 'red' WHEN c_acctbal < 0 THEN 'yellow' ELSE 'info' END AS level FROM customer) QUALIFY place <= 200""")
def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("c_acctbal") < -500, "red").when(F.col("c_acctbal") < 0, "yellow").otherwise("info")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", level.alias("level"))
    rows = rows.withColumn("o", diffs.severity_order(rows, "level", {"red": 0, "yellow": 1, "info": 2}))
    top = rows.orderBy("o", "c_acctbal", "id").limit(200)
    return top.withColumn("place", F.row_number().over(Window.orderBy("o", "c_acctbal", "id"))).select("id", "level", "place")


@query("""
SELECT c_nationkey, CASE WHEN count(*) FILTER (c_acctbal < -500) > 0 THEN 'red' WHEN count(*) FILTER (c_acctbal < 0) > 0 THEN 'yellow' ELSE 'clean' END AS verdict,
  count(*) AS n, CAST(count(*) FILTER (c_acctbal < -500) AS BIGINT) AS red FROM customer GROUP BY c_nationkey""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    red, yellow = F.count_if(F.col("c_acctbal") < -500), F.count_if(F.col("c_acctbal") < 0)
    verdict = F.when(red > 0, "red").when(yellow > 0, "yellow").otherwise("clean")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(verdict.alias("verdict"), F.count("*").alias("n"), red.alias("red"))


@query("""
SELECT p_brand, p_partkey, CAST(n AS INT) AS n FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('7' || chr(10) || p_partkey), p_partkey) AS n FROM part) WHERE n <= 4""")
def quiz_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = F.sha2(F.concat(F.lit("7\n"), F.col("p_partkey").cast("string")), 256)
    w = Window.partitionBy("p_brand").orderBy(draw, "p_partkey")
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(w).alias("n")).where("n <= 4")


@query("""
SELECT 'orders.o_custkey' AS problem, o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem.l_partkey', l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'lineitem.l_orderkey', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'labels.doc_id', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'documents.n_chars', doc_id FROM documents WHERE n_chars <> length(text)
UNION ALL SELECT 'orders.unique', o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1""")
def integrity_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)

    def orphan(name: str, key: str, target: str, target_key: str, id_: str) -> DataFrame:
        lost = t(name).where(F.col(key).isNotNull()).join(t(target).select(F.col(target_key).alias(key)), key, "left_anti")
        return lost.select(F.lit(f"{name}.{key}").alias("problem"), F.col(id_).cast("long").alias("id"))

    found = orphan("orders", "o_custkey", "customer", "c_custkey", "o_orderkey").union(orphan("lineitem", "l_partkey", "part", "p_partkey", "l_orderkey"))
    found = found.union(orphan("lineitem", "l_orderkey", "orders", "o_orderkey", "l_orderkey")).union(orphan("labels", "doc_id", "documents", "doc_id", "doc_id"))
    found = found.union(t("documents").where("n_chars <> length(text)").select(F.lit("documents.n_chars"), "doc_id"))
    twice = t("orders").groupBy("o_orderkey").agg(F.count("*").alias("n")).where("n > 1")
    return found.union(twice.select(F.lit("orders.unique"), "o_orderkey"))


@query("""
WITH base AS (SELECT n_nationkey AS id, n_name AS name, 'r' || n_regionkey AS category, [n_name] AS hosts FROM nation),
own AS (SELECT r_regionkey * 5 AS id, 'own ' || r_name AS name, 'z' AS category, ['h' || r_regionkey] AS hosts FROM region UNION ALL SELECT 1000 + r_regionkey, r_name, 'new', ['x'] FROM region)
SELECT coalesce(b.id, o.id) AS id, coalesce(o.name, b.name) AS name, coalesce(b.category, o.category) AS category, array_to_string(list_concat(coalesce(b.hosts, []), coalesce(o.hosts, [])), ',') AS hosts
FROM base b FULL JOIN own o ON b.id = o.id""")
def catalog_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.operators.reports import overridden

    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    base = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("category"), F.array("n_name").alias("hosts"))
    known = region.select((F.col("r_regionkey") * 5).alias("id"), F.concat(F.lit("own "), F.col("r_name")).alias("name"), F.lit("z").alias("category"), F.array(F.concat(F.lit("h"), F.col("r_regionkey"))).alias("hosts"))
    new = region.select((F.col("r_regionkey") + 1000).alias("id"), F.col("r_name").alias("name"), F.lit("new").alias("category"), F.array(F.lit("x")).alias("hosts"))
    return overridden(base, known.union(new)).withColumn("hosts", F.array_join("hosts", ","))


@query(f"""
WITH {_TRADE}, v AS (SELECT (event_id * 7 + user_id) % 25 AS a, lead((event_id * 7 + user_id) % 25) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT a AS src, b AS dst, count(*) AS n, e.src IS NOT NULL AS known FROM v LEFT JOIN e ON v.a = e.src AND v.b = e.dst WHERE b IS NOT NULL GROUP BY a, b, e.src IS NOT NULL""")
def trace_lit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.operators.reports import lit_edges

    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), F.col("event_id").alias("at"), ((F.col("event_id") * 7 + F.col("user_id")) % 25).alias("node"))
    edges = _trade(spark, sf_dir).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return lit_edges(steps, edges)
