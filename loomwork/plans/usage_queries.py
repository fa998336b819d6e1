"""Queries over what files use, on order lines, orders, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.text import host_of
from loomwork.operators import usage
from loomwork.plans.registry import query, table


def _pick(n: str, values: list[str]):
    return F.get(F.array(*[F.lit(v) for v in values]), F.expr(n).cast("int"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("proof", F.array_join("proof", ","))


def _first(keys: str, rows: str) -> str:
    """SQL for the distinct keys of rows with their first twelve places."""
    return f"""(SELECT {keys}, string_agg(file || ':' || line, ',' ORDER BY file, line) AS proof FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY file, line) AS place FROM (SELECT DISTINCT {keys}, file, line FROM {rows})) WHERE place <= 12 GROUP BY {keys})"""


_USES = """u AS (SELECT 's' || l_suppkey AS file, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 'f' || l_linenumber END AS symbol, 't' || l_partkey % 40 AS tab,
  ['select', 'insert', 'update', 'delete'][1 + CAST(l_quantity AS INT) % 4] AS op FROM lineitem)"""


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of tables: a supplier is a file, a line number a place, a part a table, a quantity an operation."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("file"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("f"), "l_linenumber")).alias("symbol"),
        F.concat(F.lit("t"), F.col("l_partkey") % 40).alias("table"), _pick("cast(l_quantity AS int) % 4", ["select", "insert", "update", "delete"]).alias("operation"),
    )


@query(f"""
WITH {_USES}, e AS (SELECT CASE WHEN op = 'select' THEN 'reads' ELSE 'writes' END AS kind, CASE WHEN symbol IS NULL THEN 'file:' || file ELSE 'symbol:' || file || '#' || symbol END AS src, 'table:' || tab AS dst, op, file, line FROM u)
SELECT p.kind, p.src, p.dst, p.proof, o.operations FROM {_first("kind, src, dst", "e")} p
JOIN (SELECT kind, src, dst, string_agg(DISTINCT op, ',' ORDER BY op) AS operations FROM e GROUP BY ALL) o USING (kind, src, dst)""")
def table_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(usage.table_edges(_uses(spark, sf_dir))).withColumn("operations", F.array_join("operations", ","))


@query(f"""
WITH {_USES}, d AS (SELECT DISTINCT 't' || p_size AS tab FROM part)
SELECT tab AS "table", tab NOT IN (SELECT tab FROM d) AS inferred FROM (SELECT tab FROM u UNION SELECT tab FROM d)""")
def used_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.used_tables(_uses(spark, sf_dir), table(spark, sf_dir, "part").select(F.concat(F.lit("t"), "p_size").alias("table")))


_NAMES = ["DATABASE_URL", "NEXT_PUBLIC_API_KEY", "VITE_TITLE", "STRIPE_SECRET", "PORT", "NEXT_PUBLIC_HOST", "MAIL_TOKEN"]
_READ = f"r AS (SELECT 'c' || o_custkey AS file, o_orderkey % 100 AS line, {_NAMES}[1 + o_orderkey % 7] AS name FROM orders)"


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("file"), (F.col("o_orderkey") % 100).alias("line"), _pick("o_orderkey % 7", _NAMES).alias("name"))


@query(f"""
WITH {_READ}, d AS (SELECT 's' || s_suppkey AS file, CAST(s_nationkey AS BIGINT) AS line, {[*_NAMES, "UNREAD"]}[1 + s_suppkey % 8] AS name FROM supplier),
a AS (SELECT DISTINCT name, file, line, 1 AS d FROM d UNION ALL SELECT DISTINCT name, file, line, 0 FROM r)
SELECT name, name LIKE 'NEXT_PUBLIC_%' OR name LIKE 'VITE_%' AS public, regexp_matches(name, 'SECRET|KEY|TOKEN') AS secret_like, CAST(sum(d) AS BIGINT) AS defined, CAST(sum(1 - d) AS BIGINT) AS read FROM a GROUP BY name""")
def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    defined = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("file"), F.col("s_nationkey").cast("long").alias("line"), _pick("s_suppkey % 8", [*_NAMES, "UNREAD"]).alias("name"))
    return usage.variables(defined, _read(spark, sf_dir), ["NEXT_PUBLIC_", "VITE_"])


@query(f"""
WITH {_READ}, e AS (SELECT CASE WHEN regexp_matches(name, 'SECRET|KEY|TOKEN') THEN 'uses-secret' ELSE 'reads' END AS kind, 'file:' || file AS src, 'env:' || name AS dst, file, line FROM r)
SELECT * FROM {_first("kind, src, dst", "e")}""")
def variable_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(usage.variable_edges(_read(spark, sf_dir)))


# Example calls: a third by the page's host, others by a variable, a kit or the own machine.
_CALLS = r"""c AS (SELECT 'm' || page_id % 60 AS file, page_id % 200 AS line, ['client', 'server', 'both'][1 + page_id % 3] AS runs_on,
  CASE page_id % 5 WHEN 0 THEN lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) WHEN 1 THEN 'api.openai.com' WHEN 2 THEN 'localhost' END AS host,
  CASE page_id % 5 WHEN 3 THEN 'HOOK_' || page_id % 4 END AS env, CASE page_id % 5 WHEN 4 THEN ['resend', 'stripe', 'left-pad'][1 + page_id % 3] END AS package FROM pages),
s AS (SELECT file, line, runs_on, CASE WHEN host = 'api.openai.com' THEN 'openai' WHEN host IS NOT NULL THEN host WHEN env IS NOT NULL THEN 'env:' || env ELSE package END AS service,
  CASE WHEN host = 'api.openai.com' THEN 'ai' WHEN host IS NOT NULL OR env IS NOT NULL THEN 'http' WHEN package = 'resend' THEN 'email' ELSE 'payment' END AS category
  FROM c WHERE coalesce(host <> 'localhost', true) AND coalesce(package <> 'left-pad', true))"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    calls = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("m"), F.col("page_id") % 60).alias("file"), (F.col("page_id") % 200).alias("line"), _pick("page_id % 3", ["client", "server", "both"]).alias("runs_on"),
        F.when(k == 0, host_of(F.col("url"))).when(k == 1, "api.openai.com").when(k == 2, "localhost").alias("host"), F.when(k == 3, F.concat(F.lit("HOOK_"), F.col("page_id") % 4)).alias("env"),
        F.when(k == 4, _pick("page_id % 3", ["resend", "stripe", "left-pad"])).alias("package"), F.lit("default").alias("name"), F.lit(None).cast("string").alias("symbol"),
    )
    hosts = spark.createDataFrame([("api.openai.com", "openai", "ai")], "host string, service string, category string")
    kits = spark.createDataFrame([("resend", "default", "resend", "email"), ("stripe", "default", "stripe", "payment")], "package string, name string, service string, category string")
    return usage.service_calls(calls, hosts, kits)


@query(f"""
WITH {_CALLS}, e AS (SELECT 'file:' || file AS src, 'service:' || service AS dst, category, file, line FROM s)
SELECT * FROM {_first("src, dst, category", "e")}""")
def service_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(usage.service_edges(_calls(spark, sf_dir)))


@query(f"""
WITH {_CALLS}, b AS (SELECT * FROM s WHERE category IN ('ai', 'email', 'messaging') AND runs_on IN ('client', 'both'))
SELECT service, proof, files FROM {_first("service", "b")} JOIN (SELECT service, count(DISTINCT file) AS files FROM b GROUP BY service) USING (service)""")
def called_from_browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(usage.called_from_browser(_calls(spark, sf_dir)))


@query("""
SELECT 'nation' || n_nationkey AS "check", CAST(count(*) AS BIGINT) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < -800) GROUP BY ALL""")
def passed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked_at = table(spark, sf_dir, "customer").select(F.concat(F.lit("nation"), "c_nationkey").alias("check"), F.lit(1).alias("n"))
    poor = table(spark, sf_dir, "supplier").where("s_acctbal < -800").select(F.concat(F.lit("poor"), "s_nationkey").alias("kind"))
    return usage.passed_checks(looked_at, poor, {f"nation{k}": [f"poor{k}"] for k in range(25)})


@query("""
WITH o AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey <> 2 UNION SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0),
n AS (SELECT 'n' || n_nationkey AS id, 'block' AS kind, NULL AS file, 'n' || n_nationkey AS block FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'file', 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'l' || l_orderkey || '.' || l_linenumber || '.' || l_suppkey, 'symbol', CASE WHEN l_linenumber < 7 THEN 's' || l_suppkey END, 'n' || s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT id, CASE WHEN kind = 'block' THEN id WHEN file IS NULL THEN NULL WHEN block NOT IN (SELECT id FROM o) THEN block WHEN kind = 'file' OR file NOT IN (SELECT id FROM o) THEN file ELSE id END AS box FROM n""")
def visible_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    n, s = F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("s"), "s_suppkey")
    owners = supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("n"), "s_nationkey").alias("block"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(owners, "l_suppkey").select(
        F.concat(F.lit("l"), F.concat_ws(".", "l_orderkey", "l_linenumber", "l_suppkey")).alias("id"), F.lit("symbol").alias("kind"),
        F.when(F.col("l_linenumber") < 7, F.concat(F.lit("s"), "l_suppkey")).alias("file"), "block",
    )
    nodes = nation.select(n.alias("id"), F.lit("block").alias("kind"), F.lit(None).cast("string").alias("file"), n.alias("block"))
    nodes = nodes.union(supplier.select(s, F.lit("file"), s, F.concat(F.lit("n"), "s_nationkey"))).union(lines)
    return usage.visible_boxes(nodes, nation.where("n_regionkey <> 2").select(n.alias("id")).union(supplier.where("s_acctbal > 0").select(s)))


@query("""
SELECT o_custkey, count_if(o_orderpriority LIKE '1%') AS alert, count_if(o_orderpriority LIKE '2%') AS warning, count_if(o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%') AS info,
  count_if(o_orderstatus = 'F') AS touching FROM orders GROUP BY o_custkey""")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("o_orderpriority").startswith("1"), "alert").when(F.col("o_orderpriority").startswith("2"), "warning").otherwise("info")
    touches = F.when(F.col("o_orderstatus") == "F", F.array("o_orderkey")).otherwise(F.array().cast("array<bigint>"))
    return usage.change_counts(table(spark, sf_dir, "orders").select("o_custkey", severity.alias("severity"), touches.alias("touches")), ["o_custkey"])


@query(r"""
WITH p AS (SELECT page_id, html, regexp_extract(html, '(?i)<head(?:\s[^>]*)?>', 0) AS h, regexp_extract(html, '(?i)<body[\s>]', 0) AS b, regexp_extract(html, '(?i)^(?:\s|<!--[\s\S]*?-->)*(?:<!doctype html[^>]*>(?:\s|<!--[\s\S]*?-->)*)?<html(?:\s[^>]*)?>', 0) AS r,
  regexp_extract(html, '(?i)^(?:\s|<!--[\s\S]*?-->)*<!doctype html[^>]*>', 0) AS d FROM pages)
SELECT page_id, CAST(CASE WHEN html IS NULL THEN NULL WHEN h <> '' THEN strpos(html, h) - 1 + length(h) WHEN b <> '' THEN strpos(html, b) - 1 WHEN r <> '' THEN length(r) WHEN d <> '' THEN length(d) ELSE -1 END AS INT) AS position FROM p""")
def tag_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", usage.tag_position(F.col("html")).alias("position"))


@query(r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^(?i)(https?)://', 1)) AS s, lower(regexp_extract(url, '^(?i)https?://(?:[^/?#@]*@)?([^/?#]+)', 1)) AS h, 'www.site' || page_id % 7 || '.example' AS own FROM pages)
SELECT page_id, CASE WHEN s <> '' AND h <> '' AND regexp_replace(h, CASE WHEN s = 'https' THEN ':443$' ELSE ':80$' END, '') <> own THEN s || '://' || regexp_replace(h, CASE WHEN s = 'https' THEN ':443$' ELSE ':80$' END, '') END AS origin FROM p""")
def cross_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat(F.lit("www.site"), F.col("page_id") % 7, F.lit(".example"))
    return table(spark, sf_dir, "pages").select("page_id", usage.cross_origin(F.col("url"), own).alias("origin"))
