"""Queries over recordings and findings, on events, orders and conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import sqltext
from loomwork.functions import text as fn
from loomwork.operators import behavior, overview, reports, store
from loomwork.plans.registry import query, table


def _of(name: str, values: list[str]) -> tuple[Callable[[], Column], str]:
    """What makes a column that takes one of the values by a number, and its SQL."""
    items = ", ".join(f"'{v}'" for v in values)

    def column() -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.col(name), F.lit(len(values))).cast("int"))

    return column, f"([{items}])[1 + {name} % {len(values)}]"


@query("""
WITH a AS (SELECT user_id * 40 + event_id % 40 AS action_id, min(user_id) AS run, min(ts) AS "at", count(*) AS segments FROM events WHERE event_type = 'click' GROUP BY ALL),
r AS (SELECT user_id * 40 + event_id % 40 AS action_id, count(*) AS requests, sum(event_id % 3) AS ended FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT action_id, run, "at", segments, coalesce(requests, 0) AS requests, coalesce(requests, 0) > coalesce(ended, 0) AS pending FROM a LEFT JOIN r USING (action_id)""")
def action_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("action_id", F.col("user_id") * 40 + F.col("event_id") % 40)
    actions = events.where("event_type = 'click'").select("action_id", F.col("user_id").alias("run"), F.col("ts").alias("at"))
    return store.action_list(actions, events.where("event_type = 'view'").select("action_id", (F.col("event_id") % 3).alias("ended")))


@query("""
SELECT run, max("at") AS "last", CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(actions) AS BIGINT) AS actions FROM (
  SELECT user_id AS run, max(ts) AS "at", count(*) AS requests, 0 AS actions FROM events WHERE event_type = 'view' GROUP BY user_id
  UNION ALL SELECT user_id, max(ts), 0, count(DISTINCT event_id % 40) FROM events WHERE event_type = 'click' GROUP BY user_id) GROUP BY run""")
def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("ts").alias("at"), "event_type", (F.col("event_id") % 40).alias("action_id"))
    return store.run_list(events.where("event_type = 'view'"), events.where("event_type = 'click'"))


@query("SELECT user_id, CAST(floor(value) % 5 AS BIGINT) AS reason, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL")
def limitation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", (F.floor("value") % 5).cast("long").alias("reason"))
    return store.reasons(rows, "user_id")


@query("SELECT l_orderkey, l_linenumber, o_orderpriority AS detail FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'")
def function_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("detail"))
    return store.with_details(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), details, ["l_orderkey"])


@query("""
SELECT DISTINCT c_custkey AS file, c_nationkey AS run FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')""")
def recorded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), F.col("c_nationkey").alias("run"))
    entered = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.when(F.col("o_orderstatus") == "O", "enter").otherwise("exit").alias("type"))
    return store.recorded_files(files, entered.join(files, "file"))


_KIND, _KIND_SQL = _of("event_id", ["http", "ai", "cache", "payment"])


@query(f"""
WITH e AS (SELECT event_id, user_id, {_KIND_SQL} AS kind, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'h' || (event_id % 9) END AS host, user_id % 4 = 0 AS local, props FROM events WHERE event_type IN ('view', 'click')),
d AS (SELECT event_id AS id, event_type AS sent FROM events WHERE event_id % 2 = 0)
SELECT user_id % 10 AS run, user_id AS request_id, host, kind, NULL AS provider, coalesce(sent, props) AS fields FROM e LEFT JOIN d ON d.id = e.event_id
WHERE host IS NOT NULL AND NOT local AND kind <> 'cache'""")
def outgoing_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    begun = events.where("event_type IN ('view', 'click')").select(
        F.col("user_id").alias("request_id"), F.lit("p").alias("process"), F.col("event_id").alias("id"), F.lit("boundary").alias("type"), _KIND().alias("kind"),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("h"), F.col("event_id") % 9)).alias("host"), (F.col("user_id") % 4 == 0).alias("local"), none.alias("provider"), F.col("props").alias("fields"),
    )
    ended = events.where("event_id % 2 = 0").select(
        F.col("user_id").alias("request_id"), F.lit("p").alias("process"), F.col("event_id").alias("id"), F.lit("boundary-end").alias("type"), none.alias("kind"),
        none.alias("host"), F.lit(False).alias("local"), none.alias("provider"), F.col("event_type").alias("fields"),
    )
    requests = events.select(F.col("user_id").alias("request_id"), (F.col("user_id") % 10).alias("run")).distinct()
    return store.outgoing_calls(begun.union(ended), requests)


_PATH, _PATH_SQL = _of("event_id", ["/@vite/client", "/api/notes", "/_next/static/webpack/a.hot-update.json", "/__vite_ping"])


@query(f"""
WITH m AS (SELECT user_id, event_id, regexp_matches({_PATH_SQL}, '{store.DEV_TOOLS}') AS marked FROM events),
i AS (SELECT *, sum(CASE WHEN marked THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(event_id) AS "first", max(event_id) AS "last", count(*) AS n FROM i WHERE marked GROUP BY user_id, island HAVING count(*) >= 2""")
def dev_tool_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", _PATH().alias("path"))
    return store.marked_runs(rows, "user_id", "event_id", store.is_dev_tool(F.col("path")))


_FILE, _FILE_SQL = _of("event_id", ["src/a.ts", ".next/server/b.js", "app/.cache/c.js", "lib/.d.js"])


@query(f"""
WITH m AS (SELECT user_id, event_id, regexp_matches({_FILE_SQL}, '(^|/)[.][^/]*/') AS marked FROM events),
i AS (SELECT *, sum(CASE WHEN marked THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(event_id) AS "first", max(event_id) AS "last", count(*) AS n FROM i WHERE marked GROUP BY user_id, island HAVING count(*) >= 2""")
def generated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", _FILE().alias("path"))
    return store.marked_runs(rows, "user_id", "event_id", store.is_generated(F.col("path")))


_OP, _OP_SQL = _of("l_linenumber", ["SELECT", "update", "Delete", "call"])


@query(f"""
SELECT l_orderkey, arg_max(op, coalesce(list_position(['select', 'update', 'delete'], op), 0) * 10 + CASE op WHEN 'call' THEN 1 ELSE 0 END) AS operation
FROM (SELECT l_orderkey, lower({_OP_SQL}) AS op FROM lineitem) GROUP BY l_orderkey""")
def strongest_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.strongest(table(spark, sf_dir, "lineitem").select("l_orderkey", _OP().alias("op")), ["l_orderkey"], "op")


_MODULES = ["google.cloud.storage.blob", "google.cloud", "boto3", "stripe.api", "json"]
_SDKS = [("google", "*", "google"), ("google.cloud.storage", "*", "storage"), ("boto3", "client", "aws"), ("stripe", "*", "payments"), ("google.cloud", "x1", "one")]
_MODULE, _MODULE_SQL = _of("event_id", _MODULES)
_NAME, _NAME_SQL = _of("user_id", ["client", "x1", "y"])


@query(f"""
WITH s(prefix, name, service) AS (VALUES {", ".join(str(s) for s in _SDKS)}), u AS (SELECT event_id, {_MODULE_SQL} AS module, {_NAME_SQL} AS name FROM events)
SELECT event_id, module, name, service FROM (SELECT u.*, s.service, row_number() OVER (PARTITION BY event_id ORDER BY length(s.prefix) DESC NULLS LAST, s.name <> '*' DESC) AS k
FROM u LEFT JOIN s ON (u.module = s.prefix OR starts_with(u.module, s.prefix || '.')) AND s.name IN ('*', u.name)) WHERE k = 1""")
def sdk_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "events").select("event_id", _MODULE().alias("module"), _NAME().alias("name"))
    return store.by_longest_prefix(uses, spark.createDataFrame(_SDKS, "prefix string, name string, service string"), "module")


@query("""
WITH b AS (SELECT DISTINCT o_custkey AS who, o_orderpriority AS what FROM orders WHERE o_orderkey % 2 = 0), a AS (SELECT DISTINCT o_custkey AS who, o_orderpriority AS what FROM orders WHERE o_orderkey % 2 = 1)
SELECT who, what, 'new' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT who, what, 'gone' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def new_and_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderpriority").alias("what"), (F.col("o_orderkey") % 2).alias("v"))
    return store.new_and_gone(rows.where("v = 0"), rows.where("v = 1"), ["who", "what"])


# A document as JSON with comments and final commas around it; its own text has what looks like both.
@query("""
SELECT doc_id, doc_id AS k, text AS t, len(string_split(text, chr(10))) AS n FROM documents""")
def jsonc_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("substr(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)")
    lines = F.to_json(F.transform(F.split("text", "\n", -1), lambda x: F.length(x)))
    text = F.concat(
        F.lit('/* "x": { */ {"a": "// no /* comment */, }", // yes, ]\n"t" : '), said, F.lit(', /* , */ "lines": '), F.substring(lines, F.lit(1), F.length(lines) - 1), F.lit(" , ], // }\n"),
        F.lit('"b": {"k": '), F.col("doc_id").cast("string"), F.lit(",\n} /**/ ,\n}"),
    )
    plain = store.plain_json(text)
    counted = F.size(F.from_json(F.get_json_object(plain, "$.lines"), "array<bigint>")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.get_json_object(plain, "$.b.k").cast("long").alias("k"), F.get_json_object(plain, "$.t").alias("t"), counted.alias("n"))


# Nested objects of an order, with keys in another order, a proof at two depths, a number as text, another amount, or cut short.
@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN o_totalprice = o_totalprice + (o_custkey % 2) WHEN 3 THEN true END AS same FROM orders""")
def same_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey") % 5, F.col("o_totalprice").cast("string")
    inner = F.concat(F.lit('{"status": "'), "o_orderstatus", F.lit('", "price": '), price, F.lit(', "proof": [1]}'))
    one = F.concat(F.lit('{"key": '), "o_orderkey", F.lit(', "of": ['), inner, F.lit(', {"a": {"x": 1, "y": 2.0}}], "proof": {"line": 1}}'))
    swapped = F.concat(F.lit('{"proof": [], "price": '), price, F.lit(', "status": "'), "o_orderstatus", F.lit('"}'))
    two = F.concat(F.lit('{"of": ['), swapped, F.lit(', {"a": {"y": 2, "x": 1}}], "key": '), "o_orderkey", F.lit("}"))
    typed = F.concat(F.lit('{"key": "'), "o_orderkey", F.lit('", "of": ['), swapped, F.lit(', {"a": {"y": 2, "x": 1}}]}'))
    more = (F.col("o_totalprice") + F.col("o_custkey") % 2).cast("string")
    other = F.concat(F.lit('{"of": [{"price": '), more, F.lit(', "status": "'), "o_orderstatus", F.lit('"}, {"a": {"y": 2, "x": 1}}], "key": '), "o_orderkey", F.lit("}"))
    second = F.when(k == 0, two).when(k == 1, typed).when(k == 2, other).when(k == 3, one).otherwise(F.substring(one, 1, 20))
    return table(spark, sf_dir, "orders").select("o_orderkey", store.same_json(one, second).alias("same"))


@query("""
WITH o AS (SELECT l_partkey AS id, string_agg(DISTINCT 'f' || l_suppkey % 4, ',' ORDER BY 'f' || l_suppkey % 4) AS files, max(l_quantity) AS tokens, count(*) AS places FROM lineitem GROUP BY l_partkey)
SELECT files, count(*) AS stretches, sum(tokens) AS tokens, max(places) AS places FROM o GROUP BY files""")
def duplicate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.concat(F.lit("f"), F.col("l_suppkey") % 4).alias("file"), F.col("l_quantity").alias("tokens"))
    return store.duplicate_sets(rows)


@query("""
SELECT count(*) AS n_tables, count_if(c_custkey % 3 = 0) AS inferred, count_if(c_custkey % 5 <> 0 AND c_acctbal > 0) AS with_rls, count_if(c_custkey % 5 <> 0) AS rls_known FROM customer""")
def data_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rls = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") > 0)
    return store.data_summary(table(spark, sf_dir, "customer").select((F.col("c_custkey") % 3 == 0).alias("inferred"), rls.alias("rls")))


_SEVERITY, _SEVERITY_SQL = _of("event_id", ["alert", "warning", "info"])


_ORIGIN, _ORIGIN_SQL = _of("user_id", ["surely", "possibly"])


@query(f"""
WITH i AS (SELECT user_id, event_id, {_SEVERITY_SQL} AS severity, {_ORIGIN_SQL} AS origin, event_id % 4 = 0 AS seen FROM events),
o AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT user_id, count(*) AS changes, count_if(severity = 'alert') AS alerts, count_if(severity = 'warning') AS warnings, count_if(origin = 'possibly') AS possibly,
  count_if(NOT seen) AS unread, user_id IN (SELECT user_id FROM o) AS opened FROM i GROUP BY user_id""")
def badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    items = events.select("user_id", F.col("event_id").alias("key"), _SEVERITY().alias("severity"), _ORIGIN().alias("origin"))
    return store.badge(items, items.where("key % 4 = 0").select("user_id", "key"), events.where("event_type = 'purchase'").select("user_id"), "user_id")


@query("""
WITH a AS (SELECT event_type, event_id % 3 = 0 AS ok, row_number() OVER (ORDER BY event_id DESC) AS place FROM events)
SELECT event_type, count(*) AS n, count_if(ok) AS n_right, count_if(place <= 50) AS recent, count_if(ok AND place <= 50) AS recent_right FROM a GROUP BY event_type""")
def quiz_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("event_id") % 3 == 0).alias("is_right"))
    return store.tallies(rows, "event_type", "event_id")


@query("""
WITH a AS (SELECT user_id, event_type, event_id % 3 = 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events)
SELECT user_id, event_type, count(*) AS n, count_if(ok) AS n_right, count_if(place <= 50) AS recent, count_if(ok AND place <= 50) AS recent_right FROM a GROUP BY ALL""")
def quiz_tallies_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("event_id") % 3 == 0).alias("is_right"))
    return store.tallies(rows, "event_type", "event_id", project="user_id")


_FOUND, _FOUND_SQL = _of("event_id", ["literal-key", "public-secret", "secret-in-browser", "env-tracked", "env-not-ignored", "no-rls-browser", "rls-unknown-browser", "live-key", "remote-supabase", "remote-database", "service-from-browser"])
_SHAPE, _SHAPE_SQL = _of("user_id", ["stripe-test", "aws", "google"])


@query(f"""
WITH f AS (SELECT {_FOUND_SQL} AS kind, {_SHAPE_SQL} AS key, value > 5 AS is_read FROM events)
SELECT kind, key, is_read, CASE WHEN kind = 'remote-supabase' THEN 'info' WHEN kind = 'literal-key' AND key IN ('stripe-test', 'google') THEN 'yellow'
  WHEN kind = 'public-secret' AND NOT coalesce(is_read, false) THEN 'yellow' WHEN kind IN ('public-secret', 'env-tracked', 'literal-key', 'no-rls-browser') THEN 'red'
  ELSE 'yellow' END AS level, count(*) AS n FROM f GROUP BY ALL""")
def finding_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(_FOUND().alias("kind"), _SHAPE().alias("key"), (F.col("value") > 5).alias("is_read"))
    return rows.groupBy("kind", "key", "is_read", store.finding_level(F.col("kind"), F.col("key"), F.col("is_read")).alias("level")).agg(F.count("*").alias("n"))


# Example statements: names by the order's key.
@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' ELSE 'CREATE' END AS operation,
  CASE o_orderkey % 4 WHEN 0 THEN 't' || o_custkey % 7 || ',u' WHEN 1 THEN 'log' WHEN 2 THEN 'x.t' || o_custkey % 7 ELSE 'z' END AS tables, CASE o_orderkey % 4 WHEN 1 THEN 't' || o_custkey % 7 WHEN 2 THEN 'u' ELSE '' END AS reads FROM orders""")
def sql_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("t"), F.col("o_custkey") % 7)
    statement = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("with w as (select * from public."), t, F.lit(") select * from w join \"u\" on a = 'from y'")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("WITH w AS (SELECT 1 FROM "), t, F.lit(") INSERT INTO log SELECT * FROM w")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("update x."), t, F.lit(" set a = (select b from `u`)"))).otherwise("create table if not exists [dbo].[z] (a int)")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", sqltext.sql_access(statement).alias("a"))
    return rows.select("o_orderkey", "a.operation", F.array_join("a.tables", ",").alias("tables"), F.array_join("a.reads", ",").alias("reads"))


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1000.0 AS t, CASE event_type WHEN 'purchase' THEN 'submit' WHEN 'click' THEN 'label' ELSE 'other' END AS kind FROM events),
j AS (SELECT *, t - lag(t) OVER w AS since FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT event_id, CAST(sum(CASE WHEN kind = 'submit' AND since <= 1000 OR kind = 'label' AND since <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gesture FROM j""")
def gesture_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "submit").when(F.col("event_type") == "click", "label").otherwise("other")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("at"), kind.alias("kind"))
    return behavior.gestures(rows, "user_id", "at", "kind").select("event_id", "gesture")


@query("""
WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS step FROM m)
SELECT user_id, step, event_type AS area, count(*) AS n, min(event_id) AS "first", max(event_id) AS "last" FROM s GROUP BY user_id, step, event_type""")
def steps_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.grouped_steps(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""
SELECT coalesce(b.action, s.action) AS action, coalesce(b.n, s.n) AS n, request_id, CASE WHEN b.action IS NULL THEN 'unmatched' WHEN request_id IS NULL THEN 'not recorded' ELSE 'matched' END AS status
FROM (SELECT l_orderkey AS action, l_linenumber AS n FROM lineitem WHERE l_quantity < 40) b
FULL JOIN (SELECT l_orderkey AS action, l_linenumber AS n, l_partkey AS request_id FROM lineitem WHERE l_quantity > 10) s ON b.action = s.action AND b.n = s.n""")
def matched_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("action"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("request_id"), "l_quantity")
    return behavior.matched_requests(rows.where("l_quantity < 40"), rows.where("l_quantity > 10"))


@query("""
WITH g AS (SELECT l_orderkey AS action, count(*) AS n, bool_or(l_returnflag = 'R') AS other, bool_or(l_linestatus = 'O') AS write, bool_or(l_linenumber > 5) AS query,
  bool_or(l_partkey % 40 < 3) AS path FROM lineitem GROUP BY ALL),
r AS (SELECT action, CASE WHEN other THEN 'other-origin' WHEN write THEN 'method' WHEN query THEN 'query' WHEN n > 20 OR path THEN 'path' END AS reason FROM g)
SELECT action, CASE WHEN reason IS NULL THEN 'rerun' ELSE 'by-hand' END AS how, reason FROM r""")
def redo_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    path = F.when(part % 40 == 0, "/a b").when(part % 40 == 1, F.concat(F.lit("/p/"), F.lit(fn.MARK))).when(part % 40 == 2, "/é").otherwise(F.concat(F.lit("/p/"), part.cast("string"), F.lit("/x.y_z~")))
    keys = F.when(F.col("l_linenumber") > 5, F.array(F.lit("q"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("action"), F.when(F.col("l_linestatus") == "O", "POST").otherwise("GET").alias("method"), path.alias("path"),
        keys.alias("query_keys"), (F.col("l_returnflag") == "R").alias("other_origin"),
    )
    return behavior.redo_plan(rows, "action")


_DONE, _DONE_SQL = _of("l_linenumber", ["INSERT", "UPDATE", "CREATE", "SELECT"])


@query(f"""
WITH s AS (SELECT l_orderkey, {_DONE_SQL} AS op, 't' || l_suppkey % 5 AS t, CASE WHEN l_quantity < 5 THEN NULL WHEN l_quantity < 10 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS affected FROM lineitem WHERE l_tax <> 0.05),
c AS (SELECT *, CASE WHEN op = 'CREATE' THEN 'structure' WHEN op = 'SELECT' THEN NULL WHEN affected = 0 THEN 'no change' ELSE 'database' END AS category FROM s)
SELECT l_orderkey, category, CASE WHEN category = 'structure' THEN 'structure' ELSE op || ':' || t END AS key, count(*) AS n,
  CASE WHEN bool_or(category = 'database' AND affected IS NULL) THEN NULL ELSE CAST(sum(CASE WHEN category = 'database' THEN affected ELSE 1 END) AS BIGINT) END AS total,
  string_agg(DISTINCT t, ',' ORDER BY t) AS tables, category <> 'no change' AS lasting FROM c WHERE category IS NOT NULL GROUP BY l_orderkey, category, key""")
def effect_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    none = F.lit(None).cast("string")
    steps = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.lit("database").alias("kind"), _DONE().alias("operation"), F.array(F.concat(F.lit("t"), F.col("l_suppkey") % 5)).alias("tables"),
        F.when(q < 5, None).when(q < 10, 0).otherwise(q.cast("long")).cast("long").alias("affected"), (F.col("l_tax") == 0.05).alias("error"), none.alias("host"), none.alias("provider"), F.lit(False).alias("local"),
    )
    return behavior.effects(steps, "l_orderkey").withColumn("tables", F.array_join("tables", ","))


_STEP, _STEP_SQL = _of("l_linenumber", ["database", "http", "ai", "email", "payment", "files", "auth"])
_STEP_OP, _STEP_OP_SQL = _of("l_partkey", ["SELECT", "read", "INSERT", "ALTER", "CALL", "write"])


@query(f"""
WITH s AS (SELECT {_STEP_SQL} AS kind, {_STEP_OP_SQL} AS op, 't' || l_suppkey % 9 AS t, 'h' || l_suppkey % 5 AS host, l_suppkey % 11 = 0 AS local,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 'p' || l_partkey % 3 END AS provider, 'lib' AS library, CASE WHEN l_linestatus = 'O' THEN 'test' END AS mode,
  CASE WHEN l_returnflag = 'R' THEN 'b1' END AS bucket FROM lineitem),
k AS (SELECT *, CASE kind
  WHEN 'database' THEN CASE WHEN op = 'SELECT' THEN 'db:read:' || t WHEN op = 'ALTER' THEN 'db:structure:ALTER:' || t WHEN op = 'INSERT' THEN 'db:write:INSERT:' || t ELSE 'db:other:' || upper(op) || ':' || t END
  WHEN 'http' THEN CASE WHEN NOT local THEN 'http:' || host END
  WHEN 'ai' THEN 'ai:' || coalesce(provider, '?') WHEN 'email' THEN 'email:' || coalesce(provider, library) WHEN 'auth' THEN 'auth:' || coalesce(provider, library)
  WHEN 'payment' THEN 'pay:' || coalesce(provider, '?') || ':' || coalesce(mode, '')
  ELSE CASE WHEN op = 'read' THEN 'file:read:' ELSE 'file:' || op || ':' END || CASE WHEN bucket IS NOT NULL THEN coalesce(provider, '?') || ' ' || bucket ELSE coalesce(provider, '?') END END AS key FROM s)
SELECT DISTINCT key, CASE WHEN kind = 'auth' OR kind = 'files' AND op = 'read' OR kind = 'database' AND op NOT IN ('ALTER', 'INSERT') THEN 'info' ELSE 'warning' END AS weight FROM k WHERE key IS NOT NULL""")
def boundary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    mod = lambda prefix, name, n: F.concat(F.lit(prefix), F.col(name) % n)
    rows = table(spark, sf_dir, "lineitem").select(
        _STEP().alias("kind"), _STEP_OP().alias("operation"), F.array(mod("t", "l_suppkey", 9)).alias("tables"), mod("h", "l_suppkey", 5).alias("host"),
        (F.col("l_suppkey") % 11 == 0).alias("local"), F.when(F.col("l_partkey") % 4 != 0, mod("p", "l_partkey", 3)).alias("provider"), F.lit("lib").alias("library"),
        F.when(F.col("l_linestatus") == "O", "test").alias("mode"), F.when(F.col("l_returnflag") == "R", "b1").alias("bucket"),
    )
    return behavior.boundary_key(rows).select("key", "weight").distinct()


_METHOD, _METHOD_SQL = _of("l_partkey", ["GET", "POST", "PATCH", "DELETE", "PUT", "HEAD"])


# What a request is follows from the parts that its address is made of here.
@query(f"""
WITH u AS (SELECT l_orderkey, l_linenumber, l_suppkey % 11 AS k, {_METHOD_SQL} AS m, 't' || l_partkey % 9 AS t, 'u' || l_suppkey % 7 AS b, l_linestatus = 'O' AS live FROM lineitem),
x AS (SELECT *, CASE m WHEN 'GET' THEN 'read' WHEN 'HEAD' THEN 'check' WHEN 'DELETE' THEN 'delete' WHEN 'PATCH' THEN 'PATCH' ELSE 'write' END AS doing FROM u)
SELECT l_orderkey, l_linenumber,
  CASE WHEN k = 0 THEN 'ai' WHEN k IN (1, 2, 9) THEN 'files' WHEN k = 3 THEN 'payment' WHEN k IN (4, 10) THEN 'database' WHEN k IN (5, 6) THEN 'auth' ELSE 'http' END AS kind,
  CASE k WHEN 0 THEN 'compatible (' || b || '.example.org)' WHEN 1 THEN 'S3' WHEN 2 THEN 'S3' WHEN 3 THEN 'Stripe' WHEN 4 THEN 'Supabase' WHEN 10 THEN 'Supabase' WHEN 5 THEN 'Supabase Auth' WHEN 6 THEN 'Clerk' WHEN 9 THEN 'Supabase Storage' END AS provider,
  CASE WHEN k = 0 THEN '/v1/messages' WHEN k IN (1, 2) THEN doing WHEN k = 3 THEN m || ' /v1/' || t WHEN k = 5 THEN t WHEN k = 6 THEN NULL
    WHEN k IN (4, 10) THEN CASE m WHEN 'GET' THEN 'SELECT' WHEN 'HEAD' THEN 'SELECT' WHEN 'POST' THEN 'INSERT' WHEN 'PATCH' THEN 'UPDATE' WHEN 'PUT' THEN 'UPSERT' ELSE 'DELETE' END ELSE m END AS operation,
  CASE WHEN k = 4 THEN t WHEN k = 10 THEN 'rpc:' || t ELSE '' END AS tables, CASE WHEN k = 3 THEN CASE WHEN live THEN 'live' ELSE 'test' END END AS mode,
  CASE WHEN k IN (1, 2, 9) THEN b END AS bucket, k IN (2, 7) AS local FROM x""")
def http_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t, b = F.col("l_suppkey") % 11, F.concat(F.lit("t"), F.col("l_partkey") % 9), F.concat(F.lit("u"), F.col("l_suppkey") % 7)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    urls = [
        text("https://", b, ".example.org/v1/messages"), text("https://", b, ".s3.eu-west-1.amazonaws.com/", t), text("http://localhost:9000/", b, "/", t, "?X-Amz-Signature=1"),
        text("https://api.stripe.com/v1/", t), text("https://x.supabase.co/rest/v1/", t, "?select=*"), text("https://x.supabase.co/auth/v1/", t), text("https://", b, ".clerk.accounts.dev/v1"),
        text("http://127.0.0.1:3000/", t), text("https://", b, ".example.com/", t), text("https://x.supabase.co/storage/v1/object/", b, "/", t), text("https://x.supabase.co/rest/v1/rpc/", t),
    ]
    url = F.get(F.array(*urls), k.cast("int"))
    key = F.when(k == 3, F.when(F.col("l_linestatus") == "O", "Bearer sk_live_1").otherwise("Bearer rk_test_1"))
    found = behavior.http_boundary(_METHOD(), url, key, F.when(k == 1, "abc"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", found.alias("b"))
    return rows.select("l_orderkey", "l_linenumber", "b.kind", "b.provider", "b.operation", F.array_join("b.tables", ",").alias("tables"), "b.mode", "b.bucket", "b.local")


@query("""
SELECT o_custkey % 20 AS project, count(*) AS n, max(o_orderdate) AS "last" FROM orders GROUP BY ALL""")
def project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.projects(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("project"), F.col("o_orderdate").alias("started")))


@query("""
SELECT user_id, count(*) AS n, count_if(event_type IN ('view', 'click')) AS translated, count_if(event_type = 'error') AS generic, count_if(event_type IN ('signup', 'purchase')) AS unknown,
  CAST(round(100.0 * count_if(event_type IN ('view', 'click')) / count(*)) AS BIGINT) AS per_cent FROM events GROUP BY user_id""")
def translation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "translated").when(F.col("event_type") == "error", "generic").otherwise("unknown")
    return reports.coverage(table(spark, sf_dir, "events"), "user_id", kind)


@query("""SELECT k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0) WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def open_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    carried = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return reports.debt(orders.where("o_orderstatus = 'O'"), carried, orders.where("o_orderstatus = 'P'"), "k")


# C's rounding is to even on exact ties, so the next number up stands for them.
@query("""
WITH v AS (SELECT event_id, value * pow(10, event_id % 4 - 1) AS ms FROM events)
SELECT event_id, CASE WHEN ms IS NULL THEN '' WHEN ms < 1 THEN printf('%.2f ms', CASE WHEN ms * 8 = floor(ms * 8) THEN nextafter(ms, 1e9) ELSE ms END)
  WHEN ms < 1000 THEN printf('%.1f ms', CASE WHEN ms * 4 = floor(ms * 4) THEN nextafter(ms, 1e9) ELSE ms END)
  ELSE printf('%.2f s', CASE WHEN ms / 1000 * 8 = floor(ms / 1000 * 8) THEN nextafter(ms / 1000, 1e9) ELSE ms / 1000 END) END AS shown FROM v""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("value") * F.pow(F.lit(10.0), F.col("event_id") % 4 - 1)
    return table(spark, sf_dir, "events").select("event_id", fn.duration_text(ms).alias("shown"))


@query("""
SELECT conv_id, turn, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 80) AS excerpt FROM conversations""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.excerpt(F.col("text"), 80).alias("excerpt"))


# Orders as files of two moments in a new archive; the first is read back after the second was written.
@query("""
WITH f AS (SELECT 'o/' || o_orderkey || CASE WHEN o_orderkey % 50 = 0 THEN '/.env' ELSE '.txt' END AS path, o_orderkey % 50 = 0 AS env, o_orderkey % 5000 = 1 AS large,
  CASE WHEN o_orderkey % 50 = 0 THEN 'KEY_' || o_custkey || '=' || o_orderstatus WHEN o_orderkey % 5000 = 1 THEN repeat('x', 1048577) ELSE o_orderpriority || o_custkey % 100 END AS content FROM orders)
SELECT path, CASE WHEN large THEN 'missing' WHEN env THEN 'names' ELSE 'whole' END AS state, CASE WHEN large THEN NULL WHEN env THEN sha256(regexp_extract(content, '^[^=]*=')) ELSE sha256(content) END AS content_sha256 FROM f""")
def archived_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from loomwork.sources import archive
    from loomwork.storage import shared_dir

    key = F.col("o_orderkey")
    path = F.concat(F.lit("o/"), key, F.when(key % 50 == 0, "/.env").otherwise(".txt"))
    content = (
        F.when(key % 50 == 0, F.concat(F.lit("KEY_"), "o_custkey", F.lit("="), "o_orderstatus")).when(key % 5000 == 1, F.repeat(F.lit("x"), 2**20 + 1))
        .otherwise(F.concat("o_orderpriority", F.col("o_custkey") % 100))
    )
    files = table(spark, sf_dir, "orders").select(path.alias("path"), content.alias("content"))
    folder = f"{shared_dir(spark).rstrip('/')}/loomwork/archive-{uuid.uuid4().hex}"
    first, *_ = archive.archive(files, folder)
    archive.archive(files.withColumn("content", F.concat("content", F.lit("!"))), folder)
    found = archive.materialized(spark, folder, first)
    return found.select("path", "state", F.sha2("content", 256).alias("content_sha256"))
