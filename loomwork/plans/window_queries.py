"""Queries about what an assistant's window shows, on events as the assistant's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.plans.registry import query, table
from loomwork.streaming import window


def _pick(values: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int"))


_KINDS = {"view": "start", "signup": "start", "click": "end", "purchase": "fail", "error": "notice"}
_RULES = ["cmd-test", "task-start", "todo", "write", "read", "cmd-build"]
_PLANNING = ", ".join(f"'{r}'" for r in window.PLANNING)


# The SQL goes through each user's events in turn with a state.
@query(f"""
WITH RECURSIVE e AS (SELECT user_id AS prompt, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
  CASE event_type WHEN 'click' THEN 'end' WHEN 'purchase' THEN 'fail' WHEN 'error' THEN 'notice' ELSE 'start' END AS kind, event_id % 5 AS id,
  CASE WHEN event_id % 17 <> 0 THEN 'x' || event_id % 4 END AS text, CASE WHEN event_type = 'purchase' THEN ['fail-test', 'fail-tool'][1 + event_id % 2] ELSE {_RULES}[1 + event_id % 6] END AS rule,
  CASE WHEN event_id % 7 = 0 THEN 'analysis' ELSE 'server' END AS area, event_id % 11 = 0 AS waiting FROM events),
s AS (SELECT DISTINCT prompt, 0::BIGINT AS n, []::STRUCT(id BIGINT, text VARCHAR, rule VARCHAR, area VARCHAR)[] AS begun, []::STRUCT(text VARCHAR, "count" BIGINT)[] AS done,
  NULL::STRUCT(text VARCHAR, rule VARCHAR) AS now, NULL::STRUCT(kind VARCHAR, text VARCHAR, rule VARCHAR) AS notice FROM e
UNION ALL SELECT prompt, n,
  CASE WHEN sets THEN list_append(list_filter(begun, lambda q: q.id <> eid), {{'id': eid, 'text': text, 'rule': rule, 'area': area}}) WHEN kind = 'end' THEN list_filter(begun, lambda q: q.id <> eid) ELSE begun END,
  CASE WHEN kind = 'end' AND b IS NOT NULL AND b.rule NOT IN ({_PLANNING}) AND b.area <> 'analysis'
    THEN CASE WHEN len(done) > 0 AND done[-1].text = b.text THEN list_append(done[1:len(done) - 1], {{'text': b.text, 'count': done[-1]."count" + 1}}) ELSE list_append(done, {{'text': b.text, 'count': 1::BIGINT}}) END ELSE done END,
  CASE WHEN sets AND (rule NOT IN ({_PLANNING}) OR rule = 'task-start') THEN {{'text': text, 'rule': rule}} ELSE now END,
  CASE WHEN kind IN ('start', 'notice') AND text IS NOT NULL AND waiting THEN {{'kind': 'waiting', 'text': text, 'rule': rule}} WHEN kind = 'fail' AND text IS NOT NULL THEN {{'kind': 'problem', 'text': text, 'rule': rule}}
    WHEN kind IN ('start', 'end') AND notice.kind = 'waiting' THEN NULL
    WHEN kind = 'end' AND notice.kind = 'problem' AND (notice.rule <> 'fail-test' OR coalesce(b.rule = 'cmd-test', false)) THEN NULL ELSE notice END
  FROM (SELECT s.prompt, e.n, s.begun, s.done, s.now, s.notice, e.kind, e.id AS eid, e.text, e.rule, e.area, e.waiting, e.kind = 'start' AND e.text IS NOT NULL AND NOT e.waiting AS sets,
    list_filter(s.begun, lambda x: x.id = e.id)[1] AS b FROM s JOIN e ON e.prompt = s.prompt AND e.n = s.n + 1)),
l AS (SELECT * FROM s QUALIFY n = max(n) OVER (PARTITION BY prompt))
SELECT prompt, CASE WHEN prompt % 5 = 0 THEN 'interrupted' WHEN prompt % 5 = 1 THEN 'done' ELSE coalesce(notice.kind, 'working') END AS status, CASE WHEN prompt % 5 > 1 THEN now.text END AS now,
  CASE WHEN prompt % 5 > 1 THEN now.rule END AS now_rule, CASE WHEN prompt % 5 > 1 THEN notice.kind END AS notice, CASE WHEN prompt % 5 > 1 THEN notice.text END AS notice_text,
  coalesce(array_to_string([x.text || ':' || x."count" FOR x IN done[greatest(len(done) - 29, 1):len(done)]], ','), '') AS done FROM l""")
def window_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    n = F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("prompt"), n.alias("seq"), kinds[kind].alias("kind"), (n % 5).alias("id"), F.when(n % 17 != 0, F.concat(F.lit("x"), n % 4)).alias("text"),
        F.when(kind == "purchase", _pick(["fail-test", "fail-tool"], n)).otherwise(_pick(_RULES, n)).alias("rule"), F.when(n % 7 == 0, "analysis").otherwise("server").alias("area"), (n % 11 == 0).alias("waiting"),
    )
    prompts = events.select("prompt").distinct().withColumn("status", _pick(["interrupted", "done", "running", "running", "waiting"], F.col("prompt")))
    shown = window.window_states(events, prompts)
    return shown.withColumn("done", F.array_join(F.transform("done", lambda x: F.concat(x["text"], F.lit(":"), x["count"].cast("string"))), ","))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 's' || event_id END AS subject, event_id % 6 AS task FROM events),
u AS (SELECT * FROM e WHERE event_type IN ('view', 'click')), m AS (SELECT * FROM e WHERE event_type IN ('signup', 'purchase')),
j AS (SELECT u.user_id, u.event_id, u.task, u.subject, m.subject AS made, row_number() OVER (PARTITION BY u.user_id, u.event_id ORDER BY m.event_id DESC NULLS LAST) AS k
  FROM u LEFT JOIN m ON m.user_id = u.user_id AND m.task = u.task AND m.event_id < u.event_id)
SELECT user_id AS session, event_id AS seq, task, coalesce(subject, made, '') AS subject FROM j WHERE k = 1""")
def task_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    updates, makes = kind.isin("view", "click"), kind.isin("signup", "purchase")
    task = F.col("event_id") % 6
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.when(makes, "end").otherwise("start").alias("kind"), F.when(updates, "TaskUpdate").when(makes, "TaskCreate").otherwise("Read").alias("tool"),
        F.when(updates, task).alias("task"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("s"), "event_id")).alias("subject"), F.when(makes, task).alias("result"),
    )
    return window.task_subjects(events)


# Clicks begin actions, views leave for a new document with the last one begun, signups and errors are loads; events stand 4 to 24 seconds apart.
@query("""
WITH e AS (SELECT user_id AS session, event_id AS seq, sum(4 + event_id % 21) OVER (PARTITION BY user_id ORDER BY event_id) AS t, CASE event_type WHEN 'click' THEN 'action' WHEN 'view' THEN 'leave' WHEN 'purchase' THEN 'other' ELSE 'load' END AS kind,
  last_value(CASE WHEN event_type = 'click' THEN 'a' || event_id % 8 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS action FROM events),
m AS (SELECT * FROM e WHERE kind IN ('action', 'load') OR kind = 'leave' AND action IS NOT NULL),
b AS (SELECT l.session, l.seq, l.t, (SELECT max(seq) FROM m p WHERE p.session = l.session AND p.seq < l.seq AND p.kind <> 'action') AS prior FROM m l WHERE kind = 'load'),
c AS (SELECT b.session, b.seq, b.t, p.action FROM b JOIN m p ON p.session = b.session AND p.seq = b.prior WHERE p.kind = 'leave' AND b.t - p.t < 15),
x AS (SELECT session, seq, t, action, 0 AS loads, kind FROM m WHERE kind <> 'load' UNION ALL SELECT session, seq, t, action, 1, 'load' FROM c),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 120 THEN 1 ELSE 0 END AS gap FROM x WINDOW w AS (PARTITION BY session, action ORDER BY seq)),
h AS (SELECT *, sum(gap) OVER (PARTITION BY session, action ORDER BY seq) AS life FROM g)
SELECT session, seq, action, CAST(CASE WHEN kind = 'action' THEN 1 ELSE 1 + sum(loads) OVER (PARTITION BY session, action, life ORDER BY seq) END AS BIGINT) AS segment FROM h QUALIFY kind <> 'leave'""")
def continued_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    kind = F.when(F.col("event_type") == "click", "action").when(F.col("event_type") == "view", "leave").when(F.col("event_type") == "purchase", "other").otherwise("load")
    action = F.last(F.when(F.col("event_type") == "click", F.concat(F.lit("a"), F.col("event_id") % 8)), ignorenulls=True).over(w)
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.timestamp_seconds(F.sum(4 + F.col("event_id") % 21).over(w)).alias("at"), kind.alias("kind"), action.alias("action")
    )
    return window.continued_actions(rows.where("kind <> 'leave' OR action IS NOT NULL"), keep=120)


@query("""
WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS t, event_type || ' ' || event_id AS text, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
r AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS shown, NULL::VARCHAR AS pending, NULL::BIGINT AS a1, NULL::VARCHAR AS x1, NULL::BIGINT AS a2, NULL::VARCHAR AS x2 FROM (SELECT DISTINCT key FROM e)
UNION ALL SELECT key, n, CASE WHEN first OR t >= mid + 86400000 THEN t ELSE mid END, CASE WHEN first OR t >= mid + 86400000 THEN NULL ELSE text END,
  CASE WHEN due THEN mid END, CASE WHEN due THEN pending END, CASE WHEN first OR t >= mid + 86400000 THEN t END, CASE WHEN first OR t >= mid + 86400000 THEN text END
  FROM (SELECT r.key, e.n, r.pending, e.t, e.text, r.shown IS NULL AS first, r.pending IS NOT NULL AND e.t >= r.shown + 86400000 AS due,
    CASE WHEN r.pending IS NOT NULL AND e.t >= r.shown + 86400000 THEN r.shown + 86400000 ELSE r.shown END AS mid FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)),
z AS (SELECT * FROM r QUALIFY n = max(n) OVER (PARTITION BY key))
SELECT key, a1 AS "at", x1 AS text FROM r WHERE a1 IS NOT NULL UNION ALL SELECT key, a2, x2 FROM r WHERE a2 IS NOT NULL UNION ALL SELECT key, shown + 86400000, pending FROM z WHERE pending IS NOT NULL""")
def throttled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at"), F.concat_ws(" ", "event_type", "event_id").alias("text"), F.col("event_id").alias("seq")
    )
    return window.throttled(lines, "key", "at", "text", "seq", 86_400_000)
