"""Queries over events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.operators import events as ops
from loomwork.plans.registry import query, table
from loomwork.storage import checkpointed

_RUNS = """
WITH a AS (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(CASE WHEN rn > 1 AND event_type IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM b GROUP BY user_id, run, event_type"""


@query(_RUNS)
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(_RUNS + " HAVING count(*) >= 2")
def event_runs_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", least=2)


@query("""
WITH a AS (SELECT *, event_type IN ('view', 'click', 'signup') AS m FROM events),
b AS (SELECT *, sum(CASE WHEN m THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS n_counted, min(ts) AS first, max(ts) AS last
FROM b WHERE m GROUP BY user_id, island HAVING count(*) >= 3 AND 2 * count(*) FILTER (event_type = 'view') >= count(*)""")
def setup_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    member = F.col("event_type").isin("view", "click", "signup")
    return ops.islands_where(rows, ["user_id"], ["ts", "event_id"], member, F.col("event_type") == "view", 3)


@query("""
SELECT user_id, event_id, event_type, ts, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 20""")
def event_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc(F.col("event_type") == "purchase"), F.desc("ts"), F.desc("event_id")]
    return ops.newest(table(spark, sf_dir, "events"), ["user_id"], order, 20).select("user_id", "event_id", "event_type", "ts", "rank")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "event_id", "value")


@query("""
SELECT user_id, event_type, day, event_id, value FROM (
  SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) AS n FROM events) WHERE n = 1""")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_wins(_daily(spark, sf_dir), ["user_id", "event_type", "day"], ["event_id"])


@query("""
SELECT user_id, event_type, day, event_id, value FROM (
  SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.last_wins(_daily(spark, sf_dir), ["user_id", "event_type", "day"], ["event_id"])


@query("""
WITH u AS (
  SELECT user_id AS key, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id
  UNION ALL SELECT o_custkey, count(*), max(o_orderdate) FROM orders GROUP BY o_custkey)
SELECT key, CAST(sum(n) AS BIGINT) AS n, max(last) AS last FROM u GROUP BY key""")
def runs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    two = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    return one.union(two).groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


@query("""
SELECT user_id, count(*) AS n, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS views, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors,
  count(DISTINCT event_type) AS kinds, CAST(count(*) FILTER (value IS NULL) AS BIGINT) AS unknown FROM events GROUP BY user_id""")
def event_cond_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c: F.count_if(c)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), count(F.col("event_type") == "view").alias("views"), count(F.col("event_type") == "error").alias("errors"),
        F.countDistinct("event_type").alias("kinds"), count(F.col("value").isNull()).alias("unknown"),
    )


@query("""
WITH a AS (SELECT user_id, event_type, CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN NULL ELSE event_id % 100 END AS amount FROM events)
SELECT user_id, event_type, count(*) AS n, CASE WHEN bool_or(amount IS NULL) THEN NULL ELSE CAST(sum(amount) AS BIGINT) END AS total FROM a GROUP BY user_id, event_type""")
def event_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.when(~((F.col("event_type") == "error") & (F.col("event_id") % 7 == 0)), F.col("event_id") % 100)
    return ops.keyed_totals(table(spark, sf_dir, "events").withColumn("amount", amount), ["user_id", "event_type"], "amount")


@query("""
SELECT user_id, event_id, ts, end_value AS purchased, end_value IS NOT NULL AS finished FROM (
  SELECT *, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS end_value
  FROM events) WHERE event_type = 'click'""")
def start_end_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    found = ops.later_match(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "purchase", "event_id")
    return found.select("user_id", "event_id", "ts", F.col("end_value").alias("purchased"), F.col("end_value").isNotNull().alias("finished"))


@query("""
SELECT o_orderkey, o_orderdate, shipped, shipped IS NOT NULL AS finished FROM orders LEFT JOIN (
  SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def request_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    return ops.paired(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ends, ["o_orderkey"])


@query("""
SELECT user_id, event_id, next_event_id, next_ts FROM (
  SELECT *, lead(event_id) OVER w AS next_event_id, lead(ts) OVER w AS next_ts, lead(event_type) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE event_type = 'view' AND t = 'click'""")
def page_next_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.next_event(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "ts", "event_type"])
    return rows.where("event_type = 'view' AND next_event_type = 'click'").select("user_id", "event_id", "next_event_id", "next_ts")


_NEAREST = """
SELECT key, left_id, left_at, right_id, right_at, gap_seconds FROM (
  SELECT l.user_id AS key, l.event_id AS left_id, l.ts AS left_at, r.event_id AS right_id, r.ts AS right_at, abs(epoch_us(l.ts) - epoch_us(r.ts)) / 1e6 AS gap_seconds,
    row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts, r.event_id) AS n
  FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'purchase' AND r.event_type = 'click' AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 900000000) WHERE n = 1"""


@query(_NEAREST)
def nearest_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return ops.nearest(rows.where("event_type = 'purchase'"), rows.where("event_type = 'click'"), "user_id", "ts", "event_id", "event_id", 900)


@query()
def nearest_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return ops.claimed(rows.where("event_type = 'purchase'"), rows.where("event_type = 'click'"), "user_id", "ts", "event_id", "event_id", 900)


@query("""
WITH c AS (SELECT *, o_orderdate < TIMESTAMP '1995-01-01' AS early FROM orders)
SELECT o_custkey, max(CASE WHEN early THEN o_orderdate END) AS before_o_orderdate, min(CASE WHEN NOT early THEN o_orderdate END) AS after_o_orderdate,
  max(CASE WHEN early THEN struct_pack(a := o_orderdate, b := o_orderkey) END).b AS before_o_orderkey,
  min(CASE WHEN NOT early THEN struct_pack(a := o_orderdate, b := o_orderkey) END).b AS after_o_orderkey FROM c GROUP BY o_custkey""")
def before_after_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.around(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "1995-01-01 00:00:00", ["o_orderkey"])


_SESSION = """
WITH a AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM a)"""


@query(_SESSION + " SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM b GROUP BY user_id, session")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 1800)


@query("""
WITH a AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) >= 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM a),
c AS (SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id, session))) // 36000000000 AS piece FROM b)
SELECT user_id, CAST(session AS BIGINT) AS session, CAST(piece AS BIGINT) AS piece, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM c GROUP BY user_id, session, piece""")
def session_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 14_400, cap=36_000)


@query("""
SELECT user_id, max_by(CAST(value AS DOUBLE), event_id) AS value, max_by(CASE WHEN event_type = 'error' THEN event_id END, CASE WHEN event_type = 'error' THEN event_id END) AS last_error FROM events WHERE value IS NOT NULL OR event_type = 'error' GROUP BY user_id""")
def usage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("last_error", F.when(F.col("event_type") == "error", F.col("event_id")))
    return ops.merged_fields(rows, ["user_id"], ["event_id"], ["value", "last_error"])


@query("""
WITH price(kind, per_million) AS (VALUES ('view', 3), ('click', 15), ('purchase', 60), ('signup', 1))
SELECT event_type, count(*) AS n, CASE WHEN any_value(per_million) IS NULL THEN NULL ELSE CAST(sum(event_id % 1000) * any_value(per_million) AS DOUBLE) / 1000000 END AS cost
FROM events LEFT JOIN price ON kind = event_type GROUP BY event_type""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = spark.createDataFrame([("view", 3), ("click", 15), ("purchase", 60), ("signup", 1)], "event_type string, per_million long")
    used = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("event_id") % 1000).alias("units"))
    return used.join(F.broadcast(price), "event_type", "left").select("event_type", "n", (F.col("units") * F.col("per_million") / 1e6).alias("cost"))


@query("""
WITH a AS (SELECT user_id, event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS b, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS n FROM events GROUP BY ALL)
SELECT user_id, event_type, CAST(b AS BIGINT) AS before, CAST(n AS BIGINT) AS after, CASE WHEN b = 0 THEN 'added' WHEN n = 0 THEN 'removed' WHEN b <> n THEN 'changed' ELSE 'same' END AS mark FROM a""")
def behavior_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_if(early).alias("before"), F.count_if(~early).alias("after"))
    mark = F.when(F.col("before") == 0, "added").when(F.col("after") == 0, "removed").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    return rows.withColumn("mark", mark)


@query()
def repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.repeated_blocks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_number, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events""")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        "event_id", k.alias("k"), k.try_cast("long").alias("k_number"), F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("keys")
    )


@query("""
SELECT conv_id, turn, CASE WHEN nxt IS NULL THEN 'running' WHEN nxt = 'user' THEN 'interrupted' ELSE 'done' END AS status, next_turn FROM (
  SELECT *, lead(role) OVER w AS nxt, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""")
def prompt_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.next_event(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["role", "turn"])
    status = F.when(F.col("next_role").isNull(), "running").when(F.col("next_role") == "user", "interrupted").otherwise("done")
    return rows.where("role = 'user'").select("conv_id", "turn", status.alias("status"), "next_turn")


@query("""
WITH e AS (SELECT user_id, ts, event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS request FROM events)
SELECT user_id, event_id, request, request IS NOT NULL AS after_response FROM e WHERE event_type <> 'purchase'""")
def after_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    rows = table(spark, sf_dir, "events").withColumn("request", last).where("event_type <> 'purchase'")
    return rows.select("user_id", "event_id", "request", F.col("request").isNotNull().alias("after_response"))


@query("""
WITH p AS (SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) FILTER (role = 'user') AS prompts FROM conversations GROUP BY conv_id)
SELECT conv_id, first_turn, last_turn, CAST(prompts AS BIGINT) AS prompts, lag(conv_id) OVER (ORDER BY conv_id) AS previous, lead(conv_id) OVER (ORDER BY conv_id) AS next
FROM p QUALIFY row_number() OVER (ORDER BY prompts DESC, conv_id) <= 15""")
def prompt_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("prompts")
    )
    rows = checkpointed(rows)
    top = rows.orderBy(F.desc("prompts"), "conv_id").limit(15)
    ids = [r["conv_id"] for r in top.collect()]  # the fixed length of the list
    near = [F.struct(
        F.lit(i).alias("conv_id"), F.max(F.when(F.col("conv_id") < i, F.col("conv_id"))).alias("previous"), F.min(F.when(F.col("conv_id") > i, F.col("conv_id"))).alias("next")
    ) for i in ids]
    if not ids:
        return rows.select("conv_id", "first_turn", "last_turn", "prompts", F.col("conv_id").alias("previous"), F.col("conv_id").alias("next"))
    neighbours = rows.agg(F.array(*near).alias("each")).select(F.explode("each").alias("e")).select("e.*")
    return top.join(F.broadcast(neighbours), "conv_id")



# Conversations as streamed answers: a turn is a body of a frame or two, in one of three dialects or with whole answers at even turns.
@query("""
WITH t AS (SELECT conv_id AS call, turn, text, conv_id % 4 AS d FROM conversations),
l AS (SELECT *, max(CASE WHEN d = 3 AND turn % 2 = 0 THEN turn END) OVER (PARTITION BY call) AS cut FROM t),
p AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY call ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l WHERE turn >= coalesce(cut, turn)),
a AS (SELECT call, string_agg(text, '' ORDER BY turn) AS answer FROM p WHERE before < 200 GROUP BY call),
u AS (SELECT call, CAST(max(turn * 10) AS BIGINT) AS input, CAST(max(CASE WHEN turn % 2 = 1 THEN turn + 1 END) AS BIGINT) AS output FROM t GROUP BY call)
SELECT call, input, output, left(trim(regexp_replace(answer, '\\s+', ' ', 'g')), 200) AS answer FROM u LEFT JOIN a USING (call)""")
def streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.operators import ai

    d, turn = F.col("conv_id") % 4, F.col("turn")
    piece = F.to_json(F.struct("text"))
    said = F.expr("substr(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)")  # the text as JSON
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    counts = text('{"usage": {"input_tokens": ', turn * 10, F.when(turn % 2 == 1, text(', "output_tokens": ', turn + 1)).otherwise(""), "}}")
    frame = (
        F.when(d == 0, text('{"choices": [{"delta": {"content": ', said, "}}]}")).when(d == 1, text('{"type": "response.output_text.delta", "delta": ', said, "}"))
        .when((d == 2) | (turn % 2 == 1), text('{"type": "content_block_delta", "delta": ', piece, "}")).otherwise(text('{"output_text": ', said, "}"))
    )
    bodies = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call"), turn.alias("seq"), text("event: x\ndata: ", frame, "\ndata: not json\ndata:", counts, " \n: ping\n").alias("body"))
    return ai.response_details(ai.frames(bodies))


@query("""
SELECT conv_id, turn, CASE WHEN conv_id % 3 > 0 THEN 'm' || conv_id % 5 END AS model, nullif(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 200), '') AS prompt, turn % 2 = 0 AS stream FROM conversations""")
def model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.operators import ai

    said = F.expr("substr(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    d = F.col("conv_id") % 4
    asked = (
        F.when(d == 0, text('"messages": [{"role": "user", "content": "old"}, {"role": "user", "content": ', said, '}, {"role": "assistant", "content": "no"}]'))
        .when(d == 1, text('"input": ', said)).when(d == 2, text('"contents": [{"parts": [{"text": ', said, '}, {"other": 1}]}]')).otherwise(text('"prompt": ', said, ', "messages": null'))
    )
    model = F.when(F.col("conv_id") % 3 > 0, text('"model": "m', F.col("conv_id") % 5, '", ')).otherwise('"model": 7, ')
    body = text("{", model, '"stream": ', (F.col("turn") % 2 == 0), ", ", asked, "}")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ai.request_details(body).alias("r")).select("conv_id", "turn", "r.*")
