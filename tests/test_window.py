import random

from pyspark.sql import functions as F

from loomwork.streaming import window

EVENTS = "prompt int, seq int, kind string, id string, text string, rule string, area string, waiting boolean"


def history(rng, prompts=4, n=60):
    rows, ended = [], set()
    for seq in range(n):
        p = rng.randrange(prompts)
        kind = rng.choice(["start", "start", "end", "fail", "notice"])
        rule = rng.choice(["cmd-test", "task-start", "todo", "write", "read"]) if kind != "fail" else rng.choice(["fail-test", "fail-tool"])
        rows.append((p, seq, kind, f"i{rng.randrange(5)}", rng.choice(["a", "b", None]), rule, rng.choice(["server", "analysis", None]), rng.choice([True, False, None])))
    return rows


def folded(rows):
    out = {}
    for p in {r[0] for r in rows}:
        s = window.fold_window({"begun": {}, "done": [], "now": None, "notice": None}, [r[2:] for r in sorted(rows, key=lambda r: r[1]) if r[0] == p])
        notice, now = s["notice"], s["now"] or [None, None]
        out[p] = (notice[0] if notice else "working", *now, *(notice[:2] if notice else (None, None)), [tuple(x) for x in s["done"]])
    return out


def shown(df):
    return {r["prompt"]: (r["status"], r["now"], r["now_rule"], r["notice"], r["notice_text"], [(x["text"], x["count"]) for x in r["done"]]) for r in df.collect()}


def test_states_of_prompts_against_the_fold(spark):
    rows = history(random.Random(1), 30, 3000)
    events = spark.createDataFrame(rows, EVENTS)
    assert shown(window.window_states(events)) == folded(rows)
    assert window.window_states(events.limit(0)).count() == 0
    ends = spark.createDataFrame([(0, "done"), (1, "interrupted"), (2, "waiting")], "prompt int, status string")
    got = shown(window.window_states(events, ends))
    assert got[0][:5] == ("done", None, None, None, None) and got[1][0] == "interrupted" and got[2] == folded(rows)[2]


def run(spark, frames, schema, made, tmp_path, name, mode="append", rocks=False):
    """What a stream says after each of the frames, and in the end."""
    source = tmp_path / "in"
    spark.createDataFrame([], schema).write.parquet(str(source))
    if rocks:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(source))
        query = made(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
        after = []
        for part in frames:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
            after.append(spark.table(name).collect())
        query.stop()
        return after
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_states_of_prompts_on_every_prefix(spark, tmp_path):
    rows = history(random.Random(2))
    cuts = [0, 7, 20, 21, 45, 60]
    frames = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    after = run(spark, frames, EVENTS, window.window_states_stream, tmp_path, "window_states_test", "update")
    for end, seen in zip(cuts[1:], after, strict=True):
        latest = {}
        for r in seen:
            latest[r["prompt"]] = (r["status"], r["now"], r["now_rule"], r["notice"], r["notice_text"], [(x["text"], x["count"]) for x in r["done"]])
        assert latest == folded(rows[:end]) == shown(window.window_states(spark.createDataFrame(rows[:end], EVENTS)))


def stitched(rows, carry=15, keep=3600):
    """Actions as a browser keeps them: a cookie, and how many segments each has."""
    out, cookie, known = [], {}, {}
    for session, seq, at, kind, action in sorted(rows, key=lambda r: r[1]):
        def mention(a, more, session=session, at=at):
            n, t = known.get((session, a), (0, at))
            known[session, a] = (more + (n if at - t <= keep else 0), at)
            return known[session, a][0]

        if kind == "action":
            mention(action, 0)
            out.append((session, seq, action, 1))
        elif kind == "leave":
            mention(action, 0)
            cookie[session] = (action, at)
        elif kind == "load" and session in cookie:
            a, since = cookie.pop(session)
            if at - since < carry:
                out.append((session, seq, a, mention(a, 1) + 1))
    return sorted(out)


ACTIONS = "session int, seq int, t double, kind string, action string"


def visits(rng, n=400):
    t, rows = 0.0, []
    for seq in range(n):
        t += rng.choice([0.5, 3, 9, 14, 15, 16, 40])
        kind = rng.choice(["action", "leave", "leave", "load", "load", "other"])
        rows.append((rng.randrange(3), seq, t, kind, f"a{rng.randrange(3)}" if kind in ("action", "leave") else None))
    return rows


def test_actions_go_on_across_documents(spark):
    rows = visits(random.Random(3))
    events = spark.createDataFrame(rows, ACTIONS).withColumn("at", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    assert sorted(map(tuple, window.continued_actions(events, keep=60).collect())) == stitched(rows, keep=60)
    assert window.continued_actions(events.limit(0)).count() == 0


def test_actions_as_a_stream_on_every_prefix(spark, tmp_path):
    rows = visits(random.Random(4), 120)
    cuts = [0, 1, 30, 75, 120]
    timed = lambda df: df.withColumn("at", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    after = run(spark, [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], ACTIONS, lambda s: window.continued_actions_stream(timed(s), keep=60), tmp_path, "actions_test", rocks=True)
    for end, seen in zip(cuts[1:], after, strict=True):
        batch = window.continued_actions(timed(spark.createDataFrame(rows[:end], ACTIONS)), keep=60)
        assert sorted(map(tuple, seen)) == stitched(rows[:end], keep=60) == sorted(map(tuple, batch.collect()))


def slow(lines, interval):
    """What is shown, a millisecond at a time."""
    out, shown_at, pending = [], None, None
    by = {}
    for at, text in lines:
        by.setdefault(at, []).append(text)
    for now in range(min(by), max(by) + interval + 1):
        if pending is not None and now == shown_at + interval:
            out.append((now, pending))
            shown_at, pending = now, None
        for text in by.get(now, []):
            if shown_at is None or now >= shown_at + interval:
                out.append((now, text))
                shown_at, pending = now, None
            else:
                pending = text
    return out


def test_lines_at_a_bounded_rate(spark):
    rng = random.Random(5)
    lines = [(rng.randrange(5), rng.randrange(3000), seq, f"l{seq}") for seq in range(300)] + [(None, 5, 900, "null"), (9, None, 901, "x"), (9, 1, 902, None)]
    df = spark.createDataFrame(lines, "who int, at int, seq int, words string")
    got = sorted(map(tuple, window.throttled(df, "who", "at", "words", "seq", 200).collect()), key=repr)
    want = []
    for key in {k for k, a, _, t in lines if a is not None and t is not None}:
        mine = sorted((a, s, t) for k, a, s, t in lines if k == key and a is not None and t is not None)
        want += [(None if key is None else str(key), *x) for x in slow([(a, t) for a, _, t in mine], 200)]
    assert got == sorted(want, key=repr)
    assert window.throttled(df.limit(0), "who", "at", "words", "seq").count() == 0
    assert [window.interval_of(x) for x in (None, 1, 5000, 10**9)] == [1500, 200, 5000, 60_000]


def test_lines_at_a_bounded_rate_as_a_stream(spark, tmp_path):
    rng = random.Random(6)
    times = sorted(rng.randrange(6000) for _ in range(80))
    rows = [(rng.randrange(2), t, seq, f"l{seq}") for seq, t in enumerate(times)]
    schema = "key long, ms long, seq int, text string"
    frames = [rows[:30], rows[30:55], rows[55:], [(7, 60_000, 900, "late")], [(7, 120_000, 901, "later")]]
    made = lambda s: window.throttled_stream(s.withColumn("at", F.timestamp_micros(F.col("ms") * 1000)), 300)
    after = run(spark, frames, schema, made, tmp_path, "lines_test", rocks=True)
    batch = window.throttled(spark.createDataFrame(rows, schema), "key", "ms", "text", "seq", 300)
    assert sorted(tuple(r) for r in after[-1] if r["key"] != 7) == sorted(map(tuple, batch.collect()))


def test_subjects_of_tasks(spark):
    rows = [
        ("s", 1, "end", "TaskCreate", None, "Build it", "1"), ("s", 2, "start", "TaskUpdate", "1", None, None), ("s", 3, "start", "TaskUpdate", "1", "Own", None), ("s", 4, "start", "TaskUpdate", "2", None, None),
        ("s", 5, "end", "TaskCreate", None, None, "1"), ("s", 6, "start", "TaskUpdate", "1", None, None), ("t", 7, "start", "TaskUpdate", "1", None, None), ("s", 8, "start", "TaskCreate", None, "x", "2"), ("s", 9, "end", "TaskCreate", None, "y", None),
    ]
    got = window.task_subjects(spark.createDataFrame(rows, "session string, seq int, kind string, tool string, task string, subject string, result string"))
    assert sorted(map(tuple, got.collect())) == [("s", 2, "1", "Build it"), ("s", 3, "1", "Own"), ("s", 4, "2", ""), ("s", 6, "1", ""), ("t", 7, "1", "")]
