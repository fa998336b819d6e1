"""What an assistant's window shows: tasks by name, the state of each prompt, actions across documents, lines at a bounded rate.

Each operator has a batch form, which is declarative or walks sorted partitions in
bounded memory, and a stream with keyed state; on every prefix both say the same.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Rules of sentences about the plan itself, and the rules of tests that fail and run.
PLANNING = ("task-create", "task-start", "task-done", "task-update", "task-read", "todo", "plan-mode", "skill")
FAILED_TEST, TEST = "fail-test", "cmd-test"
#: Actions that a prompt's state keeps.
DONE_LIMIT = 30


def task_subjects(events: DataFrame) -> DataFrame:
    """session, seq, task, subject of the task updates: their own subject, else what the task was called when it was created.

    events: session, seq, kind, tool, task, subject, result.  A creation tells the task's
    id in the result of its end; of several creations of an id the last before the update counts.
    """
    made = (F.col("tool") == "TaskCreate") & (F.col("kind") == "end") & F.col("result").isNotNull()
    asked = (F.col("tool") == "TaskUpdate") & (F.col("kind") == "start")
    rows = events.where(made | asked).select("session", "seq", F.when(made, F.col("result")).otherwise(F.col("task")).alias("task"), "subject", asked.alias("asks"))
    before = Window.partitionBy("session", "task").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    named = F.last(F.when(~F.col("asks"), F.struct("subject")), ignorenulls=True).over(before)
    rows = rows.withColumn("named", named).where("asks")
    return rows.select("session", "seq", "task", F.coalesce("subject", "named.subject", F.lit("")).alias("subject"))


def _is_set(kind: Column) -> Column:
    """Starts that say something and don't wait: those an end looks back to."""
    return (kind == "start") & F.col("text").isNotNull() & ~F.coalesce("waiting", F.lit(False))


def window_states(events: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """prompt, status, now, now_rule, notice, notice_text, done: what the window of each prompt shows.

    events: prompt, seq, kind (start, end, fail or notice), id, text (null: nothing to
    say), rule, area, waiting; prompts: prompt, status.  done has the last DONE_LIMIT
    actions that ended, equal ones in a row as one with their count.  An asking notice goes
    with anything done after it; a problem goes with the next action that works, a failed
    test only with a test that passes.  An action ends once.  Each part is one aggregate
    or window by prompt; only DONE_LIMIT rows of a prompt are gathered.
    """
    kind, waits = F.col("kind"), F.coalesce("waiting", F.lit(False))
    rows = events.select("prompt", "seq", "kind", "id", "text", "rule", "area", "waiting")
    marks = rows.where(_is_set(kind) | (kind == "end"))
    of = Window.partitionBy("prompt", "id").orderBy("seq")
    begun = F.lag(F.struct("kind", "text", "rule", "area")).over(of)
    ends = marks.withColumn("begun", begun).where("kind = 'end'").select("prompt", "seq", F.when(F.col("begun.kind") == "start", F.col("begun")).alias("of"))

    plans = F.col("rule").isin(*PLANNING)
    says = F.col("text").isNotNull()
    at_work = _is_set(kind) & (~F.coalesce(plans, F.lit(False)) | (F.col("rule") == "task-start"))
    sets = (kind.isin("start", "notice") & says & waits) | ((kind == "fail") & says)
    last = lambda cond: F.max(F.when(cond, F.col("seq")))
    known = rows.groupBy("prompt").agg(
        F.max_by(F.struct("text", "rule"), F.when(at_work, F.col("seq"))).alias("now"),
        F.max_by(F.struct(F.when(kind == "fail", "problem").otherwise("waiting").alias("kind"), "text", "rule"), F.when(sets, F.col("seq"))).alias("notice"),
        last(sets).alias("set_at"), last(kind.isin("start", "end")).alias("moved_at"), last(kind == "end").alias("ended_at"),
    )
    tests = ends.where(F.col("of.rule") == TEST).groupBy("prompt").agg(F.max("seq").alias("tested_at"))
    both = known.join(tests, "prompt", "left")
    after = lambda name: F.coalesce(F.col(name) > F.col("set_at"), F.lit(False))
    cleared = F.when(F.col("notice.kind") == "waiting", after("moved_at")).when(F.col("notice.rule") == FAILED_TEST, after("tested_at")).otherwise(after("ended_at"))

    shown = ends.where(F.col("of.text").isNotNull() & ~F.coalesce(F.col("of.rule").isin(*PLANNING), F.lit(False)) & (F.coalesce("of.area", F.lit("")) != "analysis"))
    order = Window.partitionBy("prompt").orderBy("seq")
    steps = shown.select("prompt", "seq", F.col("of.text").alias("text"))
    steps = steps.withColumn("new", F.coalesce(F.lag("text").over(order) != F.col("text"), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    runs = steps.groupBy("prompt", "run", "text").agg(F.count("*").alias("count"))
    kept = runs.withColumn("late", F.row_number().over(Window.partitionBy("prompt").orderBy(F.desc("run")))).where(F.col("late") <= DONE_LIMIT)
    done = kept.groupBy("prompt").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "text", "count"))), lambda x: F.struct(x["text"].alias("text"), x["count"].alias("count"))).alias("done"))

    whole = both.join(done, "prompt", "left")
    if prompts is not None:
        whole = whole.join(prompts.select("prompt", F.col("status").alias("says")), "prompt", "left")
    said = F.coalesce(F.col("says"), F.lit("running")) if prompts is not None else F.lit("running")
    finished = ~said.isin("running", "waiting")
    notice = F.when(~finished & F.col("notice").isNotNull() & ~cleared, F.col("notice"))
    status = F.when(said == "interrupted", "interrupted").when(finished, "done").otherwise(F.coalesce(notice["kind"], F.lit("working")))
    none = F.array().cast("array<struct<text:string,count:bigint>>")
    return whole.select(
        "prompt", status.alias("status"), F.when(~finished, F.col("now.text")).alias("now"), F.when(~finished, F.col("now.rule")).alias("now_rule"),
        notice["kind"].alias("notice"), notice["text"].alias("notice_text"), F.coalesce("done", none).alias("done"),
    )


_STATE = "prompt {key}, status string, now string, now_rule string, notice string, notice_text string, done array<struct<text:string,count:bigint>>"


def fold_window(state: dict, rows: list[tuple]) -> dict:
    """The state of one prompt after more of its events, in order: (kind, id, text, rule, area, waiting)."""
    begun, done = dict(state["begun"]), [list(x) for x in state["done"]]
    now, notice = state["now"], state["notice"]
    for kind, id_, text, rule, area, waiting in rows:
        id_ = str(id_)
        if kind in ("start", "end") and notice and notice[0] == "waiting":
            notice = None
        if kind == "start" and text is not None:
            if waiting:
                notice = ["waiting", text, rule]
                continue
            begun[id_] = [text, rule, area]
            if rule not in PLANNING or rule == "task-start":
                now = [text, rule]
        elif kind == "end":
            of = begun.pop(id_, None)
            if notice and notice[0] == "problem" and (notice[2] != FAILED_TEST or of and of[1] == TEST):
                notice = None
            if of and of[1] not in PLANNING and of[2] != "analysis":
                if done and done[-1][0] == of[0]:
                    done[-1][1] += 1
                else:
                    done = [*done, [of[0], 1]][-DONE_LIMIT:]
        elif kind == "fail" and text is not None:
            notice = ["problem", text, rule]
        elif kind == "notice" and text is not None and waiting:
            notice = ["waiting", text, rule]
    return {"begun": begun, "done": done, "now": now, "notice": notice}


def window_states_stream(events: DataFrame) -> DataFrame:
    """The states of prompts from a stream of events, a row for each prompt that changed (update mode)."""
    names = ["kind", "id", "text", "rule", "area", "waiting"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"begun": {}, "done": [], "now": None, "notice": None}
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        plain = rows[names].astype(object).where(rows[names].notna(), None)
        kept = fold_window(kept, list(plain.itertuples(index=False, name=None)))
        state.update((json.dumps(kept),))
        notice, now = kept["notice"], kept["now"] or [None, None]
        row = (key[0], notice[0] if notice else "working", *now, *(notice[:2] if notice else (None, None)), [{"text": t, "count": n} for t, n in kept["done"]])
        yield pd.DataFrame([row], columns=["prompt", "status", "now", "now_rule", "notice", "notice_text", "done"])

    key = events.schema["prompt"].dataType.simpleString()
    return events.groupBy("prompt").applyInPandasWithState(step, _STATE.format(key=key), "state string", "update", GroupStateTimeout.NoTimeout)


# actions that go on across documents

#: Seconds in which a new document goes on with the action that left for it, and after which an action that nothing mentions is forgotten.
CARRY, KEEP = 15, 3600
_SEGMENT = "session {key}, seq long, action string, segment long"


def _seconds(at: str) -> Column:
    return F.unix_micros(at) / 1e6


def continued_actions(events: DataFrame, carry: float = CARRY, keep: float = KEEP) -> DataFrame:
    """session, seq, action, segment: where actions begin (segment 1) and which documents go on with them.

    events: session, seq, at (timestamp), kind (action, leave or load), action.  A load goes
    on with the action of the leave before it, if no other load came between and fewer
    than `carry` seconds passed.  An action that nothing mentions for `keep` seconds is
    forgotten: its segments count anew.
    """
    rows = events.where(F.col("kind").isin("action", "leave", "load")).select("session", "seq", _seconds("at").alias("t"), "kind", "action")
    order = Window.partitionBy("session").orderBy("seq")
    moves = rows.where("kind <> 'action'").withColumn("prior", F.lag(F.struct("kind", "action", "t")).over(order))
    goes_on = (F.col("kind") == "load") & (F.col("prior.kind") == "leave") & (F.col("t") - F.col("prior.t") < carry)
    loads = moves.where(goes_on).select("session", "seq", "t", "kind", F.col("prior.action").alias("action"))
    mentions = rows.where("kind <> 'load'").unionByName(loads)
    of = Window.partitionBy("session", "action").orderBy("seq")
    gap = F.coalesce((F.col("t") - F.lag("t").over(of)) > keep, F.lit(True)).cast("int")
    lives = mentions.withColumn("gap", gap).withColumn("life", F.sum("gap").over(of))
    counted = lives.withColumn("n", F.count_if(F.col("kind") == "load").over(Window.partitionBy("session", "action", "life").orderBy("seq")))
    return counted.where("kind <> 'leave'").select("session", "seq", "action", F.when(F.col("kind") == "action", 1).otherwise(F.col("n") + 1).cast("long").alias("segment"))


class _Stitch(StatefulProcessor):
    """The open cookie of a session, and the segments and the last mention of its actions; timers forget both."""

    def __init__(self, carry: float, keep: float):
        self.carry, self.keep = carry, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cookie = handle.getValueState("cookie", "action string, t double")
        self.actions = handle.getMapState("actions", "action string", "n long, t double")

    def _mention(self, action: str, t: float, more: int) -> int:
        known = self.actions.getValue((action,)) if self.actions.containsKey((action,)) else None
        n = more + (known[0] if known and t - known[1] <= self.keep else 0)
        self.actions.updateValue((action,), (n, t))
        self.handle.registerTimer(int((t + self.keep) * 1000) + 1)
        return n

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        out = []
        for seq, at, kind, action in pd.concat(frames).sort_values("seq", kind="stable")[["seq", "at", "kind", "action"]].itertuples(index=False, name=None):
            t = pd.Timestamp(at).value / 1e9
            if kind == "action":
                self._mention(action, t, 0)
                out.append((key[0], int(seq), action, 1))
            elif kind == "leave":
                self._mention(action, t, 0)
                self.cookie.update((action, t))
            elif kind == "load" and self.cookie.exists():
                carried, since = self.cookie.get()
                self.cookie.clear()
                if t - since < self.carry:
                    out.append((key[0], int(seq), carried, self._mention(carried, t, 1) + 1))
        yield pd.DataFrame(out, columns=["session", "seq", "action", "segment"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        for (action,), (_, t) in list(self.actions.iterator()):
            if t + self.keep <= now:
                self.actions.removeKey((action,))
        if self.cookie.exists() and self.cookie.get()[1] + self.carry <= now:
            self.cookie.clear()
        yield pd.DataFrame([], columns=["session", "seq", "action", "segment"])

    def close(self) -> None:
        pass


def continued_actions_stream(events: DataFrame, late: str = "10 seconds", carry: float = CARRY, keep: float = KEEP) -> DataFrame:
    """The same from a stream (append mode, RocksDB state): event-time timers clear cookies and actions that are past."""
    key = events.schema["session"].dataType.simpleString()
    rows = events.where(F.col("kind").isin("action", "leave", "load")).withWatermark("at", late)
    return rows.groupBy("session").transformWithStateInPandas(_Stitch(carry, keep), _SEGMENT.format(key=key), "Append", "EventTime")


# lines at a bounded rate

#: Milliseconds between two lines that are shown: the usual, the least and the most.
INTERVAL, LEAST, MOST = 1500, 200, 60_000
_LINE = "key {key}, at long, text string"


def interval_of(wanted: int | None) -> int:
    """The interval that a setting asks for, inside its bounds."""
    return INTERVAL if wanted is None else min(max(int(wanted), LEAST), MOST)


def throttle(shown: int | None, pending: str | None, lines: list[tuple[int, str]], interval: int) -> tuple[int | None, str | None, list[tuple[int, str]]]:
    """When a line was last shown, the one that waits, and what more lines (at, text) make shown: at once if the interval has passed, else the newest when it has."""
    out = []
    for at, text in lines:
        if pending is not None and at >= shown + interval:
            shown += interval
            out.append((shown, pending))
            pending = None
        if shown is None or at >= shown + interval:
            out.append((at, text))
            shown = at
        else:
            pending = text
    return shown, pending, out


def _walk(batches: Iterator[pa.RecordBatch], interval: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Lines sorted by key and time; a key's last waiting line is shown when its time has come."""
    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ((), (), ()), schema, strict=True)], schema=schema)

    key, shown, pending, begun = None, None, None, False
    for batch in batches:
        out = []
        for k, at, text in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "text")), strict=True):
            if begun and k != key:
                out += [(key, shown + interval, pending)] if pending is not None else []
                shown, pending = None, None
            key, begun = k, True
            shown, pending, more = throttle(shown, pending, [(at, text)], interval)
            out += [(key, *m) for m in more]
        yield made(out)
    yield made([(key, shown + interval, pending)] if pending is not None else [])


def throttled(lines: DataFrame, key: str, at: str, text: str, order: str, interval: int = INTERVAL) -> DataFrame:
    """key, at (milliseconds), text: the lines that are shown, no two of a key closer than the interval, and always the newest.

    lines: key, at (milliseconds), text (nulls go), and an order for lines of one
    time.  Partitions are sorted and walked with one line of each key in memory.
    """
    kind = lines.schema[key].dataType
    rows = lines.where(F.col(at).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("long").alias("at"), F.col(text).cast("string").alias("text"), F.col(order).alias("o"))
    arrow = pa.schema([("key", pa.int64() if kind.simpleString() == "bigint" else pa.string()), ("at", pa.int64()), ("text", pa.string())])
    rows = rows.withColumn("key", F.col("key").cast("bigint" if kind.simpleString() == "bigint" else "string"))
    dealt = rows.repartition("key").sortWithinPartitions("key", "at", "o")
    return dealt.mapInArrow(partial(_walk, interval=interval, schema=arrow), _LINE.format(key="bigint" if kind.simpleString() == "bigint" else "string"))


class _Throttle(StatefulProcessor):
    """The time and the line of each key; a timer shows the line that waits."""

    def __init__(self, interval: int):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "shown long, pending string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        lines = [(pd.Timestamp(a).value // 10**6, t) for a, t in zip(frame["at"], frame["text"], strict=True)]
        shown, pending = self.kept.get() if self.kept.exists() else (None, None)
        shown, pending, out = throttle(shown, pending, lines, self.interval)
        self.kept.update((shown, pending))
        if pending is not None:
            self.handle.registerTimer(shown + self.interval)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["key", "at", "text"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        shown, pending = self.kept.get() if self.kept.exists() else (None, None)
        due = pending is not None and expiredTimerInfo.getExpiryTimeInMs() >= shown + self.interval
        if due:
            self.kept.update((shown + self.interval, None))
        yield pd.DataFrame([(key[0], shown + self.interval, pending)] if due else [], columns=["key", "at", "text"])

    def close(self) -> None:
        pass


def throttled_stream(lines: DataFrame, interval: int = INTERVAL, late: str = "0 seconds") -> DataFrame:
    """The same from a stream of key, at (timestamp), seq and text (append mode, RocksDB state); timers of event time show what waits."""
    key = lines.schema["key"].dataType.simpleString()
    rows = lines.where(F.col("at").isNotNull() & F.col("text").isNotNull()).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(_Throttle(interval), _LINE.format(key=key), "Append", "EventTime")
