"""Streaming forms of the event operators; each has a batch form that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def deduplicated(events: DataFrame, key: list[str], at: str = "ts", late: str = LATE) -> DataFrame:
    """Each key's first row; state is dropped once the watermark is past."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def quiet_sessions(events: DataFrame, by: str, at: str = "ts", gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Sessions that end after a quiet gap: key, started, ended, n."""
    rows = events.withWatermark(at, late).groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("ended"))
    return rows.select(by, F.col("w.start").alias("started"), "ended", "n")


def windowed_counts(events: DataFrame, kind: str, at: str = "ts", width: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Counts of each kind by windows of time."""
    rows = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("started"), kind, "n")


PROMPT = "session string, prompt long, status string, end string"
_STATE = "open array<long>, waiting array<long>"


def fold_prompts(opened: list[int], waiting: list[int], rows: list[tuple[str, int, int]]) -> tuple[list[int], list[int], list[tuple[int, str, str | None]]]:
    """Events of one session, in order, on the prompts that are open.

    rows: (kind, prompt, background tasks).  A start closes what the session left open;
    a stop ends a prompt, or lets it wait for its background tasks; an end closes all.
    """
    out: list[tuple[int, str, str | None]] = []
    for kind, prompt, background in rows:
        if kind == "start" and prompt not in opened:
            out += [(p, "done" if p in waiting else "interrupted", "next-prompt") for p in opened]
            opened, waiting = [prompt], []
            out.append((prompt, "running", None))
        elif kind == "stop" and prompt in opened:
            if background:
                waiting = [*waiting, prompt] if prompt not in waiting else waiting
                out.append((prompt, "waiting", None))
            else:
                opened, waiting = [p for p in opened if p != prompt], [p for p in waiting if p != prompt]
                out.append((prompt, "done", "stop"))
        elif kind == "session-end":
            out += [(p, "interrupted", "session-end") for p in opened]
            opened, waiting = [], []
    return opened, waiting, out


def _ordered(frames: Iterator[pd.DataFrame]) -> list[tuple[str, int, int]]:
    frames = list(frames)
    rows = pd.concat(frames).sort_values("seq", kind="stable") if frames else pd.DataFrame(columns=["kind", "prompt", "background"])
    return [(k, int(p), int(b)) for k, p, b in zip(rows["kind"], rows["prompt"].fillna(-1), rows["background"].fillna(0), strict=True)]


def prompt_states_stream(events: DataFrame) -> DataFrame:
    """Changes of prompts' states from a stream of session, seq, kind, prompt, background."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, waiting = (list(x) for x in state.get) if state.exists else ([], [])
        opened, waiting, out = fold_prompts(opened, waiting, _ordered(frames))
        state.update((opened, waiting))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["session", "prompt", "status", "end"])

    return events.groupBy("session").applyInPandasWithState(step, PROMPT, _STATE, "append", GroupStateTimeout.NoTimeout)


def prompt_states_batch(events: DataFrame) -> DataFrame:
    """The same changes from a table: what a stream must give on every prefix."""
    def fold(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, _, out = fold_prompts([], [], _ordered(iter([group])))
        return pd.DataFrame([(key[0], *o) for o in out], columns=["session", "prompt", "status", "end"])

    return events.groupBy("session").applyInPandas(fold, PROMPT)
