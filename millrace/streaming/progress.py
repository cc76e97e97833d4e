"""State that progress events add up to, on streams; the batch twins are in operators.events."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import step_of_stage

SECOND_MS = 1_000


def _timeout(keep_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout


def throttled(events: DataFrame, key: str = "id", least_ms: int = SECOND_MS, keep_ms: int | None = None) -> DataFrame:
    """Events (key, seq, at) that are ``least_ms`` or more after the last one that was let through.

    One clock for each key, whatever the stage.  With ``keep_ms``, which should be above ``least_ms``, a key is forgotten so long after its last event.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        kept = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            if last is None or row.at - last >= least_ms:
                last = int(row.at)
                kept.append((name[0], int(row.seq), last))
        state.update((last,))
        if keep_ms:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(kept, columns=[key, "seq", "at"])

    kind = dict(events.dtypes)[key]
    return events.select(key, "seq", "at").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seq bigint, at bigint", "last bigint", "append", _timeout(keep_ms))


def step_states(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """The state of each step after each micro-batch, from events (id, seq, at, event, stage, current, total).

    With ``keep_ms`` a step is forgotten so long after its last event.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, status, progress, started, finished = state.get if state.exists else (-1, "pending", 0.0, None, None)
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            started = int(row.at) if started is None else min(started, int(row.at))
            if row.seq < seq:  # an event that came late does not undo a later one
                continue
            seq = int(row.seq)
            if row.event == "stage_complete":
                status, progress, finished = "done", 100.0, int(row.at)
            else:
                known = row.event == "progress" and not pd.isna(row.current) and not pd.isna(row.total) and row.total > 0
                status, progress, finished = "active", math.floor(row.current / row.total * 10_000 + 0.5) / 100 if known else 0.0, None
        state.update((seq, status, progress, started, finished))
        if keep_ms:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame({"id": [name[0]], "step": [name[1]], "status": [status], "progress": [progress], "started_at": [started], "finished_at": pd.array([finished], "Int64")})

    known = events.withColumn("step", step_of_stage(events["stage"])).filter("step is not null and event in ('stage', 'progress', 'stage_complete')")
    kind = dict(events.dtypes)["id"]
    schema = f"id {kind}, step int, status string, progress double, started_at bigint, finished_at bigint"
    kept = "seq bigint, status string, progress double, started_at bigint, finished_at bigint"
    return known.groupBy("id", "step").applyInPandasWithState(step, schema, kept, "update", _timeout(keep_ms))


def first_seen(files: DataFrame, horizon: str | None = None, at: str = "modified") -> DataFrame:
    """Each path once. With a ``horizon`` the memory of paths is bounded by the watermark of ``at``."""
    return files.withWatermark(at, horizon).dropDuplicatesWithinWatermark(["path"]) if horizon else files.dropDuplicates(["path"])
