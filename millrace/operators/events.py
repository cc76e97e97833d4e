"""Progress events: parsing, routing, throttling and the state that they add up to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import percent
from .jobs import STAGE_STEPS, STEPS

#: Every field that an event may have; each kind of event uses some.
EVENT_SCHEMA = "event string, stage int, label string, current bigint, total bigint, total_frames bigint, total_zones bigint, scenes bigint, message string, version string"


def parsed_lines(lines: DataFrame, column: str = "value", schema: str = EVENT_SCHEMA) -> DataFrame:
    """Adds ``event``: the JSON of a line; a line that is none has all of it in ``event._corrupt``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return lines.withColumn("event", F.from_json(column, f"{schema}, _corrupt string", options))


def step_of_stage(stage: Column) -> Column:
    """The index of the step that a stage reports to; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in STAGE_STEPS.items() for x in pair]), stage)


def initial_steps(jobs: DataFrame) -> DataFrame:
    """(id, step, label, status, progress): every job with all steps pending."""
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("label")) for i, name in enumerate(STEPS)])
    return jobs.select("id", F.inline(rows)).withColumns({"status": F.lit("pending"), "progress": F.lit(0.0)})


def step_states(events: DataFrame) -> DataFrame:
    """(id, step, status, progress, started_at, finished_at) from events (id, seq, at, event, stage, current, total).

    The last event of a step decides; progress is the last known per cent to two digits (0 of no total), 0 after a start
    and 100 when complete.
    """
    known = events.withColumn("step", step_of_stage(F.col("stage"))).filter("step is not null and event in ('stage', 'progress', 'stage_complete')")
    last = F.max_by(F.struct("event", percent(F.col("current"), F.col("total")).alias("percent")), "seq")
    found = known.groupBy("id", "step").agg(last.alias("last"), F.min("at").alias("started_at"), F.max_by("at", "seq").alias("at"))
    done = F.col("last.event") == "stage_complete"
    progress = F.when(done, 100.0).when(F.col("last.event") == "progress", F.coalesce("last.percent", F.lit(0.0))).otherwise(0.0)
    return found.select("id", "step", F.when(done, "done").otherwise("active").alias("status"), progress.alias("progress"), "started_at", F.when(done, F.col("at")).alias("finished_at"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``, as one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, "last.*")


def changes(rows: DataFrame, key: str, order: Sequence[str], state: Sequence[str]) -> DataFrame:
    """Rows whose ``state`` differs from that of the row before."""
    digest = F.xxhash64(*state)
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_changed", before.isNull() | (before != digest)).filter("_changed").drop("_changed")


def first_in_window(rows: DataFrame, key: str, width_ms: int, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """The first row of each key in each tumbling window."""
    window = F.floor(F.unix_millis(F.col(at).cast("timestamp")) / width_ms)
    rest = [c for c in rows.columns if c != key]
    first = rows.withColumn("_window", window).groupBy(key, "_window").agg(F.min_by(F.struct(*rest), F.struct(at, tie)).alias("first"))
    return first.select(key, "first.*")
