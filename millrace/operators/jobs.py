"""The job queue: listing, reordering, deduplication, settings and progress."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.numbers import half_up, percent
from ..functions.text import ACTIVE_STATUSES, short_duration

#: The steps of a job.
STEPS = ("Analyze", "Prepare", "Fast Pass", "Metrics", "Scenes", "Zones", "Final Encode", "Audio", "Mux & Finish")
#: The step that each stage of the encoder reports to.
STAGE_STEPS = {0: 2, 1: 3, 2: 4, 3: 5, 4: 6}
#: An active job gives no estimate before it ran so long.
WARM_UP_MS = 3_000


def is_active(status: Column) -> Column:
    return status.isin(*ACTIVE_STATUSES)


def status_bucket(status: Column) -> Column:
    """Active jobs first, then queued (and unknown), done, error."""
    return F.when(is_active(status), 0).when(status == "done", 2).when(status == "error", 3).otherwise(1)


def listing_order() -> list[Column]:
    """Bucket, then queue order among queued jobs, then start; the id breaks ties."""
    return [status_bucket(F.col("status")), F.when(F.col("status") == "queued", F.col("queue_order")), F.coalesce("started_at", F.lit(0).cast("bigint")), F.col("id")]


def next_job(jobs: DataFrame) -> DataFrame:
    """The queued job with the least queue order: a top-1, not a sort of the table."""
    return jobs.filter(F.col("status") == "queued").orderBy("queue_order", "id").limit(1)


def next_jobs(jobs: DataFrame, queue: str = "queue") -> DataFrame:
    """The same for each queue, as one aggregation."""
    rest = [c for c in jobs.columns if c != queue]
    first = F.min_by(F.struct(*rest), F.struct("queue_order", "id")).alias("first")
    return jobs.filter(F.col("status") == "queued").groupBy(queue).agg(first).select(queue, "first.*")


def to_enqueue(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Candidates (input_path) without a live job of the path; live is neither error nor done."""
    live = jobs.filter(~F.col("status").isin("error", "done")).select("input_path")
    return candidates.join(live, "input_path", "left_anti")


def editable(status: Column) -> Column:
    return status == "queued"


def removable(status: Column) -> Column:
    return status.isin("queued", "done", "error")


def retryable(status: Column) -> Column:
    return status == "error"


def moved_one(jobs: DataFrame, chosen: Column, up: bool, queue: str = "queue") -> DataFrame:
    """Queued jobs (queue, id, queue_order) after each chosen one has swapped places with its neighbour, as ``new_order``.

    No two neighbours may be chosen; at the end of the queue nothing moves.
    """
    order = Window.partitionBy(queue).orderBy("queue_order", "id")
    picked = jobs.withColumn("chosen", chosen)
    gives, takes = (F.lag, F.lead) if up else (F.lead, F.lag)
    target, comes = gives("queue_order").over(order), F.coalesce(takes("chosen").over(order), F.lit(False))
    new = F.when(F.col("chosen") & target.isNotNull(), target).when(comes, takes("queue_order").over(order)).otherwise(F.col("queue_order"))
    return picked.withColumn("new_order", new).drop("chosen")


def moved_to_end(jobs: DataFrame, chosen: Column, top: bool, queue: str = "queue") -> DataFrame:
    """Queued jobs after the chosen one got an order before the least or after the largest; at the end already it stays."""
    whole = Window.partitionBy(queue)
    edge = F.min("queue_order").over(whole) if top else F.max("queue_order").over(whole)
    new = F.when(chosen & (F.col("queue_order") != edge), edge + (-1 if top else 1)).otherwise(F.col("queue_order"))
    return jobs.withColumn("new_order", new)


def reordered(jobs: DataFrame, ids: DataFrame, queue: str = "queue") -> DataFrame:
    """Queued jobs with ``new_order`` from 1 on by the places of ``ids`` (queue, id, place); unlisted ones keep their order.

    Ids that are unknown or not queued are passed over.
    """
    known = ids.join(jobs.select(queue, "id"), [queue, "id"])
    known = known.withColumn("rank", F.row_number().over(Window.partitionBy(queue).orderBy("place")).cast("bigint"))
    return jobs.join(known.select(queue, "id", "rank"), [queue, "id"], "left").withColumn("new_order", F.coalesce("rank", "queue_order")).drop("rank")


def slots_reassigned(jobs: DataFrame, place: Column, queue: str = "queue") -> DataFrame:
    """The k-th job by ``place`` takes the k-th least queue order of its queue."""
    ranked = jobs.withColumn("k", F.row_number().over(Window.partitionBy(queue).orderBy(place, "id")))
    slots = jobs.select(queue, F.col("queue_order").alias("new_order"), F.row_number().over(Window.partitionBy(queue).orderBy("queue_order", "id")).alias("k"))
    return ranked.join(slots, [queue, "k"]).drop("k")


def _folded(orders: dict, listed: list, log: list[tuple]) -> dict:
    """The queue orders of a queue's jobs after the edits (kind, target, ids) of ``log``; without ids those of ``listed`` are taken.

    A reorder of all jobs leaves the same whatever was before, so the last of them is the first edit that is looked at.  What is
    ranked is kept ranked from edit to edit.
    """
    known: dict[int, list] = {}

    def ids_of(k: int) -> list:
        ids = log[k][2]
        at = -1 if ids is None else k  # the listing is looked through once for all edits
        if at not in known:
            known[at] = [i for i in (listed if ids is None else ids) if i in orders]
        return known[at]

    start = next((k for k in range(len(log) - 1, -1, -1) if log[k][0] == "reorder" and len(ids_of(k)) >= len(orders) and len(set(ids_of(k))) == len(orders)), 0)
    ranked = None
    for k in range(start, len(log)):
        kind, target, _ = log[k]
        if kind in ("reorder", "slots"):
            ids = ids_of(k)
            orders.update(zip(ids, range(1, len(ids) + 1) if kind == "reorder" else sorted(orders[i] for i in ids), strict=True))
            ranked = None
            continue
        if target not in orders:
            continue
        if ranked is None:
            ranked = sorted(zip(orders.values(), orders, strict=True))
        at = bisect_left(ranked, (orders[target], target))
        other = at - 1 if kind == "up" else at + 1
        moved = {}
        if kind in ("up", "down") and 0 <= other < len(ranked):
            moved = {target: ranked[other][0], ranked[other][1]: ranked[at][0]}
        elif kind == "top" and at > 0:
            moved = {target: ranked[0][0] - 1}
        elif kind == "bottom" and at < len(ranked) - 1:
            moved = {target: ranked[-1][0] + 1}
        for i in moved:
            del ranked[bisect_left(ranked, (orders[i], i))]
        for i, order in moved.items():
            orders[i] = order
            insort(ranked, (order, i))
    return orders


def edited_in_order(jobs: DataFrame, edits: DataFrame, queue: str = "queue", listing: DataFrame | None = None) -> DataFrame:
    """Queued jobs (queue, id, queue_order) with ``new_order`` after a log of edits (queue, place, kind, id, ids), one after the other.

    ``up`` and ``down`` swap with the neighbour, ``top`` and ``bottom`` go before the least and after the largest order, ``reorder`` numbers
    ``ids`` from 1, ``slots`` deals the orders of ``ids`` out to them as listed.  Where ``ids`` is null it is the queue's ``listing`` (queue, place, id), if one
    is given, so that a list that many edits share is not repeated.  An edit of an unknown id does nothing.  Each queue is folded on its own:
    an edit depends on the edits before it, so a queue is the unit of work.  Many queues are folded in each batch.
    """
    kinds = dict(jobs.dtypes)
    lists = {"jobs": (jobs, ["id", "queue_order"]), "log": (edits, ["place", "kind", "id", "ids"])}
    if listing is not None:
        lists["listed"] = (listing, ["place", "id"])
    rows = None
    for name, (df, columns) in lists.items():
        own = df.select(F.col(queue).cast(kinds[queue]).alias(queue), F.struct(*columns).alias(name))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    # nulls are not collected: each row goes to the list of its table
    together = rows.groupBy(queue).agg(F.collect_list("jobs").alias("jobs"), *(F.sort_array(F.collect_list(n)).alias(n) for n in lists if n != "jobs")).filter(F.size("jobs") > 0)
    if listing is None:
        together = together.withColumn("listed", F.lit(None).cast(f"array<struct<id:{kinds['id']}>>"))
    schema = StructType([StructField(n, jobs.schema[n].dataType) for n in (queue, "id", "queue_order")] + [StructField("new_order", LongType())])

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n).flatten() for n in ("jobs", "log", "listed")}
            sizes = {n: pc.fill_null(pc.list_value_length(batch.column(n)), 0).to_pylist() for n in columns}
            values = lambda n, c: iter(columns[n].field(c).to_pylist())
            ids, places, listed = values("jobs", "id"), values("jobs", "queue_order"), values("listed", "id")
            log, new = zip(values("log", "kind"), values("log", "id"), values("log", "ids"), strict=True), []
            for n_jobs, n_log, n_listed in zip(sizes["jobs"], sizes["log"], sizes["listed"], strict=True):
                own = list(islice(ids, n_jobs))
                orders = dict(zip(own, islice(places, n_jobs), strict=True))
                orders = _folded(orders, list(islice(listed, n_listed)), list(islice(log, n_log)))
                new += [orders[i] for i in own]
            of = batch.column(queue).take(pc.list_parent_indices(batch.column("jobs")))
            yield pa.RecordBatch.from_arrays([of, columns["jobs"].field("id"), columns["jobs"].field("queue_order"), pa.array(new, pa.int64())], names=schema.names)

    return together.select(queue, "jobs", "log", "listed").mapInArrow(fold, schema)


def by_id(jobs: DataFrame, job_id: object) -> DataFrame:
    """The job of an id; no row if there is none."""
    return jobs.filter(F.col("id") == job_id)


def patched(settings: Column, patch: Column) -> Column:
    """Settings (quality, speed, bitrates) with the patch's non-empty fields; bit rates merge by layout."""
    text = lambda name: F.coalesce(F.nullif(patch[name], F.lit("")), settings[name])
    fresh = F.coalesce(patch["bitrates"], F.create_map().cast("map<string,int>"))
    kept = F.map_filter(settings["bitrates"], lambda k, _: ~F.map_contains_key(fresh, k))
    return F.struct(text("quality").alias("quality"), text("speed").alias("speed"), F.map_concat(kept, fresh).alias("bitrates"))


def job_progress(step: Column) -> Column:
    """The mean progress of the steps of a group, to two digits; an aggregate."""
    return half_up(F.avg(step), 2)


def step_eta(started: Column, progress: Column, status: Column, now: Column) -> Column:
    """Milliseconds left of an active step with progress; null in its first seconds or if nothing is left."""
    elapsed = now - started
    left = elapsed / progress * 100 - elapsed
    return F.when((status == "active") & (progress > 0) & (elapsed >= WARM_UP_MS) & (left > 0), left)


def encode_ratio() -> Column:
    """Elapsed over playing time of the done jobs that have a duration."""
    timed = F.col("finished_at").isNotNull() & F.col("started_at").isNotNull() & (F.col("status") == "done") & (F.col("duration") > 0)
    elapsed = F.sum(F.when(timed, F.col("finished_at") - F.col("started_at")).cast("double"))
    return F.try_divide(elapsed, F.sum(F.when(timed, F.col("duration") * 1000.0)))


def folder_eta(jobs: DataFrame, now: Column, folder: str = "folder") -> DataFrame:
    """Time estimates by folder from (status, started_at, finished_at, duration, progress).

    Done jobs give the mean and the ratio of elapsed to playing time; what is left is estimated from the ratio
    where a duration is known, else from the mean.  A folder without done and active jobs has no row.
    """
    done = (F.col("status") == "done") & F.col("started_at").isNotNull() & F.col("finished_at").isNotNull()
    active, queued, timed = is_active(F.col("status")), F.col("status") == "queued", F.coalesce(F.col("duration") > 0, F.lit(False))
    spent = (F.col("finished_at") - F.col("started_at")).cast("double")
    playing, running = F.col("duration") * 1000.0, now - F.col("started_at")
    moving = active & F.col("started_at").isNotNull() & (F.col("progress") > 0)
    by_progress = F.when(running > WARM_UP_MS, F.greatest(F.lit(0.0), running / F.col("progress") * 100 - running)).otherwise(0.0)
    waiting = active & ~F.coalesce(moving, F.lit(False))
    total = lambda when, value: F.coalesce(F.sum(F.when(when, value)), F.lit(0.0))
    sums = jobs.groupBy(folder).agg(
        F.count_if(done).alias("done_count"), F.count_if(active).alias("active_count"), F.count_if(queued).alias("queued_count"),
        total(done, spent).alias("total_elapsed"), total(active & F.col("started_at").isNotNull(), running.cast("double")).alias("active_elapsed"),
        F.try_divide(F.sum(F.when(done & timed, spent)), F.sum(F.when(done & timed, playing))).alias("ratio"),
        total(moving, by_progress).alias("_moving"), F.count_if(waiting).alias("_waiting"), total(waiting & timed, playing).alias("_waiting_ms"),
        F.count_if(queued & ~timed).alias("_untimed"), total(queued & timed, playing).alias("_queued_ms"),
    ).filter("done_count + active_count > 0")
    sums = sums.withColumn("mean", F.try_divide("total_elapsed", F.col("done_count").cast("double")))
    # what is left is linear in ratio and mean, so sums and counts are all that is needed of the jobs
    mean, ratio = F.coalesce("mean", F.lit(0.0)), F.coalesce("ratio", F.lit(0.0))
    waiting_left = F.when(mean != 0, F.col("_waiting") * mean).otherwise(F.col("_waiting_ms") * ratio)
    queued_left = F.when(F.col("ratio").isNotNull(), F.col("_queued_ms") * ratio + F.col("_untimed") * mean).otherwise(F.col("queued_count") * mean)
    found = sums.withColumn("remaining", F.col("_moving") + waiting_left + queued_left).drop("_moving", "_waiting", "_waiting_ms", "_untimed", "_queued_ms")
    return found.withColumn("estimated_total", F.col("total_elapsed") + F.col("active_elapsed") + F.col("remaining"))


def with_defaults(candidates: DataFrame, defaults: Column) -> DataFrame:
    """New rows of the queue: queued, with the settings (a struct) as they are now."""
    return candidates.withColumns({"status": F.lit("queued"), "progress": F.lit(0.0), "settings": defaults})


def eta_label() -> Column:
    """The text of an estimate of ``folder_eta``."""
    open_jobs, some = F.col("active_count") + F.col("queued_count"), F.col("done_count") > 0
    parts = F.array_compact(F.array(
        F.when(some & (open_jobs > 0), F.concat(F.lit("~"), short_duration(F.col("estimated_total")), F.lit(" total"))),
        F.when(some & (open_jobs > 0), F.concat(F.lit("~"), short_duration(F.col("remaining")), F.lit(" remaining"))),
        F.when(some & (open_jobs == 0), F.concat(F.lit("Total: "), short_duration(F.col("total_elapsed")))),
        F.when(some & (F.col("mean") > 0), F.concat(short_duration(F.col("mean")), F.lit(" avg/ep"))),
    ))
    return F.when(F.size(parts) > 0, F.array_join(parts, " · ")).otherwise("Estimated after 1st encode")


def folder_stats(jobs: DataFrame, *keys: str) -> DataFrame:
    """Counts by status, whether any is active, and the per cent done."""
    status = F.col("status")
    counts = jobs.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(status == "done").alias("done"), F.count_if(is_active(status)).alias("encoding"),
        F.count_if(status == "queued").alias("queued"), F.count_if(status == "error").alias("error"),
    )
    return counts.withColumn("percent_done", half_up(percent(F.col("done"), F.col("total"))).cast("bigint"))
