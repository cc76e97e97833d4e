"""Queries over jobs, queues and folders of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import percent
from ..functions.text import status_label
from ..operators import jobs as queue
from ..operators import tree
from .tables import FOLDERED, JOBS, NOW_MS, foldered, jobs, table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


BUCKET = "CASE status WHEN 'muxing' THEN 0 WHEN 'done' THEN 2 WHEN 'error' THEN 3 ELSE 1 END"
QUEUED = JOBS + ", queued AS (SELECT * FROM jobs WHERE status = 'queued')"


def queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).filter("status = 'queued'").select("queue", "id", "queue_order")


@query(f"""WITH {JOBS} SELECT queue, id, row_number() OVER (PARTITION BY queue ORDER BY {BUCKET}, CASE WHEN status = 'queued' THEN queue_order END NULLS FIRST, coalesce(started_at, 0), id) AS place FROM jobs""")
def queue_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("queue").orderBy(*queue.listing_order()))
    return jobs(spark, sf_dir).select("queue", "id", place.cast("bigint").alias("place"))


@query(f"WITH {JOBS} SELECT id, queue FROM jobs WHERE status = 'queued' ORDER BY queue_order, id LIMIT 1")
def next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.next_job(jobs(spark, sf_dir)).select("id", "queue")


@query(f"WITH {JOBS} SELECT c_custkey AS input_path FROM customer WHERE c_custkey NOT IN (SELECT queue FROM jobs WHERE status NOT IN ('error', 'done'))")
def enqueue_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("input_path"))
    return queue.to_enqueue(candidates, jobs(spark, sf_dir).withColumnRenamed("queue", "input_path"))


@query(f"WITH {JOBS} SELECT queue, min(id) AS id FROM jobs WHERE status = 'queued' GROUP BY queue")
def next_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.next_jobs(jobs(spark, sf_dir)).select("queue", "id")


@query("SELECT p_partkey AS input_path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'R')")
def enqueue_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files; first line items as their jobs, done where they were returned."""
    status = F.when(F.col("l_returnflag") == "R", "done").when(F.col("l_returnflag") == "A", "muxing").otherwise("queued")
    live = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("input_path"), status.alias("status"))
    return queue.to_enqueue(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("input_path")), live)


@query(f"""WITH {QUEUED}, n AS (SELECT *, row_number() OVER w AS k, lag(queue_order) OVER w AS before, lead(queue_order) OVER w AS after, lead(row_number) OVER w AS nk FROM
(SELECT *, row_number() OVER (PARTITION BY queue ORDER BY queue_order, id) AS row_number FROM queued) WINDOW w AS (PARTITION BY queue ORDER BY queue_order, id))
SELECT queue, id, CASE WHEN k = 3 THEN before WHEN nk = 3 THEN after ELSE queue_order END AS new_order FROM n""")
def move_up_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third queued job of each queue moves up."""
    place = F.row_number().over(Window.partitionBy("queue").orderBy("queue_order", "id"))
    rows = queued(spark, sf_dir).withColumn("k", place)
    return queue.moved_one(rows, F.col("k") == 3, up=True).select("queue", "id", "new_order")


@query(f"""WITH {QUEUED} SELECT queue, id, CASE WHEN id % 5 = 0 AND id % 7 = 0 AND queue_order <> min(queue_order) OVER (PARTITION BY queue) THEN min(queue_order) OVER (PARTITION BY queue) - 1 ELSE queue_order END AS new_order FROM queued""")
def move_top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.moved_to_end(queued(spark, sf_dir), F.col("id") % 35 == 0, top=True).select("queue", "id", "new_order")


@query(f"""WITH {QUEUED}, ids AS (SELECT o_custkey AS queue, o_orderkey AS id, -o_orderkey AS place FROM orders WHERE o_orderkey % 2 = 0),
r AS (SELECT queue, id, row_number() OVER (PARTITION BY queue ORDER BY place) AS rank FROM ids JOIN queued USING (queue, id))
SELECT q.queue, q.id, coalesce(rank, queue_order) AS new_order FROM queued q LEFT JOIN r ON q.queue = r.queue AND q.id = r.id""")
def reorder_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("queue"), F.col("o_orderkey").alias("id"), (-F.col("o_orderkey")).alias("place"))
    return queue.reordered(queued(spark, sf_dir), ids).select("queue", "id", "new_order")


@query(f"""WITH {QUEUED}, a AS (SELECT queue, id, row_number() OVER (PARTITION BY queue ORDER BY (id * 7919) % 10007, id) AS k FROM queued),
b AS (SELECT queue, queue_order AS new_order, row_number() OVER (PARTITION BY queue ORDER BY queue_order, id) AS k FROM queued) SELECT queue, id, new_order FROM a JOIN b USING (queue, k)""")
def slot_reassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.slots_reassigned(queued(spark, sf_dir), F.col("id") * 7919 % 10007).select("queue", "id", "new_order")


@query(f"""WITH {JOBS} SELECT id, status = 'queued' AS editable, status IN ('queued', 'done', 'error') AS removable, status = 'error' AS retryable FROM jobs""")
def job_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("status")
    return jobs(spark, sf_dir).select("id", queue.editable(status).alias("editable"), queue.removable(status).alias("removable"), queue.retryable(status).alias("retryable"))


@query(f"WITH {JOBS} SELECT id, CASE status WHEN 'queued' THEN 'Queued' WHEN 'done' THEN 'Done' ELSE 'Muxing' END AS label FROM jobs")
def status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("id", status_label(F.col("status")).alias("label"))


COUNTS = """count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'muxing') AS encoding,
count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'error') AS error, floor(floor(count(*) FILTER (status = 'done') / count(*) * 10000 + 0.5) / 100 + 0.5)::BIGINT AS percent_done"""


@query(f"WITH {FOLDERED} SELECT folder, {COUNTS} FROM above GROUP BY folder")
def folder_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.folder_stats(tree.by_ancestor(foldered(spark, sf_dir).select("path", "status")), "folder")


@query(f"WITH {FOLDERED} SELECT folder, bool_or(status = 'muxing') AS active FROM above GROUP BY folder")
def folder_has_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree.by_ancestor(foldered(spark, sf_dir).select("path", "status"))
    return rows.groupBy("folder").agg(F.bool_or(queue.is_active(F.col("status"))).alias("active"))


@query(f"WITH {FOLDERED} SELECT folder, min(CASE WHEN status = 'queued' THEN queue_order END) AS least_order FROM above GROUP BY folder")
def subtree_min_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.subtree_least_order(foldered(spark, sf_dir).select("path", "status", "queue_order"))


@query(f"""WITH {FOLDERED}, l AS (SELECT folder, min(CASE WHEN status = 'queued' THEN queue_order END) AS least_order FROM above WHERE folder <> '' GROUP BY folder),
p AS (SELECT *, CASE WHEN contains(folder, '/') THEN regexp_replace(folder, '/[^/]*$', '') ELSE '' END AS parent FROM l)
SELECT folder, row_number() OVER (PARTITION BY parent ORDER BY least_order NULLS LAST, folder) AS place FROM p""")
def sibling_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = subtree_min_order(spark, sf_dir).filter("folder <> ''").withColumn("parent", F.regexp_extract("folder", "^(.*)/[^/]*$", 1))
    place = F.row_number().over(Window.partitionBy("parent").orderBy(F.col("least_order").asc_nulls_last(), "folder"))
    return rows.select("folder", place.cast("bigint").alias("place"))


@query(f"""WITH {FOLDERED}, q AS (SELECT id, r_name, n_name, c_name, (id * 7919) % 10007 - 5000 AS o FROM foldered WHERE status = 'queued'),
l AS (SELECT *, min(o) OVER (PARTITION BY r_name) AS a, min(o) OVER (PARTITION BY r_name, n_name) AS b, min(o) OVER (PARTITION BY r_name, n_name, c_name) AS c FROM q)
SELECT id, row_number() OVER (ORDER BY a, r_name, b, n_name, c, c_name, o, id) AS place FROM l""")
def dfs_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some queue orders are negative, as after moves to the top."""
    order = F.col("id") * 7919 % 10007 - 5000
    return tree.depth_first_places(foldered(spark, sf_dir).withColumn("queue_order", order)).select("id", "place")


@query(f"""WITH {FOLDERED}, q AS (SELECT id, r_name, n_name, c_name, id % 4 > 0 AS absolute, (id * 7919) % 10007 - 5000 AS o FROM foldered WHERE status = 'queued'),
l AS (SELECT *, min(o) OVER (PARTITION BY absolute) AS z, min(o) OVER (PARTITION BY absolute, r_name) AS a, min(o) OVER (PARTITION BY absolute, r_name, n_name) AS b, min(o) OVER (PARTITION BY absolute, r_name, n_name, c_name) AS c FROM q)
SELECT id, row_number() OVER (ORDER BY CASE WHEN absolute THEN z ELSE a END, CASE WHEN absolute THEN '/' ELSE r_name END, a, r_name, b, n_name, c, c_name, o, id) AS place FROM l""")
def dfs_order_rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of the jobs lie below /, which is one folder among the others of the first level."""
    rows = foldered(spark, sf_dir).withColumn("queue_order", F.col("id") * 7919 % 10007 - 5000)
    rows = rows.withColumn("path", F.when(F.col("id") % 4 > 0, F.concat(F.lit("/"), "path")).otherwise(F.col("path")))
    return tree.depth_first_places(rows).select("id", "place")


@query(f"WITH {FOLDERED} SELECT DISTINCT folder AS path, CASE WHEN contains(folder, '/') THEN regexp_replace(folder, '/[^/]*$', '') ELSE '' END AS parent, regexp_extract(folder, '[^/]*$') AS name FROM above WHERE folder <> ''")
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.folder_tree(foldered(spark, sf_dir))


@query(f"""WITH {FOLDERED}, t AS (SELECT DISTINCT folder AS path, regexp_replace(folder, '/[^/]*$', '') AS parent FROM above WHERE folder LIKE '%/%')
SELECT t.path, p.folder AS parent, count(*) AS siblings FROM t JOIN (SELECT DISTINCT folder FROM above) p ON t.parent = p.folder JOIN t s ON s.parent = t.parent GROUP BY ALL""")
def folder_parent_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = folder_tree(spark, sf_dir)
    sizes = folders.groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("siblings"))
    parents = folders.select(F.col("path").alias("known"))
    joined = folders.join(parents, folders["parent"] == parents["known"]).join(sizes, F.col("parent") == F.col("of"))
    return joined.select("path", "parent", "siblings")


@query(f"WITH {FOLDERED} SELECT r_name, n_name, c_name, count(*) AS total, count(*) FILTER (status = 'done') AS done FROM foldered GROUP BY ROLLUP (r_name, n_name, c_name)")
def rollup_fixed_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foldered(spark, sf_dir).rollup("r_name", "n_name", "c_name").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"))


@query(f"""WITH {FOLDERED} SELECT folder, id, row_number() OVER (PARTITION BY folder ORDER BY queue_order, id) AS place FROM above WHERE status = 'queued' AND folder LIKE '%/%/%'""")
def subtree_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All queued jobs below each customer's folder, with their place in it."""
    rows = tree.by_ancestor(foldered(spark, sf_dir).filter("status = 'queued'").select("path", "queue_order", "id")).filter("folder like '%/%/%'")
    place = F.row_number().over(Window.partitionBy("folder").orderBy("queue_order", "id"))
    return rows.select("folder", "id", place.cast("bigint").alias("place"))


RATIO = "sum(finished_at - started_at) FILTER (status = 'done' AND duration > 0)::DOUBLE / sum(duration * 1000.0::DOUBLE) FILTER (status = 'done' AND duration > 0)"


@query(f"WITH {JOBS} SELECT queue, round({RATIO}, 9) AS ratio FROM jobs GROUP BY queue")
def encode_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).groupBy("queue").agg(F.round(queue.encode_ratio(), 9).alias("ratio"))


ETA = (
    FOLDERED
    + f""", first AS (SELECT folder, count(*) FILTER (status = 'done') AS done_count, count(*) FILTER (status = 'muxing') AS active_count, count(*) FILTER (status = 'queued') AS queued_count,
  coalesce(sum(finished_at - started_at) FILTER (status = 'done'), 0)::DOUBLE AS total_elapsed, {RATIO} AS ratio FROM above GROUP BY folder),
kept AS (SELECT *, CASE WHEN done_count > 0 THEN total_elapsed / done_count END AS mean FROM first WHERE done_count + active_count > 0),
rest AS (SELECT folder, sum(CASE WHEN status = 'muxing' AND progress > 0 THEN CASE WHEN {NOW_MS} - started_at > 3000 THEN greatest(0.0::DOUBLE, ({NOW_MS} - started_at) / progress * 100 - ({NOW_MS} - started_at)) ELSE 0 END
  WHEN status = 'muxing' THEN CASE WHEN coalesce(mean, 0) <> 0 THEN mean WHEN ratio IS NOT NULL AND duration > 0 THEN duration * 1000.0::DOUBLE * ratio ELSE 0 END
  WHEN status = 'queued' THEN CASE WHEN ratio IS NOT NULL AND duration > 0 THEN duration * 1000.0::DOUBLE * ratio ELSE coalesce(mean, 0) END ELSE 0 END) AS remaining,
  coalesce(sum({NOW_MS} - started_at) FILTER (status = 'muxing'), 0)::DOUBLE AS active_elapsed FROM above JOIN kept USING (folder) GROUP BY folder),
eta AS (SELECT kept.*, remaining, active_elapsed, total_elapsed + active_elapsed + remaining AS estimated_total FROM kept JOIN rest USING (folder))"""
)


@query(f"WITH {ETA} SELECT folder, done_count, active_count, queued_count, total_elapsed, round(mean, 2) AS mean, round(remaining / 1e6, 3) AS remaining, round(estimated_total / 1e6, 3) AS estimated_total FROM eta")
def folder_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _etas(spark, sf_dir)
    million = lambda c: F.round(F.col(c) / 1e6, 3).alias(c)
    return found.select("folder", "done_count", "active_count", "queued_count", "total_elapsed", F.round("mean", 2).alias("mean"), million("remaining"), million("estimated_total"))


def _etas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = foldered(spark, sf_dir).select("path", "status", "started_at", "finished_at", "duration", "progress")
    return queue.folder_eta(tree.by_ancestor(rows), F.lit(NOW_MS))


def _sql_short(ms: str) -> str:
    s = f"floor({ms} / 1000)::BIGINT"
    return f"CASE WHEN {s} >= 3600 THEN ({s} // 3600) || 'h ' || ({s} % 3600 // 60) || 'm' WHEN {s} >= 60 THEN ({s} // 60) || 'm ' || ({s} % 60) || 's' ELSE ({s} % 60) || 's' END"


@query(f"""WITH {ETA} SELECT folder, CASE WHEN done_count = 0 THEN 'Estimated after 1st encode' WHEN active_count + queued_count = 0 THEN 'Total: ' || {_sql_short("total_elapsed")} || ' · ' || {_sql_short("mean")} || ' avg/ep'
ELSE '~' || {_sql_short("round(estimated_total / 1e9) * 1e9")} || ' total · ~' || {_sql_short("round(remaining / 1e9) * 1e9")} || ' remaining · ' || {_sql_short("mean")} || ' avg/ep' END AS label FROM eta""")
def eta_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates are rounded to whole 1e9 ms first: sums of doubles differ in their last digits."""
    found = _etas(spark, sf_dir)
    for c in ("remaining", "estimated_total"):
        found = found.withColumn(c, F.round(F.col(c) / 1e9) * 1e9)
    return found.select("folder", queue.eta_label().alias("label"))


@query(f"""WITH {JOBS}, e AS (SELECT id, {NOW_MS} - started_at AS elapsed, progress FROM jobs WHERE status = 'muxing')
SELECT id, CASE WHEN progress > 0 AND elapsed >= 3000 AND elapsed / progress * 100 - elapsed > 0 THEN round((elapsed / progress * 100 - elapsed) / 1e6, 3) END AS eta FROM e""")
def step_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir).filter("status = 'muxing'")
    return rows.select("id", F.round(queue.step_eta(F.col("started_at"), F.col("progress"), F.lit("active"), F.lit(NOW_MS)) / 1e6, 3).alias("eta"))


@query("""SELECT l_orderkey AS id, floor(sum(least(l_quantity * 2, 100)) / count(*) * 100 + 0.5) / 100 AS progress FROM lineitem GROUP BY l_orderkey""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.least(F.col("l_quantity") * 2, F.lit(100.0))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(queue.job_progress(step).alias("progress"))


@query(None)
def edits_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is an edit of its customer's queue, in order of the keys: of the job itself, or of all jobs of the queue listed by a mixed order."""
    orders = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    kind = F.when(n % 13 == 0, "reorder").when(n % 11 == 0, "slots").otherwise(F.element_at(F.array(*map(F.lit, ("up", "down", "top", "bottom"))), (n % 4 + 1).cast("int")))
    log = orders.select(F.col("o_custkey").alias("queue"), n.alias("place"), kind.alias("kind"), n.alias("id"), F.lit(None).cast("array<bigint>").alias("ids"))
    listing = orders.select(F.col("o_custkey").alias("queue"), F.struct((n * 7919 % 10007).alias("k"), n.alias("n")).alias("place"), n.alias("id"))
    return queue.edited_in_order(queued(spark, sf_dir), log, listing=listing).select("queue", "id", "new_order")


@query("""WITH old AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 19 > 0),
new AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 17 > 0)
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
CASE WHEN o.o_orderkey IS NULL OR n.o_orderkey IS NULL THEN [] ELSE list_filter([CASE WHEN o.o_orderstatus IS DISTINCT FROM n.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN o.o_totalprice IS DISTINCT FROM n.o_totalprice THEN 'o_totalprice' END], lambda x: x IS NOT NULL) END::VARCHAR[] AS columns
FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey
WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_totalprice IS DISTINCT FROM n.o_totalprice""")
def snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of the orders: some came, some went, some have another price or no status."""
    from ..operators.snapshots import difference

    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    after = rows.filter(n % 17 > 0).withColumns({"o_orderstatus": F.when(n % 5 > 0, F.col("o_orderstatus")), "o_totalprice": F.col("o_totalprice") + F.when(n % 7 == 0, 1).otherwise(0)})
    return difference(rows.filter(n % 19 > 0), after, "o_orderkey")


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 11 > 0 THEN floor((o_orderkey % 977) / (o_custkey % 11 * 100)::DOUBLE * 10000 + 0.5) / 100 ELSE 0.0 END::DOUBLE AS pct FROM orders")
def pct2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), percent(F.col("o_orderkey") % 977, F.col("o_custkey") % 11 * 100).alias("pct"))


@query("""SELECT o_custkey AS request, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS added, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS skipped, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS already FROM orders GROUP BY o_custkey""")
def request_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("request")).agg(count("O").alias("added"), count("P").alias("skipped"), count("F").alias("already"))
