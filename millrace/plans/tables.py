"""The tables under the names and columns of the operators, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the frames of a video; sign-ups are key frames."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("frame", (place - 1).cast("bigint"))
    return rows.select(
        F.col("user_id").alias("video"), "frame", ((F.col("frame") == 0) | (F.col("event_type") == "signup")).alias("is_key"),
        (F.lit(30.0) + F.col("value") / 5.0).alias("score"), "event_id", "event_type", "value",
    )


FRAMES = """
frames AS (
  SELECT user_id AS video, frame, (frame = 0 OR event_type = 'signup') AS is_key,
         30.0::DOUBLE + value / 5.0::DOUBLE AS score, event_id, event_type, value
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)
)"""
SCENES = (
    FRAMES
    + """, placed AS (
  SELECT *, sum(CASE WHEN is_key THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame)::BIGINT - 1 AS scene,
         greatest(score, 0.0::DOUBLE) AS clamped
  FROM frames
)"""
)


def sql_p15(values: str) -> str:
    """The exclusive 15th percentile of a sorted list column."""
    j = f"greatest(1, least((15 * (len({values}) + 1)) // 100, len({values}) - 1))"
    d = f"(15 * (len({values}) + 1) - 100 * {j})"
    return f"CASE WHEN len({values}) = 1 THEN {values}[1] ELSE ({values}[{j}] * (100 - {d}) + {values}[{j} + 1] * {d}) / 100::DOUBLE END"


ZONES = (
    SCENES
    + f""", per_scene AS (
  SELECT video, scene, min(frame) AS start, max(frame) AS last, list_sort(list(clamped)) AS xs FROM placed GROUP BY ALL
), overall AS (SELECT video, avg(clamped) AS m FROM placed GROUP BY ALL), scored AS (
  SELECT video, scene, start, last, m, {sql_p15("xs")} AS p15 FROM per_scene JOIN overall USING (video)
), zones AS (
  SELECT video, start, last AS end_incl,
         30.0::DOUBLE - greatest(-5.0::DOUBLE, least(5.0::DOUBLE, ceil((1.0::DOUBLE - p15 / m) * 20.0::DOUBLE * 4.0::DOUBLE) / 4.0::DOUBLE)) AS crf
  FROM scored
)"""
)
ZONE_TEXTS = ZONES + """, texts AS (
  SELECT video, 'Zones : ' || string_agg(start || ',' || end_incl || ',' || crf, ';' ORDER BY start) || ';' AS text FROM zones GROUP BY video
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames (video, suffix, frame) in chunks of ten; the last chunk of a video has no suffix."""
    rows = frames(spark, sf_dir)
    last = F.max("frame").over(Window.partitionBy("video"))
    number = F.floor(F.col("frame") / 10) + 1
    suffix = F.when(number <= F.floor(last / 10), number)
    return rows.select("video", suffix.cast("bigint").alias("suffix"), "frame", "is_key", "event_id")


CHUNKS = (
    FRAMES
    + """, chunk_frames AS (
  SELECT video, CASE WHEN frame // 10 + 1 <= max(frame) OVER (PARTITION BY video) // 10 THEN frame // 10 + 1 END AS suffix, frame, is_key, event_id FROM frames
), chunks AS (SELECT video, suffix, count(*) AS frame_count FROM chunk_frames GROUP BY ALL)"""
)


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("video", "suffix").agg(F.count("*").alias("frame_count"))


#: Milliseconds that stand for now: after every order.
NOW_MS = 1_200_000_000_000


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of a customer's queue."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("muxing")
    started = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("queue"), status.alias("status"), F.col("o_orderkey").alias("queue_order"),
        F.when(status != "queued", started).alias("started_at"),
        F.when(status == "done", started + F.floor(F.col("o_totalprice")).cast("bigint") * 10).alias("finished_at"),
        F.when(F.col("o_orderkey") % 3 > 0, F.floor(F.col("o_totalprice")).cast("double")).alias("duration"),
        (F.col("o_orderkey") % 101).cast("double").alias("progress"),
    )


JOBS = """
jobs AS (
  SELECT id, queue, status, id AS queue_order,
         CASE WHEN status <> 'queued' THEN started END AS started_at,
         CASE WHEN status = 'done' THEN started + floor(price)::BIGINT * 10 END AS finished_at,
         CASE WHEN id % 3 > 0 THEN floor(price) END AS duration, (id % 101)::DOUBLE AS progress
  FROM (SELECT o_orderkey AS id, o_custkey AS queue, o_totalprice AS price, epoch_ms(o_orderdate) AS started,
               CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'muxing' END AS status FROM orders)
)"""


def foldered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with the path region/nation/customer/job."""
    customer, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    places = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed tables of 25 and 5 rows
    path = F.concat_ws("/", "r_name", "n_name", "c_name", F.col("id").cast("string"))
    rows = jobs(spark, sf_dir).join(places.select("c_custkey", "r_name", "n_name", "c_name"), F.col("queue") == F.col("c_custkey"))
    return rows.withColumn("path", path).drop("c_custkey")


FOLDERED = (
    JOBS
    + """, foldered AS (
  SELECT j.*, r_name, n_name, c_name, r_name || '/' || n_name || '/' || c_name || '/' || id AS path
  FROM jobs j JOIN customer ON queue = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), above AS (
  SELECT *, '' AS folder FROM foldered UNION ALL SELECT *, r_name FROM foldered UNION ALL
  SELECT *, r_name || '/' || n_name FROM foldered UNION ALL SELECT *, r_name || '/' || n_name || '/' || c_name FROM foldered
)"""
)


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the host and path of the url, and whether the file is checked and encoded."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract("url", r"://([^?#]*)", 1), "/+", "/"), "/$", "")
    return table(spark, sf_dir, "pages").select("page_id", "url", path.alias("path"), (F.col("page_id") % 3 > 0).alias("checked"), (F.col("page_id") % 4 == 0).alias("encoded"))


PAGE_PATHS = """
files AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+', '/', 'g'), '/$', '') AS path,
         page_id % 3 > 0 AS checked, page_id % 4 = 0 AS encoded FROM pages
), above AS (
  SELECT f.*, array_to_string(string_split(path, '/')[1:n], '/') AS folder
  FROM files f, unnest(range(0, len(string_split(path, '/')))) t(n)
)"""


def rounded(column: str, digits: int = 6) -> Column:
    """Sums of doubles depend on the order of the rows; results are compared to some digits."""
    return F.round(F.col(column), digits).alias(column)
