"""Queries over frames, scenes, zones and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import base_crf, clamped_score, weighted_psnr
from ..operators import intervals, scenes
from .tables import CHUNKS, FRAMES, SCENES, ZONE_TEXTS, ZONES, chunk_counts, chunks, frames, rounded, sql_p15, table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {FRAMES} SELECT video, frame FROM frames WHERE is_key")
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.keyframes(frames(spark, sf_dir))


@query(f"WITH {SCENES} SELECT video, frame, scene FROM placed")
def scene_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.with_scenes(frames(spark, sf_dir)).select("video", "frame", "scene")


@query(f"WITH {SCENES} SELECT video, scene, min(frame) AS start, max(frame) + 1 AS stop FROM placed GROUP BY ALL")
def scene_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.scene_bounds(frames(spark, sf_dir))


@query("""SELECT event_id AS frame, sum(CASE WHEN event_type = 'signup' OR event_id = 0 THEN 1 ELSE 0 END) OVER (ORDER BY event_id)::BIGINT - 1 AS scene,
row_number() OVER (ORDER BY event_id) - 1 AS merged FROM events""")
def one_long_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as the frames of a single video, and of a single chunk: scenes and new numbers by blocks of 4,096 frames."""
    from ..operators.scan import block_of, running_sum

    rows = table(spark, sf_dir, "events").select(F.lit(0).alias("video"), F.col("event_id").alias("frame"), (F.col("event_type") == "signup").alias("is_key"))
    block = {"_block": block_of(F.col("frame"), 4_096)}
    placed = running_sum(rows, "scene", (F.col("is_key") | (F.col("frame") == 0)).cast("bigint"), ["video"], block, ["frame"])
    numbered = running_sum(placed, "merged", F.lit(1), ["video"], block, ["frame"])
    return numbered.select("frame", (F.col("scene") - 1).alias("scene"), (F.col("merged") - 1).alias("merged"))


@query("""WITH s AS (SELECT list_sort(list(greatest(value / 5.0::DOUBLE, 0.0::DOUBLE))) AS xs, count(*) AS n FROM events), j AS (SELECT xs, n, greatest(1, least(15 * (n + 1) // 100, n - 1)) AS j FROM s)
SELECT n, round((xs[j] * (100 - (15 * (n + 1) - 100 * j)) + xs[j + 1] * (15 * (n + 1) - 100 * j)) / 100.0::DOUBLE, 6) AS p15 FROM j""")
def one_video_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15th percentile of all events as one video: no task has all its scores."""
    rows = table(spark, sf_dir, "events").select(F.lit(0).alias("video"), (F.col("value") / 5.0).alias("score"))
    return scenes.score_stats(rows, ["video"]).select("n", rounded("p15"))


@query(f"""WITH {SCENES}, bounds AS (SELECT video, scene, min(frame) AS start, max(frame) + 1 AS stop FROM placed GROUP BY ALL)
SELECT f.video, f.frame, b.scene FROM frames f JOIN bounds b ON f.video = b.video AND f.frame >= b.start AND f.frame < b.stop""")
def scene_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    return scenes.scene_range_join(rows, scenes.scene_bounds(rows)).select("video", "frame", "scene")


@query(f"""WITH {SCENES}, lists AS (SELECT video, scene, count(*) AS n, avg(clamped) AS mean, min(clamped) AS least, list_sort(list(clamped)) AS xs FROM placed GROUP BY ALL)
SELECT video, scene, n, round(mean, 6) AS mean, round({sql_p15("xs")}, 6) AS p15, least FROM lists""")
def scene_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.scene_stats(frames(spark, sf_dir)).select("video", "scene", "n", rounded("mean"), rounded("p15"), "least")


@query(f"""WITH {SCENES}, lists AS (SELECT video, avg(clamped) AS mean, min(clamped) AS least, list_sort(list(clamped)) AS xs FROM placed GROUP BY ALL)
SELECT video, round(mean, 6) AS mean, round({sql_p15("xs")}, 6) AS p15, least FROM lists""")
def metrics_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.metrics(frames(spark, sf_dir)).select("video", rounded("mean"), rounded("p15"), "least")


@query(f"WITH {ZONES} SELECT video, scene, round(p15 / m, 6) AS ratio FROM scored")
def scene_vs_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.scenes_against_mean(frames(spark, sf_dir)).select("video", "scene", F.round(F.try_divide("p15", "overall"), 6).alias("ratio"))


@query(f"WITH {FRAMES} SELECT video, frame, score FROM frames QUALIFY row_number() OVER (PARTITION BY video ORDER BY score, frame) = 1")
def worst_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.worst_frames(frames(spark, sf_dir))


@query(f"WITH {ZONES} SELECT video, start, end_incl, crf FROM zones")
def crf_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.crf_zones(frames(spark, sf_dir), base=30.0)


@query(f"WITH {ZONE_TEXTS} SELECT video, text FROM texts")
def zones_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.zones_text(crf_zones(spark, sf_dir))


@query(f"""WITH {ZONE_TEXTS}, parts AS (SELECT video, string_split(p, ',') AS f FROM texts, unnest(string_split(text[9:], ';')) t(p))
SELECT video, f[1]::BIGINT AS start, f[2]::BIGINT AS end_incl, f[3]::DOUBLE AS crf FROM parts WHERE len(f) IN (3, 4)""")
def zones_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.parsed_zones(zones_format(spark, sf_dir))


@query(f"WITH {ZONES} SELECT video, greatest(0, start - 40) AS start, end_incl - 40 AS end_incl, crf FROM zones WHERE end_incl - 40 > 0")
def zones_shift_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.shifted_zones(crf_zones(spark, sf_dir), F.lit(40)).select("video", "start", "end_incl", "crf")


@query(f"WITH {FRAMES} SELECT video, frame, score FROM frames WHERE frame % 3 = 0")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.systematic_sample(frames(spark, sf_dir)).select("video", "frame", "score")


@query(f"""WITH {FRAMES}, n AS (SELECT video, max(frame) + 1 AS nframe FROM frames GROUP BY ALL)
SELECT video, frame + k AS frame, score FROM frames JOIN n USING (video), unnest([0, 1, 2]) t(k) WHERE frame % 3 = 0 AND frame + k < nframe""")
def upsample_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    lengths = rows.groupBy("video").agg((F.max("frame") + 1).alias("nframe"))
    return scenes.upsampled(scenes.systematic_sample(rows).select("video", "frame", "score"), lengths).select("video", "frame", "score")


@query(f"WITH {CHUNKS} SELECT video, event_id, row_number() OVER (PARTITION BY video ORDER BY suffix NULLS LAST, frame) - 1 AS merged FROM chunk_frames")
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged_chunks(chunks(spark, sf_dir)).select("video", "event_id", "merged")


@query(f"WITH {FRAMES} SELECT video, max(frame) AS last_gop, count(*) AS n_keyframes FROM frames WHERE is_key GROUP BY ALL")
def last_gop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.last_group_start(keyframes(spark, sf_dir))


@query(f"""WITH {FRAMES}, g AS (SELECT video, max(frame) AS last_gop FROM frames WHERE is_key GROUP BY ALL)
SELECT video, frame FROM frames JOIN g USING (video) WHERE frame < last_gop""")
def trim_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.trimmed(frames(spark, sf_dir).select("video", "frame"), last_gop(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT video, suffix, frame, row_number() OVER (PARTITION BY video ORDER BY suffix NULLS LAST, frame) - 1 AS merged FROM chunk_frames")
def chunk_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = chunks(spark, sf_dir)
    parts = whole.filter("suffix is not null").unionByName(whole.filter("suffix is null"))
    return intervals.merged_chunks(parts).select("video", "suffix", "frame", "merged")


@query(f"WITH {CHUNKS} SELECT video, sum(frame_count)::BIGINT AS total FROM chunks WHERE suffix IS NOT NULL GROUP BY ALL")
def chunk_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.chunk_totals(chunk_counts(spark, sf_dir))


@query(f"""WITH {CHUNKS} SELECT video, suffix, frame_count,
coalesce(sum(frame_count) OVER (PARTITION BY video ORDER BY suffix NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM chunks""")
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.chunk_offsets(chunk_counts(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT video, coalesce(max(suffix), 0) + 1 AS next FROM chunks GROUP BY ALL")
def next_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.next_suffix(chunk_counts(spark, sf_dir))


@query(f"""WITH {CHUNKS}, g AS (SELECT video, max(frame) AS last_gop, count(*) AS n_keyframes FROM frames WHERE is_key GROUP BY ALL),
n AS (SELECT video, max(frame) + 1 AS source_frames, max(frame) + 1 - video % 4 + (CASE WHEN video % 7 = 0 THEN 5 ELSE 0 END) AS encoded_frames FROM frames GROUP BY video),
t AS (SELECT video, sum(frame_count)::BIGINT AS previous FROM chunks WHERE suffix IS NOT NULL GROUP BY ALL),
s AS (SELECT video, source_frames, encoded_frames, n_keyframes, last_gop, coalesce(previous, 0) AS previous FROM n JOIN g USING (video) LEFT JOIN t USING (video)),
a AS (SELECT *, CASE WHEN encoded_frames > source_frames THEN 'error' WHEN encoded_frames = source_frames THEN 'done' WHEN n_keyframes <= 1 THEN 'restart' ELSE 'resume' END AS action FROM s)
SELECT video, action, CASE action WHEN 'resume' THEN previous + last_gop WHEN 'restart' THEN previous END AS "offset" FROM a""")
def resume_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    extra = F.when(F.col("video") % 7 == 0, 5).otherwise(0)
    sizes = rows.groupBy("video").agg((F.max("frame") + 1).alias("source_frames")).withColumn("encoded_frames", F.col("source_frames") - F.col("video") % 4 + extra)
    state = sizes.join(last_gop(spark, sf_dir), "video").join(chunk_total(spark, sf_dir).withColumnRenamed("total", "previous"), "video", "left")
    return intervals.resume_decisions(state.fillna(0, ["previous"])).select("video", "action", "offset")


@query(f"""WITH {FRAMES}, p AS (SELECT video, frame, score, 20.0::DOUBLE + value / 10.0::DOUBLE AS u, 25.0::DOUBLE + value / 20.0::DOUBLE AS v FROM frames)
SELECT video, frame, round(10.0::DOUBLE * log10(65025.0::DOUBLE / ((4.0::DOUBLE * 65025.0::DOUBLE / pow(10.0::DOUBLE, score / 10.0::DOUBLE)
 + 65025.0::DOUBLE / pow(10.0::DOUBLE, u / 10.0::DOUBLE) + 65025.0::DOUBLE / pow(10.0::DOUBLE, v / 10.0::DOUBLE)) / 6.0::DOUBLE)), 6) AS psnr FROM p""")
def weighted_psnr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    return rows.select("video", "frame", F.round(weighted_psnr(F.col("score"), 20.0 + F.col("value") / 10.0, 25.0 + F.col("value") / 20.0), 6).alias("psnr"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 2 = 0 AND value > 50 THEN 40.0 ELSE 35.0 END WHEN 1 THEN CASE WHEN value > 50 THEN 35.0 ELSE 30.0 END
WHEN 2 THEN CASE WHEN value > 50 THEN 30.0 ELSE 25.0 END ELSE 27.5 END::DOUBLE AS crf FROM events""")
def base_crf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "27.5"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", base_crf(quality, F.col("value") > 50).alias("crf"))


@query("SELECT event_id, CASE WHEN value / 5.0::DOUBLE - 10.0::DOUBLE >= 0 THEN value / 5.0::DOUBLE - 10.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM events")
def clamped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", clamped_score(F.col("value") / 5.0 - 10.0).alias("score"))


@query("""WITH polls AS (SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS poll, floor(value / 100)::BIGINT AS size FROM events),
marked AS (SELECT *, CASE WHEN size = lag(size) OVER w THEN 0 ELSE 1 END AS fresh FROM polls WINDOW w AS (PARTITION BY path ORDER BY poll)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY poll) AS run FROM marked)
SELECT path, poll, size, (row_number() OVER (PARTITION BY path, run ORDER BY poll) - 1)::BIGINT AS stable FROM runs""")
def stability_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.stability import stable_counts

    polls = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("path"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("poll"), F.floor(F.col("value") / 100).alias("size")
    )
    return stable_counts(polls)


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
WHERE before IS NULL OR before <> event_type""")
def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.events import changes

    return changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", "event_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def ndjson_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.events import parsed_lines

    rows = parsed_lines(table(spark, sf_dir, "events"), "props", "k bigint")
    return rows.filter("event._corrupt is null").select("event_id", "event.k")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 6 END::BIGINT AS step FROM events")
def stage_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.events import step_of_stage

    return table(spark, sf_dir, "events").select("event_id", step_of_stage((F.col("event_id") % 6).cast("int")).cast("bigint").alias("step"))


@query("""WITH e AS (SELECT user_id AS id, event_id AS seq, epoch_us(ts) // 1000 AS ms, (event_id % 6 + 2)::BIGINT AS step, CASE event_id % 4 WHEN 0 THEN 'stage' WHEN 3 THEN 'stage_complete' ELSE 'progress' END AS event,
  floor(value)::BIGINT AS current, event_id % 3 * 70 AS total FROM events WHERE event_id % 6 < 5),
l AS (SELECT *, min(ms) OVER (PARTITION BY id, step) AS started_at FROM e)
SELECT id, step, CASE event WHEN 'stage_complete' THEN 'done' ELSE 'active' END AS status,
  CASE event WHEN 'stage_complete' THEN 100.0 WHEN 'progress' THEN CASE WHEN total > 0 THEN floor(current / total::DOUBLE * 10000 + 0.5) / 100 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS progress,
  started_at, CASE WHEN event = 'stage_complete' THEN ms END AS finished_at FROM l QUALIFY row_number() OVER (PARTITION BY id, step ORDER BY seq DESC) = 1""")
def step_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as those of an encoder: the stage is their number modulo six, of which one is unknown."""
    from ..operators.events import step_states

    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), n.alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"),
        F.when(n % 4 == 0, "stage").when(n % 4 == 3, "stage_complete").otherwise("progress").alias("event"),
        (n % 6).cast("int").alias("stage"), F.floor("value").cast("bigint").alias("current"), (n % 3 * 70).alias("total"),
    )
    return step_states(rows).withColumn("step", F.col("step").cast("bigint"))


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def step_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.events import latest

    return latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, epoch_ms(ts) // 60000 ORDER BY ts, event_id) = 1""")
def throttle_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each minute: an approximation of the sequential throttle."""
    from ..operators.events import first_in_window

    return first_in_window(table(spark, sf_dir, "events"), "user_id", 60_000).select("user_id", "event_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events),
ordered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS k FROM e), firsts AS (SELECT user_id, ms, min(event_id) AS event_id FROM e GROUP BY ALL),
next AS MATERIALIZED (SELECT a.user_id, a.event_id, b.event_id AS follows FROM e a ASOF JOIN firsts b ON a.user_id = b.user_id AND a.ms + 86400000 <= b.ms),
passed AS (SELECT user_id, event_id FROM ordered WHERE k = 1 UNION ALL SELECT n.user_id, n.follows FROM passed p JOIN next n ON p.user_id = n.user_id AND p.event_id = n.event_id)
SELECT user_id, event_id FROM passed""")
def throttle_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events at most one a day, counted from the last that passed."""
    from ..operators.throttle import throttled

    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return throttled(rows, ["user_id"], "ms", "event_id", 86_400_000, 7 * 86_400_000).select("user_id", "event_id")


@query("""SELECT doc_id, unnest(lines) AS value, unnest(range(len(lines))) AS line FROM
(SELECT doc_id, CASE WHEN ends_with(text, chr(10)) OR text = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS lines FROM documents WHERE text IS NOT NULL)""")
def lines_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks of seven bytes, which also cut characters, and put together line by line."""
    from ..operators.lines import lines_of_chunks as put_together

    content = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length("bytes"), F.lit(1)) - 1) / 7).cast("int"))
    cut = content.select("doc_id", "bytes", F.explode(starts).alias("seq"))
    return put_together(cut.select("doc_id", "seq", F.substring(F.col("bytes"), F.col("seq") * 7 + 1, F.lit(7)).alias("chunk")), "doc_id")


@query(f"WITH {FRAMES} SELECT video, frame, score, score - frame % 3 AS encoded FROM frames")
def paired_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame next to the one that stands for it in an encoded video of as many frames."""
    rows = frames(spark, sf_dir).select("video", "frame", "score")
    encoded = rows.select("video", "frame", (F.col("score") - F.col("frame") % 3).alias("encoded"))
    return intervals.paired_frames(rows, encoded).select("video", "frame", "score", "encoded")
