"""Queries over names, streams, listings and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers, text
from ..operators import audio, jobs, library, tree
from .tables import PAGE_PATHS, page_paths, table

QUERIES, SQL = {}, {}
ORGANISATION = "millrace"


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


NAMES = """
names AS (
  SELECT p_partkey AS id, p_size AS size, p_name || ' - [' || CASE p_partkey % 7 WHEN 0 THEN 'REMUX' WHEN 1 THEN 'WEBDL' WHEN 2 THEN 'x_WEBRIP_y' WHEN 3 THEN 'bluray' WHEN 4 THEN 'WEB-DL' WHEN 5 THEN 'HDTV' ELSE 'dvd' END
    || '][' || p_type || ']' || CASE WHEN p_partkey % 3 = 0 THEN '-' || replace(p_brand, '#', '_') WHEN p_partkey % 3 = 1 THEN '-a b' ELSE '' END AS name,
  p_name || CASE WHEN p_partkey % 5 = 0 THEN '-millrace' ELSE '' END || CASE p_partkey % 6 WHEN 0 THEN '.mkv' WHEN 1 THEN '.MP4' WHEN 2 THEN '.nfo' WHEN 3 THEN '.srt' WHEN 4 THEN '' ELSE '.tar.ts' END AS file
  FROM part
)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    group = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-"), F.replace("p_brand", F.lit("#"), F.lit("_")))).when(F.col("p_partkey") % 3 == 1, "-a b").otherwise("")
    name = F.concat("p_name", F.lit(" - ["), pick("REMUX", "WEBDL", "x_WEBRIP_y", "bluray", "WEB-DL", "HDTV", "dvd"), F.lit("]["), "p_type", F.lit("]"), group)
    file = F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, "-millrace").otherwise(""), pick(".mkv", ".MP4", ".nfo", ".srt", "", ".tar.ts"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), name.alias("name"), file.alias("file"))


@query(f"WITH {NAMES} SELECT id, CASE id % 7 WHEN 0 THEN 'Bluray' WHEN 1 THEN 'WEBDL' WHEN 2 THEN 'Bluray' WHEN 3 THEN 'Bluray' WHEN 4 THEN 'Bluray' WHEN 5 THEN 'HDTV' ELSE 'DVD' END AS tag FROM names")
def source_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("id", text.source_tag(F.col("name")).alias("tag"))


@query(f"WITH {NAMES} SELECT id, nullif(regexp_extract(name, '\\]-([A-Za-z0-9_]+)$', 1), '') AS release FROM names")
def release_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("id", text.release_group(F.col("name")).alias("release"))


@query(f"WITH {NAMES} SELECT id, trim(regexp_replace(name, '\\s*[-–—]*\\s*\\[.*$', '')) AS title FROM names")
def base_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("id", text.base_title(F.col("name")).alias("title"))


@query("""SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(CASE p_partkey % 4 WHEN 0 THEN 'Opus 5.1' WHEN 1 THEN 'Opus' WHEN 2 THEN 'Opus  -Opus' ELSE 'Opusy' END || '   ' || p_type, '\\s*-\\s*', ' - ', 'g'), '\\s{2,}', ' ', 'g')) AS title FROM part WHERE p_partkey % 4 < 3
UNION ALL SELECT p_partkey, 'AACy ' || p_type FROM part WHERE p_partkey % 4 = 3""")
def sanitize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = F.element_at(F.array(*map(F.lit, ("DTS-HD MA 5.1", "truehd atmos", "AC3  -flac", "AACy"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    title = F.concat(codec, F.lit("   "), "p_type")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.sanitized_title(title).alias("title"))


RESOLUTION = "CASE WHEN w >= 3200 OR h >= 2100 THEN '2160p' WHEN w >= 1800 OR h >= 1000 THEN '1080p' WHEN w >= 1200 OR h >= 700 THEN '720p' WHEN w >= 1000 OR h >= 560 THEN '576p' WHEN w > 0 AND h > 0 THEN '480p' ELSE '1080p' END"


@query(f"SELECT id, {RESOLUTION} AS tag FROM (SELECT p_partkey AS id, p_size * 80 - 80 AS w, p_size * 45 - 45 AS h FROM part)")
def resolution_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.resolution_tag(F.col("p_size") * 80 - 80, F.col("p_size") * 45 - 45).alias("tag"))


LAYOUT = "CASE size % 9 WHEN 0 THEN 'mono' WHEN 1 THEN 'stereo' WHEN 2 THEN '2.1' WHEN 3 THEN '5.1' WHEN 4 THEN '5.1' WHEN 5 THEN '6.1' WHEN 6 THEN '7.1' WHEN 7 THEN '7.1.4' ELSE 'stereo' END"
RATE = "CASE layout WHEN 'mono' THEN 64 WHEN '2.1' THEN 160 WHEN '5.1' THEN 256 WHEN '6.1' THEN 320 WHEN '7.1' THEN 384 WHEN '7.1.4' THEN 512 ELSE 128 END"
LABEL = "CASE layout WHEN 'mono' THEN 'Opus 1.0' WHEN 'stereo' THEN 'Opus 2.0' ELSE 'Opus ' || layout END"


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("mono", "stereo", "2.1", "5.1", "5.1(side)", "6.1", "7.1", "dolbyatmos", "quad"))), (F.col("size") % 9 + 1).cast("int"))
    return names(spark, sf_dir).withColumn("layout", numbers.layout_name(raw))


@query(f"WITH {NAMES}, l AS (SELECT id, {LAYOUT} AS layout FROM names) SELECT id, layout, {RATE}::BIGINT AS kbit, {LABEL} AS label FROM l")
def layout_bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = F.col("layout")
    return layouts(spark, sf_dir).select("id", "layout", numbers.layout_bitrate(layout).cast("bigint").alias("kbit"), numbers.layout_label(layout).alias("label"))


@query(f"""WITH {NAMES}, l AS (SELECT *, {LAYOUT} AS layout FROM names), r AS (SELECT *, {LABEL} AS label FROM l)
SELECT id, trim(regexp_replace(name, '\\s*[-–—]*\\s*\\[.*$', '')) || ' [' || CASE id % 7 WHEN 1 THEN 'WEBDL' WHEN 5 THEN 'HDTV' WHEN 6 THEN 'DVD' ELSE 'Bluray' END || '-1080p][' || label || '][AV1]-millrace.mkv' AS output FROM r""")
def output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    made = text.output_name(text.base_title(name), text.source_tag(name), text.resolution_tag(F.lit(1920), F.lit(1080)), numbers.layout_label(F.col("layout")), ORGANISATION)
    return layouts(spark, sf_dir).select("id", made.alias("output"))


@query(f"WITH {NAMES} SELECT id, file FROM names WHERE id % 6 IN (0, 1, 5)")
def media_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).filter(text.is_media(F.col("file"))).select("id", "file")


@query(f"""WITH {NAMES}, m AS (SELECT size % 10 AS root, file, id % 5 = 0 AND id % 6 <> 5 AS encoded, file IN (SELECT file FROM names WHERE size > 40) AS live FROM names WHERE id % 6 IN (0, 1, 5))
SELECT root::BIGINT AS root, count(*) FILTER (NOT encoded AND NOT live) AS added, count(*) FILTER (NOT encoded AND live) AS skipped, count(*) FILTER (encoded) AS already_encoded FROM m GROUP BY root""")
def library_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = names(spark, sf_dir)
    live = rows.filter("size > 40").select(F.col("file").alias("input_path"))
    files = rows.select(F.col("file").alias("path"), (F.col("size") % 10).cast("bigint").alias("root"))
    return library.scan_counts(files, live, ORGANISATION)


@query("SELECT p_partkey AS id, [x FOR x IN [trim(y) FOR y IN string_split(replace(p_name, ' ', ' , ,') || ', ', ',')] IF x <> ''] AS parts FROM part")
def split_trim_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.concat(F.replace("p_name", F.lit(" "), F.lit(" , ,")), F.lit(", "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.split_trim(listed).alias("parts"))


@query("""SELECT l_orderkey AS id, list_sort(list(l_quantity * 2) FILTER (l_quantity > 10)) AS doubled, coalesce(bool_or(l_quantity > 45), false) AS large, sum(l_quantity) AS total FROM lineitem GROUP BY l_orderkey""")
def array_hof(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_quantity").alias("q"))
    doubled = F.sort_array(F.transform(F.filter("q", lambda x: x > 10), lambda x: x * 2))
    return lists.select("id", F.when(F.size(doubled) > 0, doubled).alias("doubled"), F.exists("q", lambda x: x > 45).alias("large"), F.aggregate("q", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("""SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY is_file, w, n, name) AS place FROM
(SELECT s_nationkey % 5 AS folder, CASE WHEN s_suppkey % 3 = 0 THEN 'Season ' ELSE 'Ep ' END || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'season ' ELSE 'ep ' END AS w, s_suppkey AS n, s_suppkey % 3 > 0 AS is_file FROM supplier)""")
def browse_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_folder = F.col("s_suppkey") % 3 == 0
    name = F.concat(F.when(is_folder, "Season ").otherwise("Ep "), F.col("s_suppkey").cast("string"))
    rows = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("folder"), name.alias("name"), is_folder.alias("is_folder"))
    place = F.row_number().over(Window.partitionBy("folder").orderBy(library.listing_key(F.col("name"), F.col("is_folder"))))
    return rows.select("folder", "name", place.cast("bigint").alias("place"))


@query("SELECT p_partkey AS id, replace(replace(replace(replace(replace('<' || p_name || '> & \"' || p_type || ''' ', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS xml FROM part")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("<"), "p_name", F.lit('> & "'), "p_type", F.lit("' "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.xml_escaped(raw).alias("xml"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN 'high' ELSE 'medium' END AS quality, CASE WHEN s_suppkey % 2 = 0 THEN 'fast' ELSE 'slow' END AS speed,
CASE WHEN s_suppkey % 4 = 0 THEN 96 ELSE 128 END::BIGINT AS stereo, CASE WHEN s_suppkey % 4 = 0 THEN 200 END::BIGINT AS six FROM supplier""")
def settings_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = lambda *x: F.create_map(*map(F.lit, x))
    settings = F.struct(F.lit("medium").alias("quality"), F.lit("slow").alias("speed"), entries("stereo", 128, "5.1", 256).alias("bitrates"))
    key = F.col("s_suppkey")
    patch = F.struct(
        F.when(key % 3 > 0, "high").otherwise("").alias("quality"), F.when(key % 2 == 0, "fast").alias("speed"),
        F.when(key % 4 == 0, entries("stereo", 96, "6.1", 200)).alias("bitrates"),
    )
    made = table(spark, sf_dir, "supplier").select(key.alias("id"), jobs.patched(settings, patch).alias("s"))
    return made.select("id", "s.quality", "s.speed", F.element_at("s.bitrates", "stereo").cast("bigint").alias("stereo"), F.element_at("s.bitrates", "6.1").cast("bigint").alias("six"))


@query("""SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice, l_partkey, l_suppkey, l_linenumber) = 1""")
def best_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ties = ["l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber"]
    return audio.best_streams(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", ties).select("l_orderkey", "l_quantity", "l_extendedprice")


ORDERED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey)"


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the streams of a file, with their place."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").withColumn("place", place.cast("bigint")).withColumn("file", F.col("l_orderkey"))


@query(f"""WITH s AS (SELECT l_orderkey AS file, {ORDERED} AS place, l_discount FROM lineitem)
SELECT file, place, CASE WHEN place <= 2 THEN l_discount ELSE 0.0 END::DOUBLE AS value FROM s""")
def zip_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams with the delays of a list that is shorter."""
    rows = streams(spark, sf_dir)
    delays = rows.filter("place <= 2").select("file", "place", F.col("l_discount").alias("value"))
    return audio.joined_by_place(rows.select("file", "place"), delays, "file", "place", 0.0)


@query(f"""WITH s AS (SELECT l_orderkey AS file, {ORDERED} AS place, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS language, CASE WHEN l_linenumber % 3 = 0 THEN '  ' ELSE 'title' END AS title FROM lineitem)
SELECT file, place, trim(title) <> '' AND (language IS NULL OR count(*) OVER (PARTITION BY file, coalesce(language, 'und')) > 1) AS keep_title FROM s""")
def keep_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams(spark, sf_dir).withColumn("language", F.nullif("l_returnflag", F.lit("N"))).withColumn("title", F.when(F.col("l_linenumber") % 3 == 0, "  ").otherwise("title"))
    return audio.with_kept_titles(rows).select("file", "place", "keep_title")


@query(f"""WITH s AS (SELECT l_orderkey AS file, {ORDERED} AS place, l_partkey % 301 - 150 AS ms FROM lineitem)
SELECT file, place, CASE WHEN ms < 0 THEN 'atrim=start=' || (abs(ms) / 1000.0::DOUBLE) WHEN ms > 0 THEN 'adelay=' || ms || ':all=1' ELSE '' END AS filter FROM s""")
def delay_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams(spark, sf_dir).select("file", "place", numbers.delay_filter(F.col("l_partkey") % 301 - 150).alias("filter"))


@query("""WITH b AS (SELECT o_orderkey AS id, o_custkey * (o_orderkey % 7) * 1024 * (o_orderkey % 3 + 1) AS b FROM orders),
u AS (SELECT *, CASE WHEN b >= 1099511627776 THEN 1099511627776 WHEN b >= 1073741824 THEN 1073741824 WHEN b >= 1048576 THEN 1048576 WHEN b >= 1024 THEN 1024 ELSE 1 END AS unit FROM b),
h AS (SELECT *, (200 * b + unit) // (2 * unit) AS hundredths FROM u)
SELECT id, (hundredths // 100) || '.' || lpad((hundredths % 100)::VARCHAR, 2, '0') || CASE unit WHEN 1 THEN ' B' WHEN 1024 THEN ' KiB' WHEN 1048576 THEN ' MiB' WHEN 1073741824 THEN ' GiB' ELSE ' TiB' END AS size FROM h""")
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("o_custkey") * (F.col("o_orderkey") % 7) * 1024 * (F.col("o_orderkey") % 3 + 1)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.human_size(size).alias("size"))


@query("""SELECT id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS long,
CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS short FROM (SELECT o_orderkey AS id, floor(o_totalprice * 37 / 1000)::BIGINT AS s FROM orders)""")
def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("o_totalprice") * 37
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.duration(ms).alias("long"), text.short_duration(ms).alias("short"))


@query("SELECT o_orderkey AS id, format('{:,}', o_orderkey * 37) || ' / ' || format('{:,}', o_custkey * 1000) || ' frames' AS label FROM orders")
def frames_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = text.frames_label(F.col("o_orderkey") * 37, F.col("o_custkey") * 1000)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), label.alias("label"))


@query(f"WITH {PAGE_PATHS} SELECT page_id, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '[^/.][^/]*\\.([^/.]*)$', 1) AS ext FROM files")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return page_paths(spark, sf_dir).select("page_id", text.dirname(path).alias("folder"), text.basename(path).alias("name"), text.extension(path).alias("ext"))


@query(f"""WITH {PAGE_PATHS}, roots AS (SELECT DISTINCT folder AS root FROM above WHERE folder LIKE '%/en' OR folder LIKE 'www%')
SELECT page_id, path FROM files f WHERE EXISTS (SELECT 1 FROM roots WHERE f.path = root OR starts_with(f.path, root || '/'))""")
def path_allowed_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = page_paths(spark, sf_dir).select("page_id", "path")
    roots = tree.by_ancestor(files).filter(F.col("folder").endswith("/en") | F.col("folder").startswith("www")).select(F.col("folder").alias("root"))
    return tree.within(files, roots)


@query(f"WITH {PAGE_PATHS} SELECT folder, count(*) AS total, count(*) FILTER (encoded) AS encoded FROM above GROUP BY folder")
def dir_counts_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.recursive_counts(page_paths(spark, sf_dir), encoded=F.col("encoded"))


@query("""WITH v AS (SELECT DISTINCT 'd' || p_partkey % 50 AS folder, 'v' || p_partkey % 40 AS stem FROM part WHERE p_partkey % 2 = 0),
s AS (SELECT DISTINCT 'd' || p_partkey % 50 AS folder, 'v' || p_partkey % 40 || '.' || p_size AS stem, CASE WHEN p_size % 3 = 0 THEN '.txt' ELSE '.SRT' END AS ext FROM part)
SELECT v.folder || '/' || v.stem || '.mkv' AS video, s.folder || '/' || s.stem || ext AS path FROM v JOIN s ON v.folder = s.folder AND starts_with(s.stem, v.stem) WHERE ext = '.SRT'""")
def sidecar_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for videos and for subtitles, some of other extensions; v1 begins v1.7 and v12.7."""
    part = table(spark, sf_dir, "part")
    place = F.concat(F.lit("d"), (F.col("p_partkey") % 50).cast("string"), F.lit("/v"), (F.col("p_partkey") % 40).cast("string"))
    videos = part.filter("p_partkey % 2 = 0").select(F.concat(place, F.lit(".mkv")).alias("path")).distinct()
    ending = F.when(F.col("p_size") % 3 == 0, ".txt").otherwise(".SRT")
    return library.sidecars(part.select(F.concat(place, F.lit("."), F.col("p_size").cast("string"), ending).alias("path")).distinct(), videos)


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 5 > 0 AND p_size % 7 > 0 THEN (p_size % 10)::DOUBLE END AS least, CASE WHEN p_size % 5 > 0 AND p_size % 7 > 0 THEN (p_size * 100)::DOUBLE END AS most FROM part""")
def luminance_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of mastering luminance, of which some lack a part."""
    from ..operators.probe import luminance

    size, word = F.col("p_size"), lambda x: x.cast("string")
    spoken = F.concat(F.when(size % 5 > 0, F.concat(F.lit("min: "), word(size % 10), F.lit(".0 cd/m2"))).otherwise(""), F.lit(", "), F.when(size % 7 > 0, F.concat(F.lit("max:  "), word(size * 100), F.lit(" cd/m2"))).otherwise("max"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), luminance(spoken).alias("l"))
    return rows.select("id", "l.least", "l.most")


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_paths(spark, sf_dir).groupBy("path").agg(F.bool_and("checked").alias("checked"), F.bool_or("encoded").alias("encoded"))


LEAVES = (
    PAGE_PATHS
    + """, leaves AS (SELECT path, bool_and(checked) AS checked, bool_or(encoded) AS encoded FROM files GROUP BY path),
places AS (SELECT path, checked, encoded, array_to_string(string_split(path, '/')[1:n], '/') AS folder FROM leaves, unnest(range(0, len(string_split(path, '/')))) t(n)),
states AS (SELECT folder, CASE WHEN bool_and(checked) THEN 'all' WHEN bool_or(checked) THEN 'some' ELSE 'none' END AS state FROM places GROUP BY folder)"""
)


@query(f"WITH {LEAVES} SELECT folder, state FROM states")
def tristate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.check_states(leaves(spark, sf_dir))


@query(f"""WITH {LEAVES}, hit AS (SELECT p.path, min_by(s.state = 'none', length(s.folder)) AS goal FROM places p JOIN states s USING (folder) WHERE s.folder LIKE '%/es' OR s.folder LIKE 'm.%' GROUP BY p.path)
SELECT path, coalesce(goal, checked) AS checked FROM leaves LEFT JOIN hit USING (path)""")
def check_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leaves(spark, sf_dir)
    folders = tree.by_ancestor(rows).filter("folder like '%/es' or folder like 'm.%'").select("folder").distinct()
    return tree.toggled(rows.select("path", "checked"), folders)


MAXIMAL = (
    LEAVES
    + """, parented AS (SELECT folder AS path, CASE WHEN folder LIKE '%/%' THEN regexp_replace(folder, '/[^/]*$', '') ELSE '' END AS parent FROM states WHERE state = 'all' AND folder <> ''
UNION ALL SELECT path, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END FROM leaves WHERE checked),
maximal AS (SELECT path FROM parented WHERE parent NOT IN (SELECT folder FROM states WHERE state = 'all') UNION ALL SELECT folder FROM states WHERE state = 'all' AND folder = '')"""
)


@query(f"WITH {MAXIMAL} SELECT path FROM maximal")
def maximal_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.maximal_checked(leaves(spark, sf_dir).select("path", "checked"))


@query(f"WITH {LEAVES} SELECT split_part(path, '/', 1) AS root, count(*) FILTER (checked AND NOT encoded) AS pending FROM leaves GROUP BY 1")
def selected_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos left to encode below the maximal checked paths, by root."""
    rows = leaves(spark, sf_dir)
    chosen = tree.maximal_checked(rows.select("path", "checked")).withColumnRenamed("path", "root")
    held = tree.within(rows.filter("not encoded").select("path"), chosen)
    roots = rows.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("root"), "path")
    return roots.join(held.withColumn("one", F.lit(1)), "path", "left").groupBy("root").agg(F.count("one").alias("pending"))


ROOTED = (
    PAGE_PATHS.replace("above AS", "unrooted AS")
    + """, rooted AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN path ELSE '/data/lib/' || path END AS path, checked, encoded FROM files),
leaves AS (SELECT path, bool_and(checked) AS checked, bool_or(encoded) AS encoded FROM rooted GROUP BY path),
above AS (SELECT path, checked, encoded, CASE WHEN n = 1 AND starts_with(path, '/') THEN '/' ELSE array_to_string(string_split(path, '/')[1:n], '/') END AS folder
  FROM leaves, unnest(range(CASE WHEN starts_with(path, '/') THEN 1 ELSE 0 END, len(string_split(path, '/')))) t(n)),
states AS (SELECT folder, CASE WHEN bool_and(checked) THEN 'all' WHEN bool_or(checked) THEN 'some' ELSE 'none' END AS state FROM above GROUP BY folder)"""
)
#: The folder that holds a path, in SQL.
SQL_PARENT = "CASE WHEN path IN ('', '/') THEN NULL WHEN path NOT LIKE '%/%' THEN '' WHEN path NOT LIKE '_%/%' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END"


def rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of a library: four fifths below /data/lib, the rest on relative paths; some are spelt with slashes too many."""
    path = F.when(F.col("page_id") % 5 == 0, F.col("path")).otherwise(F.concat(F.lit("/data/lib/"), "path"))
    return page_paths(spark, sf_dir).withColumn("path", path)


def rooted_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooted(spark, sf_dir).groupBy("path").agg(F.bool_and("checked").alias("checked"), F.bool_or("encoded").alias("encoded"))


def misspelt(paths: DataFrame, column: str) -> DataFrame:
    """The same paths with doubled slashes and one at the end."""
    return paths.withColumn(column, F.concat(F.replace(column, F.lit("/"), F.lit("//")), F.lit("/")))


@query(f"""WITH {ROOTED} SELECT page_id, path FROM rooted WHERE starts_with(path, '/data/lib/m.') OR starts_with(path, 'www.') OR path LIKE '/data/lib/%/en/%' OR path LIKE '/data/lib/%/en'""")
def allowed_rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below roots that are absolute, relative, and misspelt."""
    files = rooted(spark, sf_dir).select("page_id", "path")
    wanted = F.col("folder").rlike("^/data/lib/m[.][^/]*$|^www[.][^/]*$|^/data/lib/[^/]*(/.*)?/en$")
    found = tree.all_folders(files).unionByName(files.select(F.col("path").alias("folder"))).filter(wanted).distinct()
    return tree.within(files, misspelt(found.select(F.col("folder").alias("root")), "root"))


@query(f"WITH {ROOTED} SELECT folder, state FROM states")
def tristate_rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.check_states(rooted_leaves(spark, sf_dir))


@query(f"""WITH {ROOTED}, hit AS (SELECT a.path, min_by(s.state = 'none', length(s.folder)) AS goal FROM above a JOIN states s USING (folder) WHERE s.folder LIKE '%/es' OR s.folder LIKE '/data/lib/m.%' GROUP BY a.path)
SELECT path, coalesce(goal, checked) AS checked FROM leaves LEFT JOIN hit USING (path)""")
def toggled_rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rooted_leaves(spark, sf_dir)
    folders = tree.all_folders(rows).filter("folder like '%/es' or folder like '/data/lib/m.%'")
    return tree.toggled(rows.select("path", "checked"), misspelt(folders, "folder"))


MAXIMAL_ROOTED = (
    ROOTED
    + f""", held AS (SELECT folder AS path FROM states WHERE state = 'all' AND (NOT starts_with(folder, '/') OR starts_with(folder, '/data/lib/'))),
parented AS (SELECT path, {SQL_PARENT} AS parent FROM (SELECT path FROM held UNION ALL SELECT path FROM leaves WHERE checked)),
maximal AS (SELECT path FROM parented WHERE parent IS NULL OR parent NOT IN (SELECT path FROM held))"""
)


@query(f"WITH {MAXIMAL_ROOTED} SELECT path FROM maximal")
def maximal_rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's hosts and the relative root are the roots; /data and /data/lib stand for nothing."""
    rows = rooted_leaves(spark, sf_dir)
    hosts = tree.all_folders(rows).filter("folder rlike '^/data/lib/[^/]+$' or folder = ''").select(F.col("folder").alias("root"))
    return tree.maximal_checked(rows.select("path", "checked"), hosts)


@query(f"WITH {ROOTED} SELECT CASE WHEN starts_with(path, '/') THEN split_part(path, '/', 4) ELSE split_part(path, '/', 1) END AS host, count(*) FILTER (checked AND NOT encoded) AS pending FROM leaves GROUP BY 1")
def pending_rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rooted_leaves(spark, sf_dir)
    chosen = tree.maximal_checked(rows.select("path", "checked")).withColumnRenamed("path", "root")
    held = tree.within(rows.filter("not encoded").select("path"), chosen).withColumn("one", F.lit(1))
    host = F.split_part("path", F.lit("/"), F.when(F.col("path").startswith("/"), 4).otherwise(1)).alias("host")
    return rows.select("path", host).join(held, "path", "left").groupBy("host").agg(F.count("one").alias("pending"))


@query(f"""WITH {ROOTED}, folders AS (SELECT DISTINCT folder, starts_with(folder, '/') AS absolute FROM above),
numbered AS (SELECT *, row_number() OVER (PARTITION BY absolute ORDER BY CASE WHEN folder = '/' THEN '' ELSE replace(folder, '/', chr(1)) END) AS first FROM folders)
SELECT folder, {SQL_PARENT.replace("path", "folder")} AS parent, CASE WHEN folder IN ('', '/') THEN 0 ELSE len(string_split(folder, '/')) - absolute::BIGINT END::BIGINT AS depth, first,
first + (SELECT count(*) FROM folders b WHERE a.absolute = b.absolute AND a.folder <> b.folder AND (a.folder IN ('', '/') OR starts_with(b.folder, a.folder || '/'))) AS last FROM numbered a""")
def nested_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nested_sets(rooted(spark, sf_dir)).withColumn("depth", F.col("depth").cast("bigint"))


@query(f"""WITH RECURSIVE {ROOTED}, picked AS (SELECT page_id AS place, CASE page_id % 3 WHEN 0 THEN path WHEN 1 THEN {SQL_PARENT} ELSE regexp_extract(path, '^(/data/lib/)?[^/]+') END AS path FROM rooted),
clicks AS (SELECT path, row_number() OVER (ORDER BY place) AS k FROM picked WHERE path NOT IN ('', '/')),
start AS (SELECT list(struct_pack(p := path, c := checked) ORDER BY path) AS l FROM leaves),
steps AS (SELECT 0::BIGINT AS k, l FROM start UNION ALL
  SELECT clicks.k, list_transform(l, lambda x: struct_pack(p := x.p, c := CASE WHEN x.p = path OR starts_with(x.p, path || '/')
    THEN len(list_filter(l, lambda y: y.c AND (y.p = path OR starts_with(y.p, path || '/')))) = 0 ELSE x.c END)) FROM steps JOIN clicks ON clicks.k = steps.k + 1),
ended AS (SELECT unnest(l) AS x FROM steps WHERE k = (SELECT max(k) FROM steps)) SELECT x.p AS path, x.c AS checked FROM ended""")
def toggles_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click for each page: on its file, its folder or its host."""
    files = rooted(spark, sf_dir)
    host = F.regexp_extract("path", "^(/data/lib/)?[^/]+", 0)
    target = F.when(F.col("page_id") % 3 == 0, F.col("path")).when(F.col("page_id") % 3 == 1, text.folder_of(F.col("path"))).otherwise(host)
    clicks = files.select(F.col("page_id").alias("place"), target.alias("path")).filter(~text.is_root(F.col("path")))
    return tree.toggled_in_order(rooted_leaves(spark, sf_dir).select("path", "checked"), clicks)


@query(f"""WITH {NAMES}, p AS (SELECT id, 'a' || id % 5 || CASE id % 3 WHEN 0 THEN '/' ELSE '\\' END || 'b' || id % 7 AS rel, '/lib/x' || id % 4 || '/' || file AS input, id % 4 = 0 AS replaces FROM names)
SELECT id, CASE WHEN replaces THEN 'lib/x' || id % 4 WHEN id % 11 = 0 THEN '' ELSE replace(rel, '\\', '/') END AS folder FROM p""")
def job_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that replace their source lie in the folder of their input, others in their relative path, which may have backslashes or be null."""
    word = lambda c: c.cast("string")
    rel = F.concat(F.lit("a"), word(F.col("id") % 5), F.when(F.col("id") % 3 == 0, "/").otherwise("\\"), F.lit("b"), word(F.col("id") % 7))
    rows = names(spark, sf_dir).withColumn("rel", F.when(F.col("id") % 11 > 0, rel)).withColumn("input", F.concat(F.lit("/lib/x"), word(F.col("id") % 4), F.lit("/"), "file"))
    return rows.select("id", tree.job_folder(F.col("input"), F.col("rel"), F.col("id") % 4 == 0).alias("folder"))


@query("""SELECT page_id, coalesce(nullif(try_cast(regexp_extract(t, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0), 7) AS number FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS t FROM pages)""")
def tolerant_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", numbers.leading_int(F.regexp_extract("url", "[^/]*$", 0), 7).alias("number"))


@query("""SELECT page_id, try_cast(regexp_extract(url, 'page=([0-9.]+)', 1) AS DOUBLE) AS page, nullif(regexp_extract(url, 'ref=(\\w+)', 1), '') AS ref FROM pages""")
def kv_regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda pattern: F.nullif(F.regexp_extract("url", pattern, 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", value(r"page=([0-9.]+)").try_cast("double").alias("page"), value(r"ref=(\w+)").alias("ref"))


@query("""SELECT p_partkey AS id, p_size % 3 = 0 AS is_hdr, p_size % 5 = 0 AS has_hdr10plus, p_size % 7 = 0 AS has_dolby_vision, CASE WHEN p_size % 2 = 0 THEN 9 END::BIGINT AS primaries FROM part""")
def hdr_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.probe import hdr_flags as flags
    from ..operators.probe import primaries_code

    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(size % 3 == 0, "PQ").otherwise("BT.709").alias("transfer"),
        F.concat(F.when(size % 5 == 0, "SMPTE hdr10+ ").otherwise("x "), F.when(size % 7 == 0, "dolby VISION").otherwise("")).alias("format"),
        F.when(size % 2 == 0, "BT.2020").otherwise("Display P3").alias("colour"),
    )
    return rows.select("id", *flags(F.col("transfer"), F.col("format")), primaries_code(F.col("colour")).cast("bigint").alias("primaries"))


HDR = """hdr AS (SELECT p_partkey AS id, p_size AS n FROM part)"""


@query(f"""WITH {HDR} SELECT id, CASE WHEN n % 2 = 0 THEN 16 END::BIGINT AS transfer, CASE WHEN n % 3 = 0 THEN 9 END::BIGINT AS primaries, CASE WHEN n % 5 = 0 THEN 9 END::BIGINT AS matrix,
CASE WHEN n % 7 = 0 THEN 1 END::BIGINT AS range, CASE WHEN n % 4 > 0 AND n % 3 > 0 THEN n * 10 END::BIGINT AS content, CASE WHEN n % 4 > 0 AND n % 3 > 0 THEN n END::BIGINT AS frame,
CASE WHEN n % 6 > 0 THEN (n % 6)::DOUBLE / 1000.0::DOUBLE END AS least, CASE WHEN n % 6 > 0 THEN (n * 20)::DOUBLE END AS most,
CASE WHEN n % 9 = 0 THEN NULL WHEN n % 9 < 5 THEN 0.68::DOUBLE ELSE 0.708::DOUBLE END AS red_x, CASE WHEN n % 9 > 0 THEN 0.3127::DOUBLE END AS white_x FROM hdr""")
def hdr_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a media probe prints of each part: names and values, line by line, some of which are missing or no numbers."""
    from ..operators import probe

    n = F.col("p_size")
    line = lambda name, value, when=F.lit(True): F.when(when, F.concat(F.lit(f"{name} : "), value.cast("string"), F.lit("\n"))).otherwise("")
    said = F.concat(
        line("transfer_characteristics", F.when(n % 2 == 0, "PQ").otherwise("BT.709")), line("colour_primaries", F.when(n % 3 == 0, "BT.2020").otherwise("Display P3")),
        line("matrix_coefficients", F.lit("BT.2020 non-constant"), n % 5 == 0), line("colour_range", F.when(n % 7 == 0, "Limited").otherwise("Full")),
        line("MaxCLL", F.when(n % 4 > 0, F.concat((n * 10).cast("string"), F.lit(" cd/m2"))).otherwise("n/a")), line("MaxFALL", n, n % 3 > 0),
        line("MasteringDisplay_Luminance", F.concat(F.lit("min: "), ((n % 6) / 1000.0).cast("string"), F.lit(" cd/m2, max: "), (n * 20).cast("string"), F.lit(" cd/m2")), n % 6 > 0),
        line("MasteringDisplay_ColorPrimaries", F.when(n % 9 < 5, "Display P3").otherwise("BT.2020"), n % 9 > 0),
    )
    found = probe.hdr_metadata(probe.probe_fields(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), said.alias("text"))))
    whole = lambda c: F.col(c).cast("bigint").alias(c.split(".")[-1])
    return found.select(
        F.col("file").alias("id"), *map(whole, ("transfer", "primaries", "matrix", "range", "levels.content", "levels.frame")), "luminance.least", "luminance.most",
        F.get("chromaticity", F.lit(0)).alias("red_x"), F.get("white", F.lit(0)).alias("white_x"),
    )


@query("""SELECT p_partkey AS id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<Tags>' || chr(10) || '  <Tag>' || chr(10) ||
'    <Simple>' || chr(10) || '      <Name>BRAND</Name>' || chr(10) || '      <String>' || p_brand || ' &amp; &lt;co&gt;</String>' || chr(10) || '    </Simple>' || chr(10) ||
'    <Simple>' || chr(10) || '      <Name>TITLE</Name>' || chr(10) || '      <String>' || p_name || ' &quot;' || p_size || '&quot;</String>' || chr(10) || '    </Simple>' || chr(10) ||
'  </Tag>' || chr(10) || '</Tags>' || chr(10) AS document FROM part""")
def tag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import tag_document

    tags = F.create_map(F.lit("TITLE"), F.concat("p_name", F.lit(' "'), F.col("p_size").cast("string"), F.lit('"')), F.lit("BRAND"), F.concat("p_brand", F.lit(" & <co>")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tag_document(tags).alias("document"))


@query("SELECT p_partkey AS id, (p_size * 80)::BIGINT * (p_size * 45) > 1920 * 1080 AS high FROM part")
def high_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scenes import high_resolution as is_high

    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), is_high(F.col("p_size") * 80, F.col("p_size") * 45).alias("high"))
