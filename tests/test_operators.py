"""Operators on rows made by hand, against plain Python."""

import math
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import numbers, text
from millrace.operators import audio, events, intervals, jobs, library, probe, scenes, tree


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("xs", [[5.0], [1.0, 2.0], [3.0, 1.0, 2.0, 9.0, 4.0, 4.0], [float(x) for x in range(100)], [0.0] * 7])
def test_exclusive_quantile(spark, xs):
    got = spark.createDataFrame([(sorted(xs),)], "xs array<double>").select(numbers.exclusive_quantile(F.col("xs"), 15)).first()[0]
    assert got == pytest.approx(xs[0] if len(xs) == 1 else statistics.quantiles(sorted(xs), n=100)[14])


def test_clamped_score(spark):
    got = [r[0] for r in spark.createDataFrame([(-1.0,), (math.nan,), (math.inf,), (2.5,)], "s double").select(numbers.clamped_score(F.col("s"))).collect()]
    assert got == [0.0, 0.0, 100.0, 2.5]


@pytest.mark.parametrize(("name", "tag"), [("a REMUX WEBDL", "Bluray"), ("a_WEBRIP_b", "Bluray"), ("WEB-DL x", "Bluray"), ("x.webrip.y", "WEBRip"), ("x HDTV", "HDTV"), ("", "Bluray")])
def test_source_tag(spark, name, tag):
    assert one(spark, text.source_tag(F.col("n")), n=name) == tag


@pytest.mark.parametrize(("name", "title", "group"), [("Show – S01 [x]-GRP_1", "Show – S01", "GRP_1"), ("Show — [x]", "Show", None), ("Plain", "Plain", None)])
def test_names(spark, name, title, group):
    assert one(spark, text.base_title(F.col("n")), n=name) == title
    assert one(spark, text.release_group(F.col("n")), n=name) == group


def test_lenient_numbers(spark):
    rows = [("12abc",), ("",), ("0",), ("x",), (None,), (" -3",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(numbers.leading_int(F.col("t"), 9)).collect()]
    assert got == [12, 9, 9, 9, 9, -3]


def test_natural_order(spark):
    rows = spark.createDataFrame([("Ep 10",), ("Ep 9",), ("ep 9 part 11",), ("Ep 9 part 2",)], "n string")
    assert [r[0] for r in rows.orderBy(text.natural_key(F.col("n"))).collect()] == ["Ep 9", "Ep 9 part 2", "ep 9 part 11", "Ep 10"]


def test_digit_runs_of_any_length(spark):
    names = ["a" + d for d in ("9" * 30, "1" + "0" * 30, "007", "8", "9" * 21)]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n")), "n").collect()]
    assert got == ["a007", "a8", "a" + "9" * 21, "a" + "9" * 30, "a1" + "0" * 30]


@pytest.mark.parametrize(("size", "label"), [(0, "0.00 B"), (1152, "1.13 KiB"), (1023, "1023.00 B"), (1024**2 - 1, "1024.00 KiB"), (5 * 1024**4 + 1, "5.00 TiB"), (2**60, "1048576.00 TiB")])
def test_sizes(spark, size, label):
    assert one(spark, text.human_size(F.col("n")), n=size) == label


def test_walk_of_folders(spark):
    rows = [(1, "b/x/1", -7), (2, "a/2", 5), (3, "a/3", -9), (4, "4", -100), (5, "b/5", 0), (6, "b/x/6", 123_456_789_012_345), (7, "c/7", None), (8, "a/z/8", 9)]
    df = spark.createDataFrame([(i, p, "queued" if o is not None else "done", o) for i, p, o in rows], "id int, path string, status string, queue_order bigint")
    got = [r.id for r in tree.depth_first_places(df).orderBy("place").collect()]
    assert got == [8, 3, 2, 1, 6, 5, 4]  # a before b by -9 and -7; files after folders


def test_paired_frames(spark):
    rows = lambda n: spark.range(n).select(F.lit("v").alias("video"), F.col("id").alias("frame"))
    assert intervals.paired_frames(rows(4), rows(4)).count() == 4
    with pytest.raises(Exception, match="frames of v: 4 and 3"):
        intervals.paired_frames(rows(4), rows(3)).collect()
    assert sorted(r.frame for r in intervals.skipped(rows(4), F.lit(2)).collect()) == [2, 3]


def test_hdr_metadata(spark):
    said = "HDR_Format : HDR10\ntransfer_characteristics: PQ\ncolour_primaries: BT.2020\nMaxCLL: 1000 cd/m2\nMaxFALL: 400 cd/m2\nMasteringDisplay_ColorPrimaries: Display P3\nMasteringDisplay_Luminance: min: 0.005 cd/m2, max: 1000 cd/m2"
    fields = probe.probe_fields(spark.createDataFrame([("a", said), ("b", None)], "file string, text string"))
    got = {r.file: r for r in probe.hdr_metadata(fields).collect()}
    assert (got["a"].transfer, got["a"].primaries, got["a"].matrix) == (16, 9, None)
    assert tuple(got["a"].levels) == (1000, 400) and tuple(got["a"].luminance) == (0.005, 1000.0)
    assert got["a"].white == [0.3127, 0.329] and got["a"].chromaticity[:2] == [0.68, 0.32]
    assert got["b"].white is None and got["b"].levels is None


def test_small_expressions(spark):
    assert one(spark, text.last_characters(F.col("t"), 3), t="abcdef") == "def"
    assert len(one(spark, text.short_id(F.col("t")), t="a/b")) == 8
    assert one(spark, scenes.high_resolution(F.col("w"), F.col("h")), w=1920, h=1081) and not one(spark, scenes.high_resolution(F.col("w"), F.col("h")), w=1920, h=1080)
    row = tree.nodes_with_defaults(spark.createDataFrame([("n", "p", "folder", None, 3, None)], "name string, path string, type string, size bigint, videos int, encoded_videos int")).first()
    assert (row.is_folder, row["size"], row.videos, row.encoded_videos) == (True, 0, 3, 0)
    new = jobs.with_defaults(spark.createDataFrame([("p",)], "input_path string"), F.struct(F.lit("high").alias("quality"))).first()
    assert (new.status, new.progress, new.settings.quality) == ("queued", 0.0, "high")


def frames(spark, keys, scores):
    return spark.createDataFrame([("v", i, i in keys, s) for i, s in enumerate(scores)], "video string, frame bigint, is_key boolean, score double")


@settings(max_examples=8, deadline=None)
@given(st.sets(st.integers(0, 19)), st.lists(st.floats(0, 90), min_size=20, max_size=20))
def test_zones_cover_all_frames(spark, keys, scores):
    zones = sorted((r.start, r.end_incl, r.crf) for r in scenes.crf_zones(frames(spark, keys, scores), 30.0).collect())
    assert [z[0] for z in zones] == sorted({0, *keys})
    assert all(a[1] + 1 == b[0] for a, b in zip(zones, zones[1:], strict=False)) and zones[-1][1] == 19
    assert all(z[2] is None or abs(z[2] - 30) <= 5 for z in zones)


def test_means_are_summed_in_order_of_frames(spark):
    scores = [2.0**53, *[1.0] * 40]  # each 1 is lost behind the first score, but not if they are added up before it
    rows = frames(spark, {0}, scores).repartition(7)
    assert [r.overall for r in scenes.scenes_against_mean(rows).collect()] == [2.0**53 / len(scores)]


def test_zero_mean_has_no_adjustment(spark):
    assert scenes.crf_zones(frames(spark, {0}, [0.0, 0.0]), 30.0).first()["crf"] is None


def test_upsampling_keeps_samples(spark):
    rows = frames(spark, {0}, [float(i) for i in range(8)])
    lengths = spark.createDataFrame([("v", 8)], "video string, nframe bigint")
    got = {r.frame: r.score for r in scenes.upsampled(scenes.systematic_sample(rows), lengths).collect()}
    assert got == {i: float(i // 3 * 3) for i in range(8)}


def test_zone_texts(spark):
    rows = spark.createDataFrame([("a", "Zones : 0,9,30.0;10,40,25.5;x,y;1,2;41,60,30,extra;"), ("b", ""), ("c", "nothing")], "video string, text string")
    zones = intervals.parsed_zones(rows)
    assert sorted(map(tuple, zones.collect())) == [("a", 0, 9, 30.0), ("a", 10, 40, 25.5), ("a", 41, 60, 30.0)]
    moved = intervals.shifted_zones(zones, F.lit(40))
    assert sorted((r.start, r.end_incl) for r in moved.collect()) == [(1, 20)]  # a zone that ends at the offset goes


QUEUE = "queue int, id int, queue_order int"


def test_moves_at_the_ends(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], QUEUE)
    move = lambda i, up: [r.new_order for r in jobs.moved_one(rows, F.col("id") == i, up).orderBy("id").collect()]
    assert move(1, True) == [1, 2, 3] and move(3, False) == [1, 2, 3]
    assert move(2, True) == [2, 1, 3] and move(2, False) == [1, 3, 2]
    assert [r.new_order for r in jobs.moved_to_end(rows, F.col("id") == 3, True).orderBy("id").collect()] == [1, 2, 0]
    assert [r.new_order for r in jobs.moved_to_end(rows, F.col("id") == 3, False).orderBy("id").collect()] == [1, 2, 3]


def test_reorder_passes_over_unknown_ids(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], QUEUE)
    ids = spark.createDataFrame([(1, 3, 0), (1, 99, 1), (1, 1, 2)], "queue int, id int, place int")
    assert {r.id: r.new_order for r in jobs.reordered(rows, ids).collect()} == {3: 1, 1: 2, 2: 2}


def test_slots_are_a_permutation(spark):
    rows = spark.createDataFrame([(1, i, 10 * i) for i in range(1, 7)], QUEUE)
    got = {r.id: r.new_order for r in jobs.slots_reassigned(rows, -F.col("id")).collect()}
    assert got == {i: 10 * (7 - i) for i in range(1, 7)}


def test_folder_eta(spark):
    rows = [
        ("none", "queued", None, None, 5.0, 0.0), ("young", "muxing", 99_000, None, 5.0, 50.0),
        ("mix", "done", 0, 10_000, 5.0, 100.0), ("mix", "queued", None, None, 10.0, 0.0), ("mix", "queued", None, None, None, 0.0), ("mix", "muxing", 90_000, None, 5.0, 50.0),
    ]
    df = spark.createDataFrame(rows, "folder string, status string, started_at bigint, finished_at bigint, duration double, progress double")
    got = {r.folder: r for r in jobs.folder_eta(df, F.lit(100_000)).collect()}
    assert set(got) == {"young", "mix"}
    assert got["young"].remaining == 0.0
    assert got["mix"].remaining == pytest.approx(20_000 + 10_000 + 10_000)  # by ratio 2, by the mean, by progress
    assert got["mix"].estimated_total == pytest.approx(10_000 + 10_000 + 40_000)
    labels = {r.folder: r.label for r in jobs.folder_eta(df, F.lit(100_000)).select("folder", jobs.eta_label().alias("label")).collect()}
    assert labels == {"young": "Estimated after 1st encode", "mix": "~1m 0s total · ~40s remaining · 10s avg/ep"}


def test_tree_checks(spark):
    rows = spark.createDataFrame([("a/b/1", True), ("a/b/2", True), ("a/3", False), ("c/4", True)], "path string, checked boolean")
    assert {r.folder: r.state for r in tree.check_states(rows).collect()} == {"": "some", "a": "some", "a/b": "all", "c": "all"}
    assert sorted(r.path for r in tree.maximal_checked(rows).collect()) == ["a/b", "c"]
    toggled = tree.toggled(rows, spark.createDataFrame([("a",)], "folder string"))
    assert {r.path: r.checked for r in toggled.collect()} == {"a/b/1": False, "a/b/2": False, "a/3": False, "c/4": True}


def test_titles_and_delays(spark):
    rows = spark.createDataFrame([(1, "en", "a"), (1, "en", "b"), (1, "de", "c"), (1, None, "d"), (1, "fr", " ")], "file int, language string, title string")
    assert {r.title: r.keep_title for r in audio.with_kept_titles(rows).collect()} == {"a": True, "b": True, "c": False, "d": True, " ": False}
    got = [one(spark, numbers.delay_filter(F.col("d")), d=d) for d in (-1500, 0, 40)]
    assert got == ["atrim=start=1.5", "", "adelay=40:all=1"]


def test_probes(spark):
    rows = spark.createDataFrame([("a", "0,640,480\n1,1920,800\n2,1920,1080\n"), ("b", "")], "file string, csv string")
    assert sorted(map(tuple, probe.video_streams(rows).collect())) == [("a", 1, 1920, 800), ("b", 0, 1920, 1080)]
    rows = spark.createDataFrame([("a", '{"streams":[{"index":1,"channels":2,"tags":{"language":"en"}}]}'), ("b", "bad")], "file string, json string")
    assert [(r.file, r["index"], r.layout, r.language) for r in probe.audio_streams(rows).collect()] == [("a", 1, "stereo", "en")]
    assert one(spark, probe.luminance(F.col("t")), t="min: 0.005 cd/m2, max: 1000 cd/m2").asDict() == {"least": 0.005, "most": 1000.0}
    assert one(spark, probe.light_levels(F.col("a"), F.col("b")), a="1000", b="x") is None


def test_library(spark):
    files = spark.createDataFrame([("r/a.mkv", "r"), ("r/b-org.mp4", "r"), ("r/c.mov", "r"), ("r/d.txt", "r")], "path string, root string")
    live = spark.createDataFrame([("r/c.mov",)], "input_path string")
    assert tuple(library.scan_counts(files, live, "org").first()) == ("r", 1, 1, 1)
    near = spark.createDataFrame([("x/Ep 1.srt",), ("x/Ep 10.nfo",), ("y/Ep 1.srt",), ("x/Ep 1.txt",)], "path string")
    film = spark.createDataFrame([("x/Ep 1.mkv",)], "path string")
    assert sorted(r.path for r in library.sidecars(near, film).collect()) == ["x/Ep 1.srt", "x/Ep 10.nfo"]


def test_step_states(spark):
    rows = [("j", 1, 10, "stage", 0, None, None), ("j", 2, 20, "progress", 0, 25, 100), ("j", 3, 30, "stage", 1, None, None), ("j", 4, 40, "stage_complete", 0, None, None), ("j", 5, 50, "other", 9, None, None)]
    df = spark.createDataFrame(rows, "id string, seq bigint, at bigint, event string, stage int, current bigint, total bigint")
    got = {r.step: (r.status, r.progress, r.started_at, r.finished_at) for r in events.step_states(df).collect()}
    assert got == {2: ("done", 100.0, 10, 40), 3: ("active", 0.0, 30, None)}
    assert events.initial_steps(spark.createDataFrame([("j",)], "id string")).count() == 9


def test_patch_keeps_what_is_empty(spark):
    row = spark.sql("select named_struct('quality', 'low', 'speed', 'slow', 'bitrates', map('mono', 64, '5.1', 256)) s, named_struct('quality', '', 'speed', 'fast', 'bitrates', map('mono', 32)) p")
    got = row.select(jobs.patched(F.col("s"), F.col("p")).alias("x")).first()["x"]
    assert (got.quality, got.speed, got.bitrates) == ("low", "fast", {"mono": 32, "5.1": 256})
