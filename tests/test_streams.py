"""Streams give what their batch twins give, and sources read what sinks write."""

import base64
import json
import os
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import events
from millrace.operators import lines
from millrace.sources import config, containers, files
from millrace.streaming import polling, progress, sinks, stability


def drained(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name)


def streamed(spark, tmp_path, rows, schema, batches=3):
    """Rows as a stream, one file for each micro-batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    names = [f.split()[0] for f in schema.split(", ")]
    size = -(-len(rows) // batches)
    for k in range(batches):
        file = folder / f"{k}.json"
        file.write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows[k * size : (k + 1) * size]))
        os.utime(file, (1_000_000 + 10 * k,) * 2)  # batches come in order of the files' times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_stability_gate(spark, tmp_path):
    sizes = {"a": [5, 5, 5, 5, 5], "b": [1, 2, 2, 3, 3, 3], "c": [0, 0, 0, 0], "d": [7, 7, None, 7, 7], "e": [4, 4, None, 4, 4, 4]}
    rows = sorted([(p, i, s) for p, xs in sizes.items() for i, s in enumerate(xs)], key=lambda r: r[1])
    schema = "path string, poll bigint, size bigint"
    query = polling.gate(streamed(spark, tmp_path, rows, schema), 2, 3_600_000).writeStream.format("memory").queryName("gate").start()
    until = time.time() + 60  # a state with timers is looked at again and again, so there is no end of the available data
    while sum(p.numInputRows for p in query.recentProgress) < len(rows) and time.time() < until:
        time.sleep(0.5)
    query.stop()
    got = spark.table("gate")
    twin = stability.ready_files(spark.createDataFrame(rows, schema), 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, twin.collect())) == [("a", 2, 5), ("b", 5, 3), ("e", 5, 4)]
    assert stability.polls_needed(25) == 3


def test_throttle_and_steps(spark, tmp_path):
    rows = [("j", 1, 0, "stage", 0, None, None), ("j", 2, 400, "progress", 0, 1, 4), ("j", 3, 1_000, "progress", 0, 2, 4), ("j", 4, 1_900, "stage_complete", 0, None, None), ("j", 5, 2_100, "stage", 1, None, None)]
    schema = "id string, seq bigint, at bigint, event string, stage int, current bigint, total bigint"
    stream = streamed(spark, tmp_path, rows, schema)
    assert [r.seq for r in drained(progress.throttled(stream), "throttled").orderBy("seq").collect()] == [1, 3, 5]
    last = {}
    for r in drained(progress.step_states(stream), "steps", "update").collect():
        last[r.step] = tuple(r)  # the memory sink keeps every update in order
    twin = events.step_states(spark.createDataFrame(rows, schema))
    assert sorted(last.values()) == sorted(map(tuple, twin.collect()))


def test_arriving_files_once(spark, tmp_path):
    for name in ("x.mkv", "sub/y.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("1")
    found = drained(progress.first_seen(files.arriving_files(spark, str(tmp_path))), "arriving")
    assert sorted(r.name for r in found.collect()) == ["x.mkv", "y.txt"]
    assert [r.name for r in files.media_files(spark, str(tmp_path)).collect()] == ["x.mkv"]


def test_bad_event_lines_are_kept(spark, tmp_path):
    (tmp_path / "e.ndjson").write_text('{"event":"stage","stage":1}\n{"event":"pro\n')
    got = drained(files.event_stream(spark, str(tmp_path)).select("event.*"), "lines").collect()
    assert sorted((r.event or "", r._corrupt or "") for r in got) == [("", '{"event":"pro'), ("stage", "")]


def test_metric_log(spark, tmp_path):
    rows = spark.createDataFrame([(1, 30.5, 31.0, 32.0), (0, 29.0, 28.0, 27.5)], "frame bigint, y double, u double, v double")
    files.write_metric_log(rows, str(tmp_path / "log"))
    assert sorted(map(tuple, files.metric_log(spark, str(tmp_path / "log")).collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "bad").write_text("0: 1.0 2.0 3.0\nnonsense\n")
    with pytest.raises(Exception, match="not a metric line"):
        files.metric_log(spark, str(tmp_path / "bad")).collect()


def polled_once(stream, out, checkpoint):
    """One micro-batch: a poll and what it makes ready."""
    query = sinks.written_once(stream, out, checkpoint).trigger(once=True).start()
    query.awaitTermination()
    assert query.exception() is None


def test_folder_is_polled_until_files_are_ready(spark, tmp_path):
    """A growing file, a steady one, one that vanishes and comes back; the query is stopped and started at every poll."""
    folder = tmp_path / "library" / "sub"
    folder.mkdir(parents=True)
    sizes = {"grows": [1, 2, 3, 3, 3, 3], "steady": [5] * 6, "goes": [4, 4, None, 4, 4, 4], "empty": [0] * 6}
    out, log, checkpoint = (str(tmp_path / n) for n in ("out", "log", "checkpoint"))
    for k in range(6):
        for name, xs in sizes.items():
            file = folder / f"{name} %20.mkv"
            file.unlink(missing_ok=True) if xs[k] is None else file.write_bytes(b"x" * xs[k])
        polled_once(polling.gate(polling.polls(spark, str(tmp_path / "library"), log, 0), 2, 3_600_000), out, checkpoint)
    rows = [(f"{folder}/{n} %20.mkv", k + 1, x) for n, xs in sizes.items() for k, x in enumerate(xs)]
    twin = stability.ready_files(spark.createDataFrame(rows, "path string, poll bigint, size bigint"), 2)
    got = sorted(map(tuple, sinks.read_written(spark, out).collect()))
    assert got == sorted(map(tuple, twin.collect())) and len(got) == 3
    assert len(list((tmp_path / "log").glob("*.json"))) <= 2  # listings that are worked off go


def test_gate_forgets(spark, tmp_path):
    folder = tmp_path / "library"
    folder.mkdir()
    (folder / "a.mkv").write_bytes(b"x")
    out, log, checkpoint = (str(tmp_path / n) for n in ("out", "log", "checkpoint"))
    held = lambda: spark.read.format("statestore").load(checkpoint).count()
    for _ in range(2):
        polled_once(polling.gate(polling.polls(spark, str(folder), log, 0), 1, 8_000), out, checkpoint)
    assert held() == 1 and sinks.read_written(spark, out).count() == 1
    (folder / "a.mkv").unlink()
    time.sleep(9)
    for _ in range(2):
        (folder / "b.mkv").write_bytes(b"")
        polled_once(polling.gate(polling.polls(spark, str(folder), log, 0), 1, 8_000), out, checkpoint)
        (folder / "b.mkv").unlink()
        time.sleep(1)
    polled_once(polling.gate(polling.polls(spark, str(folder), log, 0), 1, 8_000), out, checkpoint)
    time.sleep(9)
    polled_once(polling.gate(polling.polls(spark, str(folder), log, 0), 1, 8_000), out, checkpoint)
    assert held() == 0


def test_a_key_of_the_throttle_is_forgotten(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text('{"id": "a", "seq": 1, "at": 5}\n{"id": "a", "seq": 2, "at": 7}\n')
    stream = spark.readStream.schema("id string, seq bigint, at bigint").json(str(tmp_path / "in"))
    for k in (1, 2):
        polled_once(progress.throttled(stream, keep_ms=2_000), out, checkpoint)
        time.sleep(3)
        (tmp_path / "in" / f"{k}.json").write_text('{"id": "b%d", "seq": 1, "at": 5}\n' % k)
    polled_once(progress.throttled(stream, keep_ms=2_000), out, checkpoint)
    assert sorted(tuple(r) for r in sinks.read_written(spark, out).collect()) == [("a", 1, 5), ("b1", 1, 5), ("b2", 1, 5)]
    held = spark.read.format("statestore").load(checkpoint).select("key.*").collect()
    assert "a" not in {r[0] for r in held}  # forgotten with a later batch


def test_a_restarted_stream_writes_each_row_once(spark, tmp_path):
    rows = [(i, f"r{i}") for i in range(30)]
    stream = streamed(spark, tmp_path, rows, "id bigint, name string", batches=6)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    failing = {"left": 2}

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        failing["left"] -= 1
        if failing["left"] == 0:
            raise RuntimeError("stopped between the files and the commit")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    with pytest.raises(Exception, match="stopped between"):
        query.processAllAvailable()
    assert 0 < sinks.read_written(spark, out).count() < 30
    again = sinks.written_once(stream, out, checkpoint).start()
    again.processAllAvailable()
    again.stop()
    assert sorted(map(tuple, sinks.read_written(spark, out).collect())) == rows


def test_lines_out_of_chunks(spark, tmp_path):
    texts = {1: "one\ntwö\n\nfour", 2: "a\n", 3: "no end", 4: "", 5: "\n\n", 6: "漢字かな\n😀" * 4}
    rows = []
    for key, text in texts.items():
        data = text.encode()
        cut = [data[i : i + 3] for i in range(0, len(data), 3)] or [b""]
        rows += [(key, i, c, i == len(cut) - 1) for i, c in enumerate(cut)]
    want = sorted((k, i, x) for k, t in texts.items() for i, x in enumerate(t.split("\n")[:-1] if t.endswith("\n") or not t else t.split("\n")))
    chunks = spark.createDataFrame(rows, "key int, seq int, chunk binary, last boolean")
    assert sorted(map(tuple, lines.lines_of_chunks(chunks).collect())) == want
    rows.sort(key=lambda r: r[1])
    encoded = [(k, s, base64.b64encode(c).decode(), last) for k, s, c, last in rows]
    stream = streamed(spark, tmp_path, encoded, "key int, seq int, chunk string, last boolean", batches=8).withColumn("chunk", F.unbase64("chunk"))
    assert sorted(map(tuple, drained(lines.lines_as_they_end(stream), "ended_lines").collect())) == want


def test_lines_over_blocks_of_chunks(spark, monkeypatch):
    """Blocks of four chunks: lines over many of them, cut characters, gaps in the numbers, null chunks and keys, bytes that are no text."""
    monkeypatch.setattr(lines, "CHUNKS", 4)
    rng = random.Random(3)
    data = {k: "".join(rng.choice(["é", "漢", "a", "b", "😀", "\n"] + ["c"] * k) for _ in range(150)).encode() for k in range(6)}
    data |= {None: b"no key\nbut lines" * 9, 7: b"\xff\n\xfe\xfda\n\x80" * 8, 8: b"\n" * 30, 9: b"one long line" * 20}
    rows, want = [], []
    for key, text in data.items():
        at, seq = 0, rng.randint(0, 9)
        while at < len(text):
            n = rng.randint(1, 5)
            rows.append((key, seq, text[at : at + n]))
            at, seq = at + n, seq + rng.choice([1, 1, 1, 6])
        rows.append((key, seq, None))
        cut = text.split(b"\n")
        want += [(key, i, x.hex().upper()) for i, x in enumerate(cut if cut[-1] else cut[:-1])]
    rng.shuffle(rows)
    got = lines.lines_of_chunks(spark.createDataFrame(rows, "key int, seq int, chunk binary").repartition(5)).withColumn("value", F.hex("value")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def ivf(frames, tail=b""):
    head = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, b"AV01", 640, 360, 30, 1, len(frames), 0)
    return head + b"".join(struct.pack("<IQ", len(x), t) + x for t, x in enumerate(frames)) + tail


def test_containers(spark, tmp_path):
    folder = tmp_path / "c d"
    folder.mkdir()
    (folder / "a.ivf").write_bytes(ivf([b"one", b"three"], struct.pack("<IQ", 99, 7) + b"cut"))
    large = [bytes([i % 251]) * (i * 37 % 5_000) for i in range(400)]
    (folder / "b.ivf").write_bytes(ivf(large))
    (folder / "short.ivf").write_bytes(b"DKIF")
    (folder / "none.ivf").write_bytes(ivf([]))
    heads = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.frames) for r in containers.container_headers(spark, str(folder)).collect()}
    assert heads == {"a.ivf": (640, 360, 2), "b.ivf": (640, 360, 400), "none.ivf": (640, 360, 0)}
    got = containers.container_frames(spark, str(folder), 100_000).withColumn("task", F.spark_partition_id()).collect()
    by = {n: sorted((r.frame, r.time, bytes(r.data)) for r in got if r.path.endswith(n)) for n in ("a.ivf", "b.ivf")}
    assert by["a.ivf"] == [(0, 0, b"one"), (1, 1, b"three")]
    assert by["b.ivf"] == [(i, i, x) for i, x in enumerate(large)]
    assert len({r.task for r in got if r.path.endswith("b.ivf")}) > 1


def test_headers_alone_are_read():
    data = ivf([bytes(200_000)] * 5)
    asked = []

    def read(at, size):
        asked.append(size)
        return data[at : at + size]

    assert [n for _, n, _ in containers.walked(read, len(data))] == [200_000] * 5
    assert sum(asked) == 5 * containers.FRAME_HEADER


def test_scene_file_and_config(spark, tmp_path):
    (tmp_path / "s.txt").write_text("True\n0\n48\n100\n240\n1920\n1080\n24\n1\n")
    row = files.scene_file(spark, str(tmp_path / "s.txt")).first()
    assert (row.high_resolution, row.keyframes, row.nframe, row.fps_den) == (True, [0, 48, 100], 240, 1)
    made = config.load({"AUDIO_BITRATE_5_1": "300k", "AUDIO_BITRATE_MONO": "0", "LIBRARY_DIRS": " a, ,b "})
    assert (made.bitrates["5.1"], made.bitrates["mono"], made.library_dirs, made.quality) == (300, 64, ("a", "b"), "medium")


def test_path_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.mkv", "sub/b.mkv"):
        (tmp_path / name).write_text("1")
    names = lambda p: sorted(r.name for r in files.path_listing(spark, str(p)).collect())
    assert names(tmp_path) == ["a.mkv", "b.mkv"] and names(tmp_path / "a.mkv") == ["a.mkv"] and names(tmp_path / "none") == []
    live = spark.createDataFrame([], "input_path string")
    counts = lambda p: tuple(files.path_counts(spark, str(p), live, "org").first())
    (tmp_path / "x-org.mkv").write_text("1")
    (tmp_path / "y.txt").write_text("1")
    assert counts(tmp_path) == (2, 0, 1) and counts(tmp_path / "a.mkv") == (1, 0, 0)
    assert counts(tmp_path / "y.txt") == counts(tmp_path / "none") == (0, 0, 0)


def test_scene_and_zone_writers(spark, tmp_path):
    row = (1, True, [0, 48], 240, 1920, 1080, 24, 1)
    rows = spark.createDataFrame([row], "video int, high_resolution boolean, keyframes array<bigint>, nframe int, width int, height int, fps_num int, fps_den int")
    files.write_scene_files(rows, str(tmp_path / "scenes"))
    assert tuple(files.scene_file(spark, str(tmp_path / "scenes/video=1")).first())[1:] == row[1:]
    zones = spark.createDataFrame([(1, 0, 9, 30.0), (1, 10, 50, 25.0), (2, 0, 5, 20.0)], "video int, start bigint, end_incl bigint, crf double")
    files.write_offset_zones(zones, 20, str(tmp_path / "zones"))
    assert sorted(p.name for p in (tmp_path / "zones").glob("video=*")) == ["video=1"]
    assert files.zone_texts(spark, str(tmp_path / "zones/video=1")).first().text.strip() == "Zones : 0,30,25.0;"


def test_event_lines(spark, tmp_path):
    files.write_events(spark.createDataFrame([("stage", 1)], "event string, stage int"), str(tmp_path / "e"))
    assert files.event_stream(spark, str(tmp_path / "e")).isStreaming
    assert spark.read.text(str(tmp_path / "e")).first()[0] == '{"event":"stage","stage":1}'


def test_tag_document(spark):
    import xml.etree.ElementTree as ET

    made = spark.createDataFrame([({"b": "x < y", "a": "1"},)], "tags map<string,string>").select(files.tag_document(F.col("tags"))).first()[0]
    assert [(s.find("Name").text, s.find("String").text) for s in ET.fromstring(made.encode()).iter("Simple")] == [("a", "1"), ("b", "x < y")]
