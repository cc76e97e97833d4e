"""IVF containers by byte ranges: no task holds a whole file, and what is not asked for is not read."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytes import store_of
from .files import listing

#: Sizes of the container's file and frame headers in bytes.
FILE_HEADER, FRAME_HEADER = 32, 12
#: Bytes of a file whose frames are one task's, at least, and bytes that are asked for at once.
RANGE_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: Bytes that are read at once when frames are small and their headers close together.
STEP_BYTES = 64 << 10
_HEADER = "path string, width int, height int, frames bigint"
_INDEX = "path string, frame bigint, offset bigint, size bigint, time bigint"
_FRAMES = "path string, frame bigint, time bigint, data binary"
#: Rows of an index batch.
ROWS = 10_000


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _read(uri: str) -> Callable[[int, int], bytes]:
    """A function (offset, size) that reads a file; at its end it gives less."""
    store, path = store_of(uri)
    file = store.open_input_file(path)
    return lambda at, size: file.read_at(size, at)


def container_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, frames) of each container: 32 bytes of a file are read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri in batch.column(0).to_pylist():
                head = _read(uri)(0, FILE_HEADER)
                if len(head) == FILE_HEADER:
                    rows.append((uri, *struct.unpack_from("<HH", head, 12), *struct.unpack_from("<I", head, 24)))
            yield _batch(rows, ["path", "width", "height", "frames"], [pa.string(), pa.int32(), pa.int32(), pa.int64()])

    return listing(spark, path).filter(F.col("size") >= FILE_HEADER).select("path").mapInArrow(run, _HEADER)


def walked(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int, int, int]]:
    """(offset of the data, its size, time) of each whole frame of a file of ``size`` bytes, from the frames' headers alone."""
    at, window, start = FILE_HEADER, b"", 0
    while at + FRAME_HEADER <= size:
        if not start <= at <= start + len(window) - FRAME_HEADER:
            window, start = read(at, STEP_BYTES if window and at - start < 2 * STEP_BYTES else FRAME_HEADER), at
        n, time = struct.unpack_from("<IQ", window, at - start)
        if at + FRAME_HEADER + n > size:
            return
        yield at + FRAME_HEADER, n, time
        at += FRAME_HEADER + n


def frame_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, offset, size, time): where the frames of each container are.  A frame that is cut short ends its file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), *[pa.int64()] * 4]
        for batch in batches:
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for frame, place in enumerate(walked(_read(uri), size)):
                    rows.append((uri, frame, *place))
                    if len(rows) == ROWS:
                        yield _batch(rows, ["path", "frame", "offset", "size", "time"], types)
                        rows = []
                yield _batch(rows, ["path", "frame", "offset", "size", "time"], types)

    return listing(spark, path).select("path", "size").mapInArrow(run, _INDEX)


def _runs(rows: list[tuple], most: int) -> Iterator[list[tuple]]:
    """Rows (path, frame, offset, size, time) in runs of neighbours that ``most`` bytes hold, or of one."""
    run: list[tuple] = []
    for row in rows:
        if run and (row[0] != run[-1][0] or row[2] != run[-1][2] + run[-1][3] + FRAME_HEADER or row[2] + row[3] - run[0][2] > most):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def container_frames(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, frame, time, data) of each whole frame.

    The index is dealt out by ranges of ``range_bytes`` of each file, so that the frames of one file come from several tasks, and
    neighbours are read with one call.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("path", "frame", "offset", "size", "time")), strict=True))
            for near in _runs(rows, READ_BYTES):
                first, last = near[0], near[-1]
                data = _read(first[0])(first[2], last[2] + last[3] - first[2])
                found = [(p, frame, time, data[at - first[2] : at - first[2] + n]) for p, frame, at, n, time in near]
                yield _batch(found, ["path", "frame", "time", "data"], types)

    index = frame_index(spark, path).withColumn("range", F.floor(F.col("offset") / range_bytes))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(parts, "path", "range").sortWithinPartitions("path", "offset").drop("range").mapInArrow(run, _FRAMES)
