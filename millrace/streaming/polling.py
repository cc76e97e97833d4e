"""A folder polled again and again, as a streaming source, and the gate that waits until a file's size is steady."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.bytes import store_of

#: Files of a poll that one task reads.
SLICE = 10_000
_SCHEMA = "path string, poll bigint, size bigint"


@dataclass
class Slice(InputPartition):
    """Rows ``first`` to ``stop`` of a poll."""

    poll: int
    first: int
    stop: int


class _Log:
    """The listings of polls, one file each, so that a batch that is run again reads what it read before."""

    def __init__(self, uri: str) -> None:
        self.store, self.base = store_of(uri.rstrip("/"))
        self.store.create_dir(self.base, recursive=True)

    def _path(self, poll: int) -> str:
        return f"{self.base}/{poll:012d}.json"

    def polls(self) -> list[int]:
        found = self.store.get_file_info(fs.FileSelector(self.base))
        return sorted(int(f.base_name[:12]) for f in found if f.base_name.endswith(".json"))

    def write(self, poll: int, rows: list[tuple[str, int | None]]) -> None:
        draft = self._path(poll) + ".draft"
        with self.store.open_output_stream(draft) as out:
            out.write(json.dumps({"at": time.time(), "rows": rows}).encode())
        self.store.move(draft, self._path(poll))

    def read(self, poll: int) -> dict:
        with self.store.open_input_stream(self._path(poll)) as file:
            return json.loads(file.read())

    def delete_before(self, poll: int) -> None:
        for old in self.polls():
            if old < poll:
                self.store.delete_file(self._path(old))


class FolderPollReader(DataSourceStreamReader):
    """The offset is the number of the last poll; asking for the latest one makes a new poll if it is time."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.log_uri = options["path"], options["log"]
        self.seconds = float(options.get("seconds", "10"))
        self.log = _Log(self.log_uri)

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        polls = self.log.polls()
        last = polls[-1] if polls else 0
        before = self.log.read(last) if polls else {"at": 0.0, "rows": []}
        if polls and time.time() - before["at"] < self.seconds:
            return {"poll": last}
        store, base = store_of(self.folder)
        listed = store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
        sizes = {f.path: f.size for f in listed if f.type == fs.FileType.File}
        gone = [p for p, size in before["rows"] if size is not None and p not in sizes]
        self.log.write(last + 1, [*sizes.items(), *((p, None) for p in gone)])
        return {"poll": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        found = []
        for poll in range(start["poll"] + 1, end["poll"] + 1):
            n = len(self.log.read(poll)["rows"])
            found += [Slice(poll, at, min(n, at + SLICE)) for at in range(0, n, SLICE)]
        return found

    def read(self, partition: Slice) -> Iterator[tuple]:
        rows = _Log(self.log_uri).read(partition.poll)["rows"]
        for path, size in rows[partition.first : partition.stop]:
            yield path, partition.poll, size

    def commit(self, end: dict) -> None:
        self.log.delete_before(end["poll"])  # the last poll stays: the next one is compared with it

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "log"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.log = _Log(self.log_uri)


class FolderPolls(DataSource):
    """``path`` is polled every ``seconds``; ``log`` is a folder that keeps the listings of polls that are not yet worked off."""

    @classmethod
    def name(cls) -> str:
        return "folder_polls"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema: object) -> FolderPollReader:
        return FolderPollReader(dict(self.options))


def polls(spark: SparkSession, folder: str, log: str, seconds: float = 10) -> DataFrame:
    """A stream of (path, poll, size): every file of ``folder`` at every poll, and once with a null size when it has vanished."""
    spark.dataSource.register(FolderPolls)
    return spark.readStream.format("folder_polls").options(path=folder, log=log, seconds=str(seconds)).load()


def gate(rows: DataFrame, needed: int, keep_ms: int) -> DataFrame:
    """(path, poll, size) of each file when it is ready, once, from a stream of polls; the batch twin is ``stability.ready_files``.

    What is known of a path is forgotten when it vanishes before it is ready, and by a timer ``keep_ms`` after its last poll in any case, so the
    state is bounded by the files that are there.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        size, stable, done = state.get if state.exists else (-1, 0, False)
        vanished = False
        for poll, now in pd.concat(list(batches)).sort_values("poll")[["poll", "size"]].itertuples(index=False):
            vanished = pd.isna(now)
            if vanished:
                size, stable = -1, 0
                continue
            stable = stable + 1 if now == size else 0
            size = int(now)
            if not done and stable >= needed and size > 0:
                done = True
                yield pd.DataFrame({"path": [key[0]], "poll": [int(poll)], "size": [size]})
        if vanished and not done:
            state.remove()
        else:
            state.update((size, stable, done))
            state.setTimeoutDuration(keep_ms)

    return rows.groupBy("path").applyInPandasWithState(step, _SCHEMA, "size bigint, stable bigint, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
