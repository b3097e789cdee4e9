"""Captures: files of reports that lie one behind the other, read in several tasks, as a stream while they grow, and written so
that each report is there once.

A file is cut into splits, and a split's reports are those that start in it. A task finds them by steps from a report before
its split: from a fingerprint some way back at which CHECKS reports follow each other by the lengths in their headers, so that
bytes in a payload that look like a report are passed by. (A payload that holds so many whole reports in a row would be taken
for them.) What is no report, after a damage, comes as rows without a probe_id, up to where RESUME reports follow each other.

As a stream, offsets are bytes of each file, up to the end of its last whole report, which is found from the file's end.

The sink writes each task's reports to a file of its own attempt and publishes, at the commit, one manifest that lists the
files of the committed attempts; a streaming batch's manifest bears its number, and a batch that is replayed changes
nothing. Reading with the option `committed` follows the manifests, so that files of lost attempts do not count.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from causeway.sources.wire import CLOCK_BYTES, FINGERPRINT, HEADER_BYTES, WORD_BYTES, with_header, with_payload

NAME = "trace_capture"
SCHEMA = "path string, offset long, probe_id long, content binary"
MAGIC = FINGERPRINT.to_bytes(4, "little")
SPLIT_BYTES, WINDOW, LEAST = 32 << 20, 1 << 20, 4 << 10
#: Reports that must follow each other where reading begins amid a file, and where it goes on behind a damage.
CHECKS, RESUME = 8, 2
MANIFESTS = "_manifests"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


class Bytes:
    """Random access to a file through one window."""

    def __init__(self, file, size: int, window: int = WINDOW):
        self.file, self.size, self.at, self.held, self.window = file, size, 0, b"", window

    def get(self, at: int, n: int) -> bytes:
        n = max(min(n, self.size - at), 0)
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(min(max(n, self.window), self.size - at), at) if n else b""
        return self.held[at - self.at : at - self.at + n]

    def report_at(self, at: int) -> int | None:
        """Bytes of the report that starts here; None if none does."""
        head = self.get(at, HEADER_BYTES)
        if len(head) < HEADER_BYTES or head[:4] != MAGIC:
            return None
        clocks, words = struct.unpack_from("<HI", head, 27)
        return HEADER_BYTES + clocks * CLOCK_BYTES + words * WORD_BYTES

    def follows(self, at: int, checks: int) -> bool:
        """So many whole reports follow each other from here on, or as many as the file has."""
        for n in range(checks):
            if at == self.size:
                return n > 0
            size = self.report_at(at)
            if size is None:
                return False
            if at + size > self.size:
                return n > 0
            at += size
        return True

    def border(self, at: int, checks: int = RESUME) -> int:
        """The first report at or after a place; the end if there is none."""
        while at < self.size:
            found = self.get(at, self.window).find(MAGIC)
            if found < 0:
                at += max(min(self.window, self.size - at) - 3, 1)
            elif self.follows(at + found, checks):
                return at + found
            else:
                at += found + 1
        return self.size

    def step(self, at: int) -> tuple[int, bool]:
        """(where the report here ends, or what is no report; whether it is one)."""
        size = self.report_at(at)
        return (at + size, True) if size is not None and at + size <= self.size else (self.border(at + 1), False)

    def synced(self, place: int, least: int = 0) -> int:
        """Where the first report, or stretch without one, begins at or after a place: by the steps from a report before it."""
        back = self.window
        while True:
            at = max(place - back, least)
            at = at if at == least else self.border(at, CHECKS)
            if at == least or at < place:
                break
            back *= 8
        while at < place:
            at, _ = self.step(at)
        return at

    def whole_end(self) -> int:
        """The end of the last whole report."""
        at = end = self.synced(max(self.size - WINDOW, 0))
        while at < self.size:
            at, whole = self.step(at)
            end = at if whole or at < self.size else end
        return end

    def rows(self, start: int, stop: int, probes: set[int] | None, aligned: bool) -> Iterator[tuple[int, int | None, bytes]]:
        """(offset, probe_id, content) of the reports that start from start on and before stop."""
        at = start if aligned else self.synced(start)
        while at < stop:
            end, whole = self.step(at)
            if whole:
                (probe,) = struct.unpack_from("<I", self.get(at, 8), 4)
                if probes is None or probe in probes:
                    yield at, probe, self.get(at, end - at)
            elif probes is None:
                for part in range(at, end, WINDOW):
                    yield part, None, self.get(part, min(end - part, WINDOW))
            at = end


@dataclass
class Split(InputPartition):
    path: str
    start: int
    stop: int
    size: int
    aligned: bool


def _files(folder: str, committed: bool) -> list[tuple[str, int]]:
    """(path, bytes) of the capture files under a folder, or of one file."""
    from pyarrow import fs

    system, root = _open(folder)
    if system.get_file_info(root).type == fs.FileType.File:
        return [(folder, system.get_file_info(root).size)]
    if committed:
        at = posixpath.join(root, MANIFESTS)
        names = set()
        for info in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if info.path.endswith(".json"):
                with system.open_input_stream(info.path) as f:
                    names.update(json.loads(f.read()))
        infos = system.get_file_info([posixpath.join(root, n) for n in sorted(names)])
    else:
        infos = [i for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.File and not posixpath.basename(i.path).startswith(("_", "."))]
    return sorted((f"{folder.rstrip('/')}/{posixpath.basename(i.path)}", i.size) for i in infos)


def _splits(path: str, start: int, stop: int, size: int, each: int) -> list[Split]:
    return [Split(path, at, min(at + each, stop), size, at == start) for at in range(start, stop, each)]


class _Rows:
    """What batch and stream readers share."""

    probes: set[int] | None = None

    def _setup(self, options) -> None:
        self.folder, self.each = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.committed = str(options.get("committed", "false")).lower() == "true"

    def read(self, partition: Split):
        if partition.start >= partition.stop:
            return
        system, at = _open(partition.path)
        with system.open_input_file(at) as file:
            # What is read ahead of a split is as long as one, so that small splits do not read a file many times over.
            window = min(max(self.each, LEAST), WINDOW)
            for offset, probe, content in Bytes(file, partition.size, window).rows(partition.start, partition.stop, self.probes, partition.aligned):
                yield partition.path, offset, probe, content


class CaptureReader(_Rows, DataSourceReader):
    def __init__(self, options):
        self._setup(options)

    def pushFilters(self, filters):
        """Equality of probe_id, or a list of them, is looked up in headers; payloads of others are not passed on."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("probe_id",):
                self.probes = {f.value} if self.probes is None else self.probes & {f.value}
            elif isinstance(f, In) and f.attribute == ("probe_id",):
                self.probes = set(f.value) if self.probes is None else self.probes & set(f.value)
            else:
                yield f

    def partitions(self):
        every = [s for path, size in _files(self.folder, self.committed) for s in _splits(path, 0, size, size, self.each)]
        return every or [Split(self.folder, 0, 0, 0, True)]  # without one Spark would ask for all at once


class CaptureStream(_Rows, DataSourceStreamReader):
    def __init__(self, options):
        self._setup(options)

    def initialOffset(self):
        return {}

    def latestOffset(self):
        out = {}
        for path, size in _files(self.folder, self.committed):
            system, at = _open(path)
            with system.open_input_file(at) as file:
                out[path] = Bytes(file, size).whole_end()
        return out

    def partitions(self, start, end):
        return [s for path, stop in sorted(end.items()) for s in _splits(path, start.get(path, 0), stop, stop, self.each)]


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class _Sink:
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def _write(self, iterator) -> Written:
        task = TaskContext.get()
        system, root = _open(self.folder)
        system.create_dir(root, recursive=True)
        name, out = f"reports-{self.job}-{task.partitionId():05d}-{task.taskAttemptId()}", None
        for row in iterator:
            if row["content"] is not None:
                out = out or system.open_output_stream(posixpath.join(root, name), compression=None)
                out.write(bytes(row["content"]))
        if out is not None:
            out.close()
        return Written(name if out is not None else None)

    def _publish(self, messages, number: str) -> None:
        """The manifest appears whole, by a rename; one that is there already stays."""
        from pyarrow import fs

        system, root = _open(self.folder)
        at = posixpath.join(root, MANIFESTS)
        system.create_dir(at, recursive=True)
        target = posixpath.join(at, f"{number}.json")
        if system.get_file_info(target).type == fs.FileType.File:
            return
        with system.open_output_stream(posixpath.join(at, f".{self.job}"), compression=None) as f:
            f.write(json.dumps(sorted(m.name for m in messages if m is not None and m.name)).encode())
        system.move(posixpath.join(at, f".{self.job}"), target)


class CaptureWriter(_Sink, DataSourceWriter):
    def write(self, iterator):
        return self._write(iterator)

    def commit(self, messages):
        self._publish(messages, self.job)

    def abort(self, messages):
        """Files of attempts are in no manifest."""


class CaptureStreamWriter(_Sink, DataSourceStreamWriter):
    def write(self, iterator):
        return self._write(iterator)

    def commit(self, messages, batchId):
        self._publish(messages, f"batch-{batchId}")

    def abort(self, messages, batchId):
        """Files of attempts are in no manifest."""


class CaptureSource(DataSource):
    """Options: path, splitBytes, committed."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CaptureReader(self.options)

    def streamReader(self, schema):
        return CaptureStream(self.options)

    def writer(self, schema, overwrite):
        return CaptureWriter(self.options["path"])

    def streamWriter(self, schema, overwrite):
        return CaptureStreamWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_capture(spark: SparkSession, path: str, committed: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, offset, probe_id, content) of the reports in the files under a folder, or in one file."""
    register(spark)
    return spark.read.format(NAME).option("committed", committed).option("splitBytes", split_bytes).load(path)


def stream_capture(spark: SparkSession, path: str, committed: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """read_capture as a stream of files that come and grow."""
    register(spark)
    return spark.readStream.format(NAME).option("committed", committed).option("splitBytes", split_bytes).load(path)


def keyed(reports: DataFrame) -> DataFrame:
    """reports (content) without those that have the key (probe_id, epoch, seq_num) of another one; damaged ones stay."""
    rows = with_header(reports.select("content").where("content is not null")).withColumn("epoch", F.shiftright("clock_word", 16))
    # A damaged one's key is its own, so that one pass keeps all of them.
    rows = rows.withColumn("damaged", F.when(F.col("error").isNotNull(), F.monotonically_increasing_id()))
    return rows.dropDuplicates(["probe_id", "epoch", "seq_num", "damaged"]).select("content")


def write_capture(reports: DataFrame, path: str) -> None:
    """Writes reports (content) under a folder, each key once; files are listed by one manifest."""
    register(reports.sparkSession)
    keyed(reports).write.format(NAME).mode("append").save(path)


def decoded(capture: DataFrame) -> DataFrame:
    """capture rows with header, error, frontier and words."""
    return with_payload(with_header(capture.drop("probe_id")))
