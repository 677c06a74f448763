"""Data sources over binary files: recordings read by byte range, or as they grow, and files written at job commit.

``pcm_frames`` reads folders of 16-bit mono recordings as (path, frame_no, rms, peak).
In batch a file is as many partitions as it has stretches of ``split_bytes``, so
a long recording is many tasks.  As a stream its offset is the size of each file
when last looked at; a batch holds the frames that were completed since.
Partitions are counted in frames and each task finds the samples by the file's
head, so the driver reads sizes only.  Short stretches share a task, so that many
small files are some hundred tasks, not one each.

``whole_files`` writes (name, content) as files: tasks write side files, the job's
commit renames them, an abort removes them, those of lost tasks too.  What a task wrote
is on the disk before it reports, all its files at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .. import storage
from .files import wav_data_offset

FRAMES = "path string, frame_no long, rms double, peak double"
HEAD = 4096
#: Tasks that short stretches are dealt to, what opening a file counts as, and the most that stretches of one task count as, in bytes.
TASKS, OPENING, TASK_BYTES = 256, 64 << 10, 256 << 20
#: Rows of a batch, but for those of the last stretch in it.
ROWS = 8192


@dataclass
class Stretch(InputPartition):
    """Frames [first, last) of a file that counts as ``size`` bytes long; a last frame of fewer samples too, if ``torn``."""

    uri: str
    first: int
    last: int
    size: int
    torn: bool


@dataclass
class Share(InputPartition):
    """Stretches that one task reads, one after the other."""

    stretches: list[Stretch]


def shares(stretches: list[Stretch], frame: int) -> list[Share]:
    """Neighbouring stretches together, up to a TASKS-th of all or TASK_BYTES."""
    costs = [OPENING + min(p.size, 2 * frame * (p.last - p.first)) for p in stretches]
    most, out, at = min(TASK_BYTES, sum(costs) / TASKS), [], 0
    for p, cost in zip(stretches, costs):
        if not out or at + cost > most:
            out.append(Share([]))
            at = 0
        out[-1].stretches.append(p)
        at += cost
    return out


class Options:
    def __init__(self, options: dict[str, str]):
        self.path, self.frame, self.split = options["path"], int(options.get("frame", 1600)), int(options.get("split_bytes", 32 << 20))
        self.suffix = options.get("suffix", "")

    def stretches(self, uri: str, first: int, size: int, torn: bool) -> list[Stretch]:
        """The file's frames from ``first`` on; there can't be more than fit its size."""
        step, end = max(1, self.split // (2 * self.frame)), size // (2 * self.frame) + 1
        return [Stretch(uri, at, min(end, at + step), size, torn) for at in range(first, end, step)]


def pieces(o: Options, p: Stretch, piece: int = 4096) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """(URI, first frame, rms, peak) of a stretch, some frames at a time."""
    with storage.open_input(p.uri) as f:
        start = wav_data_offset(f.read(min(HEAD, p.size)))
        width = 2 * o.frame
        for first in range(p.first, p.last, piece):
            at = start + first * width
            length = min(start + min(p.last, first + piece) * width, p.size) - at
            whole, rest = divmod(length // 2, o.frame) if length > 0 else (0, 0)
            count = whole * o.frame + (rest if p.torn else 0)
            if count <= 0:
                return
            f.seek(at)
            x = (np.frombuffer(f.read(2 * count), "<i2").astype(np.float32) / 32768.0).astype(float)
            parts = [v for v in (x[: whole * o.frame].reshape(whole, o.frame), x[None, whole * o.frame :]) if v.size]
            yield p.uri, first, np.concatenate([np.sqrt(np.mean(v**2, axis=1)) for v in parts]), np.concatenate([np.max(np.abs(v), axis=1) for v in parts])


def levels(o: Options, stretches: Iterable[Stretch]) -> Iterator[pa.RecordBatch]:
    """(path, frame_no, rms, peak) of stretches, some thousand rows at a time."""
    held, rows = [], 0

    def batch() -> pa.RecordBatch:
        uris, firsts, rms, peak = zip(*held)
        counts = [len(v) for v in rms]
        path = pa.array(uris, "string").take(pa.array(np.repeat(np.arange(len(uris)), counts)))
        frame_no = np.concatenate([np.arange(first, first + n, dtype="int64") for first, n in zip(firsts, counts)])
        return pa.RecordBatch.from_arrays([path, pa.array(frame_no), pa.array(np.concatenate(rms)), pa.array(np.concatenate(peak))], ["path", "frame_no", "rms", "peak"])

    for p in stretches:
        for piece in pieces(o, p):
            held.append(piece)
            rows += len(piece[2])
            if rows >= ROWS:
                yield batch()
                held, rows = [], 0
    if held:
        yield batch()


class PcmReader(DataSourceReader):
    def __init__(self, options: Options):
        self.o = options

    def partitions(self) -> list[Share]:
        found = [p for uri, size in storage.sizes(self.o.path, self.o.suffix).items() for p in self.o.stretches(uri, 0, size, True)]
        return shares(found, self.o.frame) or [Share([])]

    def read(self, p: Share) -> Iterator[pa.RecordBatch]:
        return levels(self.o, p.stretches)


class PcmStreamReader(DataSourceStreamReader):
    """Only whole frames are given out; the rest of a file waits for what completes it."""

    def __init__(self, options: Options):
        self.o = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Sizes by name: the folder is the same for all."""
        return {uri.rsplit("/", 1)[1]: size for uri, size in storage.sizes(self.o.path, self.o.suffix).items()}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        out = []
        start, end = ({uri.rsplit("/", 1)[-1]: size for uri, size in x.items()} for x in (start, end))  # offsets of older checkpoints are by URI
        for name, size in end.items():
            if size > (seen := start.get(name, 0)):
                uri = f"{self.o.path.rstrip('/')}/{name}"
                # The head is shorter than HEAD, so frames before this one were complete; the task leaves out those that were too.
                first = max(0, (seen - HEAD - 8) // (2 * self.o.frame))
                out += [Grown(p.uri, p.first, p.last, p.size, False, seen) for p in self.o.stretches(uri, first, size, False)]
        return shares(out, self.o.frame)

    def new(self, p: Grown) -> Stretch:
        """The stretch without the frames that were complete when its file was seen last."""
        known = 0
        if p.seen:
            with storage.open_input(p.uri) as f:
                known = max(0, p.seen - wav_data_offset(f.read(min(HEAD, p.seen)))) // (2 * self.o.frame)
        return replace(p, first=max(p.first, known))

    def read(self, p: Share) -> Iterator[pa.RecordBatch]:
        return levels(self.o, map(self.new, p.stretches))

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Grown(Stretch):
    seen: int


class PcmFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> PcmReader:
        return PcmReader(Options(self.options))

    def streamReader(self, schema) -> PcmStreamReader:
        return PcmStreamReader(Options(self.options))


@dataclass
class Written(WriterCommitMessage):
    """Names of files; the side file of each is called as the task and its number."""

    task: str
    names: list[str]


class FilesWriter(DataSourceWriter):
    """Made once a job, which has a hidden folder for its side files: without that folder a task that outlives its job can't write."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.side = f"{self.folder}/.job-{uuid.uuid4().hex}"
        storage.make_folder(self.side)

    def write(self, rows: Iterator) -> Written:
        done = Written(uuid.uuid4().hex, [])
        for r in rows:
            storage.write_new(f"{self.side}/{done.task}-{len(done.names)}", bytes(r["content"] or b""), settled=False)
            done.names.append(r["name"])
        storage.settle(self.side)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            for k, name in enumerate(m.names):
                storage.rename(f"{self.side}/{m.task}-{k}", f"{self.folder}/{name}")
        storage.remove_folder(self.side)

    def abort(self, messages: list[Written | None]) -> None:
        storage.remove_folder(self.side)


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (PcmFrames, WholeFiles):
        spark.dataSource.register(source)


def recorded_frames(spark: SparkSession, folder: str, frame: int = 1600, split_bytes: int = 32 << 20) -> DataFrame:
    """(path, frame_no, rms, peak) of every recording in a folder."""
    register(spark)
    return spark.read.format("pcm_frames").options(path=folder, frame=frame, split_bytes=split_bytes).load()


def growing_frames(spark: SparkSession, folder: str, frame: int = 1600, split_bytes: int = 32 << 20) -> DataFrame:
    """The same as a stream: the frames that recordings have gained since the last batch."""
    register(spark)
    return spark.readStream.format("pcm_frames").options(path=folder, frame=frame, split_bytes=split_bytes).load()


def write_files(files: DataFrame, folder: str) -> None:
    """Files (name, content) into a folder, all at the job's commit or none; those there already are replaced."""
    register(files.sparkSession)
    files.select("name", "content").write.format("whole_files").option("path", folder).mode("append").save()
