"""Headerless files of 16-bit little-endian samples as a Spark data source, one row per (file, frame).

A file is a flat run of whole frames. The reader plans byte ranges of whole frames, so one very large
file is read by many tasks, and many small ones by one; each task yields Arrow batches of a few megabytes. The writer commits: tasks write
under names of their own, and only when all have ended are the files named and entered in the folder's index, which the reader then
goes by. Frames of a file need not follow each other; numbers of one with gaps stand in a small file beside it.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)

from framekit.dims import STANDARDS

FIRST = re.compile(r"first=(\d+)[^/]*$")
SCHEMA = "path string, frame_id bigint, samples array<smallint>"
# Sample rates of the encodings that are not at four times the subcarrier.
RAW_RATES = {"RAW_S16_28M": 28000000.0, "RAW_S16_40M": 40000000.0}
TASK_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
#: What opening one more file counts as when small ranges are put together.
OPEN_BYTES = 1 << 20
INDEX, NUMBERS = "_index.json", "_numbers-"


def frame_samples(standard: str, encoding: str) -> int:
    """Samples per frame of an encoding."""
    values = STANDARDS[standard]
    if encoding in RAW_RATES:
        return math.floor(RAW_RATES[encoding] / values["frame_rate"] + 0.5)
    return int(values["samples_per_frame"])


@dataclass
class FrameRanges(InputPartition):
    """Ranges of files: path, first frame in the file, count, whether frame numbers stand beside it."""

    ranges: list[tuple[str, int, int, bool]]


def packed(items: Sequence, sizes: Sequence[int], most: int, each: int) -> list[list]:
    """Items in order, put together while their sizes, and ``each`` for every one, stay within ``most``."""
    groups: list[list] = []
    held = most + 1
    for item, size in zip(items, sizes, strict=True):
        if held + size + each > most:
            groups.append([])
            held = 0
        groups[-1].append(item)
        held += size + each
    return groups


def files_below(paths: Sequence[str], suffix: str) -> Iterator[tuple[str, int]]:
    """Files of given names or below given folders: path and size; names that begin with ``_`` or a dot are left out."""
    from pyarrow import fs

    for path in paths:
        system, root = fs.FileSystem.from_uri(path)
        info = system.get_file_info(root)
        entries = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        scheme = path[: len(path) - len(root)] if path.endswith(root) else path.split("://")[0] + "://"
        for entry in entries:
            name = entry.path.rsplit("/", 1)[-1]
            if entry.type == fs.FileType.File and not name.startswith(("_", ".")) and name.endswith(suffix):
                yield scheme + entry.path, entry.size


def read_index(folder: str) -> dict[str, dict]:
    """The files that writers have committed to a folder, by name; empty where there is no index."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    if system.get_file_info(f"{root}/{INDEX}").type != fs.FileType.File:
        return {}
    with system.open_input_file(f"{root}/{INDEX}") as file:
        return {entry["file"]: entry for entry in json.loads(file.read())}


def qualified(spark: SparkSession, path: str) -> str:
    """The path on the session's default file system, if it names none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return re.sub(r"^file:/+", "file:///", full)


def first_frame(path: str) -> int:
    """The number of a file's first frame, from its name; 0 where the name has none."""
    found = FIRST.search(path)
    return int(found[1]) if found else 0


class RawFrameReader(DataSourceReader):
    """Frames of files in byte ranges. Wanted paths and bounds of ``frame_id`` keep files and ranges from being planned."""

    def __init__(self, options: dict[str, str]):
        self.paths = options["path"].split(",")
        n = int(options["framesamples"]) if "framesamples" in options else frame_samples(options["standard"], options["encoding"])
        self.frame_bytes = 2 * n
        self.suffix = options.get("suffix", "")
        self.only: set[str] | None = None
        self.low, self.high = 0, 1 << 62

    def partitions(self) -> list[InputPartition]:
        per_task = max(1, TASK_BYTES // self.frame_bytes)
        indexes: dict[str, dict[str, dict]] = {}
        ranges: list[tuple[str, int, int, bool]] = []
        for path, size in sorted(files_below(self.paths, self.suffix)):
            if self.only is not None and path not in self.only:
                continue
            folder, name = path.rsplit("/", 1)
            if folder not in indexes:
                indexes[folder] = read_index(folder)
            entry = indexes[folder].get(name)
            if indexes[folder] and entry is None:
                continue  # not committed
            if size % self.frame_bytes:
                raise ValueError(f"{path}: size {size} is not a multiple of the frame size {self.frame_bytes}")
            start, gaps = first_frame(path), bool(entry and entry["gaps"])
            if gaps and (entry["last_frame"] < self.low or entry["first_frame"] >= self.high):
                continue
            low, high = (0, size // self.frame_bytes) if gaps else (max(0, self.low - start), min(size // self.frame_bytes, self.high - start))
            ranges += [(path, first, min(per_task, high - first), gaps) for first in range(low, high, per_task)]
        return self.tasks(ranges)

    def tasks(self, ranges: list[tuple[str, int, int, bool]]) -> list[InputPartition]:
        return [FrameRanges(group) for group in packed(ranges, [r[2] * self.frame_bytes for r in ranges], TASK_BYTES, OPEN_BYTES)] or [FrameRanges([])]

    def read(self, partition: FrameRanges):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        n = self.frame_bytes // 2
        step = max(1, BATCH_BYTES // self.frame_bytes)
        for path, begin, count, gaps in partition.ranges:
            system, root = fs.FileSystem.from_uri(path)
            if gaps:
                folder, name = root.rsplit("/", 1)
                with system.open_input_file(f"{folder}/{NUMBERS}{name}") as file:
                    numbers = np.frombuffer(file.read_at(8 * count, 8 * begin), "<i8")
            else:
                numbers = np.arange(first_frame(path) + begin, first_frame(path) + begin + count, dtype="<i8")
            with system.open_input_file(root) as file:
                for at in range(0, count, step):
                    k = min(step, count - at)
                    data = file.read_at(k * self.frame_bytes, (begin + at) * self.frame_bytes)
                    if len(data) != k * self.frame_bytes:
                        raise OSError(f"{path}: short read at frame {begin + at}")
                    values = pa.array(np.frombuffer(data, dtype="<i2"), type=pa.int16())
                    offsets = pa.array(np.arange(k + 1, dtype="int32") * n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * k, type=pa.string()), pa.array(numbers[at : at + k]), pa.ListArray.from_arrays(offsets, values)],
                        names=["path", "frame_id", "samples"],
                    )


class RawFrameStream(DataSourceStreamReader):
    """Files that grow while they are captured: a batch brings the whole frames that each has got since the last one.

    The offset holds the number of frames read of each file, so it is as long as the folder has files.
    """

    def __init__(self, options: dict[str, str]):
        self.reader = RawFrameReader(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {path: size // self.reader.frame_bytes for path, size in files_below(self.reader.paths, self.reader.suffix)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        per_task = max(1, TASK_BYTES // self.reader.frame_bytes)
        return self.reader.tasks([
            (path, first, min(per_task, end[path] - first), False) for path in sorted(end) for first in range(start.get(path, 0), end[path], per_task)
        ])

    def read(self, partition: FrameRanges):  # type: ignore[override]
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class WrittenFiles(WriterCommitMessage):
    """Files of one task: name while written, index entry."""

    files: list[tuple[str, dict]]


class RawFrameWriter(DataSourceArrowWriter):
    """Writes ordered ``capture_id, part, frame_id, codes``: one file for each (capture, part)."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, iterator) -> WrittenFiles:  # type: ignore[no-untyped-def]
        import numpy as np

        system, root = self._place()
        system.create_dir(root, recursive=True)
        done: list[tuple[str, dict]] = []
        key, out, own, numbers = None, None, "", []

        def close() -> None:
            if out is None:
                return
            out.close()
            frames = np.concatenate(numbers).astype("<i8")
            gaps = bool((np.diff(frames) != 1).any())
            if gaps:
                with system.open_output_stream(f"{own}.numbers") as beside:
                    beside.write(frames.tobytes())
            name = f"capture={key[0]}-first={key[1]:012d}.raw"
            done.append((own, {"file": name, "capture_id": key[0], "first_frame": int(frames[0]), "last_frame": int(frames[-1]), "n_frames": len(frames), "gaps": gaps}))

        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                captures, parts, frames = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("capture_id", "part", "frame_id"))
                codes = batch.column(batch.schema.get_field_index("codes"))
                edges = codes.offsets.to_numpy()
                flat = codes.values.to_numpy(zero_copy_only=False).astype("<i2", copy=False)
                cuts = np.flatnonzero((captures[1:] != captures[:-1]) | (parts[1:] != parts[:-1])) + 1
                for first, last in zip([0, *cuts], [*cuts, len(frames)], strict=True):
                    found = (int(captures[first]), int(parts[first]))
                    if key is None or found != (key[0], key[2]):
                        close()
                        key, own, numbers = (found[0], int(frames[first]), found[1]), f"{root}/_{uuid.uuid4().hex}.tmp", []
                        out = system.open_output_stream(own)
                    out.write(flat[edges[first] : edges[last]].tobytes())
                    numbers.append(frames[first:last].copy())
            close()
        except BaseException:
            if out is not None:
                out.close()
            self._remove([*(name for name, _ in done), own])
            raise
        return WrittenFiles(done)

    def _remove(self, names: Sequence[str]) -> None:
        from pyarrow import fs

        system, _ = self._place()
        for name in (x for own in names if own for x in (own, f"{own}.numbers")):
            if system.get_file_info(name).type == fs.FileType.File:
                system.delete_file(name)

    def commit(self, messages: list[WrittenFiles | None]) -> None:  # type: ignore[override]
        """Name all files and enter them in the index; files of the same names are replaced."""
        from pyarrow import fs

        system, root = self._place()
        index = read_index(self.folder)

        def move(own: str, final: str) -> None:
            if system.get_file_info(final).type == fs.FileType.File:
                system.delete_file(final)
            system.move(own, final)

        for own, entry in (f for m in messages if m for f in m.files):
            if entry["gaps"]:
                move(f"{own}.numbers", f"{root}/{NUMBERS}{entry['file']}")
            move(own, f"{root}/{entry['file']}")
            index[entry["file"]] = entry
        whole = f"{root}/_{uuid.uuid4().hex}.index"
        system.create_dir(root, recursive=True)
        with system.open_output_stream(whole) as out:
            out.write(json.dumps([index[name] for name in sorted(index)]).encode())
        move(whole, f"{root}/{INDEX}")

    def abort(self, messages: list[WrittenFiles | None]) -> None:  # type: ignore[override]
        self._remove([own for m in messages if m for own, _ in m.files])


class FilteredRawFrameReader(RawFrameReader):
    """The reader for sessions that push filters to Python sources."""

    def pushFilters(self, filters):  # type: ignore[no-untyped-def]  # noqa: N802
        """All filters are also left to Spark; here they only narrow what is read."""
        for f in filters:
            name, value = getattr(f, "attribute", (None,))[-1], getattr(f, "value", None)
            if name == "path" and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.only = wanted if self.only is None else self.only & wanted
            elif name == "frame_id" and value is not None:
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high = min(self.high, value + (not isinstance(f, LessThan)))
            yield f


class RawFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RawFrameReader:  # type: ignore[no-untyped-def]
        options = dict(self.options)
        return (FilteredRawFrameReader if options.get("pushdown") == "true" else RawFrameReader)(options)

    def streamReader(self, schema) -> RawFrameStream:  # type: ignore[no-untyped-def]  # noqa: N802
        return RawFrameStream(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RawFrameWriter:  # type: ignore[no-untyped-def]
        return RawFrameWriter(dict(self.options))


def read_raw_frames(
    spark: SparkSession, paths: str | list[str], standard: str = "PAL", encoding: str = "CVBS_U10_4FSC",
    samples: int | None = None, suffix: str = "",
) -> DataFrame:
    """Frames of raw sample files or folders; ``samples`` overrides the frame size of the standard.

    A file whose name holds ``first=<n>`` starts at that frame. Filters are pushed to the files where the session allows it
    (``spark.sql.python.filterPushdown.enabled``).
    """
    spark.dataSource.register(RawFrames)
    reader = spark.read.format("raw_frames").option("standard", standard).option("encoding", encoding).option("suffix", suffix)
    reader = reader.option("pushdown", str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower())
    if samples is not None:
        reader = reader.option("frameSamples", str(samples))
    named = [paths] if isinstance(paths, str) else paths
    return reader.option("path", ",".join(qualified(spark, p) for p in named)).load()


def stream_raw_frames(
    spark: SparkSession, folder: str, standard: str = "PAL", encoding: str = "CVBS_U10_4FSC", samples: int | None = None, suffix: str = "",
) -> DataFrame:
    """A stream of the whole frames of files that are still being captured: ``path, frame_id, samples``."""
    spark.dataSource.register(RawFrames)
    reader = spark.readStream.format("raw_frames").option("standard", standard).option("encoding", encoding).option("suffix", suffix)
    if samples is not None:
        reader = reader.option("frameSamples", str(samples))
    return reader.option("path", qualified(spark, folder)).load()


def write_raw_frames(frames: DataFrame, folder: str, per_file: int = 4096) -> DataFrame:
    """Write (capture_id, frame_id, codes) as raw files, one for each ``per_file`` frame numbers of a capture that has any.

    Rows of one file meet in one task in frame order; a capture of any length becomes many files, so no
    task holds a whole capture. Gaps stay within a file. Files count only when all tasks have ended; a failed attempt leaves none. Returns the
    folder's index, one row per file: ``capture_id, first_frame, n_frames, gaps``.
    """
    from pyspark.sql import functions as F

    spark = frames.sparkSession
    spark.dataSource.register(RawFrames)
    folder = qualified(spark, folder)
    parts = frames.select(
        F.col("capture_id").cast("bigint").alias("capture_id"), F.floor(F.col("frame_id") / per_file).alias("part"), F.col("frame_id").cast("bigint").alias("frame_id"),
        F.col("codes").cast("array<smallint>").alias("codes"),
    )
    ordered = parts.repartition("capture_id", "part").sortWithinPartitions("capture_id", "part", "frame_id")
    ordered.write.format("raw_frames").mode("append").option("path", folder).save()
    rows = [(e["capture_id"], e["first_frame"], e["n_frames"], e["gaps"]) for e in read_index(folder).values()]
    return spark.createDataFrame(rows, "capture_id bigint, first_frame bigint, n_frames bigint, gaps boolean")
